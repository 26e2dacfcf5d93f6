"""Near copies: one document of each group stays, groups being components over all pairs of similar shingle sets.

Candidates come from two sides. SimHash fingerprints meet under the pigeonring keys of ``simhash`` and give the links of most groups. What
they miss is found by an exact set-similarity join: sets meet under each shingle of their prefixes, rare shingles first, and must pass the
length and positional filters, and a parity bitmap, which tells most unlike sets apart. What is left is checked on whole shingle sets.

Prefixes. A set of n shingles shares all but ``spare`` (a fifth of n at similarity 0.8) with any similar one, so its first ``spare + 1``
shingles in the global order hold one that both share. Within the rare shingles the order is that of their hashes. Where a set has r of
them, r > spare, the chance that its first k are all among those not shared is at most (spare / r) ** k; once that is below 2 ** -64, the
chance that two shingles have equal hashes, a longer prefix finds nothing more. So a long text sends 28 shingles, not a fifth of them.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cropmill.llm.simhash import link_edges
from cropmill.llm.wordhash import gram_hashes, prefix_sums, span_hashes
from cropmill.operators.graph import connected_components
from cropmill.storage import release, settle, small_batches

#: A-Z become a-z, ASCII white space becomes a space, all else stays.
FOLD = bytes(b + 32 if 65 <= b <= 90 else 32 if b in b"\t\n\v\f\r" else b for b in range(256))
#: Bytes hashed at once.
CHUNK = 1 << 18
#: Rows that are sent to every executor at most, of under a hundred bytes each.
MOST_SENT = 500_000
#: Bits of a set's bitmap.
BITS = 1024


def word_hashes(texts: list[bytes]) -> list[np.ndarray]:
    """Hashes of each text's words, in order; words stand between ASCII white space, A-Z count as a-z."""
    out: list[list[np.ndarray]] = [[] for _ in texts]
    owners, parts, size = [], [], 0

    def flush() -> None:
        norm = b" ".join([*parts, b""]).translate(FOLD)
        data = np.frombuffer(norm, np.uint8)
        inside = np.zeros(len(data) + 2, np.int8)
        inside[1:-1] = data != 32
        step = np.diff(inside)
        starts, ends = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
        hashes = span_hashes(prefix_sums(data), starts, ends)
        cuts = np.searchsorted(starts, np.cumsum([len(p) + 1 for p in parts[:-1]], dtype=np.int64))
        for i, own in zip(owners, np.split(hashes, cuts), strict=True):
            out[i].append(own)

    for i, text in enumerate(texts):
        at = 0
        while at < len(text):
            end = at + CHUNK
            while end < len(text) and text[end] not in b" \t\n\v\f\r":  # pieces end between words
                end += 1
            piece = text[at:end]
            if parts and size + len(piece) > CHUNK:
                flush()
                owners, parts, size = [], [], 0
            owners.append(i)
            parts.append(piece)
            size += len(piece)
            at = end
    if parts:
        flush()
    none = np.zeros(0, np.uint64)
    return [x[0] if len(x) == 1 else np.concatenate(x) if x else none for x in out]


def shingle_sets(texts: list[bytes | None], shingle: int) -> list[np.ndarray]:
    """Sorted distinct hashes of each text's word shingles (fewer words: the whole sequence; none: empty)."""
    own = word_hashes([t or b"" for t in texts])
    sizes = np.array([len(w) for w in own], np.int64)
    words = np.concatenate(own) if own else np.zeros(0, np.uint64)
    grams = gram_hashes(words, shingle)
    first = np.cumsum(sizes) - sizes
    return [np.unique(grams[a : a + n - shingle + 1]) if n >= shingle else gram_hashes(w, int(n)) if n else w for a, n, w in zip(first, sizes, own, strict=True)]


def majority(shingles: np.ndarray) -> int:
    """The SimHash of a set of 64-bit hashes."""
    counts = np.unpackbits(shingles.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(shingles)).view(np.uint64)[0])


def least_overlap(a: np.ndarray | Column, b: np.ndarray | Column, similarity: float, ceil=np.ceil) -> np.ndarray | Column:
    """How many members sets of ``a`` and ``b`` members must share for this Jaccard similarity."""
    return ceil((a + b) * (similarity / (1 + similarity)) - 1e-6)


def bitmap(shingles: np.ndarray) -> np.ndarray:
    """For each of ``BITS`` classes of hashes, whether an odd number of members falls into it; as 64-bit words."""
    odd = np.bincount((shingles >> np.uint64(16) & np.uint64(BITS - 1)).astype(np.int64), minlength=BITS) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.uint64)


def may_be_similar(a: np.ndarray, b: np.ndarray, size_a: np.ndarray, size_b: np.ndarray, similarity: float) -> np.ndarray:
    """Whether bitmaps (rows of words) leave it open that sets are similar: they differ in no more bits than the sets do in members."""
    most = size_a + size_b - 2 * least_overlap(size_a, size_b, similarity)
    return np.bitwise_count(a ^ b).sum(axis=1) <= most


def prefix(shingles: np.ndarray, common: np.ndarray, counts: np.ndarray, similarity: float) -> np.ndarray:
    """The first members of a set in the global order, as many as similar sets need to meet.

    The order is by count (``common``: frequent shingles, ascending; all others count as 0), then by hash. Any order is right; this one
    keeps boilerplate out of prefixes.
    """
    n = len(shingles)
    spare = n - math.ceil(similarity * n - 1e-6)
    level = np.zeros(n, np.int64)
    if n and len(common):
        at = np.minimum(np.searchsorted(common, shingles), len(common) - 1)
        level = np.where(common[at] == shingles, counts[at], 0)
    rare = int((level == 0).sum())
    need = spare + 1
    if 0 < spare < rare:
        need = min(need, math.ceil(64 * math.log(2) / math.log(rare / spare)))
    return shingles[np.lexsort((shingles, level))][:need]


def if_small(rows: DataFrame, most: int = MOST_SENT) -> DataFrame:
    """``rows``, to be broadcast if they are ``most`` at most; the join shuffles both sides otherwise."""
    return F.broadcast(rows) if rows.limit(most + 1).count() <= most else rows


def whole_units(batches: Iterator[pa.RecordBatch], keys: int, least: int = 200_000) -> Iterator[list[np.ndarray]]:
    """Columns of rows sorted by their first ``keys`` columns, cut between those values into pieces of ``least`` rows or more."""
    parts, n = [], 0
    for batch in batches:
        parts.append([c.to_numpy(zero_copy_only=False) for c in batch.columns])
        n += batch.num_rows
        if n >= least and any(parts[-1][c][-1] != parts[0][c][0] for c in range(keys)):
            held = [np.concatenate(c) for c in zip(*parts, strict=True)]
            at = int(np.flatnonzero(np.any([held[c] != held[c][-1] for c in range(keys)], axis=0))[-1]) + 1
            yield [c[:at] for c in held]
            parts = [[c[at:] for c in held]]
            n -= at
    if parts:
        yield [np.concatenate(c) for c in zip(*parts, strict=True)]


def all_pairs(cols: list[np.ndarray], similarity: float, most: int = 500_000) -> Iterator[pa.RecordBatch]:
    """Pairs within whole units that may be similar and differ in root.

    Columns: token and the two parts of its rows that meet (p, q), then size, node, place, root, the row's own part, its bitmap. Rows are sorted
    by unit and size. Where p and q differ, only pairs across them count: those within have a unit of their own.
    """
    token, p, q, size, node, at, root, own, bits = cols
    bits = np.frombuffer(b"".join(bits), np.uint64).reshape(-1, BITS // 64)
    n_rows = len(token)
    unit = np.zeros(n_rows, np.int64)
    unit[1:] = np.cumsum((token[1:] != token[:-1]) | (p[1:] != p[:-1]) | (q[1:] != q[:-1]))
    rows, a, b, n = np.arange(n_rows), [], [], 0

    def out() -> pa.RecordBatch:
        both = np.unique(np.sort(np.stack([np.concatenate(a), np.concatenate(b)], axis=1), axis=1), axis=0)
        return pa.RecordBatch.from_arrays([pa.array(both[:, 0].copy()), pa.array(both[:, 1].copy())], names=["a", "b"])

    for d in range(1, n_rows):
        rows = rows[rows < n_rows - d]
        # Sizes ascend: once a row's next is too large, so are all that follow.
        rows = rows[(unit[rows] == unit[rows + d]) & (size[rows] >= least_overlap(size[rows], size[rows + d], similarity))]
        if not len(rows):
            break
        x, y = rows, rows + d
        ok = (root[x] != root[y]) & ((p[x] == q[x]) | (own[x] != own[y])) & (np.minimum(size[x] - at[x], size[y] - at[y]) >= least_overlap(size[x], size[y], similarity))
        x, y = x[ok], y[ok]
        ok = may_be_similar(bits[x], bits[y], size[x], size[y], similarity)
        a.append(node[x[ok]])
        b.append(node[y[ok]])
        n += len(a[-1])
        if n > most:
            yield out()
            a, b, n = [], [], 0
    if n:
        yield out()


def similar(pivot: np.ndarray, others: list[np.ndarray], similarity: float) -> np.ndarray:
    """Which sets have at least this Jaccard similarity with the pivot; none is empty."""
    sizes = np.array([len(s) for s in others])
    data, owner = np.concatenate(others), np.repeat(np.arange(len(others)), sizes)
    spot = np.minimum(np.searchsorted(pivot, data), len(pivot) - 1)
    both = np.bincount(owner[pivot[spot] == data], minlength=len(others))
    return both >= similarity * (sizes + len(pivot) - both) - 1e-9


class NearCopies:
    """The steps of ``deduplicated`` over one table; every step's rows are written to the shared folder."""

    def __init__(self, docs: DataFrame, id_col: str, text_col: str, shingle: int, similarity: float, bits: int, block_rows: int, block_bytes: int, block_pairs: int) -> None:
        small_batches(docs.sparkSession)
        self.shingle, self.similarity, self.bits, self.block_rows, self.block_bytes, self.block_pairs = shingle, similarity, bits, block_rows, block_bytes, block_pairs
        # A row is known by two hashes of all that it holds, whichever task reads it; nulls are told apart by their flags.
        whole = [x for c in docs.columns for x in (F.col(f"`{c}`"), F.col(f"`{c}`").isNull())]
        ident = F.struct(F.col(id_col).isNull().alias("no_id"), F.col(id_col).alias("id"), F.xxhash64(F.lit(1), *whole).alias("ka"), F.xxhash64(F.lit(2), *whole).alias("kb"))
        self.docs = docs.select(F.struct("*").alias("row"), ident.alias("rank"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary").alias("body"))

    def places(self) -> DataFrame:
        """For each row (rank, node, size, fp, bits); and, with null nodes, (token, n): shingles that three or more texts of a batch have."""
        shingle = self.shingle

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            names = ["rank", "node", "size", "fp", "token", "n", "bits"]
            for batch in batches:
                sets = shingle_sets(batch.column(1).to_pylist(), shingle)
                node = np.fromiter((xxhash.xxh3_64_intdigest(s.tobytes()) for s in sets), np.uint64, len(sets)).view(np.int64)
                fp = np.fromiter((majority(s) if len(s) else 0 for s in sets), np.uint64, len(sets)).view(np.int64)
                none = pa.nulls(len(sets), pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(node), pa.array([len(s) for s in sets], pa.int64()), pa.array(fp), none, none, pa.array([bitmap(s).tobytes() for s in sets], pa.binary())], names=names)
                single = np.unique(node, return_index=True)[1]
                token, n = np.unique(np.concatenate([sets[i] for i in single]) if len(single) else np.zeros(0, np.uint64), return_counts=True)
                often = n >= 3
                if often.any():
                    none = pa.nulls(int(often.sum()), pa.int64())
                    yield pa.RecordBatch.from_arrays([pa.nulls(len(none), batch.column(0).type), none, none, none, pa.array(token[often].view(np.int64)), pa.array(n[often]), pa.nulls(len(none), pa.binary())], names=names)

        long = T.LongType()
        schema = T.StructType([T.StructField("rank", self.docs.schema["rank"].dataType), *(T.StructField(c, long) for c in ("node", "size", "fp", "token", "n")), T.StructField("bits", T.BinaryType())])
        return settle(self.docs.select("rank", "body").mapInArrow(run, schema), "places")

    def heads(self, common: np.ndarray, counts: np.ndarray) -> DataFrame:
        """(token, size, node, at) of the prefixes of all texts; a set that a task meets again is passed over."""
        shingle, similarity = self.shingle, self.similarity

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            seen: set[int] = set()
            for batch in batches:
                node, size, own = [], [], []
                for s in shingle_sets(batch.column(0).to_pylist(), shingle):
                    key = xxhash.xxh3_64_intdigest(s.tobytes())
                    if len(s) and key not in seen:
                        seen.add(key)
                        node.append(key)
                        size.append(len(s))
                        own.append(prefix(s, common, counts, similarity))
                if own:
                    n = [len(h) for h in own]
                    cols = (np.concatenate(own).view(np.int64), np.repeat(np.array(size, np.int64), n), np.repeat(np.array(node, np.uint64).view(np.int64), n), np.concatenate([np.arange(x) for x in n]))
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["token", "size", "node", "at"])

        return settle(self.docs.select("body").mapInArrow(run, "token long, size long, node long, at long"), "heads")

    def sets(self, needed: DataFrame) -> DataFrame:
        """(root, p, q, node, shingles): the sets of ``needed`` (root, p, q, node, rank), read from the first row of each node."""
        shingle = self.shingle

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                own = [s.tobytes() for s in shingle_sets(batch.column(4).to_pylist(), shingle)]
                yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(own, pa.binary())], names=["root", "p", "q", "node", "shingles"])

        first = needed.select(F.col("rank.ka").alias("ka"), F.col("rank.kb").alias("kb"), "root", "p", "q", "node")
        rows = self.docs.select(F.col("rank.ka").alias("ka"), F.col("rank.kb").alias("kb"), "body")
        rows = rows.join(if_small(first), ["ka", "kb"]).select("root", "p", "q", "node", "body")
        return rows.mapInArrow(run, "root long, p long, q long, node long, shingles binary")

    def possible(self, pairs: DataFrame, nodes: DataFrame) -> DataFrame:
        """The pairs ``(a, b)`` that sizes and bitmaps allow to be similar."""
        similarity = self.similarity
        for side in ("a", "b"):
            pairs = pairs.join(nodes.select(F.col("node").alias(side), F.col("size").alias(f"size_{side}"), F.col("bits").alias(f"bits_{side}")), side)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                size_a, size_b = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("size_a", "size_b"))
                a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint64).reshape(-1, BITS // 64) for c in ("bits_a", "bits_b"))
                keep = may_be_similar(a, b, size_a, size_b, similarity) & (np.minimum(size_a, size_b) >= least_overlap(size_a, size_b, similarity))
                yield batch.select(["a", "b"]).filter(pa.array(keep))

        return pairs.mapInArrow(run, "a long, b long")

    def links(self, pairs: DataFrame, nodes: DataFrame) -> DataFrame:
        """``(src, dst)``: the distinct pairs ``(a, b)`` of nodes whose sets are similar.

        The nodes of a component of pairs are dealt into blocks; each two blocks with a pair are a unit of work. So a set is sent once
        where its component is one block, else once for each block that it is compared with, and memory is two blocks. Components of many
        pairs have more blocks, so that their checks spread over tasks too.
        """
        similarity = self.similarity
        pairs = settle(self.possible(pairs.distinct(), nodes), "pairs")
        roots = connected_components(pairs, "a", "b")
        homes = roots.join(nodes.select("node", "rank", "size"), "node")
        sums = homes.groupBy("root").agg(F.count("*").alias("rows"), F.sum(8 * F.col("size")).alias("bytes"))
        asked = pairs.join(roots, pairs["a"] == roots["node"]).groupBy("root").agg(F.count("*").alias("pairs"))
        # Of k blocks two share some 2 / k ** 2 of the pairs.
        enough = [F.col("rows") / self.block_rows, F.col("bytes") / self.block_bytes, F.sqrt(2 * F.col("pairs") / self.block_pairs)]
        sums = sums.join(asked, "root").select("root", F.greatest(*[F.ceil(x) for x in enough]).alias("parts"))
        homes = settle(homes.join(sums, "root").select("node", "rank", "root", F.pmod(F.xxhash64("node"), "parts").alias("part")), "homes")
        of_a = homes.select(F.col("node").alias("a"), "root", F.col("part").alias("x"))
        of_b = homes.select(F.col("node").alias("b"), F.col("part").alias("y"))
        dealt = pairs.join(of_a, "a").join(of_b, "b").select("root", F.least("x", "y").alias("p"), F.greatest("x", "y").alias("q"), "a", "b")
        dealt = settle(dealt, "dealt")
        needed = dealt.select("root", "p", "q", F.explode(F.array("a", "b")).alias("node")).distinct()
        needed = settle(needed.join(homes.select("node", "rank"), "node"), "needed")
        rows = self.sets(needed).select("root", "p", "q", F.col("node").alias("a"), F.lit(None).cast("long").alias("b"), "shingles")
        rows = rows.unionByName(dealt.withColumn("shingles", F.lit(None).cast("binary")))
        rows = rows.repartition("root", "p", "q").sortWithinPartitions("root", "p", "q", F.col("b").isNotNull(), "a")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            key, held, pivot, others = None, {}, None, []

            def out() -> Iterator[pa.RecordBatch]:
                if others:
                    near = similar(held[pivot], [held[b] for b in others], similarity)
                    found = np.array(others, np.int64)[near]
                    if len(found):
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(found), pivot, np.int64)), pa.array(found)], names=["src", "dst"])

            for batch in batches:
                for root, p, q, a, b, body in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    if (root, p, q) != key or a != pivot or len(others) >= 1_000:
                        yield from out()
                        pivot, others = a, []
                    if (root, p, q) != key:
                        key, held = (root, p, q), {}
                    if b is None:
                        held[a] = np.frombuffer(body, np.uint64)
                    else:
                        others.append(b)
            yield from out()

        found = settle(rows.mapInArrow(run, "src long, dst long"), "links")
        release(pairs, roots, homes, dealt, needed)
        return found

    def met(self, heads: DataFrame) -> DataFrame:
        """The rows of ``heads`` whose token some other node has too."""
        tokens = heads.groupBy("token").agg(F.min("node").alias("lo"), F.max("node").alias("hi")).where("lo < hi").select("token")
        return settle(heads.join(tokens, "token").distinct(), "met")

    def partners(self, met: DataFrame, *orders: Column | str) -> DataFrame:
        """Pairs of each node with the first node, by each order, of each of its tokens, where they may be similar."""
        row = F.struct("size", "node", "at")
        firsts = met.groupBy("token").agg(*[F.min_by(row, o).alias(f"o{i}") for i, o in enumerate(orders)])
        firsts = firsts.select("token", F.explode(F.array_distinct(F.array(*[f"o{i}" for i in range(len(orders))]))).alias("one"))
        rows = met.join(firsts, "token")
        need = least_overlap(F.col("size"), F.col("one.size"), self.similarity, F.ceil)
        near = rows.where((F.col("node") != F.col("one.node")) & (F.least(F.col("size") - F.col("at"), F.col("one.size") - F.col("one.at")) >= need))
        return near.select(F.least("node", "one.node").alias("a"), F.greatest("node", "one.node").alias("b")).distinct()

    @staticmethod
    def apart(pairs: DataFrame, roots: DataFrame) -> DataFrame:
        """The pairs whose nodes are in different components."""
        of_a, of_b = roots.select(F.col("node").alias("a"), F.col("root").alias("x")), roots.select(F.col("node").alias("b"), F.col("root").alias("y"))
        return pairs.join(of_a, "a", "left").join(of_b, "b", "left").where(F.coalesce("x", "a") != F.coalesce("y", "b")).select("a", "b")

    def by_fingerprint(self, nodes: DataFrame) -> DataFrame:
        """Pairs of nodes whose fingerprints are within ``bits``: enough of them to connect all that are."""
        named = nodes.where("size > 0")
        heads = settle(named.groupBy("fp").agg(F.min("node").alias("head")), "heads")
        equal = named.join(heads, "fp").where("node <> head").select(F.col("head").alias("a"), F.col("node").alias("b"))
        links = link_edges(heads.select("fp"), self.bits)
        of_a, of_b = heads.select(F.col("fp").alias("src"), F.col("head").alias("x")), heads.select(F.col("fp").alias("dst"), F.col("head").alias("y"))
        linked = links.join(of_a, "src").join(of_b, "dst").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
        return equal.unionByName(linked)

    def unlinked(self, met: DataFrame, roots: DataFrame, nodes: DataFrame) -> DataFrame:
        """All pairs under the tokens of ``met`` that may be similar and are in different components so far."""
        similarity = self.similarity
        rest = met.join(roots, "node", "left").select("token", "size", "node", "at", F.coalesce("root", "node").alias("root"))
        split = rest.groupBy("token").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count("*").alias("n")).where("lo < hi")
        parts = F.ceil(F.col("n") / self.block_rows).cast("int")
        rest = rest.join(split.select("token", parts.alias("parts")), "token").withColumn("own", F.pmod(F.xxhash64("node"), "parts").cast("int"))
        # A token of many rows has a unit for each two of its parts; a row goes to those of its own part.
        other = rest.join(nodes.select("node", "bits"), "node").select("*", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other"))
        rows = other.select("token", F.least("own", "other").alias("p"), F.greatest("own", "other").alias("q"), "size", "node", "at", "root", "own", "bits")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for cols in whole_units(batches, 3):
                yield from all_pairs(cols, similarity)

        return rows.repartition("token", "p", "q").sortWithinPartitions("token", "p", "q", "size", "node").mapInArrow(run, "a long, b long")

    def stay(self) -> DataFrame:
        """The rows that stay."""
        places = self.places()
        often = places.where("token is not null").groupBy("token").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "token").limit(50_000).collect()
        token, n = np.array([r.token for r in often], np.int64).view(np.uint64), np.array([r.n for r in often], np.int64)
        order = np.argsort(token)
        known = places.where("node is not null")
        nodes = settle(known.groupBy("node").agg(F.min("rank").alias("rank"), F.max("size").alias("size"), F.max("fp").alias("fp"), F.max("bits").alias("bits"), F.count("*").alias("copies")), "nodes")
        heads = self.heads(token[order], n[order])
        met = self.met(heads)
        release(heads)
        # One partner that the tokens of a group have in common; then some for each token, of any of its nodes and of any of its components
        # alike; at last all pairs that are left.
        found = [self.links(self.by_fingerprint(nodes).unionByName(self.partners(met, F.xxhash64("node"))), nodes)]
        roots = connected_components(found[0])
        by_root = met.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
        orders = [F.struct(F.xxhash64(F.lit(turn), "token", c), F.xxhash64(F.lit(turn), "node")) for turn in range(2) for c in ("node", "root")]
        found.append(self.links(self.apart(self.partners(by_root, *orders), roots), nodes))
        release(roots)
        roots = connected_components(functools.reduce(DataFrame.unionByName, found))
        found.append(self.links(self.unlinked(met, roots, nodes), nodes))
        release(met, roots)
        roots = connected_components(functools.reduce(DataFrame.unionByName, found))
        groups = nodes.join(roots, "node", "left").select("node", "rank", "copies", F.coalesce("root", "node").alias("root"))
        groups = settle(groups.select("node", "copies", "root", "rank"), "members")
        least = settle(groups.groupBy("root").agg(F.min("rank").alias("stays"), F.sum("copies").alias("rows")).where("rows > 1"), "least")
        settled = settle(known.join(groups.join(least, "root").select("node", "stays"), "node").select("rank", "stays"), "ranks")
        # Rows that are equal in all columns have one key; a group of them has one left.
        keys = settled.select(F.col("rank.ka").alias("ka"), F.col("rank.kb").alias("kb"), (F.col("rank") == F.col("stays")).alias("stays"))
        keys = settle(keys.groupBy("ka", "kb").agg(F.max("stays").alias("stays"), F.count("*").alias("n")).where("not stays or n > 1"), "gone")
        release(*found, groups, least, settled, roots, nodes, places)
        rows = self.docs.select("row", F.col("rank.ka").alias("ka"), F.col("rank.kb").alias("kb"))
        out = rows.join(if_small(keys.select("ka", "kb")), ["ka", "kb"], "left_anti").select("row.*")
        again = keys.where("stays").select("ka", "kb")
        if again.limit(1).count():
            out = out.unionByName(rows.join(if_small(again), ["ka", "kb"]).dropDuplicates(["ka", "kb"]).select("row.*"))
        return out


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, similarity: float = 0.8, bits: int = 4, block_rows: int = 1_000, block_bytes: int = 16 << 20, block_pairs: int = 2_000) -> DataFrame:
    """The rows of ``docs`` of which no other row of their group has a smaller id: one document of each group stays.

    Groups are components over all pairs whose word shingles have at least this Jaccard similarity. Rows of equal shingles are one node.
    Fingerprints within ``bits`` bits, and some partners for each token of a prefix, give the first candidates; then all pairs under a
    token that these links leave in different components are candidates. Every link is checked on whole sets, in blocks of ``block_rows``
    and ``block_bytes`` on average, two of which have some ``block_pairs`` pairs; results do not depend on block sizes. Null ids count as larger than any; of rows of equal ids, and of
    equal rows, one stays. Null texts are empty ones, which are copies of each other. An empty table gives an empty table. All columns are
    kept, whatever their names.
    """
    return NearCopies(docs, id_col, text_col, shingle, similarity, bits, block_rows, block_bytes, block_pairs).stay()
