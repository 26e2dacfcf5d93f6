"""SimHash near-duplicate groups, found with the pigeonring principle.

A fingerprint has 64 bits, cut into ``t + 1`` segments on a ring (``t``: the most differing bits of a link). If two fingerprints
differ in at most ``t`` bits, some start segment has chains of every length ``l`` whose differences sum to at most
``l * t / (t + 1)`` (the strong form of the pigeonring principle, Qin and Xiao 2018): its first segment is equal, its first two
differ in at most one bit, and so on. So fingerprints meet under keys of two consecutive segments, the first exact and the second
exact or with one bit flipped; longer chains prune what meets, and the full Hamming distance decides.

Buckets give, for each component of their links, its first member with each other one, and never all pairs. A bucket of any size is
solved by splitting it on the bits in which its members differ. A task emits a link only if it joins two of the groups that it knows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cropmill.operators.graph import connected_components, least_members
from cropmill.storage import settle, small_batches

#: Buckets up to this size are compared as one matrix.
DENSE = 512
#: Runs up to this length are compared in bulk, offset by offset.
SHORT = 6


def fingerprint(text: bytes | None, shingle: int = 4) -> int:
    """The unsigned fingerprint of one text: majority bits of XXH64 (seed 42) over its word shingles.

    A-Z is lower-cased, words are split at ASCII white space. A text of fewer words than ``shingle`` has one shingle, a text
    without words (or null) the fingerprint 0.
    """
    words = (text or b"").lower().split()
    if not words:
        return 0
    whole = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    k = min(shingle, len(words))
    starts = np.concatenate(([0], ends[:-1] + 1))[: len(words) - k + 1].tolist()
    digest = xxhash.xxh64_digest
    counts, n = np.zeros(64, np.int64), len(starts)
    ends = ends[k - 1 :].tolist()
    for at in range(0, n, 65536):
        hashes = b"".join([digest(whole[s:e], 42) for s, e in zip(starts[at : at + 65536], ends[at : at + 65536], strict=True)])
        counts += np.unpackbits(np.frombuffer(hashes, np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.uint32)
    return int.from_bytes(np.packbits(2 * counts > n).tobytes(), "big")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4) -> DataFrame:
    """``(id_col, fp)``; ``fp`` holds the 64 bits as a signed long."""
    small_batches(docs.sparkSession)
    narrow = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").cast("binary").alias("body"))
    kind = docs.schema[id_col].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bits = np.fromiter((fingerprint(x.as_py(), shingle) for x in batch.column(1)), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(bits.view(np.int64))], names=["id", "fp"])

    out = narrow.mapInArrow(run, T.StructType([T.StructField("id", kind), T.StructField("fp", T.LongType())]))
    return out.withColumnRenamed("id", id_col)


def segments(bits: int) -> list[tuple[int, int]]:
    """``(shift, width)`` of the ``bits + 1`` ring segments of 64 bits."""
    m = bits + 1
    cuts = [round(i * 64 / m) for i in range(m + 1)]
    return [(lo, hi - lo) for lo, hi in zip(cuts, cuts[1:], strict=False)]


def ring_keys(fp: str, bits: int) -> F.Column:
    """The bucket keys of a fingerprint: for each start segment, that segment and the next, as they are and with each bit of the next flipped.

    The lowest bit tells flipped keys from a fingerprint's own; a bucket is what stands above it.
    """
    parts = segments(bits)
    # Beyond 7 bits the 16-bit fields still hold: segments only get narrower as ``bits`` grows.
    keys = []
    for i, (shift, width) in enumerate(parts):
        shift2, width2 = parts[(i + 1) % len(parts)]
        first = F.shiftrightunsigned(F.col(fp), shift).bitwiseAND(F.lit((1 << width) - 1))
        second = F.shiftrightunsigned(F.col(fp), shift2).bitwiseAND(F.lit((1 << width2) - 1))
        own = F.shiftleft(F.lit(i << 48).bitwiseOR(F.shiftleft(first, 24)).bitwiseOR(second), 1)
        keys += [own] + [own.bitwiseXOR(F.lit((2 << b) | 1)) for b in range(width2)]
    return F.array(*keys)


def forest(close: np.ndarray) -> list[tuple[int, int]]:
    """Edges from each component's first member to its others, for a dense boolean adjacency."""
    n = len(close)
    new = np.ones(n, bool)
    edges: list[tuple[int, int]] = []
    for seed in range(n):
        if not new[seed]:
            continue
        new[seed] = False
        queue = [seed]
        while queue:
            at = queue.pop()
            found = np.flatnonzero(close[at] & new)
            new[found] = False
            edges += [(seed, int(x)) for x in found]
            queue += found.tolist()
    return edges


def link_block(fps: np.ndarray, bits: int) -> list[tuple[int, int]]:
    """Pairs of values whose components are those of all links within distinct ``fps``, whatever their number.

    A large block is split by pigeonhole on the bits in which its members differ; where at most ``bits`` bits differ, all are linked.
    """
    n = len(fps)
    if n < 2:
        return []
    if n <= DENSE:
        close = np.bitwise_count(fps[:, None] ^ fps[None, :]) <= bits
        return [(int(fps[a]), int(fps[b])) for a, b in forest(close)]
    differ = int(np.bitwise_or.reduce(fps ^ fps[0]))
    open_bits = [b for b in range(64) if differ >> b & 1]
    if len(open_bits) <= bits:
        return [(int(fps[0]), int(x)) for x in fps[1:]]
    edges = []
    for i in range(bits + 1):
        mask = np.uint64(sum(1 << b for b in open_bits[i :: bits + 1]))
        own = fps & mask
        order = np.argsort(own, kind="stable")
        cut = np.flatnonzero(np.diff(own[order])) + 1
        for part in np.split(order, cut):
            edges += link_block(fps[part], bits)
    return list(set(edges))


def _links(keys: np.ndarray, fps: np.ndarray, bits: int) -> list[np.ndarray]:
    """Links among rows sorted by key, within buckets that hold some fingerprint's own key."""
    parts = segments(bits)
    m = len(parts)
    masks = np.array([[sum(((1 << w) - 1) << s for s, w in (parts[(i + j) % m] for j in range(n))) for i in range(m)] for n in range(1, m + 1)], np.uint64)
    out = []
    bucket = keys >> 1
    start = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1])))
    size = np.diff(np.append(start, len(keys)))
    size[keys[start] & 1 == 1] *= -1  # flipped keys only
    run = np.repeat(np.arange(len(start)), np.abs(size))
    short = np.repeat((size >= 2) & (size <= SHORT), np.abs(size))
    for d in range(1, SHORT):
        if d >= len(keys):
            break
        a = np.flatnonzero(short[:-d] & (run[:-d] == run[d:]))
        x = fps[a] ^ fps[a + d]
        chain = keys[a] >> 49
        ok = (x != 0) & (keys[a] & keys[a + d] & 1 == 0)
        for n in range(2, m):  # chains of two to m-1 segments within their share, then the full check
            ok &= np.bitwise_count(x & masks[n - 1][chain]) <= n * bits // m
        ok &= np.bitwise_count(x) <= bits
        out.append(np.stack([fps[a[ok]], fps[a[ok] + d]], axis=1))
    for i in np.flatnonzero(size > SHORT):
        block = np.unique(fps[start[i] : start[i] + size[i]])
        if edges := link_block(block, bits):
            out.append(np.array(edges, np.uint64))
    return out


class Groups:
    """The groups of linked fingerprints that a task knows so far."""

    def __init__(self) -> None:
        self.parent: dict[int, int] = {}

    def root(self, x: int) -> int:
        parent = self.parent
        top = x
        while (up := parent.get(top, top)) != top:
            top = up
        while x != top:
            parent[x], x = top, parent[x]
        return top

    def joining(self, pairs: np.ndarray) -> np.ndarray:
        """Links from the smallest member of each component of ``pairs`` to others of it, but for those that are in its group already."""
        nodes, place = np.unique(pairs, return_inverse=True)
        place = place.reshape(-1, 2)
        least = least_members(place[:, 0], place[:, 1], len(nodes))
        out = []
        for x, y in zip(nodes.tolist(), nodes[least].tolist(), strict=True):
            a, b = self.root(x), self.root(y)
            if a != b:
                self.parent[max(a, b)] = min(a, b)
                out.append((y, x))
        return np.array(out, np.uint64).reshape(-1, 2)


def link_edges(distinct: DataFrame, bits: int = 4, fp: str = "fp") -> DataFrame:
    """``(src, dst)`` of a table of distinct fingerprints: pairs whose components are those of all links of at most ``bits`` bits."""
    # Dealt out by number first: the few bytes of fingerprints would else be read by one or two tasks, which make 69 times as much of them. (By ``fp``
    # itself Spark would leave the exchange out.)
    parts = int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    probes = distinct.select(fp).repartition(parts, F.xxhash64(fp)).select(F.explode(ring_keys(fp, bits)).alias("key"), F.col(fp).alias("fp"))
    dealt = probes.repartition(F.shiftright("key", 1)).sortWithinPartitions("key")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, fps = np.zeros(0, np.int64), np.zeros(0, np.uint64)

        groups = Groups()

        def out(keys: np.ndarray, fps: np.ndarray) -> Iterator[pa.RecordBatch]:
            found = [x for x in _links(keys, fps, bits) if len(x)] if len(keys) > 1 else []
            if found:
                pairs = groups.joining(np.concatenate(found)).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0].copy()), pa.array(pairs[:, 1].copy())], names=["src", "dst"])

        for batch in batches:
            keys = np.concatenate([keys, batch.column(0).to_numpy(zero_copy_only=False)])
            fps = np.concatenate([fps, batch.column(1).to_numpy(zero_copy_only=False).view(np.uint64)])
            if len(keys) < 200_000:
                continue
            at = int(np.searchsorted(keys, keys[-1] & ~1))  # the last bucket may go on
            yield from out(keys[:at], fps[:at])
            keys, fps = keys[at:], fps[at:]
            if len(keys) > 200_000:  # within one run, repeats need not be kept
                fps = np.unique(fps)
                keys = np.full(len(fps), keys[0])
        yield from out(keys, fps)

    return dealt.mapInArrow(run, "src long, dst long").distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, bits: int = 4) -> DataFrame:
    """One row per document: ``id_col``, ``fingerprint`` (16 hex digits), ``component_id``, ``component_fp``.

    ``component_id`` is the smallest id reachable over links of at most ``bits`` differing bits. Null and empty texts have
    fingerprint 0 and link like any other; repeated ids give repeated rows; null ids take part, but are never a component's
    id unless it has no other (then null). An empty table gives an empty table. Other columns are ignored.
    """
    own = settle(fingerprints(docs, id_col, text_col, shingle), "fingerprints")
    classes = own.groupBy("fp").agg(F.min(id_col).alias("least"))
    roots = connected_components(link_edges(own.select("fp").distinct(), bits))
    linked = classes.join(roots.select(F.col("node").alias("fp"), "root"), "fp")
    least = linked.groupBy("root").agg(F.min("least").alias("component_id"))
    linked = linked.join(least, "root").select("fp", "root", "component_id")
    # Written first, so that the join meets plain exchanges, whose large partitions Spark can split.
    whole = classes.join(linked, "fp", "left").select("fp", F.coalesce("component_id", "least").alias("component_id"), F.coalesce("root", "fp").alias("component_fp"))
    return own.join(settle(whole, "classes"), "fp", "left").select(id_col, F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "component_fp")
