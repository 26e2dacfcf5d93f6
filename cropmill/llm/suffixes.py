"""Removal of long repeated byte strings, by a distributed merge sort of sparse suffixes.

A string of ``span`` bytes is removed where it stands if it also starts anywhere else. Each span-byte window owns one anchor: the place
of its smallest hash of ``GRAM`` bytes. Equal windows have equal anchors at equal offsets, so only the suffixes at anchors are sorted,
and of these only those whose gram stands more than once.

A task sorts its suffixes, front-codes the run (length of the prefix shared with the one before, and the rest) and exchanges its parts by
ranges of gram hashes. The receiving task merges the runs with a loser tree that remembers each contender's common prefix with the last
winner and compares from there on only. Neighbours in the merged order, and the bytes before the anchors, tell which windows of an anchor
are repeated. Suffixes that are equal as far as they matter are exchanged once a task. Grams that stand very often are not sorted in one
place: the hashes of their windows are exchanged instead, each once a task, over all tasks.

Documents are known by two hashes of their text, so copies share one result. No stage holds more than a bounded part of the corpus.
"""

from __future__ import annotations

import hashlib
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cropmill.llm.passages import repeated_passages
from cropmill.llm.wordhash import FOLD, POWERS, mix, prefix_sums
from cropmill.storage import settle, small_batches

#: Bytes of an anchor's gram.
GRAM = 100
#: Bytes hashed at once.
CHUNK = 1 << 18
#: A gram that stands more often than this is hot.
HOT = 256
#: Blocks up to this many distinct suffixes are solved pair by pair.
FEW = 16


def anchors_of(data: bytes, starts: np.ndarray, sizes: np.ndarray, span: int) -> tuple[np.ndarray, ...]:
    """Anchors of several texts joined in ``data``: text number, place in the text, largest and smallest offset of its windows, gram hash.

    A window that starts at p owns the leftmost smallest gram within it; its offset is that gram's place less p.
    """
    w = span - GRAM + 1
    none = tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.int64, np.uint64))
    if len(data) < span:
        return none
    body = np.frombuffer(data, np.uint8)
    sums = prefix_sums(body)
    n = len(body) - GRAM + 1
    grams = mix((sums[GRAM:] - sums[:-GRAM]) * POWERS.down[:n])
    low = np.uint64(max(20, int(n).bit_length()))
    keys = ((grams >> low) << low) | np.arange(n, dtype=np.uint64)
    full = -(-n // w) * w
    keys = np.concatenate([keys, np.full(full - n, np.iinfo(np.uint64).max)]).reshape(-1, w)
    ahead = np.minimum.accumulate(keys, axis=1).ravel()
    behind = np.minimum.accumulate(keys[:, ::-1], axis=1)[:, ::-1].ravel()
    windows = len(body) - span + 1
    best = np.minimum(behind[:windows], ahead[w - 1 : w - 1 + windows]) & ((np.uint64(1) << low) - np.uint64(1))
    text = np.repeat(np.arange(len(starts)), sizes)[:windows]
    p = np.flatnonzero(np.arange(windows) + span <= (starts + sizes)[text])
    if not len(p):
        return none
    best = best[p].astype(np.int64)
    cut = np.flatnonzero(np.concatenate(([True], (best[1:] != best[:-1]) | (p[1:] != p[:-1] + 1))))
    last = np.append(cut[1:], len(p)) - 1
    at, who = best[cut], text[p[cut]]
    # Smallest hashes are small numbers; mixed again they fill the range that runs are cut by.
    return who, at - starts[who], at - p[cut], at - p[last], mix(grams[at] * np.uint64(0x9E3779B97F4A7C15))


def anchors(docs: DataFrame, span: int) -> DataFrame:
    """``(gram, k1, k2, at)`` of the anchors of each text of ``(k1, k2, body)``; a text that a task meets again is passed over.

    ``at`` is the place in the text, times 2**20, and the two offsets, ten bits each.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, int]] = set()
        keys, parts, places, size = [], [], [], 0

        def out() -> Iterator[pa.RecordBatch]:
            sizes = np.array([len(x) for x in parts], np.int64)
            starts = np.cumsum(sizes) - sizes
            who, at, most, least, grams = anchors_of(b"".join(parts), starts, sizes, span)
            own = np.array(keys, np.int64).reshape(-1, 2)[who]
            at = at + np.array(places, np.int64)[who]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (grams.view(np.int64), own[:, 0].copy(), own[:, 1].copy(), (at << 20) | (most << 10) | least)], names=["gram", "k1", "k2", "at"])

        for batch in batches:
            for k1, k2, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                if (k1, k2) in seen:
                    continue
                seen.add((k1, k2))
                body = body.as_py()
                # A long text is cut into pieces that overlap, so that each window lies in one piece.
                for s in range(0, len(body) - span + 1, 8 * CHUNK):
                    piece = body[s : s + 8 * CHUNK + span - 1]
                    if size and size + len(piece) > CHUNK:
                        yield from out()
                        keys, parts, places, size = [], [], [], 0
                    keys.append((k1, k2))
                    parts.append(piece)
                    places.append(s)
                    size += len(piece)
        if parts:
            yield from out()

    return docs.select("k1", "k2", "body").mapInArrow(run, "gram long, k1 long, k2 long, at long")


def common_prefix(a: bytes, b: bytes, i: int) -> int:
    """Length of the common prefix of two strings that are known to share ``i`` bytes."""
    n = min(len(a), len(b))
    if a[i:n] == b[i:n]:
        return n
    step = 32
    while a[i : i + step] == b[i : i + step]:
        i += step
    while step > 1:
        step //= 2
        if a[i : i + step] == b[i : i + step]:
            i += step
    return i


def front_coded(strings: list[bytes]) -> tuple[bytes, bytes, bytes]:
    """Shared-prefix lengths, lengths of the rests, and the rests of sorted strings."""
    shared, rests, before = [], [], b""
    for s in strings:
        h = common_prefix(before, s, 0) if before else 0
        shared.append(h)
        rests.append(s[h:])
        before = s
    return np.array(shared, np.uint16).tobytes(), np.array([len(x) for x in rests], np.uint16).tobytes(), b"".join(rests)


def decoded(run: tuple[bytes, bytes, bytes]) -> Iterator[tuple[bytes, int]]:
    """The strings of a front-coded run, each with the length of the prefix shared with the one before."""
    at, s = 0, b""
    for h, n in zip(np.frombuffer(run[0], np.uint16).tolist(), np.frombuffer(run[1], np.uint16).tolist(), strict=True):
        s = s[:h] + run[2][at : at + n]
        at += n
        yield s, h


def merge(runs: list[Iterator[tuple[bytes, int]]]) -> Iterator[tuple[bytes, int, int]]:
    """Merge sorted runs of (string, prefix shared with the one before): (string, prefix shared with the last output, run).

    A loser tree. Every contender carries the length of its common prefix with the last output. The longer one wins without a look at
    the strings; at a tie the strings are compared after that prefix, and the loser keeps its common prefix with the winner.
    """
    k = 1 << max(0, (len(runs) - 1).bit_length())
    head: list[bytes | None] = [None] * k
    shared = [0] * k
    for i, r in enumerate(runs):
        head[i] = next(r, (None, 0))[0]
    loser = [0] * k

    def play(a: int, b: int) -> tuple[int, int]:
        """Winner and loser."""
        x, y = head[a], head[b]
        if x is None or y is None:
            return (b, a) if x is None else (a, b)
        ha, hb = shared[a], shared[b]
        if ha != hb:
            return (a, b) if ha > hb else (b, a)
        h = common_prefix(x, y, ha)
        first = h == len(x) or (h < len(y) and x[h] < y[h])
        if len(x) == len(y) == h:
            first = a < b
        win, lose = (a, b) if first else (b, a)
        shared[lose] = h
        return win, lose

    def build(node: int) -> int:
        if node >= k:
            return node - k
        win, loser[node] = play(build(2 * node), build(2 * node + 1))
        return win

    win = build(1) if k > 1 else 0
    while head[win] is not None:
        yield head[win], shared[win], win
        head[win], shared[win] = next(runs[win], (None, 0))
        node = (win + k) // 2
        while node:
            win, loser[node] = play(win, loser[node])
            node //= 2


class Block:
    """The merged suffixes of one gram: distinct contents in order."""

    def __init__(self, span: int) -> None:
        self.rest = span - GRAM  # bytes after a gram that its windows reach
        self.clear()

    def clear(self) -> None:
        self.right: list[bytes] = []
        self.left: list[bytes] = []
        self.shared: list[int] = []  # of the bytes after the gram, with the content before
        self.whole: list[bool] = []  # stands more than once
        self.who: list[list[tuple[int, int, int]]] = []  # members whose windows are not yet reported

    def add(self, right: bytes, left: bytes, same: bool, shared: int, many: bool, member: tuple[int, int, int]) -> None:
        if same:
            self.whole[-1] = True
        else:
            self.right.append(right)
            self.left.append(left)
            self.shared.append(min(shared, len(right), len(self.right[-2])) if len(self.right) > 1 else 0)
            self.whole.append(many)
            self.who.append([])
        if not many:
            self.who[-1].append(member)

    def solve(self) -> Iterator[tuple[int, int, int, int]]:
        """(k1, k2, first, last) of repeated window starts."""
        m, rest = len(self.right), self.rest
        open_: dict[int, set[int]] = {}
        reach = FEW if m <= FEW else 4
        for i in range(m):
            if not self.who[i]:
                continue
            k1, k2, at = self.who[i][0]
            place, most, least = at >> 20, at >> 10 & 1023, at & 1023
            if self.whole[i]:
                for k1, k2, at in self.who[i]:
                    yield k1, k2, (at >> 20) - most, (at >> 20) - least
                continue
            found: set[int] = set()
            for step in (-1, 1):
                h, j = rest, i
                for _ in range(reach):
                    j += step
                    if not 0 <= j < m:
                        break
                    h = min(h, self.shared[max(j, j - step)])
                    if rest - h > most:
                        break
                    found.update(range(max(least, rest - h), min(most, common_prefix(self.left[i], self.left[j], 0)) + 1))
                if len(found) == most - least + 1:
                    break
            for a, b in ranges(sorted(found)):
                yield k1, k2, place - b, place - a
            if m > FEW and len(found) <= most - least:
                open_[i] = set(range(least, most + 1)) - found
        if open_:
            need = set().union(*open_.values())
            seen: dict[tuple[int, bytes], int] = {}
            mine: dict[int, list[tuple[int, bytes]]] = {}
            for j in range(m):
                for o in need if j not in open_ else need | open_[j]:
                    if o <= len(self.left[j]) and rest - o <= len(self.right[j]):
                        key = (o, xxhash.xxh3_128_digest(self.left[j][:o] + self.right[j][: rest - o]))
                        seen[key] = seen.get(key, 0) + 1
                        if j in open_ and o in open_[j]:
                            mine.setdefault(j, []).append(key)
            for j, keys in mine.items():
                k1, k2, at = self.who[j][0]
                for a, b in ranges(sorted(o for o, d in keys if seen[o, d] > 1)):
                    yield k1, k2, (at >> 20) - b, (at >> 20) - a


def ranges(values: list[int]) -> Iterator[tuple[int, int]]:
    """Maximal runs of ascending integers: first, last."""
    first = last = None
    for v in values:
        if last is not None and v == last + 1:
            last = v
            continue
        if last is not None:
            yield first, last
        first = last = v
    if last is not None:
        yield first, last


def joined_ranges(rows: np.ndarray) -> np.ndarray:
    """Rows of (k1, k2, first, last), those of a text that overlap or touch joined."""
    if len(rows) < 2:
        return rows
    rows = rows[np.lexsort((rows[:, 3], rows[:, 2], rows[:, 1], rows[:, 0]))]
    # Texts are set apart by more than their places span, so that one running maximum serves all.
    text = np.concatenate(([0], np.cumsum((rows[1:, :2] != rows[:-1, :2]).any(axis=1))))
    apart = text * (int(rows[:, 3].max()) + 2)
    reach = np.maximum.accumulate(rows[:, 3] + apart)
    first = np.flatnonzero(np.concatenate(([True], (rows[1:, 2] + apart[1:] > reach[:-1] + 1) | (text[1:] != text[:-1]))))
    out = rows[first].copy()
    last = np.append(first[1:], len(rows)) - 1
    out[:, 3] = reach[last] - apart[last]
    return out


def _runs(joined: DataFrame, parts: int, span: int) -> DataFrame:
    """(part, blob) from rows of (k1, k2, body, found): ``found`` lists (gram, at, hot) of a text's repeated grams."""
    schema = "part long, blob binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple[bytes, int, tuple[int, int, int]]] = []
        digests: list[bytes] = []  # of the windows of hot grams
        windows: list[np.ndarray] = []  # their texts and places
        size = 0

        def out() -> Iterator[pa.RecordBatch]:
            rows.sort(key=lambda r: r[0])
            cut: dict[int, list] = {}
            last = None
            for s, r, who in rows:
                kept = cut.setdefault(int.from_bytes(s[:8], "big") * parts >> 64, [])
                if s == last:
                    kept[-1][2].append(who)
                else:
                    kept.append((s, r, [who]))
                    last = s
            done = [np.array([(k1, k2, (at >> 20) - (at >> 10 & 1023), (at >> 20) - (at & 1023)) for kept in cut.values() for _, _, who in kept if len(who) > 1 for k1, k2, at in who], np.int64).reshape(-1, 4)]
            yield from sent({part: pickle.dumps((front_coded([s for s, _, _ in kept]), np.array([[len(who) > 1, r, *who[0]] for _, r, who in kept], np.int64).tobytes()), 5) for part, kept in cut.items()})
            if digests:
                d, at = np.frombuffer(b"".join(digests), np.uint64).reshape(-1, 2), np.concatenate(windows)
                order = np.lexsort((d[:, 1], d[:, 0]))
                d, at = d[order], at[order]
                first = np.flatnonzero(np.concatenate(([True], (d[1:] != d[:-1]).any(axis=1))))
                times = np.diff(np.append(first, len(d)))
                again = np.repeat(times > 1, times)
                done.append(at[again][:, [0, 1, 2, 2]])
                meta = np.concatenate([(times > 1)[:, None].astype(np.int64), at[first]], axis=1)
                d = d[first]
                yield from sent({parts + p: pickle.dumps((d[i].tobytes(), meta[i].tobytes()), 5) for p, i in dealt(d[:, 0])})
            done = joined_ranges(np.concatenate(done))
            yield from sent({2 * parts + p: done[i].tobytes() for p, i in dealt(mix(done[:, 0].view(np.uint64)))})

        def dealt(hashes: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
            """Row numbers by range of hashes."""
            part = ((hashes >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)
            order = np.argsort(part, kind="stable")
            for i in np.split(order, np.flatnonzero(np.diff(part[order])) + 1) if len(order) else ():
                yield int(part[i[0]]), i

        def sent(blobs: dict[int, bytes]) -> Iterator[pa.RecordBatch]:
            if blobs:
                yield pa.RecordBatch.from_arrays([pa.array(list(blobs), pa.int64()), pa.array(list(blobs.values()), pa.binary())], names=["part", "blob"])

        for batch in batches:
            for k1, k2, body, found in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), batch.column(3).to_pylist(), strict=True):
                body = body.as_py()
                for at, (gram, is_hot) in {x["at"]: (x["gram"], x["hot"]) for x in found}.items():
                    place, most, least = at >> 20, at >> 10 & 1023, at & 1023
                    if is_hot:
                        p = np.arange(place - most, place - least + 1)
                        digests.append(b"".join([xxhash.xxh3_128_digest(body[x : x + span]) for x in p.tolist()]))
                        windows.append(np.stack([np.full(len(p), k1), np.full(len(p), k2), p], axis=1))
                        size += 64 * len(p)
                        continue
                    right = body[place + GRAM : place + span - least]
                    s = b"".join(((gram & 0xFFFFFFFFFFFFFFFF).to_bytes(8, "big"), right, b"\xff", body[place - most : place][::-1]))
                    rows.append((s, len(right), (k1, k2, at)))
                    size += len(s) + 200
                if size > 64 << 20:  # a run is bounded; one task may send several
                    yield from out()
                    rows, digests, windows, size = [], [], [], 0
        yield from out()

    return joined.select("k1", "k2", "body", "found").mapInArrow(run, schema)


def _merged(runs: DataFrame, parts: int, span: int) -> DataFrame:
    """(k1, k2, first, last): repeated window starts of texts, from the runs of each part."""

    def solve(part: int, blobs: list[bytes]) -> Iterator[np.ndarray]:
        if part >= 2 * parts:
            yield joined_ranges(np.concatenate([np.frombuffer(b, np.int64).reshape(-1, 4) for b in blobs]))
            return
        loaded = [pickle.loads(b) for b in blobs]  # written by ``_runs`` of this job
        if part >= parts:
            digests = np.concatenate([np.frombuffer(x[0], np.uint64).reshape(-1, 2) for x in loaded])
            meta = np.concatenate([np.frombuffer(x[1], np.int64).reshape(-1, 4) for x in loaded])
            _, group, times = np.unique(digests, axis=0, return_inverse=True, return_counts=True)
            again = (times[group.ravel()] > 1) & (meta[:, 0] == 0)
            # A digest that one task has met twice is reported there, but may meet a single one of another task here.
            yield joined_ranges(meta[again][:, [1, 2, 3, 3]])
            return
        metas = [np.frombuffer(x[1], np.int64).reshape(-1, 5).tolist() for x in loaded]
        place = [0] * len(loaded)
        block, gram, last, found = Block(span), None, None, []
        for s, shared, r in merge([decoded(x[0]) for x in loaded]):
            many, size, k1, k2, at = metas[r][place[r]]
            place[r] += 1
            if s[:8] != gram:
                found += block.solve()
                block.clear()
                gram = s[:8]
            block.add(s[8 : 8 + size], s[9 + size :], s == last, shared - 8, bool(many), (k1, k2, at))
            last = s
            if len(found) > 50_000:
                yield joined_ranges(np.array(found, np.int64))
                found = []
        found += block.solve()
        yield joined_ranges(np.array(found, np.int64).reshape(-1, 4))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, blobs = None, []

        def out() -> Iterator[pa.RecordBatch]:
            for x in solve(part, blobs) if blobs else ():
                if len(x):
                    yield pa.RecordBatch.from_arrays([pa.array(x[:, c].copy()) for c in range(4)], names=["k1", "k2", "first", "last"])

        for batch in batches:
            for p, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if p != part:
                    yield from out()
                    part, blobs = p, []
                blobs.append(b)
        yield from out()

    return runs.repartition(2 * parts, "part").sortWithinPartitions("part").mapInArrow(run, "k1 long, k2 long, first long, last long")


def repeated_starts(texts: DataFrame, span: int = 400) -> DataFrame:
    """``(k1, k2, first, last)``: ranges of places at which strings of ``span`` bytes start that start elsewhere too.

    ``texts`` has ``k1``, ``k2`` (hashes of the text) and ``body``. Ranges may overlap. Of texts that one task meets twice the
    ranges may be missing: such texts are repeated as wholes, which the caller sees from their number.
    """
    rows = texts.where(F.octet_length("body") >= span)
    own = anchors(rows, span)
    # Written first, so that the join meets plain exchanges, whose large partitions Spark can split.
    counts = settle(own.groupBy("gram").agg(F.count("*").alias("n")).where("n > 1"), "grams")
    found = settle(own.join(counts, "gram").select("gram", "k1", "k2", "at", (F.col("n") > HOT).alias("hot")), "anchors")
    spark = texts.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-found.count() // 40_000))
    lists = found.groupBy("k1", "k2").agg(F.collect_list(F.struct("gram", "at", "hot")).alias("found"))

    def once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, int]] = set()
        for batch in batches:
            keep = []
            for key in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                keep.append(key not in seen)
                seen.add(key)
            yield batch.filter(pa.array(keep))

    single = rows.select("k1", "k2", "body").mapInArrow(once, "k1 long, k2 long, body binary")
    return _merged(_runs(single.join(lists, ["k1", "k2"]), parts, span), parts, span)


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", span: int = 400, passage_words: int = 50) -> DataFrame:
    """One row per document: ``id_col``, ``n_bytes``, ``n_removed``, ``n_spans``, ``kept_sha256``, ``kept`` (bytes, where any are removed), ``spans``, ``n_passage_words``.

    Bytes covered by a string of ``span`` bytes that starts anywhere else too (in any document, this one included) are removed; all
    strings are judged on the input. ``n_passage_words`` counts the words in runs of ``passage_words`` words that another document has too,
    whatever their bytes; they are reported, not removed (0: not counted). ``spans`` is a flat array of start, end of the maximal removed runs. Null texts are empty. Texts
    shorter than ``span`` stay whole. Repeated rows are copies of each other, of equal or null ids too. An empty table gives an empty
    table; other columns are ignored.
    """
    small_batches(docs.sparkSession)
    body = F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary")
    keyed = docs.select(F.col(id_col).alias("id"), body.alias("body")).select("id", "body", F.xxhash64("body").alias("k1"), F.xxhash64(F.lit(1), "body").alias("k2"))
    ranges_ = repeated_starts(keyed, span)
    least = min(span, 2 * passage_words - 1) if passage_words else span
    copies = keyed.where(F.octet_length("body") >= least).groupBy("k1", "k2").agg(F.count("*").alias("n")).where("n > 1").select("k1", "k2", F.lit(0).cast("long").alias("first"), F.lit(-1).cast("long").alias("last"))
    mark = F.struct("first", "last")
    marks = ranges_.unionByName(copies).groupBy("k1", "k2").agg(F.collect_set(mark).alias("marks"), F.min("last").alias("least"))
    # A repeated text needs no ranges: all of it goes, and its rows may be many.
    marks = settle(marks.select("k1", "k2", F.when(F.col("least") < 0, F.array(F.struct(F.lit(0).cast("long").alias("first"), F.lit(-1).cast("long").alias("last")))).otherwise(F.col("marks")).alias("marks")), "marks")
    if passage_words:
        passages = repeated_passages(keyed, passage_words)
        marks = marks.join(passages, ["k1", "k2"], "full")
    else:
        marks = marks.withColumn("n_passage_words", F.lit(0).cast("long"))
    kind = docs.schema[id_col].dataType

    # Of a text that its task has met before, all is removed; its bytes need not be moved.
    def light(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, int]] = set()
        for batch in batches:
            bodies, sizes, digests, words = [], [], [], []
            for k1, k2, x in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), batch.column(1), strict=True):
                x = x.as_py()
                sizes.append(len(x))
                short = len(x) < span
                digests.append(hashlib.sha256(x).hexdigest())
                words.append(len(x.translate(FOLD).split()) if passage_words else 0)
                bodies.append(None if short or (k1, k2) in seen else x)
                if not short:
                    seen.add((k1, k2))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(bodies, pa.binary()), batch.column(2), batch.column(3), pa.array(sizes, pa.int64()), pa.array(digests), pa.array(words, pa.int64())], names=["id", "body", "k1", "k2", "size", "digest", "words"])

    rows = keyed.mapInArrow(light, T.StructType([T.StructField("id", kind), T.StructField("body", T.BinaryType()), T.StructField("k1", T.LongType()), T.StructField("k2", T.LongType()), T.StructField("size", T.LongType()), T.StructField("digest", T.StringType()), T.StructField("words", T.LongType())]))
    joined = rows.join(marks, ["k1", "k2"], "left").select("id", "body", "size", "digest", "marks", "words", "n_passage_words")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        empty = hashlib.sha256(b"").hexdigest()
        for batch in batches:
            cols: list[list] = [[] for _ in range(7)]
            for x, size, digest, marks, words, passages in zip(*(batch.column(c) for c in range(1, 7)), strict=True):
                size, marks, words = size.as_py(), marks.as_py(), words.as_py()
                many = bool(marks) and any(m["last"] < 0 for m in marks)
                passages = (words if words >= passage_words else 0) if many else passages.as_py() or 0
                if not marks or size < span:
                    row = (size, 0, 0, digest.as_py(), None, [])
                elif many:
                    row = (size, size, 1, empty, b"", [0, size])
                else:
                    runs: list[list[int]] = []
                    for a, b in sorted((m["first"], m["last"] + span) for m in marks):
                        if runs and a <= runs[-1][1]:
                            runs[-1][1] = max(runs[-1][1], b)
                        else:
                            runs.append([a, b])
                    text, at, kept = x.as_py(), 0, []
                    for a, b in runs:
                        kept.append(text[at:a])
                        at = b
                    kept = b"".join([*kept, text[at:]])
                    row = (size, size - len(kept), len(runs), hashlib.sha256(kept).hexdigest(), kept, [v for r in runs for v in r])
                for c, v in zip(cols, (*row, passages), strict=True):
                    c.append(v)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.list_(pa.int64()), pa.int64()), strict=True))], names=[id_col, "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept", "spans", "n_passage_words"])

    schema = T.StructType([T.StructField(id_col, kind), *(T.StructField(c, T.LongType()) for c in ("n_bytes", "n_removed", "n_spans")), T.StructField("kept_sha256", T.StringType()), T.StructField("kept", T.BinaryType()), T.StructField("spans", T.ArrayType(T.LongType())), T.StructField("n_passage_words", T.LongType())])
    return joined.mapInArrow(cut, schema)
