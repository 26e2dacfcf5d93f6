"""Benchmark decontamination by winnowing.

Of every run of ``window`` words the smallest of its hashes of ``k`` words is kept (Schleimer, Wilkerson and Aiken 2003), on both
sides, so two texts that share ``window`` consecutive words share a kept hash. Kept hashes of documents are looked up among those
of the benchmark, and each hit is extended to the windows around it, which are compared as text. So a text of one repeated word costs no
more than another. Items shorter than the window are looked up as a whole, by their own length.

The benchmark is read in blocks of a bounded size, each broadcast and applied to all documents in turn; documents are neither
shuffled nor collected.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cropmill.llm.wordhash import Words, gram_hashes
from cropmill.storage import small_batches

#: Texts that are hashed together hold about this many bytes.
CHUNK = 1 << 20


def kept(grams: np.ndarray, window_ok: np.ndarray, w: int) -> np.ndarray:
    """Which grams are the smallest of some run of ``w`` grams that starts where ``window_ok`` holds."""
    n = len(window_ok)
    out = np.zeros(len(grams), bool)
    if n:
        least = grams[:n].copy()
        for j in range(1, w):
            np.minimum(least, grams[j : j + n], out=least)
        for j in range(w):
            out[j : j + n] |= (grams[j : j + n] == least) & window_ok
    return out


class Index:
    """Fingerprints and windows of a bounded block of benchmark items. Items of the same words share one entry."""

    def __init__(self, items: list[tuple[object, bytes]], window: int, k: int) -> None:
        self.window, self.k = window, k
        groups: dict[bytes, list] = {}
        own: list[np.ndarray] = []
        for key, text in items:
            words = Words([text])
            canon = words.joined(0, len(words.starts))
            if canon:
                if canon not in groups:
                    own.append(words.hashes)
                groups.setdefault(canon, []).append(key)
        self.canon = list(groups)
        #: Where each entry's words start in it, and one more than its end.
        self.starts = [np.cumsum([0, *(len(w) + 1 for w in c.split(b" "))], dtype=np.int32) for c in groups]
        self.keys = [sorted({str(k) for k in keys if k is not None}) for keys in groups.values()]
        long = [c for c, h in enumerate(own) if len(h) >= window]
        grams = [gram_hashes(own[c], k) for c in long]
        self.grams = self._table(np.concatenate([g[kept(g, np.ones(len(own[c]) - window + 1, bool), window - k + 1)] for c, g in zip(long, grams, strict=True)] or [np.zeros(0, np.uint64)]))
        #: By length of window: its hashes, ascending, and for each the entry and the place in it; an entry has each hash once.
        self.windows = {window: self._places({c: gram_hashes(own[c], window) for c in long})}
        for n in sorted({len(h) for h in own if len(h) < window}):
            self.windows[n] = self._places({c: gram_hashes(h, n) for c, h in enumerate(own) if len(h) == n})
        self.said: dict[tuple[int, bytes], list[int]] = {}

    @staticmethod
    def _table(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        known = np.unique(values)
        low = np.zeros(1 << 16, bool)
        low[(known & np.uint64(0xFFFF)).astype(np.int64)] = True
        return known, low

    @staticmethod
    def _places(hashes: dict[int, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if not hashes:
            return np.zeros(0, np.uint64), np.zeros(0, np.int32), np.zeros(0, np.int32)
        h = np.concatenate(list(hashes.values()))
        entry = np.repeat(np.array(list(hashes), np.int32), [len(x) for x in hashes.values()])
        place = np.concatenate([np.arange(len(x), dtype=np.int32) for x in hashes.values()])
        order = np.lexsort((place, entry, h))
        h, entry, place = h[order], entry[order], place[order]
        first = np.concatenate(([True], (h[1:] != h[:-1]) | (entry[1:] != entry[:-1])))
        return h[first], entry[first], place[first]

    def _fingerprinted(self, grams: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Those of the places ``at`` whose gram is a fingerprint of the block."""
        known, low = self.grams
        at = at[low[(grams[at] & np.uint64(0xFFFF)).astype(np.int64)]]
        if not len(at) or not len(known):
            return at[:0]
        spot = np.minimum(np.searchsorted(known, grams[at]), len(known) - 1)
        return at[known[spot] == grams[at]]

    def _entries(self, n: int, value: int, lo: int, hi: int, said: bytes) -> list[int]:
        """The entries that hold the words ``said`` as a window of ``n`` words, among those of its hash; compared as text, once."""
        if len(self.said) > 100_000:
            self.said = {}
        if (value, said) not in self.said:
            _, entry, place = self.windows[n]
            self.said[value, said] = [c for c, j in zip(entry[lo:hi].tolist(), place[lo:hi].tolist(), strict=True) if self.canon[c][self.starts[c][j] : self.starts[c][j + n] - 1] == said]
        return self.said[value, said]

    def search(self, texts: list[bytes]) -> tuple[list[int], dict[int, list[tuple[int, int]]], dict[int, set[int]]]:
        """The texts' word counts; by text, matched windows of words (may overlap) and the matched entries."""
        words = Words(texts)
        runs: dict[int, list[tuple[int, int]]] = defaultdict(list)
        found: dict[int, set[int]] = defaultdict(set)
        counts = np.diff(words.first)
        text_of = np.repeat(np.arange(len(texts)), counts)
        own, total = words.hashes, len(words.hashes)
        for n, (hashes, _, _) in self.windows.items():
            if total < n or not len(hashes):
                continue
            whole = text_of[: total - n + 1] == text_of[n - 1 :]
            if n == self.window:
                # A shared window holds a kept gram of both sides: the windows around the hits are all that can be shared.
                grams, reach = gram_hashes(own, self.k), n - self.k + 1
                hits = self._fingerprinted(grams, np.flatnonzero(kept(grams, whole, reach)))
                starts = np.unique((hits[:, None] - np.arange(reach)[None, :]).ravel())
                starts = starts[(starts >= 0) & (starts < len(whole))]
                starts = starts[whole[starts]]
            else:
                starts = np.flatnonzero(whole)
            value = gram_hashes(own, n)[starts] if len(starts) else np.zeros(0, np.uint64)
            lo, hi = np.searchsorted(hashes, value, "left"), np.searchsorted(hashes, value, "right")
            for i in np.flatnonzero(lo < hi).tolist():
                at = int(starts[i])
                if entries := self._entries(n, int(value[i]), int(lo[i]), int(hi[i]), words.joined(at, at + n)):
                    t = int(text_of[at])
                    runs[t].append((at - int(words.first[t]), at + n - int(words.first[t])))
                    found[t].update(entries)
        return counts.tolist(), runs, found


def union(runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(runs):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Slices of the batches with about ``CHUNK`` bytes of text each."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column("body")), 0).to_numpy(zero_copy_only=False)
        total = np.cumsum(sizes, dtype=np.int64) // CHUNK
        cuts = [0, *(np.flatnonzero(np.diff(total)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:], strict=False):
            if b > a:
                yield batch.slice(a, b - a)


def matched_runs(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", window: int = 10, k: int = 5, block_bytes: int = 8 << 20) -> DataFrame:
    """One row per document: ``id_col``, ``n_words``, ``runs`` (flat array of start, end word numbers, disjoint, ascending), ``items`` (matched item ids as strings, distinct, sorted).

    A run is a maximal union of words inside occurrences of windows. Null texts have no words; items without words match
    nothing; items of equal ids count once and an item of null id marks words but is not listed. An empty benchmark leaves every
    document clean. Repeated documents give repeated rows; columns other than the named ones are ignored.
    """
    spark = docs.sparkSession
    small_batches(spark)
    items = items.select(F.col(item_col).cast("string").alias("key"), F.col(item_text).cast("string").cast("binary").alias("body")).where("body is not null")
    size = items.agg(F.sum(F.octet_length("body"))).first()[0] or 0
    blocks = max(1, -(-size // block_bytes))
    kind = docs.schema[id_col].dataType
    schema = T.StructType([T.StructField("id", kind), T.StructField("body", T.BinaryType()), T.StructField("n_words", T.LongType()), T.StructField("runs", T.ArrayType(T.LongType())), T.StructField("items", T.ArrayType(T.StringType()))])
    state = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").cast("binary").alias("body"), F.lit(0).cast("long").alias("n_words"), F.array().cast("array<long>").alias("runs"), F.array().cast("array<string>").alias("items"))
    for b in range(blocks):
        part = items.where(F.pmod(F.xxhash64("body"), F.lit(blocks)) == b) if blocks > 1 else items
        index = spark.sparkContext.broadcast(Index([(r.key, bytes(r.body)) for r in part.toLocalIterator()], window, k))

        def run(batches: Iterator[pa.RecordBatch], index=index, last=b == blocks - 1) -> Iterator[pa.RecordBatch]:
            for batch in _chunks(batches):
                texts = [x or b"" for x in batch.column("body").to_pylist()]
                counts, runs, found = index.value.search(texts)
                old_runs, old_items = batch.column("runs").to_pylist(), batch.column("items").to_pylist()
                for t in runs:
                    spans = union(runs[t] + list(zip(old_runs[t][::2], old_runs[t][1::2], strict=True)))
                    old_runs[t] = [x for s in spans for x in s]
                    old_items[t] = sorted({*old_items[t], *(key for c in found[t] for key in index.value.keys[c])})
                body = pa.nulls(len(texts), pa.binary()) if last else batch.column("body")
                yield pa.RecordBatch.from_arrays([batch.column("id"), body, pa.array(counts, pa.int64()), pa.array(old_runs, pa.list_(pa.int64())), pa.array(old_items, pa.list_(pa.string()))], names=schema.names)

        state = state.mapInArrow(run, schema)
    return state.select(F.col("id").alias(id_col), "n_words", "runs", "items")


def hit_words(runs: str = "runs") -> F.Column:
    """Number of words in a flat array of runs."""
    return F.expr(f"aggregate({runs}, 0L, (a, x) -> x - a)")  # ends less starts, as the signs alternate over an even count
