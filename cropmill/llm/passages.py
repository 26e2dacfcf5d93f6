"""Passages of many words that stand in two documents or more, by winnowed anchors.

Each window of ``words`` words owns one anchor, the place of its smallest hash of half as many words, so equal windows have equal anchors.
Anchors that two texts share choose the windows whose hashes are exchanged; a window that two texts have is repeated.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cropmill.llm.arrays import bound
from cropmill.llm.wordhash import Words, gram_hashes, mix
from cropmill.storage import release, settle

#: Bytes of text that are hashed at once, and shared anchors (eight bytes each) that are sent to all tasks at once.
CHUNK, MOST_ANCHORS = 1 << 19, 2_000_000
_BASE = np.uint64(0x9E3779B97F4A7C15)


def least_places(values: np.ndarray, w: int) -> np.ndarray:
    """For each run of ``w`` values the place of the smallest (the leftmost of equal ones, by their upper bits)."""
    n = len(values)
    if n < w:
        return np.zeros(0, np.int64)
    low = np.uint64(max(20, int(n).bit_length()))
    keys = ((values >> low) << low) | np.arange(n, dtype=np.uint64)
    full = -(-n // w) * w
    keys = np.concatenate([keys, np.full(full - n, np.iinfo(np.uint64).max)]).reshape(-1, w)
    ahead = np.minimum.accumulate(keys, axis=1).ravel()
    behind = np.minimum.accumulate(keys[:, ::-1], axis=1)[:, ::-1].ravel()
    best = np.minimum(behind[: n - w + 1], ahead[w - 1 : n])
    return (best & ((np.uint64(1) << low) - np.uint64(1))).astype(np.int64)


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[tuple[int, int]], list[bytes]]]:
    """Keys and texts of about ``CHUNK`` bytes; a text that a task meets again is passed over."""
    seen: set[tuple[int, int]] = set()
    keys, texts, size = [], [], 0
    for batch in batches:
        for k1, k2, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
            if (k1, k2) in seen:
                continue
            seen.add((k1, k2))
            keys.append((k1, k2))
            texts.append(body.as_py())
            size += len(texts[-1])
            if size >= CHUNK:
                yield keys, texts
                keys, texts, size = [], [], 0
    if keys:
        yield keys, texts


def _windows(texts: list[bytes], n: int) -> tuple[Words, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The words of some texts, the grams, and of each window of ``n`` words within a text its start, its text and its anchor."""
    words, half = Words(texts), n // 2
    own = words.hashes
    text = np.repeat(np.arange(len(texts)), np.diff(words.first))
    grams = gram_hashes(own, half)
    anchor = least_places(grams, n - half + 1)
    start = np.flatnonzero(text[: len(anchor)] == text[n - 1 :][: len(anchor)]) if len(anchor) else np.zeros(0, np.int64)
    return words, grams, start, text[start], anchor[start]


def repeated_passages(texts: DataFrame, words: int = 50) -> DataFrame:
    """``(k1, k2, n_passage_words)``: how many words of each text lie in runs of ``words`` words that another text has too.

    ``texts`` has ``k1``, ``k2`` (hashes of the text) and ``body``. Words are runs of letters, digits and bytes beyond ASCII, A-Z as a-z. Texts
    without such runs are left out. Rows of equal text are one text here; the caller knows their number. An empty table gives an empty one.
    """
    rows = texts.where(F.octet_length("body") >= 2 * words - 1).select("k1", "k2", "body")

    def anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, bodies in _chunks(batches):
            _, grams, _, text, anchor = _windows(bodies, words)
            fresh = np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (text[1:] != text[:-1])])[: len(anchor)]
            who = np.array([k for k, _ in keys], np.int64)[text[fresh]]
            yield pa.RecordBatch.from_arrays([pa.array(mix(grams[anchor[fresh]] * _BASE).view(np.int64)), pa.array(who)], names=["gram", "k1"])

    found = rows.mapInArrow(anchors, "gram long, k1 long").groupBy("gram").agg(F.min("k1").alias("lo"), F.max("k1").alias("hi"))
    shared = settle(found.where("lo < hi").select("gram"), "shared-anchors")
    blocks = max(1, -(-shared.count() // MOST_ANCHORS))
    parts = []
    for b in range(blocks):
        part = shared.where(F.pmod(F.xxhash64("gram"), F.lit(blocks)) == b) if blocks > 1 else shared
        known = texts.sparkSession.sparkContext.broadcast(np.sort(part.toArrow().column("gram").to_numpy().view(np.uint64)))

        def windows(batches: Iterator[pa.RecordBatch], known=known) -> Iterator[pa.RecordBatch]:
            some = known.value
            for keys, bodies in _chunks(batches) if len(some) else ():
                own, grams, start, text, anchor = _windows(bodies, words)
                value = mix(grams[anchor] * _BASE)
                hit = some[np.minimum(np.searchsorted(some, value), len(some) - 1)] == value
                start, text = start[hit], text[hit]
                h = np.zeros(len(start), np.uint64)
                for j in range(words):
                    h = h * _BASE + own.hashes[start + j]
                who = np.array(keys, np.int64).reshape(-1, 2)[text]
                yield pa.RecordBatch.from_arrays([pa.array(mix(h).view(np.int64)), pa.array(who[:, 0].copy()), pa.array(who[:, 1].copy()), pa.array(start - own.first[text])], names=["h", "k1", "k2", "at"])

        parts.append(settle(rows.mapInArrow(windows, "h long, k1 long, k2 long, at long"), "passage-windows"))
    held = parts[0]
    for p in parts[1:]:
        held = held.unionByName(p)
    # Written first, so that the join meets plain exchanges, whose large partitions (a window that very many texts have) Spark can split.
    again = settle(held.groupBy("h").agg(F.min("k1").alias("lo"), F.max("k1").alias("hi")).where("lo < hi").select("h"), "repeated-windows")
    places = held.join(again, "h").groupBy("k1", "k2").agg(F.array_sort(F.collect_set("at")).alias("at"))
    # Starts ascend: a window adds the words up to the next one's start, and all of its own if that is beyond.
    covered = bound(F.col("at"), lambda at: F.aggregate(F.transform(at, lambda s, i: F.least(F.lit(words).cast("long"), F.coalesce(F.get(at, i + 1) - s, F.lit(words).cast("long")))), F.lit(0).cast("long"), lambda a, n: a + n))
    out = settle(places.select("k1", "k2", covered.alias("n_passage_words")), "passages")
    release(shared, again, *parts)
    return out
