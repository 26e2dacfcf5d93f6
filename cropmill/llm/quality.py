"""A document-quality classifier: histogram gradient-boosted trees over document statistics.

Statistics are computed from the whole text's bytes. Trees are complete binary trees in flat arrays, so a batch of documents goes
down all of them by array indexing. The driver fits on a bounded sample of labelled rows; all documents are scored where they lie.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cropmill.storage import small_batches

#: Names of the statistics, in the order of ``statistics``.
NAMES = ("bytes", "words", "word_bytes", "longest_word", "distinct_words", "commonest_word", "lines", "line_bytes", "distinct_lines", "shortest_line", "stops", "upper", "lower", "digits", "spaces", "newlines", "high_bytes", "controls", "full_stops", "commas", "quotes", "brackets", "pipes", "stars", "hashes", "percents", "dollars", "ampersands", "exclamations", "questions", "colons", "dashes", "slashes", "other_marks", "upper_words", "marked_words")
_SETS = {"upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", "lower": b"abcdefghijklmnopqrstuvwxyz", "digits": b"0123456789", "spaces": b" \t", "newlines": b"\r\n", "high_bytes": bytes(range(128, 256)), "controls": bytes([*range(9), 11, 12, *range(14, 32), 127]), "full_stops": b".", "commas": b",", "quotes": b"\"'`", "brackets": b"()[]{}<>", "pipes": b"|", "stars": b"*", "hashes": b"#", "percents": b"%", "dollars": b"$", "ampersands": b"&", "exclamations": b"!", "questions": b"?", "colons": b":;", "dashes": b"-_", "slashes": b"/\\", "other_marks": b"+=@^~"}
_SUMS = np.zeros((256, len(_SETS)))
for _i, _chars in enumerate(_SETS.values()):
    _SUMS[list(_chars), _i] = 1


def statistics(text: bytes | None) -> np.ndarray:
    """The statistics of one whole text; an empty one has zeros."""
    text = text or b""
    out = np.zeros(len(NAMES), np.float32)
    if not text:
        return out
    n = len(text)
    words, lines = text.split(), text.split(b"\n")
    out[0] = np.log1p(n)
    if words:
        w = len(words)
        sizes = np.fromiter(map(len, words), np.int64, w)
        distinct: dict[bytes, int] = {}
        for x in words:
            distinct[x] = distinct.get(x, 0) + 1
        out[1:6] = np.log1p(w), sizes.mean(), np.log1p(sizes.max()), len(distinct) / w, max(distinct.values()) / w
        caps = marked = 0
        for x, times in distinct.items():
            if x.isupper() and len(x) > 1:
                caps += times
            if not x[-1:].isalnum() and x[-1] < 128 and x[-1] not in b".,;:?)\"'":
                marked += times
        out[34:36] = caps / w, marked / w
    spans = [len(x) for x in lines]
    out[6:11] = np.log1p(len(lines)), np.log1p(np.mean(spans)), len(set(lines)) / len(lines), np.log1p(min(spans)), sum(x.rstrip().endswith((b".", b"?", b"!")) for x in lines) / len(lines)
    out[11:34] = np.bincount(np.frombuffer(text, np.uint8), minlength=256) @ _SUMS / n
    return out


@dataclass
class Forest:
    """Complete trees of one depth: ``feature`` and ``split`` by tree and inner node, ``value`` by tree and leaf."""

    base: float
    feature: np.ndarray
    split: np.ndarray
    value: np.ndarray

    def score(self, x: np.ndarray) -> np.ndarray:
        """Chances of label 1 for rows of statistics."""
        trees, inner = self.feature.shape
        total = np.full(len(x), self.base)
        if trees:
            rows, tree = np.arange(len(x))[:, None], np.arange(trees)[None, :]
            at = np.zeros((len(x), trees), np.int64)
            for _ in range((inner + 1).bit_length() - 1):
                at = 2 * at + 1 + (x[rows, self.feature[tree, at]] > self.split[tree, at])
            total += self.value[tree, at - inner].sum(axis=1)
        return 1 / (1 + np.exp(-np.clip(total, -40, 40)))


def fit(x: np.ndarray, y: np.ndarray, trees: int = 60, depth: int = 4, rate: float = 0.15, bins: int = 64, ridge: float = 1.0, least: float = 5.0) -> Forest:
    """Boost ``trees`` trees on the logistic loss; candidate splits are quantiles of each statistic, ``bins`` at most.

    Without rows the forest answers one half; with one label only, that label's smoothed share.
    """
    inner = (1 << depth) - 1
    n = len(y)
    share = (y.sum() + 0.5) / (n + 1) if n else 0.5
    base = float(np.log(share / (1 - share)))
    none = Forest(base, np.zeros((0, inner), np.int64), np.zeros((0, inner)), np.zeros((0, inner + 1)))
    if n < 2 or y.min() == y.max():
        return none
    cuts = [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1])) for c in x.T]
    code = np.stack([np.searchsorted(c, v, side="left") for c, v in zip(cuts, x.T, strict=True)], axis=1)
    m = x.shape[1]
    offset = np.arange(m) * bins
    feature, split, value = np.zeros((trees, inner), np.int64), np.full((trees, inner), np.inf), np.zeros((trees, inner + 1))
    total = np.full(n, base)
    for t in range(trees):
        p = 1 / (1 + np.exp(-total))
        g, h = y - p, p * (1 - p)
        at = np.zeros(n, np.int64)
        for d in range(depth):
            nodes, first = 1 << d, (1 << d) - 1
            cell = ((at - first)[:, None] * (m * bins) + offset + code).ravel()
            size = nodes * m * bins
            sums = [np.bincount(cell, np.repeat(v, m), size).reshape(nodes, m, bins).cumsum(axis=2) for v in (g, h)]
            gl, hl = (s[:, :, :-1] for s in sums)
            gt, ht = (s[:, :, -1:] for s in sums)
            gain = gl**2 / (hl + ridge) + (gt - gl) ** 2 / (ht - hl + ridge) - gt**2 / (ht + ridge)
            gain[(hl < least / 4) | (ht - hl < least / 4)] = -1
            best = gain.reshape(nodes, -1).argmax(axis=1)
            for k in np.flatnonzero(gain.reshape(nodes, -1).max(axis=1) > 1e-9):
                f, b = divmod(int(best[k]), bins - 1)
                if b < len(cuts[f]):
                    feature[t, first + k], split[t, first + k] = f, cuts[f][b]
            at = 2 * at + 1 + (x[np.arange(n), feature[t, at]] > split[t, at])
        leaf = at - inner
        value[t] = rate * np.bincount(leaf, g, inner + 1) / (np.bincount(leaf, h, inner + 1) + ridge)
        total += value[t][leaf]
    return Forest(base, feature, split, value)


def held_out(id_col: str) -> F.Column:
    """Whether a document belongs to the fold that no model learns from: CRC-32 of the id as text leaves 2 modulo 4 (null: the empty text)."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 4 == 2


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = 20_000) -> Forest:
    """Fit on at most ``sample`` labelled rows outside the held-out fold, chosen by a hash of their ids.

    ``sample`` bounds what reaches the driver (36 numbers a row). Labels other than 0 and 1 are left out; repeated labels of an id are averaged.
    """
    small_batches(docs.sparkSession)
    known = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull() & ~held_out(id_col)).groupBy(F.col(id_col).alias("key")).agg(F.avg(F.col(label_col).cast("double")).alias("label"))
    chosen = known.orderBy(F.xxhash64("key"), "key").limit(sample)
    body = F.col(text_col).cast("string").cast("binary")
    rows = docs.select(F.col(id_col).alias("key"), body.alias("body")).join(F.broadcast(chosen), "key").select("key", "label", "body")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            stats = [statistics(x.as_py()).tolist() for x in batch.column("body")]
            yield pa.RecordBatch.from_arrays([batch.column("label"), pa.array(stats, pa.list_(pa.float32()))], names=["label", "stats"])

    # An id may stand on many rows, so the bound is applied again.
    found = rows.mapInArrow(run, "label double, stats array<float>").orderBy(F.xxhash64("label", "stats")).limit(sample).collect()
    y = np.array([r.label for r in found])
    return fit(np.array([r.stats for r in found], np.float32).reshape(len(found), len(NAMES)), y)


def scored(docs: DataFrame, forest: Forest, text_col: str = "text", out: str = "score") -> DataFrame:
    """All columns of ``docs`` and ``out``, the chance of label 1 (null and empty texts too). A column named ``out`` is replaced."""
    small_batches(docs.sparkSession)
    rest = docs.drop(out)
    shared = docs.sparkSession.sparkContext.broadcast(forest)
    at = rest.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            stats = np.array([statistics(x.encode() if x else b"") for x in batch.column(at).to_pylist()], np.float32).reshape(batch.num_rows, len(NAMES))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(shared.value.score(stats))], names=[*batch.schema.names, out])

    return rest.mapInArrow(run, T.StructType([*rest.schema.fields, T.StructField(out, T.DoubleType())]))
