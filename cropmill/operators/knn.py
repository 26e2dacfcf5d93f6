"""Exact nearest neighbours by blocks: every query against every vector of a base table.

Both sides are packed into blocks of rows; each query block is sent to every base block, where one matrix product and a partial sort
give the block's best. A window over the few that are left ranks them. Neither side is collected or broadcast, and memory is bounded by
two blocks.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def dot(a: Column | str, b: Column | str) -> Column:
    """Inner product of two double arrays."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def unit(v: Column) -> Column:
    """A vector divided by its norm (at least 1e-12)."""
    v = v.cast("array<double>")
    # The norm stands in a struct, so that it is computed once and not for each component.
    both = F.struct(v.alias("v"), F.greatest(F.sqrt(dot(v, v)), F.lit(1e-12)).alias("norm"))
    return F.transform(F.array(both), lambda s: F.transform(s["v"], lambda x: x / s["norm"]))[0]


def blocks(df: DataFrame, id_col: str, vector_col: str, parts: int, rows: int) -> DataFrame:
    """``(block, n, ids, vectors)``: rows dealt out by a hash of the id, each block's ids and double vectors as bytes."""
    dealt = df.select(F.pmod(F.xxhash64(id_col), F.lit(parts)).alias("block"), F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v")).where("v is not null")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, ids, vectors = None, [], []

        def out() -> Iterator[pa.RecordBatch]:
            if ids:
                yield pa.RecordBatch.from_pydict({"block": pa.array([key], pa.int64()), "n": pa.array([len(ids)], pa.int64()), "ids": pa.array([np.array(ids, np.int64).tobytes()], pa.binary()), "vectors": pa.array([np.array(vectors, np.float64).tobytes()], pa.binary())})

        for batch in batches:
            for k, i, v in zip(*(batch.column(c).to_pylist() for c in range(3)), strict=True):
                if k != key or len(ids) >= rows:
                    yield from out()
                    key, ids, vectors = k, [], []
                ids.append(i)
                vectors.append(v)
        yield from out()

    return dealt.repartition(parts, "block").sortWithinPartitions("block", "id").mapInArrow(run, "block long, n long, ids binary, vectors binary")


def knn_join(queries: DataFrame, base: DataFrame, k: int, id_col: str = "record_idx", vector_col: str = "feature", metric: str = "ip", exclude_self: bool = True, query_rows: int = 2_048, base_rows: int = 16_384, width: int = 0) -> DataFrame:
    """``(record_idx, neighbor_idx, similarity, rank)``: the ``k`` best of ``base`` for each query.

    ``metric`` is ``ip`` (raw inner product) or ``cosine`` (both sides normalised first). With a ``width`` the best ``width`` by that metric
    are ranked anew by cosine, which is computed where both vectors are, and the ``k`` best stay. Ties go to smaller ids. Null vectors
    take no part.
    """
    if metric not in ("ip", "cosine"):
        raise ValueError(f"unknown metric {metric}")
    norm = metric == "cosine"
    nq, nb = (max(1, math.ceil(x.count() / r)) for x, r in ((queries, query_rows), (base, base_rows)))
    left = blocks(queries, id_col, vector_col, nq, 2 * query_rows).select(F.explode(F.sequence(F.lit(0).cast("long"), F.lit(nb - 1).cast("long"))).alias("block"), F.col("n").alias("qn"), F.col("ids").alias("qids"), F.col("vectors").alias("qv"))
    met = blocks(base, id_col, vector_col, nb, 2 * base_rows).hint("merge").join(left, "block")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                q, b = np.frombuffer(r["qv"]).reshape(r["qn"], -1), np.frombuffer(r["vectors"]).reshape(r["n"], -1)
                if norm:
                    q, b = (x / np.maximum(np.sqrt((x * x).sum(axis=1, keepdims=True)), 1e-12) for x in (q, b))
                qi, bi = np.frombuffer(r["qids"], np.int64), np.frombuffer(r["ids"], np.int64)
                s = q @ b.T
                if exclude_self:
                    s[qi[:, None] == bi[None, :]] = -np.inf
                m = min(width or k, s.shape[1])
                edge = np.partition(s, s.shape[1] - m, axis=1)[:, s.shape[1] - m]
                # Ties with the last, and what rounding might have put below it, are kept for the ranking.
                row, col = np.nonzero((s >= edge[:, None] - 1e-9) & np.isfinite(s))
                exact = np.cumsum(q[row] * b[col], axis=1)[:, -1] if len(row) else np.zeros(0)
                out = [pa.array(qi[row]), pa.array(bi[col]), pa.array(exact)]
                if width:
                    uq, ub = (x / np.maximum(np.sqrt((x * x).sum(axis=1, keepdims=True)), 1e-12) for x in (q, b))
                    out.append(pa.array(np.cumsum(uq[row] * ub[col], axis=1)[:, -1] if len(row) else np.zeros(0)))
                yield pa.RecordBatch.from_arrays(out, names=["record_idx", "neighbor_idx", "similarity", "cosine"][: len(out)])

    found = met.mapInArrow(run, "record_idx long, neighbor_idx long, similarity double" + ", cosine double" * bool(width))
    order = Window.partitionBy("record_idx").orderBy(F.desc("similarity"), "neighbor_idx")
    if width:
        found = found.withColumn("place", F.row_number().over(order)).where(F.col("place") <= width).select("record_idx", "neighbor_idx", F.col("cosine").alias("similarity"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def search_width(n: int, k: int, rerank_k: int, times: int = 20) -> int:
    """Candidates that an index is asked for before exact reranking."""
    return min(n, max(k, rerank_k, times * k))


def rerank(candidates: DataFrame, queries: DataFrame, base: DataFrame, k: int, id_col: str = "record_idx", vector_col: str = "feature") -> DataFrame:
    """Exact cosine order of candidate pairs ``(record_idx, neighbor_idx)``, repeats dropped; the ``k`` best of each query."""
    pairs = candidates.select("record_idx", "neighbor_idx").distinct()
    pairs = pairs.join(queries.select(F.col(id_col).alias("record_idx"), unit(F.col(vector_col)).alias("qv")), "record_idx")
    pairs = pairs.join(base.select(F.col(id_col).alias("neighbor_idx"), unit(F.col(vector_col)).alias("bv")), "neighbor_idx")
    order = Window.partitionBy("record_idx").orderBy(F.desc("similarity"), "neighbor_idx")
    return pairs.select("record_idx", "neighbor_idx", dot("qv", "bv").alias("similarity")).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def without_same_box(neighbors: DataFrame, records: DataFrame, k: int) -> DataFrame:
    """Neighbours of another natural key (image, box, line) than their query, ranked anew; ask for one more than ``k`` before."""
    key = F.struct("image_path", "bbox", "annotation_line")
    own = neighbors.join(records.select("record_idx", key.alias("own")), "record_idx").join(records.select(F.col("record_idx").alias("neighbor_idx"), key.alias("other")), "neighbor_idx")
    order = Window.partitionBy("record_idx").orderBy(F.desc("similarity"), "neighbor_idx")
    return own.where("own <> other").drop("own", "other", "rank").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
