"""Centroids, medoids, boundary samples and representatives of groups of vectors."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cropmill.operators.knn import dot, unit
from cropmill.storage import release, settle


def centroids(rows: DataFrame, keys: list[str], vector_col: str = "feature") -> DataFrame:
    """Unit mean vector of each group: ``keys``, ``centroid``.

    Each task first adds up the vectors of its own groups, so a group of any size is shuffled as one sum a task.
    """
    group = F.struct(*keys)
    narrow = rows.select(F.to_json(group, {"ignoreNullFields": "false"}).alias("key"), F.col(vector_col).cast("array<double>").alias("v")).where("v is not null")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            keys_, vectors = batch.column(0).to_pylist(), np.array(batch.column(1).to_pylist(), np.float64)
            names, at = np.unique(np.array(keys_, object).astype(str), return_inverse=True)
            part = np.zeros((len(names), vectors.shape[1] if vectors.ndim > 1 else 0))
            np.add.at(part, at.ravel(), vectors)
            for name, s in zip(names.tolist(), part, strict=True):
                sums[name] = sums[name] + s if name in sums else s
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(list(sums)), pa.array([s.tolist() for s in sums.values()], pa.list_(pa.float64()))], names=["key", "s"])

    parts = narrow.mapInArrow(run, "key string, s array<double>").select("key", F.posexplode("s").alias("pos", "x"))
    whole = parts.groupBy("key", "pos").agg(F.sum("x").alias("x")).groupBy("key").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "x"))), lambda p: p["x"]).alias("s"))
    return whole.select(F.from_json("key", rows.select(*keys).schema).alias("k"), unit(F.col("s")).alias("centroid")).select("k.*", "centroid")


def centroid_scores(rows: DataFrame, keys: list[str], vector_col: str = "feature") -> DataFrame:
    """``rows`` and ``centroid_score``: the inner product with the group's centroid, to ten digits so that sums in any order agree."""
    return rows.join(centroids(rows, keys, vector_col), keys).withColumn("centroid_score", F.round(dot(F.col(vector_col).cast("array<double>"), "centroid"), 10)).drop("centroid")


def medoids(rows: DataFrame, keys: list[str], vector_col: str = "feature", id_col: str = "record_idx") -> DataFrame:
    """``keys``, ``representative_idx``: the member nearest to the centroid; ties go to the smallest id."""
    best = F.max_by(id_col, F.struct("centroid_score", -F.col(id_col)))
    return centroid_scores(rows, keys, vector_col).groupBy(*keys).agg(best.alias("representative_idx"))


def boundaries(rows: DataFrame, keys: list[str], count: int, vector_col: str = "feature", id_col: str = "record_idx") -> DataFrame:
    """``keys``, ``id_col``, ``boundary_rank``: the ``count`` members farthest from the centroid, of groups of two or more.

    Only ids and scores are ranked, and a task passes on ``count`` of a group at most; sizes are counted apart.
    """
    scores = centroid_scores(rows, keys, vector_col).select(*keys, id_col, "centroid_score")
    order = Window.partitionBy(*keys).orderBy("centroid_score", id_col)
    ranked = scores.withColumn("boundary_rank", F.row_number().over(order)).where(F.col("boundary_rank") <= count)
    sizes = rows.where(F.col(vector_col).isNotNull()).groupBy(*keys).agg(F.count("*").alias("members")).where("members > 1")
    return ranked.join(sizes, keys).select(*keys, id_col, "boundary_rank")


def farthest_first(vectors: np.ndarray, ids: list[int], count: int) -> list[int]:
    """The medoid, then again and again the member least similar to those taken."""
    mean = vectors.mean(axis=0)
    norm = np.sqrt((mean * mean).sum())
    taken = [int(np.argmax(np.round(vectors @ (mean / norm if norm > 0 else mean), 10)))]
    near = vectors @ vectors[taken[0]]
    near[taken[0]] = np.inf
    while len(taken) < min(count, len(ids)):
        taken.append(int(np.argmin(np.round(near, 10))))
        near = np.maximum(near, vectors @ vectors[taken[-1]])
        near[taken[-1]] = np.inf
    return [ids[i] for i in taken]


def representatives(rows: DataFrame, key: str, count: int, vector_col: str = "feature", id_col: str = "record_idx") -> DataFrame:
    """``key``, ``record_idx``, ``pick`` (from 1): up to ``count`` representatives of each group, farthest first.

    Each round compares all rows with those that their group has taken (at most ``count`` vectors) and keeps the least similar one by a
    plain aggregate, so a group of any size is spread over all tasks. Null vectors and null keys take no part.
    """
    own = rows.select(F.col(key).alias("key"), F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v")).where("v is not null")
    point = F.struct("id", "v")
    first = centroid_scores(own, ["key"], "v").groupBy("key").agg(F.max_by(point, F.struct("centroid_score", -F.col("id"))).alias("next"))
    taken = settle(first.select("key", F.array("next").alias("taken")), "taken")
    for _ in range(count - 1):
        near = F.array_max(F.transform("taken", lambda t: F.round(dot("v", t["v"]), 10)))
        open_ = own.join(taken, "key").where(~F.exists("taken", lambda t: t["id"] == F.col("id"))).select("key", "id", "v", near.alias("near"))
        more = open_.groupBy("key").agg(F.min_by(point, F.struct("near", "id")).alias("next"))
        grown = settle(taken.join(more, "key", "left").select("key", F.when(F.col("next").isNull(), F.col("taken")).otherwise(F.concat("taken", F.array("next"))).alias("taken")), "taken")
        release(taken)
        taken = grown
    picks = taken.select("key", F.posexplode(F.transform("taken", lambda t: t["id"])).alias("place", "record_idx"))
    return picks.select(F.col("key").alias(key), "record_idx", (F.col("place") + 1).alias("pick"))


def id_list(ids: Column) -> Column:
    return F.array_join(ids.cast("array<string>"), " ")
