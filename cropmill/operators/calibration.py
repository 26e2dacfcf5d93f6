"""Similarity calibration: how far a nearest neighbour's class can be trusted at a similarity."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cropmill.functions.text import matches_class
from cropmill.operators.curation import sample_rows, with_sides
from cropmill.operators.knn import knn_join

# The thresholds reported.
THRESHOLDS = (0.70, 0.75, 0.80, 0.85, 0.88, 0.90, 0.92, 0.95, 0.97, 0.98)


def detail(neighbors: DataFrame, records: DataFrame, width: float = 0.02) -> DataFrame:
    """One row per query: its nearest neighbour, its neighbours' agreement, and the bin of the nearest similarity.

    The majority class is the commonest; ties go to the class that comes first by rank.
    """
    sided = with_sides(neighbors, records, "class_id", "class_name", "file_name")
    same = F.col("class_id") == F.col("neighbor_class_id")
    votes = sided.groupBy("record_idx", "neighbor_class_name").agg(F.count("*").alias("n"), F.min("rank").alias("r"))
    majority = votes.groupBy("record_idx").agg(F.max_by(F.struct(F.col("neighbor_class_name").alias("topk_majority_class"), F.col("n").alias("majority_count")), F.struct("n", -F.col("r"))).alias("m"))
    top = F.min_by(F.struct(F.col("similarity").alias("top1_similarity"), F.col("neighbor_idx").alias("top1_record_idx"), F.col("neighbor_class_id").alias("top1_class_id"), F.col("neighbor_class_name").alias("top1_class_name"), same.alias("top1_same_class")), "rank")
    rows = sided.groupBy("record_idx", "class_id", "class_name", "file_name").agg(top.alias("t"), F.avg(same.cast("double")).alias("topk_same_class_ratio"), F.count("*").alias("topk")).join(majority, "record_idx")
    w = max(0.001, width)
    start = F.floor(F.col("t.top1_similarity") / w) * w
    return rows.select("record_idx", "class_id", "class_name", "file_name", "t.*", "topk_same_class_ratio", "m.topk_majority_class", (F.col("m.majority_count") / F.col("topk")).alias("topk_majority_ratio"), "topk", start.alias("similarity_bin_start"), F.format_string("%.3f-%.3f", start, start + w).alias("similarity_bin"))


def sampled_detail(records: DataFrame, most: int, seed: int, class_filter: str = "", k: int = 10, width: float = 0.02) -> DataFrame:
    """``detail`` for a sample of at most ``most`` records (0: all) of a class, searched among all records."""
    own = records.where(matches_class(class_filter, F.col("class_id"), F.col("class_name")))
    return detail(knn_join(sample_rows(own, most, seed), records, k), records, width)


def _pct(x) -> F.Column:
    return F.round(F.avg(x) * 100.0, 2)


def bins(rows: DataFrame) -> DataFrame:
    return rows.groupBy("similarity_bin").agg(F.count("*").alias("count"), _pct(F.col("top1_same_class").cast("double")).alias("top1_same_class_rate"), F.round(F.avg("top1_similarity"), 4).alias("mean_top1_similarity"), _pct("topk_same_class_ratio").alias("mean_topk_same_class_ratio"), _pct("topk_majority_ratio").alias("mean_topk_majority_ratio"))


def thresholds(rows: DataFrame, values: tuple[float, ...] = THRESHOLDS) -> DataFrame:
    """Coverage and agreement at or above each threshold; no rows give null rates. One pass over the rows."""
    spread = rows.select("top1_similarity", "top1_same_class", "topk_same_class_ratio", F.explode(F.array(*map(F.lit, values))).alias("similarity_threshold"))
    above = F.col("top1_similarity") >= F.col("similarity_threshold")
    out = spread.groupBy("similarity_threshold").agg(F.count_if(above).alias("count"), F.round(F.count_if(above) * 100.0 / F.count("*"), 2).alias("coverage_pct"), _pct(F.when(above, F.col("top1_same_class").cast("double"))).alias("top1_same_class_rate"), _pct(F.when(above, F.col("topk_same_class_ratio"))).alias("mean_topk_same_class_ratio"))
    return out


def classes(rows: DataFrame) -> DataFrame:
    return rows.groupBy("class_id", "class_name").agg(F.count("*").alias("count"), F.round(F.avg("top1_similarity"), 4).alias("mean_top1_similarity"), _pct(F.col("top1_same_class").cast("double")).alias("top1_same_class_rate"), _pct("topk_same_class_ratio").alias("mean_topk_same_class_ratio"))
