"""Rows behind review galleries: drop candidates, calibration pairs, cluster samples. Each is filtered, sorted and cut to what is shown."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cropmill.functions.text import safe_double
from cropmill.operators.curation import is_drop, random_order
from cropmill.operators.review import STATUSES

#: Sorts of the drop gallery and of calibration pairs; ids settle ties.
DROP_SORTS = ("Highest similarity", "Lowest similarity", "Largest group", "Random")
PAIR_SORTS = ("Different first", "Highest similarity", "Lowest similarity", "Random")


def drop_gallery(drops: DataFrame, groups: DataFrame, class_name: str = "All", status: str = "All", min_similarity: float = 0.0, sort: str = "Highest similarity", limit: int = 60, seed: int = 42) -> DataFrame:
    """Drop candidates of a class and review state, the first ``limit`` of the sort.

    ``drops`` has ``record_idx``, ``class_name``, ``action``, ``user_keep_override``, ``review_status``, ``similarity_to_primary``,
    ``reduction_group_id``. ``Still dropped`` leaves out what the user keeps. Rows of unknown group sort as groups of size 0.
    """
    kept = F.coalesce(F.col("user_keep_override"), F.lit(False))
    rows = drops if class_name == "All" else drops.where(F.col("class_name") == class_name)
    if status == "Still dropped":
        rows = rows.where(is_drop(F.col("action")) & ~kept)
    elif status == "User keeps":
        rows = rows.where(kept)
    elif status in STATUSES:
        rows = rows.where(F.coalesce("review_status", F.lit("Unreviewed")) == status)
    if min_similarity > 0:
        rows = rows.where(safe_double(F.col("similarity_to_primary").cast("string"), 0.0) >= min_similarity)
    rows = rows.join(groups.select("reduction_group_id", "group_size"), "reduction_group_id", "left").withColumn("group_size", F.coalesce("group_size", F.lit(0)))
    first: list[Column] = {
        "Highest similarity": [F.desc("similarity_to_primary")],
        "Lowest similarity": [F.asc_nulls_last("similarity_to_primary")],
        "Largest group": [F.desc("group_size")],
        "Random": [random_order("record_idx", seed)],
    }.get(sort, [])
    return rows.orderBy(*first, "record_idx").limit(limit)


def calibration_examples(detail: DataFrame, min_similarity: float = 0.0, similarity_bin: str = "All", match: str = "All", sort: str = "Different first", limit: int = 24, seed: int = 42) -> DataFrame:
    """Query and neighbour pairs to look at: of one bin, of same or different class, the first ``limit`` of the sort."""
    rows = detail.where(F.col("top1_similarity") >= min_similarity)
    if similarity_bin != "All":
        rows = rows.where(F.col("similarity_bin") == similarity_bin)
    if match in ("Same class", "Different class"):
        rows = rows.where(F.col("top1_same_class") == (match == "Same class"))
    first: list[Column] = {
        "Different first": [F.asc("top1_same_class"), F.desc("top1_similarity")],
        "Highest similarity": [F.desc("top1_similarity")],
        "Lowest similarity": [F.asc("top1_similarity")],
    }.get(sort, [random_order("record_idx", seed)])
    return rows.orderBy(*first, "record_idx").limit(limit)


def cluster_samples(rows: DataFrame, group: str, value: str, limit: int = 48) -> DataFrame:
    """The first ``limit`` records of one cluster (or any other group), by class, size and id."""
    return rows.where(F.col(group).cast("string") == value).orderBy("class_name", "size_bucket", "record_id").limit(limit)


def point_choices(rows: DataFrame, limit: int = 300) -> DataFrame:
    """``record_idx`` of the points that a picker offers, by class, cluster and id."""
    return rows.orderBy("class_name", "cluster_label", "record_id").limit(limit).select("record_idx")
