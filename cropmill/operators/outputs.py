"""All tables and the summary of a curation report and of a reduction plan."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cropmill.operators import curation, groups, reduction
from cropmill.storage import settle

KEYS = ["class_id", "class_name", "size_bucket"]


def report_rows(records: DataFrame) -> DataFrame:
    """The report's columns of records; ``area_pct`` is made from ``area_ratio`` where it is missing."""
    if "area_pct" not in records.columns:
        records = records.withColumn("area_pct", F.col("area_ratio") * 100.0)
    return records.select(*[c for c in curation.ROW_BASE if c in records.columns])


def curation_outputs(records: DataFrame, queries: DataFrame, neighbors: DataFrame, near: float, cross: float, rare: int, boundary: int, partial: bool) -> dict[str, DataFrame]:
    """The eleven tables of a report and its ``summary`` row.

    ``queries`` are the records that were asked for (all, or a sample); ``neighbors`` are theirs among all of ``records``.
    """
    neighbors = settle(neighbors, "neighbors")
    edges = settle(curation.near_duplicate_edges(neighbors, records, near), "near")
    crossing = settle(curation.cross_class_edges(neighbors, records, cross), "cross")
    found = settle(curation.duplicate_groups(edges, records), "duplicates")
    advice = settle(curation.curation_recommendations(queries, neighbors, near, cross, rare, boundary, records), "advice")
    images = settle(curation.image_rollup(advice, "report", partial), "images")
    medoids = groups.medoids(queries, KEYS).select(F.col("representative_idx").alias("record_idx"))
    sizes = queries.groupBy(*KEYS).agg(F.count("*").alias("group_count"))
    rows = report_rows(queries)
    tables = {
        "records_sample": rows,
        "neighbor_summary": curation.neighbor_summary(neighbors, records),
        "near_duplicates": edges,
        "cross_class_overlap": crossing,
        "duplicate_groups": found,
        "group_summary": curation.group_summary(queries, rare, boundary),
        "representatives": rows.join(medoids, "record_idx", "left_semi"),
        "boundary_samples": rows.join(groups.boundaries(queries, KEYS, boundary).select("record_idx", "boundary_rank"), "record_idx"),
        "rare_samples": rows.join(sizes.where(F.col("group_count") <= rare), KEYS),
        "curation_recommendations": advice,
        "image_recommendations": images,
    }
    counts = [
        records.agg(F.count("*").alias("total_records")),
        queries.agg(F.count("*").alias("sampled_records")),
        edges.agg(F.count("*").alias("near_duplicate_edges")),
        found.agg(F.count_distinct("duplicate_group_id").alias("duplicate_groups")),
        crossing.agg(F.count("*").alias("cross_class_edges")),
        tally(advice, "action", "recommendation_counts"),
        tally(images, "image_action", "image_action_counts"),
    ]
    settings = {"duplicate_threshold": near, "cross_class_threshold": cross, "rare_group_size": rare, "boundary_count": boundary, "partial_report": partial}
    return tables | {"summary": one_row(counts, settings)}


def reduction_outputs(records: DataFrame, queries: DataFrame, neighbors: DataFrame, tight: float, cross: float, per_group: int, partial: bool, same_class: bool = True, same_size: bool = True) -> dict[str, DataFrame]:
    """The seven tables of a reduction plan, kept and dropped records among them, and its ``summary`` row."""
    neighbors = settle(neighbors, "neighbors")
    edges = settle(reduction.tight_edges(neighbors, records, tight, same_class, same_size), "tight")
    protected = settle(reduction.protected_ids(neighbors, records, cross), "protected")
    members = settle(reduction.reduction_members(edges, records, protected, 2, per_group), "members")
    found = reduction.reduction_groups(members, records)
    touched = queries.select("record_idx").union(neighbors.select(F.col("neighbor_idx").alias("record_idx"))).distinct()
    advice = settle(reduction.reduction_recommendations(members, protected, touched, records), "advice")
    images = settle(reduction.image_plan(advice, partial), "images")
    dropped = curation.is_drop(F.col("action"))
    tables = {
        "reduction_groups": found,
        "reduction_group_members": members,
        "reduction_tight_edges": edges,
        "reduction_recommendations": advice,
        "reduction_keep_records": advice.where(~dropped),
        "reduction_drop_records": advice.where(dropped),
        "reduction_image_plan": images,
    }
    counts = [
        records.agg(F.count("*").alias("total_records")),
        queries.agg(F.count("*").alias("sampled_query_records")),
        advice.agg(F.count("*").alias("planned_records"), F.count_if(dropped).alias("drop_record_candidates"), F.coalesce(F.round(F.count_if(dropped) * 100.0 / F.count("*"), 6), F.lit(0.0)).alias("record_reduction_pct_of_planned")),
        edges.agg(F.count("*").alias("tight_edges")),
        members.agg(F.count_distinct("reduction_group_id").alias("tight_groups"), F.count("*").alias("grouped_records"), F.count_if("is_representative").alias("representative_records")),
        protected.agg(F.count("*").alias("protected_records")),
        reduction.split_images(images).agg(F.count_if(F.col("image_action").startswith("DROP")).alias("image_drop_candidates"), F.count_if("is_dropped").alias("safe_image_drop_candidates")),
    ]
    settings = {"tight_threshold": tight, "protect_cross_class_threshold": cross, "same_class_only": same_class, "same_size_only": same_size, "partial_plan": partial}
    return tables | {"summary": one_row(counts, settings)}


def tally(rows: DataFrame, column: str, out: str) -> DataFrame:
    """One row: a map of the column's values to their counts, sorted by value."""
    n = rows.groupBy(column).agg(F.count("*").alias("n"))
    return n.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(column, "n")))).alias(out))


def one_row(parts: list[DataFrame], settings: dict) -> DataFrame:
    """Single rows side by side; each part is an aggregate, so every side of the joins is one row."""
    out = parts[0]
    for p in parts[1:]:
        out = out.join(F.broadcast(p))
    return out.select("*", *[F.lit(v).alias(k) for k, v in settings.items()])
