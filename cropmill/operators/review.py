"""Review of a reduction plan: boards, samples, explorer, facets, overviews, statuses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cropmill.operators.curation import random_order

from cropmill.functions.text import action_group

# The review states.
STATUSES = ("Unreviewed", "Drop confirmed", "Keep", "Hold")
#: Orders of group boards; ids settle ties.
BOARD_SORTS = {"drops": ["drop_candidates", "mean_similarity_to_primary"], "similarity": ["mean_similarity_to_primary", "drop_candidates"], "size": ["group_size", "mean_similarity_to_primary"]}
#: Orders of the explorer: columns, each with whether it descends.
EXPLORER_SORTS = {
    "Highest similarity": [("sim", True), ("group_size", True)],
    "Lowest similarity": [("sim", False), ("group_size", True)],
    "Largest group": [("group_size", True), ("sim", True)],
    "Drop first": [("is_drop", True), ("sim", True)],
    "File name": [("file_name", False)],
    "Group order": [("reduction_group_id", False), ("is_representative", True), ("sim", True)],
}
#: Named bundles of explorer arguments.
PRESETS = {
    "High similarity drops": {"action": "Drop candidate", "min_similarity": 0.995, "sort": "Highest similarity"},
    "Low similarity drops": {"action": "Drop candidate", "sort": "Lowest similarity"},
    "Large groups": {"sort": "Largest group"},
    "User keeps": {"action": "User keep", "sort": "Group order"},
    "Random": {"sort": "Random"},
}


def board(groups: DataFrame, sort: str = "drops", class_filter: str | None = None, limit: int = 20, top_per_class: bool = False) -> DataFrame:
    """The groups of a board: filtered, one of each class if wished, sorted, the first ``limit``."""
    rows = groups if class_filter in (None, "All") else groups.where((F.col("class_name") == class_filter) | (F.col("class_id").cast("string") == class_filter))
    order = [F.desc(c) for c in BOARD_SORTS[sort]] + [F.asc("reduction_group_id")]
    if top_per_class:
        rows = rows.withColumn("place", F.row_number().over(Window.partitionBy("class_name").orderBy(*order))).where("place = 1").drop("place")
    return rows.orderBy(*order).limit(limit)


def wall(groups: DataFrame, floor: float, rows: int, sort: str = "drops") -> DataFrame:
    """Board of four times the rows, of which those of at least ``floor`` mean similarity are shown; fewer than ``rows`` may be left."""
    order = [F.desc(c) for c in BOARD_SORTS[sort]] + [F.asc("reduction_group_id")]
    return board(groups, sort, limit=4 * rows).where(F.col("mean_similarity_to_primary") >= floor).orderBy(*order).limit(rows)


def protected_wall(groups: DataFrame, members: DataFrame) -> DataFrame:
    return groups.join(members.where(F.col("action").contains("PROTECTED")).select("reduction_group_id").distinct(), "reduction_group_id", "left_semi")


def group_samples(members: DataFrame, per_group: int) -> DataFrame:
    """Each group's representative, then its drops before others by falling similarity: ``pick`` from 0."""
    order = [F.desc("is_representative"), F.desc(F.col("action").startswith("DROP")), F.desc("similarity_to_primary"), F.asc("record_idx")]
    return members.withColumn("pick", F.row_number().over(Window.partitionBy("reduction_group_id").orderBy(*order)) - 1).where(F.col("pick") <= per_group)


def explorer_frame(members: DataFrame, groups: DataFrame, records: DataFrame, overrides: DataFrame, statuses: DataFrame) -> DataFrame:
    """Members with their records, group sizes, overrides and review states."""
    rows = members.join(records.select("record_idx", "class_id", "class_name", "size_bucket", "image_path", "file_name"), "record_idx").join(groups.select("reduction_group_id", "group_size"), "reduction_group_id").join(overrides.select("record_idx", F.lit(True).alias("wish")).distinct(), "record_idx", "left").join(statuses.select("record_idx", "review_status"), "record_idx", "left")
    hit = F.coalesce(F.col("wish"), F.lit(False)) & F.col("action").startswith("DROP")
    status = F.when(F.col("review_status").isin(*STATUSES), F.col("review_status")).otherwise("Unreviewed")
    rows = rows.withColumn("original_action", F.col("action")).withColumn("user_keep_override", hit).withColumn("action", F.when(F.col("user_keep_override"), "KEEP_USER_OVERRIDE").otherwise(F.col("action"))).withColumn("review_status", status)
    return rows.withColumn("action_group", action_group(F.col("action"))).withColumn("is_drop", F.col("action").startswith("DROP")).withColumn("sim", F.col("similarity_to_primary")).drop("wish")


def explore(frame: DataFrame, class_name: str | None = None, action: str | None = None, review: str | None = None, size: str | None = None, group_query: str = "", text_query: str = "", min_similarity: float = 0.0, sort: str = "Group order", seed: int = 0) -> DataFrame:
    """The explorer's rows, filtered, with ``place`` from 1 in the chosen order (ids settle ties)."""
    for c, v in (("class_name", class_name), ("action_group", action), ("review_status", review), ("size_bucket", size)):
        if v not in (None, "All"):
            frame = frame.where(F.col(c) == v)
    if min_similarity > 0:
        frame = frame.where((F.col("sim") >= min_similarity) | F.col("is_representative"))
    if group_query.strip():
        q = group_query.strip()
        frame = frame.where(F.col("reduction_group_id").cast("string").contains(q) | F.lower("file_name").contains(q.lower()))
    if text_query.strip():
        q = text_query.strip()
        found = [F.lower(c).contains(q.lower()) for c in ("file_name", "image_path", "class_name", "action")] + [F.col(c).cast("string").contains(q) for c in ("reduction_group_id", "record_idx")]
        frame = frame.where(any_of(found))
    order = [random_order("record_idx", seed).asc()] if sort == "Random" else [F.desc(c) if down else F.asc(c) for c, down in EXPLORER_SORTS[sort]]
    return frame.withColumn("place", F.row_number().over(Window.orderBy(*order, F.asc("record_idx"))))


def any_of(tests: list[Column]) -> Column:
    out = tests[0]
    for t in tests[1:]:
        out = out | t
    return out


def page(rows: DataFrame, number: int, size: int) -> DataFrame:
    """Page ``number`` from 1."""
    return rows.where(F.col("place").between((number - 1) * size + 1, number * size))


def facets(rows: DataFrame, tops: dict[str, int]) -> DataFrame:
    """``(field, value, n)``: the commonest values of each field, ties by value."""
    out = None
    for c, n in tops.items():
        one = rows.groupBy(F.col(c).cast("string").alias("value")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "value").limit(n).select(F.lit(c).alias("field"), "value", "n")
        out = one if out is None else out.unionByName(one)
    return out


def class_overview(members: DataFrame, records: DataFrame) -> DataFrame:
    rows = members.join(records.select("record_idx", "class_id", "class_name"), "record_idx")
    drop = F.count_if(F.col("action").startswith("DROP"))
    return rows.groupBy("class_id", "class_name").agg(F.count("*").alias("grouped"), F.count_if("is_representative").alias("representatives"), F.count_if("is_protected").alias("protected"), drop.alias("drops"), F.round(drop * 100.0 / F.greatest(F.count("*"), F.lit(1)), 2).alias("drop_pct"))


def kpis(frame: DataFrame) -> DataFrame:
    return frame.agg(F.count("*").alias("filtered"), F.count_if("is_drop").alias("drops"), F.count_if("user_keep_override").alias("user_keeps"), F.count_if(F.col("review_status") != "Unreviewed").alias("reviewed"), F.count_distinct("reduction_group_id").alias("groups"), F.round(F.avg("sim"), 6).alias("mean_similarity"))


def similarity_quantiles(members: DataFrame) -> DataFrame:
    rows = members.where("similarity_to_primary > 0")
    return rows.agg(*[F.round(F.expr(f"percentile(similarity_to_primary, {q})"), 6).alias(n) for n, q in (("q0", 0.0), ("q25", 0.25), ("q50", 0.5), ("q75", 0.75), ("q100", 1.0))])


def similarity_histogram(members: DataFrame, bins: int = 41) -> DataFrame:
    """Counts by action group of equal bins from just below the smallest similarity to 1; the last bin is closed."""
    rows = members.where("similarity_to_primary > 0").select(action_group(F.col("action")).alias("action_group"), "similarity_to_primary")
    low = rows.agg(F.greatest(F.lit(0.0), F.min("similarity_to_primary") - 0.001).alias("low"))
    at = F.least(F.lit(bins - 1), F.floor((F.col("similarity_to_primary") - F.col("low")) / (1 - F.col("low")) * bins)).cast("int")
    return rows.join(F.broadcast(low)).where("similarity_to_primary <= 1").groupBy("action_group", at.alias("bin")).agg(F.count("*").alias("n"))


def upsert_statuses(now: DataFrame, changes: DataFrame) -> DataFrame:
    """Review states after changes ``(record_idx, review_status, at)``: the last of a record counts; Unreviewed removes it.

    ``keeps`` tells whether the state also overrides the drop.
    """
    rows = now.select("record_idx", "review_status", F.lit(-1).cast("long").alias("at")).unionByName(changes.select("record_idx", F.when(F.col("review_status").isin(*STATUSES), F.col("review_status")).otherwise("Unreviewed").alias("review_status"), F.col("at").cast("long").alias("at")))
    last = rows.groupBy("record_idx").agg(F.max_by("review_status", "at").alias("review_status"))
    return last.where("review_status <> 'Unreviewed'").withColumn("keeps", F.col("review_status").isin("Keep", "Hold"))


def group_compare(members: DataFrame, group_id: int, most: int = 500) -> DataFrame:
    """A group's members: representatives, then by action and falling similarity, numbered from 1; the first ``most``."""
    order = Window.orderBy(F.desc("is_representative"), "action", F.desc("similarity_to_primary"), "record_idx")
    return members.where(F.col("reduction_group_id") == group_id).withColumn("place", F.row_number().over(order)).where(F.col("place") <= most)


def inspect_record(frame: DataFrame, record_idx: int, siblings: int = 8) -> DataFrame:
    """The first members of a record's group beside it, representatives and drops first, with ``place`` from 1."""
    group = frame.where(F.col("record_idx") == record_idx).select("reduction_group_id")
    rows = frame.join(group, "reduction_group_id", "left_semi").where(F.col("record_idx") != record_idx)
    order = Window.orderBy(F.desc("is_representative"), F.desc("is_drop"), F.desc("sim"), "record_idx")
    return rows.withColumn("place", F.row_number().over(order)).where(F.col("place") <= siblings)


def record_flow(members: DataFrame, planned: int) -> DataFrame:
    """Planned records by what becomes of them."""
    c = members.agg(F.count_if("is_representative").alias("representatives"), F.count_if(F.col("is_protected") & ~F.col("is_representative")).alias("protected"), F.count_if(F.col("action").startswith("DROP")).alias("drops"))
    return c.select(F.lit(planned).cast("long").alias("planned"), "*", F.greatest(F.lit(0).cast("long"), F.lit(planned) - F.col("representatives") - F.col("protected") - F.col("drops")).alias("other"))


def export_preview(images: DataFrame) -> DataFrame:
    """Images kept, dropped, and with only some of their records dropped."""
    drop = F.col("image_action").startswith("DROP")
    return images.agg(F.count("*").alias("images"), F.count_if(drop).alias("dropped"), F.count_if(~drop).alias("kept"), F.count_if((F.col("drop_record_candidates") > 0) & (F.col("drop_record_candidates") < F.col("planned_records"))).alias("partial_labels"))


def focus(points: DataFrame, class_name: str) -> DataFrame:
    """Overlap points of a class or next to it, and their partners."""
    seeds = points.where((F.col("class_name") == class_name) | (F.col("other_class") == class_name))
    ids = seeds.select("record_idx").union(seeds.select(F.col("other_idx").alias("record_idx"))).distinct()
    return points.join(ids, "record_idx", "left_semi")
