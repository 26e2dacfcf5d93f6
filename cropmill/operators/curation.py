"""The curation report: duplicate and overlap edges, neighbour summaries, groups, keep/review/drop actions, and their image roll-up."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cropmill.functions.text import file_name
from cropmill.operators.graph import connected_components
from cropmill.operators.groups import boundaries, id_list, medoids
from cropmill.storage import settle

# The columns of report rows.
ROW_BASE = ("record_idx", "record_id", "class_id", "class_name", "size_bucket", "area_pct", "bbox_width", "bbox_height", "aspect_bucket", "image_path", "label_path", "file_name", "bbox", "annotation_line")


def with_sides(neighbors: DataFrame, records: DataFrame, *columns: str) -> DataFrame:
    """Neighbour pairs with columns of both records: ``c`` of the query, ``neighbor_c`` of the neighbour."""
    own = records.select("record_idx", *columns)
    other = records.select(F.col("record_idx").alias("neighbor_idx"), *[F.col(c).alias(f"neighbor_{c}") for c in columns])
    return neighbors.join(own, "record_idx").join(other, "neighbor_idx")


def near_duplicate_edges(neighbors: DataFrame, records: DataFrame, threshold: float = 0.98) -> DataFrame:
    """Undirected edges of one class and size bucket; of two directions the one of the smaller query stands."""
    sided = with_sides(neighbors, records, "class_id", "class_name", "size_bucket").where((F.col("similarity") >= threshold) & (F.col("class_id") == F.col("neighbor_class_id")) & (F.col("size_bucket") == F.col("neighbor_size_bucket")))
    a, b = F.least("record_idx", "neighbor_idx"), F.greatest("record_idx", "neighbor_idx")
    edges = sided.select(a.alias("a"), b.alias("b"), "record_idx", "similarity", "class_id", "class_name", "size_bucket")
    best = edges.groupBy("a", "b").agg(F.min_by(F.struct("similarity", "class_id", "class_name", "size_bucket"), "record_idx").alias("e"))
    return best.select(F.col("a").alias("record_idx"), F.col("b").alias("neighbor_idx"), "e.*")


def cross_class_edges(neighbors: DataFrame, records: DataFrame, threshold: float = 0.90) -> DataFrame:
    """Directed edges between classes."""
    sided = with_sides(neighbors, records, "class_id", "class_name", "size_bucket")
    return sided.where((F.col("similarity") >= threshold) & (F.col("class_id") != F.col("neighbor_class_id"))).select("record_idx", "neighbor_idx", "similarity", "class_id", "class_name", "neighbor_class_id", "neighbor_class_name", "size_bucket", "neighbor_size_bucket")


def neighbor_summary(neighbors: DataFrame, records: DataFrame) -> DataFrame:
    """Each query's nearest neighbour and how many of its neighbours share its class and size bucket."""
    sided = with_sides(neighbors, records, "class_id", "class_name", "size_bucket")
    same = F.col("class_id") == F.col("neighbor_class_id")
    top = F.min_by(F.struct(F.col("neighbor_idx").alias("top1_idx"), F.col("similarity").alias("top1_similarity"), F.col("neighbor_class_name").alias("top1_class"), same.alias("top1_same_class")), "rank")
    out = sided.groupBy("record_idx").agg(top.alias("t"), F.count_if(same).alias("same_class_neighbors"), F.count_if(~same).alias("cross_class_neighbors"), F.count_if(F.col("size_bucket") == F.col("neighbor_size_bucket")).alias("same_size_neighbors"))
    return out.select("record_idx", "t.*", "same_class_neighbors", "cross_class_neighbors", "same_size_neighbors")


def duplicate_components(edges: DataFrame) -> DataFrame:
    """``(record_idx, root)`` of the components of the edges; the root is the smallest member."""
    return connected_components(edges, "record_idx", "neighbor_idx").select(F.col("node").alias("record_idx"), "root")


def numbered(rows: DataFrame, key: str, out: str) -> DataFrame:
    """Dense numbers from 1 for the distinct keys, in their order.

    Keys are sorted by range and counted by partition, so no task sees them all.
    """
    keys = rows.select(key).distinct().repartitionByRange(key).sortWithinPartitions(key)
    keys = keys.withColumn("p", F.spark_partition_id()).withColumn("i", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)))
    keys = settle(keys, "numbers")
    before = keys.groupBy("p").agg(F.count("*").alias("n")).withColumn("before", F.coalesce(F.sum("n").over(Window.orderBy("p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return rows.join(keys.join(before, "p").select(key, (F.col("before") + F.col("i") + 1).alias(out)), key)


def duplicate_groups(edges: DataFrame, records: DataFrame) -> DataFrame:
    """Members of duplicate components, numbered by their roots, with their medoids."""
    members = numbered(duplicate_components(edges), "root", "duplicate_group_id").join(records, "record_idx")
    best = medoids(members, ["duplicate_group_id"])
    return members.join(best, "duplicate_group_id").select("duplicate_group_id", "record_idx", "representative_idx", (F.col("record_idx") == F.col("representative_idx")).alias("is_representative"), "class_id", "class_name", "size_bucket", "image_path", file_name(F.col("image_path")).alias("file_name"))


def group_summary(records: DataFrame, rare_max: int = 5, boundary_count: int = 2) -> DataFrame:
    """Class and size groups: count, medoid, boundary members, and whether the group is rare."""
    keys = ["class_id", "class_name", "size_bucket"]
    counts = records.groupBy(*keys).agg(F.count("*").alias("count"))
    edge = boundaries(records, keys, boundary_count).groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("boundary_rank", "record_idx"))), lambda x: x["record_idx"]).alias("b"))
    out = counts.join(medoids(records, keys), keys).join(edge, keys, "left")
    return out.select(*keys, "count", "representative_idx", id_list(F.coalesce("b", F.array().cast("array<bigint>"))).alias("boundary_indices"), (F.col("count") <= rare_max).alias("is_rare_group"))


def curation_recommendations(records: DataFrame, neighbors: DataFrame, near_threshold: float = 0.98, cross_threshold: float = 0.90, rare_max: int = 5, boundary_count: int = 2, known: DataFrame | None = None) -> DataFrame:
    """An action and its reasons for every record: review, rare, representative, boundary, near duplicate, keep, in this order of weight.

    ``known`` has the records that neighbours may be, where ``records`` are a sample of them.
    """
    known = records if known is None else known
    keys = ["class_id", "class_name", "size_bucket"]
    neighbors = settle(neighbors, "neighbors")  # read three times below; the search is what costs
    near = near_duplicate_edges(neighbors, known, near_threshold)
    cross = cross_class_edges(neighbors, known, cross_threshold)
    review = cross.select("record_idx").unionByName(cross.select(F.col("neighbor_idx").alias("record_idx"))).distinct().withColumn("review", F.lit(True))
    dups = duplicate_groups(near, known).select("record_idx", F.lit(True).alias("dup"), "is_representative")
    counts = records.groupBy(*keys).agg(F.count("*").alias("group_count"))
    medoid = medoids(records, keys).select(F.col("representative_idx").alias("record_idx"), F.lit(True).alias("medoid")).distinct()
    edge = boundaries(records, keys, boundary_count).select("record_idx", F.lit(True).alias("edge")).distinct()
    flags = records.join(counts, keys).join(review, "record_idx", "left").join(dups, "record_idx", "left").join(medoid, "record_idx", "left").join(edge, "record_idx", "left")
    is_ = lambda c: F.coalesce(F.col(c), F.lit(False))
    rare, head = F.col("group_count") <= rare_max, is_("medoid") | is_("is_representative")
    action = F.when(is_("review"), "REVIEW_CROSS_CLASS").when(rare, "KEEP_RARE").when(head, "KEEP_REPRESENTATIVE").when(is_("edge"), "KEEP_BOUNDARY").when(is_("dup"), "DROP_NEAR_DUPLICATE").otherwise("KEEP")
    reason = F.concat_ws("; ", F.when(is_("review"), "high similarity to another class"), F.when(rare, "rare class/size group"), F.when(head, "group representative"), F.when(is_("edge"), "feature boundary sample"), F.when(action == "DROP_NEAR_DUPLICATE", "same-class same-size duplicate"))
    return flags.select(*[c for c in ROW_BASE if c in records.columns], action.alias("action"), reason.alias("reason")).join(neighbor_summary(neighbors, known), "record_idx", "left")


def image_rollup(recommendations: DataFrame, kind: str = "report", partial: bool = False) -> DataFrame:
    """Image actions: drop if all records drop. ``kind`` ``report`` reviews images with review records, ``plan`` keeps protected ones.

    ``partial`` marks drops of a sampled or filtered run as unsafe.
    """
    drop = F.col("action").startswith("DROP")
    all_drop = F.bool_and(drop)
    agg = [F.min("label_path").alias("label_path"), F.count("*").alias("n"), F.count_if(drop).alias("d"), F.array_join(F.array_sort(F.collect_set("action")), ", ").alias("actions"), F.array_join(F.array_sort(F.collect_set("class_name")), ", ").alias("classes"), all_drop.alias("all_drop"), F.bool_or(F.col("action").startswith("REVIEW")).alias("review")]
    out = recommendations.groupBy("image_path").agg(*agg)
    action = F.when(F.col("all_drop"), "DROP_IMAGE_CANDIDATE").otherwise("KEEP_IMAGE")
    if kind == "report":
        action = F.when(F.col("review"), "REVIEW_IMAGE").otherwise(action)
    safe = "SAFE_ONLY_IN_FULL_REPORT" if kind == "report" else "SAFE_ONLY_IN_FULL_PLAN"
    safety = F.when(action != "DROP_IMAGE_CANDIDATE", "KEEP_OR_REVIEW").otherwise("SAMPLE_ONLY_DO_NOT_DELETE" if partial else safe)
    counts = [F.col("n").alias("sampled_records")] if kind == "report" else [F.col("n").alias("planned_records"), F.col("d").alias("drop_record_candidates")]
    return out.select("image_path", "label_path", file_name(F.col("image_path")).alias("file_name"), action.alias("image_action"), safety.alias("drop_safety"), *counts, "actions", "classes")


def action_summary(recommendations: DataFrame) -> DataFrame:
    """Counts and shares of actions."""
    return recommendations.groupBy("action").agg(F.count("*").alias("records")).withColumn("pct", F.round(F.col("records") * 100.0 / F.sum("records").over(Window.partitionBy()), 2))


def sample_rows(rows: DataFrame, n: int, seed: int, id_col: str = "record_idx") -> DataFrame:
    """A bounded uniform sample without replacement: the ``n`` smallest MD5 sums of ``id:seed``. Sampling is the feature here."""
    return rows.orderBy(random_order(id_col, seed), id_col).limit(n) if n > 0 else rows


def random_order(id_col: str, seed: int) -> Column:
    """A sort key that shuffles rows, the same each time for one seed."""
    return F.md5(F.concat_ws(":", F.col(id_col).cast("string"), F.lit(str(seed))))


def is_drop(action: Column) -> Column:
    return action.startswith("DROP")
