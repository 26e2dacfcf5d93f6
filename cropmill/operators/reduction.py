"""Similarity reduction: tight edges, protected records, star cover, plan, image plan, overrides, export."""

from __future__ import annotations

from collections import defaultdict

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cropmill.operators.curation import ROW_BASE, image_rollup, numbered, with_sides
from cropmill.operators.graph import connected_components
from cropmill.operators.groups import farthest_first, id_list
from cropmill.storage import settle


def tight_edges(neighbors: DataFrame, records: DataFrame, threshold: float = 0.985, same_class: bool = True, same_size: bool = True) -> DataFrame:
    """Undirected edges; the similarity of a pair is the larger of its directions."""
    rows = with_sides(neighbors, records, "class_id", "size_bucket").where(F.col("similarity") >= threshold)
    if same_class:
        rows = rows.where("class_id = neighbor_class_id")
    if same_size:
        rows = rows.where("size_bucket = neighbor_size_bucket")
    pairs = rows.groupBy(F.least("record_idx", "neighbor_idx").alias("a"), F.greatest("record_idx", "neighbor_idx").alias("b")).agg(F.max("similarity").alias("similarity"))
    return pairs.select(F.col("a").alias("record_idx"), F.col("b").alias("neighbor_idx"), "similarity")


def protected_ids(neighbors: DataFrame, records: DataFrame, threshold: float = 0.90) -> DataFrame:
    """Both ends of every pair of different classes at or above the threshold."""
    rows = with_sides(neighbors, records, "class_id").where((F.col("similarity") >= threshold) & (F.col("class_id") != F.col("neighbor_class_id")))
    return rows.select(F.explode(F.array("record_idx", "neighbor_idx")).alias("record_idx")).distinct()


def star_cover(edges: list[tuple[int, int, float]], least: int = 2) -> list[tuple[int, list[tuple[int, float]]]]:
    """Greedy stars of one component: (representative, members with similarity), in the order in which they are taken.

    The representative has most open neighbours, then the largest sum of their similarities, then the smallest id.
    """
    near: dict[int, dict[int, float]] = defaultdict(dict)
    for a, b, s in edges:
        near[a][b] = near[b][a] = s
    open_, out = set(near), []
    degree = {n: len(x) for n, x in near.items()}
    weight = {n: sum(x.values()) for n, x in near.items()}

    def close(gone: list[int]) -> None:
        open_.difference_update(gone)
        for g in gone:
            for n, s in near[g].items():
                degree[n] -= 1
                weight[n] -= s

    while open_:
        rep = max(open_, key=lambda n: (degree[n], round(weight[n], 9), -n))
        members = sorted(n for n in near[rep] if n in open_)
        if len(members) + 1 < least:
            close([rep])
            continue
        out.append((rep, [(rep, 1.0), *((n, near[rep][n]) for n in members)]))
        close([rep, *members])
    return out


def reduction_members(edges: DataFrame, records: DataFrame, protected: DataFrame, least: int = 2, per_group: int = 1) -> DataFrame:
    """Members of the star cover with their actions. A representative is kept even if protected; then protection beats dropping.

    Star cover is sequential within a component, so a component is one task's work; ``tight`` thresholds keep components small.
    """
    roots = connected_components(edges, "record_idx", "neighbor_idx")
    rows = edges.join(roots.select(F.col("node").alias("record_idx"), "root"), "record_idx")

    def run(group: pd.DataFrame) -> pd.DataFrame:
        found = star_cover(list(zip(group["record_idx"].tolist(), group["neighbor_idx"].tolist(), group["similarity"].tolist(), strict=True)), least)
        return pd.DataFrame([(int(group["root"].iloc[0]), i, rep, n, s) for i, (rep, members) in enumerate(found) for n, s in members], columns=["root", "seq", "primary_representative_idx", "record_idx", "similarity_to_primary"])

    cover = rows.groupBy("root").applyInPandas(run, "root long, seq long, primary_representative_idx long, record_idx long, similarity_to_primary double")
    cover = settle(cover.withColumn("group_key", F.struct("root", "seq")), "cover")
    cover = numbered(cover, "group_key", "reduction_group_id").drop("group_key", "root", "seq")
    if per_group > 1:
        full = cover.join(records.select("record_idx", F.col("feature").cast("array<double>").alias("v")), "record_idx")

        def more(group: pd.DataFrame) -> pd.DataFrame:
            import numpy as np

            group = group.sort_values("record_idx")
            rep = int(group["primary_representative_idx"].iloc[0])
            ranked = farthest_first(np.array(group["v"].tolist()), group["record_idx"].tolist(), per_group)
            taken = [rep, *[i for i in ranked if i != rep][: per_group - 1]]
            return pd.DataFrame({"reduction_group_id": group["reduction_group_id"].iloc[0], "record_idx": taken, "pick": range(len(taken))})

        reps = full.groupBy("reduction_group_id").applyInPandas(more, "reduction_group_id long, record_idx long, pick long")
    else:
        reps = cover.groupBy("reduction_group_id").agg(F.first("primary_representative_idx").alias("record_idx")).withColumn("pick", F.lit(0).cast("long"))
    lists = reps.groupBy("reduction_group_id").agg(id_list(F.transform(F.array_sort(F.collect_list(F.struct("pick", "record_idx"))), lambda x: x["record_idx"])).alias("representative_indices"))
    flags = cover.join(lists, "reduction_group_id").join(reps.select("reduction_group_id", "record_idx", F.lit(True).alias("is_rep")), ["reduction_group_id", "record_idx"], "left").join(protected.select("record_idx", F.lit(True).alias("is_prot")), "record_idx", "left")
    rep, prot = (F.coalesce(F.col(c), F.lit(False)) for c in ("is_rep", "is_prot"))
    return flags.select("reduction_group_id", "record_idx", "primary_representative_idx", "representative_indices", rep.alias("is_representative"), prot.alias("is_protected"), "similarity_to_primary", member_action(rep, prot).alias("action"))


def member_action(representative, protected):
    return F.when(representative, "KEEP_REPRESENTATIVE").when(protected, "KEEP_PROTECTED_CROSS_CLASS").otherwise("DROP_TIGHT_DUPLICATE")


def reduction_groups(members: DataFrame, records: DataFrame) -> DataFrame:
    """One row per group: sizes, reduction, similarities, classes and sizes of its members."""
    info = members.join(records.select("record_idx", "class_id", "class_name", "size_bucket"), "record_idx")
    drop = F.col("action").startswith("DROP")
    out = info.groupBy("reduction_group_id").agg(
        F.count("*").alias("group_size"),
        F.count_if(drop).alias("drop_candidates"),
        F.count_if(~drop).alias("keep_count"),
        F.round(F.count_if(drop) * 100.0 / F.count("*"), 6).alias("natural_record_reduction_pct"),
        F.min("primary_representative_idx").alias("primary_representative_idx"),
        F.array_join(F.array_sort(F.collect_set(F.concat_ws(": ", F.col("class_id").cast("string"), "class_name"))), ", ").alias("classes"),
        F.array_join(F.array_sort(F.collect_set("size_bucket")), ", ").alias("size_buckets"),
        F.round(F.min("similarity_to_primary"), 6).alias("min_similarity_to_primary"),
        F.round(F.avg("similarity_to_primary"), 8).alias("mean_similarity_to_primary"),
    )
    head = records.select(F.col("record_idx").alias("primary_representative_idx"), "class_id", "class_name", F.col("image_path").alias("representative_image_path"))
    return out.join(head, "primary_representative_idx")


def reduction_recommendations(members: DataFrame, protected: DataFrame, touched: DataFrame, records: DataFrame) -> DataFrame:
    """Actions of all planned records: queries, their neighbours, group members and protected records."""
    ids = touched.select("record_idx").union(members.select("record_idx")).union(protected.select("record_idx")).distinct()
    rows = ids.join(members.select("record_idx", "reduction_group_id", "action"), "record_idx", "left").join(protected.select("record_idx", F.lit(True).alias("p")), "record_idx", "left").join(records, "record_idx")
    prot, free = F.coalesce(F.col("p"), F.lit(False)), F.col("action").isNull()
    action = F.coalesce("action", F.when(prot, "KEEP_PROTECTED_CROSS_CLASS").otherwise("KEEP"))
    reason = F.when(action == "KEEP_REPRESENTATIVE", "tight group representative").when(action == "KEEP_PROTECTED_CROSS_CLASS", "high similarity to another class").when(action == "DROP_TIGHT_DUPLICATE", "tight same-class feature duplicate").otherwise("not in a tight duplicate group")
    return rows.select(*[c for c in ROW_BASE if c in records.columns], "reduction_group_id", action.alias("action"), reason.alias("reason"), (~free).alias("is_grouped"), prot.alias("is_protected"))


def image_plan(recommendations: DataFrame, partial: bool = False) -> DataFrame:
    return image_rollup(recommendations, "plan", partial)


def is_partial(max_queries: int, total: int, filtered: bool, strict: bool = True) -> bool:
    """Whether a plan covers part of the data. ``strict`` also counts class and size filters, so that their drops are never called safe."""
    return 0 < max_queries < total or (strict and filtered)


def apply_overrides(recommendations: DataFrame, images: DataFrame, overrides: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Records and image plan after a user's wish to keep some of the dropped records."""
    wish = overrides.select("record_idx", F.lit(True).alias("wish")).distinct()
    hit = F.coalesce(F.col("wish"), F.lit(False)) & F.col("action").startswith("DROP")
    records = recommendations.join(wish, "record_idx", "left").withColumn("original_action", F.col("action")).withColumn("is_user_keep_override", hit).withColumn("action", F.when(hit, "KEEP_USER_OVERRIDE").otherwise(F.col("action"))).drop("wish")
    kept = records.where("is_user_keep_override").select("image_path", F.lit(True).alias("kept")).distinct()
    own = F.coalesce(F.col("kept"), F.lit(False))
    images = images.join(kept, "image_path", "left")
    images = images.withColumn("image_action", F.when(own, "KEEP_IMAGE_USER_OVERRIDE").otherwise(F.col("image_action"))).withColumn("drop_safety", F.when(own, "USER_OVERRIDE_KEEP").otherwise(F.col("drop_safety"))).withColumn("actions", F.when(own, F.concat("actions", F.lit(", KEEP_USER_OVERRIDE"))).otherwise(F.col("actions")))
    return records, images.drop("kept")


def split_images(images: DataFrame) -> DataFrame:
    """The image plan and ``is_dropped``: candidates whose drop is safe."""
    return images.withColumn("is_dropped", F.col("image_action").startswith("DROP") & (F.col("drop_safety") != "SAMPLE_ONLY_DO_NOT_DELETE"))


def filtered_labels(kept: DataFrame, files: DataFrame) -> DataFrame:
    """New text of label files: lines of kept annotations, in order. ``files`` has ``label_path`` and ``content``; a file without lines is left out."""
    lines = files.select("label_path", F.posexplode(F.split("content", "\r\n|\n|\r")).alias("annotation_line", "line"))
    wanted = kept.select("label_path", F.col("annotation_line").cast("int").alias("annotation_line")).distinct()
    found = lines.join(wanted, ["label_path", "annotation_line"], "left_semi")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("annotation_line", "line"))), lambda x: x["line"]), "\n")
    return found.groupBy("label_path").agg(F.count("*").alias("kept_annotations"), text.alias("content"))
