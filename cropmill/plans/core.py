"""Queries of search, curation, reduction and calibration."""

from __future__ import annotations

from pyspark.sql import functions as F

from cropmill.operators import calibration, curation, groups, ivf, knn, reduction
from cropmill.plans import cover
from cropmill.plans.views import BOUNDARY, CC, CROSS, EDGES, GRP, MEM, NEAR, RARE, REC, medoid, members, nb, neighbors, records, sql
from cropmill.storage import settle

QUERIES, ORACLE_SQL = {}, {}


def query(oracle: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLE_SQL[f.__name__] = oracle
        return f

    return add


def sim():
    return F.round("similarity", 6).alias("similarity")


def full(spark, sf):
    return records(spark, sf).withColumn("feature", F.col("embedding").cast("array<double>"))


def emb_nb(k: int, extra: str = "") -> str:
    score = "list_inner_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[])"
    return f"SELECT a.vec_id AS record_idx, b.vec_id AS neighbor_idx, round({score}, 6) AS similarity, row_number() OVER (PARTITION BY a.vec_id ORDER BY {score} DESC, b.vec_id) AS rank FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id {extra} QUALIFY rank <= {k}"


@query(emb_nb(10))
def knn_topk(spark, sf):
    rows = full(spark, sf)
    return knn.knn_join(rows, rows, 10).select("record_idx", "neighbor_idx", sim(), "rank")


_COS = "(list_inner_product(a.f, b.f) / (sqrt(list_inner_product(a.f, a.f)) * sqrt(list_inner_product(b.f, b.f))))"


@query(sql(f"SELECT a.record_idx, b.record_idx AS neighbor_idx, round({_COS}, 6) AS similarity, row_number() OVER (PARTITION BY a.record_idx ORDER BY {_COS} DESC, b.record_idx) AS rank FROM (SELECT vec_id AS record_idx, embedding::DOUBLE[] AS f FROM embeddings) a JOIN (SELECT vec_id AS record_idx, embedding::DOUBLE[] AS f FROM embeddings) b ON a.record_idx <> b.record_idx QUALIFY rank <= 5"))
def knn_rerank_cosine(spark, sf):
    rows = full(spark, sf)
    return knn.knn_join(rows, rows, 5, width=knn.search_width(1 << 30, 5, 50, 4)).select("record_idx", "neighbor_idx", sim(), "rank")


@query(sql("SELECT record_idx, neighbor_idx, round(similarity, 6) AS similarity, rank FROM nb", REC, nb(8)))
def search_record_exclude_self(spark, sf):
    own = records(spark, sf)
    return knn.without_same_box(knn.knn_join(own, own, 9, exclude_self=False), own, 8).select("record_idx", "neighbor_idx", sim(), "rank")


@query(sql("SELECT n.rank, n.neighbor_idx AS record_id, n.nclass AS class_id, n.nname AS class_name, n.nsize AS size_bucket, round(n.similarity, 5) AS similarity, r.image_path FROM nb n JOIN rec r ON r.record_idx = n.neighbor_idx WHERE n.record_idx = 7", REC, nb(10)))
def search_result_display(spark, sf):
    own = records(spark, sf)
    found = knn.knn_join(own.where("record_idx = 7"), own, 10)
    return curation.with_sides(found, own, "class_id", "class_name", "size_bucket", "image_path").select("rank", F.col("neighbor_idx").alias("record_id"), F.col("neighbor_class_id").alias("class_id"), F.col("neighbor_class_name").alias("class_name"), F.col("neighbor_size_bucket").alias("size_bucket"), F.round("similarity", 5).alias("similarity"), F.col("neighbor_image_path").alias("image_path"))


@query(sql("SELECT a AS record_idx, b AS neighbor_idx, round(e.s, 6) AS similarity, e.c AS class_id, e.n AS class_name, e.z AS size_bucket FROM nd", REC, nb(), EDGES))
def near_duplicate_edges(spark, sf):
    return curation.near_duplicate_edges(neighbors(spark, sf), records(spark, sf), NEAR).withColumn("similarity", F.round("similarity", 6))


@query(sql(f"SELECT record_idx, neighbor_idx, round(similarity, 6) AS similarity, class_id, class_name, nclass AS neighbor_class_id, nname AS neighbor_class_name, size_bucket, nsize AS neighbor_size_bucket FROM nb WHERE similarity >= {CROSS} AND class_id <> nclass", REC, nb()))
def cross_class_edges(spark, sf):
    return curation.cross_class_edges(neighbors(spark, sf), records(spark, sf), CROSS).withColumn("similarity", F.round("similarity", 6))


_SUMMARY = "ns AS (SELECT record_idx, arg_min(neighbor_idx, rank) AS top1_idx, round(arg_min(similarity, rank), 6) AS top1_similarity, arg_min(nname, rank) AS top1_class, arg_min(class_id = nclass, rank) AS top1_same_class, count(*) FILTER (class_id = nclass) AS same_class_neighbors, count(*) FILTER (class_id <> nclass) AS cross_class_neighbors, count(*) FILTER (size_bucket = nsize) AS same_size_neighbors FROM nb GROUP BY 1)"


@query(sql("SELECT * FROM ns", REC, nb(), _SUMMARY))
def neighbor_summary(spark, sf):
    return curation.neighbor_summary(neighbors(spark, sf), records(spark, sf)).withColumn("top1_similarity", F.round("top1_similarity", 6))


def _edges(spark, sf):
    return curation.near_duplicate_edges(neighbors(spark, sf), records(spark, sf), NEAR)


@query(sql("SELECT record_idx, root FROM cc", REC, nb(), EDGES, CC))
def duplicate_components(spark, sf):
    return curation.duplicate_components(_edges(spark, sf))


DUP = "dg AS (SELECT c.record_idx, dense_rank() OVER (ORDER BY c.root) AS duplicate_group_id, r.f FROM cc c JOIN rec r USING (record_idx))"


@query(sql("SELECT d.duplicate_group_id, d.record_idx, m.representative_idx, d.record_idx = m.representative_idx AS is_representative, r.class_id, r.class_name, r.size_bucket, r.image_path, r.file_name FROM dg d JOIN dm m USING (duplicate_group_id) JOIN rec r USING (record_idx)", REC, nb(), EDGES, CC, DUP, medoid("dg", "duplicate_group_id", "dm")))
def duplicate_groups(spark, sf):
    return curation.duplicate_groups(_edges(spark, sf), records(spark, sf))


KEYS = "class_id, class_name, size_bucket"
GM = medoid("rec", KEYS, "gm")


@query(sql(f"SELECT {KEYS}, representative_idx FROM gm", REC, GM))
def group_medoid(spark, sf):
    return groups.medoids(records(spark, sf), ["class_id", "class_name", "size_bucket"])


GB = f"gb AS (SELECT {KEYS}, record_idx, row_number() OVER (PARTITION BY {KEYS} ORDER BY score, record_idx) AS boundary_rank FROM gm_s QUALIFY boundary_rank <= {BOUNDARY} AND count(*) OVER (PARTITION BY {KEYS}) > 1)"


@query(sql("SELECT * FROM gb", REC, GM, GB))
def group_boundary(spark, sf):
    return groups.boundaries(records(spark, sf), ["class_id", "class_name", "size_bucket"], BOUNDARY)


@query(sql(f"SELECT r.class_id, r.class_name, r.size_bucket, count(*) AS count, any_value(gm.representative_idx) AS representative_idx, coalesce(any_value(b.l), '') AS boundary_indices, count(*) <= {RARE} AS is_rare_group FROM rec r JOIN gm USING ({KEYS}) LEFT JOIN (SELECT {KEYS}, string_agg(record_idx::VARCHAR, ' ' ORDER BY boundary_rank) AS l FROM gb GROUP BY ALL) b USING ({KEYS}) GROUP BY 1, 2, 3", REC, GM, GB))
def rare_groups(spark, sf):
    return curation.group_summary(records(spark, sf), RARE, BOUNDARY)


RECO = f"""xe AS (SELECT record_idx, neighbor_idx FROM nb WHERE similarity >= {CROSS} AND class_id <> nclass),
xr AS (SELECT record_idx FROM xe UNION SELECT neighbor_idx FROM xe),
gc AS (SELECT {KEYS}, count(*) AS n FROM rec GROUP BY ALL),
fl AS (SELECT r.*, r.record_idx IN (SELECT record_idx FROM xr) AS review, gc.n <= {RARE} AS rare, (r.record_idx IN (SELECT representative_idx FROM gm) OR r.record_idx IN (SELECT representative_idx FROM dm)) AS head, r.record_idx IN (SELECT record_idx FROM gb) AS edge, r.record_idx IN (SELECT record_idx FROM cc) AS dup FROM rec r JOIN gc USING ({KEYS})),
rc AS (SELECT *, CASE WHEN review THEN 'REVIEW_CROSS_CLASS' WHEN rare THEN 'KEEP_RARE' WHEN head THEN 'KEEP_REPRESENTATIVE' WHEN edge THEN 'KEEP_BOUNDARY' WHEN dup THEN 'DROP_NEAR_DUPLICATE' ELSE 'KEEP' END AS action FROM fl),
rr AS (SELECT *, concat_ws('; ', CASE WHEN review THEN 'high similarity to another class' END, CASE WHEN rare THEN 'rare class/size group' END, CASE WHEN head THEN 'group representative' END, CASE WHEN edge THEN 'feature boundary sample' END, CASE WHEN action = 'DROP_NEAR_DUPLICATE' THEN 'same-class same-size duplicate' END) AS reason FROM rc)"""
RECO_CTES = (REC, nb(), EDGES, CC, DUP, medoid("dg", "duplicate_group_id", "dm"), GM, GB, RECO)


def _reco(spark, sf):
    return curation.curation_recommendations(records(spark, sf), neighbors(spark, sf), NEAR, CROSS, RARE, BOUNDARY)


@query(sql("SELECT rr.record_idx, class_id, class_name, size_bucket, image_path, action, reason, ns.* EXCLUDE (record_idx) FROM rr LEFT JOIN ns USING (record_idx)", *RECO_CTES, _SUMMARY))
def curation_recommendations(spark, sf):
    return _reco(spark, sf).select("record_idx", "class_id", "class_name", "size_bucket", "image_path", "action", "reason", "top1_idx", F.round("top1_similarity", 6).alias("top1_similarity"), "top1_class", "top1_same_class", "same_class_neighbors", "cross_class_neighbors", "same_size_neighbors")


@query(sql("SELECT image_path, min(label_path) AS label_path, any_value(file_name) AS file_name, CASE WHEN bool_or(action LIKE 'REVIEW%') THEN 'REVIEW_IMAGE' WHEN bool_and(action LIKE 'DROP%') THEN 'DROP_IMAGE_CANDIDATE' ELSE 'KEEP_IMAGE' END AS image_action, CASE WHEN bool_and(action LIKE 'DROP%') THEN 'SAFE_ONLY_IN_FULL_REPORT' ELSE 'KEEP_OR_REVIEW' END AS drop_safety, count(*) AS sampled_records, string_agg(DISTINCT action, ', ' ORDER BY action) AS actions, string_agg(DISTINCT class_name, ', ' ORDER BY class_name) AS classes FROM rr GROUP BY 1", *RECO_CTES))
def image_recommendations(spark, sf):
    return curation.image_rollup(_reco(spark, sf), "report")


@query(sql("SELECT action, count(*) AS records, round(count(*) * 100.0 / sum(count(*)) OVER (), 2) AS pct FROM rr GROUP BY 1", *RECO_CTES))
def curation_summary(spark, sf):
    return curation.action_summary(_reco(spark, sf))


IMAGE_PLAN = """ip AS (SELECT image_path, min(label_path) AS label_path, any_value(file_name) AS file_name, CASE WHEN bool_and(action LIKE 'DROP%') THEN 'DROP_IMAGE_CANDIDATE' ELSE 'KEEP_IMAGE' END AS image_action, CASE WHEN bool_and(action LIKE 'DROP%') THEN 'SAFE_ONLY_IN_FULL_PLAN' ELSE 'KEEP_OR_REVIEW' END AS drop_safety, count(*) AS planned_records, count(*) FILTER (action LIKE 'DROP%') AS drop_record_candidates, string_agg(DISTINCT action, ', ' ORDER BY action) AS actions, string_agg(DISTINCT class_name, ', ' ORDER BY class_name) AS classes FROM sr GROUP BY 1)"""

TIGHT = f"te AS (SELECT least(record_idx, neighbor_idx) AS record_idx, greatest(record_idx, neighbor_idx) AS neighbor_idx, max(similarity) AS similarity FROM nb WHERE similarity >= {NEAR} AND class_id = nclass AND size_bucket = nsize GROUP BY 1, 2)"


@query(sql("SELECT record_idx, neighbor_idx, round(similarity, 6) AS similarity FROM te", REC, nb(30), TIGHT))
def tight_edges(spark, sf):
    return reduction.tight_edges(neighbors(spark, sf, 30), records(spark, sf), NEAR).withColumn("similarity", F.round("similarity", 6))


@query(sql(f"SELECT record_idx FROM nb WHERE similarity >= {CROSS} AND class_id <> nclass UNION SELECT neighbor_idx FROM nb WHERE similarity >= {CROSS} AND class_id <> nclass", REC, nb(30)))
def protected_ids(spark, sf):
    return reduction.protected_ids(neighbors(spark, sf, 30), records(spark, sf), CROSS)


def _plan(spark, sf, per_group: int = 1):
    near, own = settle(neighbors(spark, sf, 30), "neighbors"), records(spark, sf)
    protected = reduction.protected_ids(near, own, CROSS)
    return reduction.reduction_members(reduction.tight_edges(near, own, NEAR), own, protected, 2, per_group), protected, near, own


@query(sql("SELECT * REPLACE (round(similarity_to_primary, 6) AS similarity_to_primary) FROM mem", REC, nb(30), TIGHT, cover.MEMBERS))
def reduction_members(spark, sf):
    return _plan(spark, sf)[0].withColumn("similarity_to_primary", F.round("similarity_to_primary", 6))


@query(sql("SELECT * REPLACE (round(similarity_to_primary, 6) AS similarity_to_primary) FROM mem", REC, nb(30), TIGHT, cover.MEMBERS2))
def reduction_members_two_representatives(spark, sf):
    return _plan(spark, sf, 2)[0].withColumn("similarity_to_primary", F.round("similarity_to_primary", 6))


@query(sql("SELECT * FROM grph", REC, nb(30), TIGHT, cover.MEMBERS, GRP))
def reduction_groups(spark, sf):
    found, _, _, own = _plan(spark, sf)
    return reduction.reduction_groups(found, own)


@query(sql(f"SELECT *, {cover.REASONS} FROM sr", REC, nb(30), TIGHT, cover.MEMBERS, cover.RECOMMENDED))
def reduction_recommendations(spark, sf):
    found, protected, near, own = _plan(spark, sf)
    touched = near.select("record_idx").union(near.select(F.col("neighbor_idx").alias("record_idx"))).distinct()
    return reduction.reduction_recommendations(found, protected, touched, own).drop("bbox").withColumn("area_pct", F.round("area_pct", 6))


@query(sql("SELECT * FROM ip", REC, nb(30), TIGHT, cover.MEMBERS, cover.RECOMMENDED, IMAGE_PLAN))
def reduction_image_plan(spark, sf):
    return reduction.image_plan(reduction_recommendations(spark, sf))


@query(sql("SELECT class_name, unnest(list_transform(t, lambda x: x.i)) AS record_idx, unnest(range(1, len(t) + 1))::INT AS pick FROM t5", REC, cover.FARTHEST))
def representatives_farthest_first(spark, sf):
    return groups.representatives(records(spark, sf), "class_name", 5)


def _standin(spark, sf):
    """Recommendations and image plan of the stand-in members."""
    own = records(spark, sf)
    reco = members(spark, sf).join(own.select("record_idx", "class_name", "image_path", "label_path", "annotation_line"), "record_idx")
    return reco, reduction.image_plan(reco)


STANDIN = f"""sr AS (SELECT m.*, r.class_name, r.image_path, r.label_path, r.file_name, r.annotation_line FROM mem m JOIN rec r USING (record_idx)),
{IMAGE_PLAN},
ov AS (SELECT *, action AS original_action, (record_idx % 5 = 1 AND action LIKE 'DROP%') AS is_user_keep_override FROM sr),
oi AS (SELECT DISTINCT image_path AS p FROM ov WHERE is_user_keep_override),
io AS (SELECT image_path, label_path, file_name, CASE WHEN p IS NULL THEN image_action ELSE 'KEEP_IMAGE_USER_OVERRIDE' END AS image_action, CASE WHEN p IS NULL THEN drop_safety ELSE 'USER_OVERRIDE_KEEP' END AS drop_safety, planned_records, drop_record_candidates, CASE WHEN p IS NULL THEN actions ELSE actions || ', KEEP_USER_OVERRIDE' END AS actions, classes FROM ip LEFT JOIN oi ON p = image_path)"""


def _wishes(spark, sf):
    return records(spark, sf).where("record_idx % 5 = 1").select("record_idx")


@query(sql("SELECT * FROM ip", REC, MEM, STANDIN))
def image_plan_rollup(spark, sf):
    return _standin(spark, sf)[1]


@query(sql("SELECT record_idx, CASE WHEN is_user_keep_override THEN 'KEEP_USER_OVERRIDE' ELSE action END AS action, original_action, is_user_keep_override FROM ov", REC, MEM, STANDIN))
def apply_overrides(spark, sf):
    return reduction.apply_overrides(*_standin(spark, sf), _wishes(spark, sf))[0].select("record_idx", "action", "original_action", "is_user_keep_override")


@query(sql("SELECT *, (image_action LIKE 'DROP%' AND drop_safety <> 'SAMPLE_ONLY_DO_NOT_DELETE') AS is_dropped FROM io", REC, MEM, STANDIN))
def export_split(spark, sf):
    return reduction.split_images(reduction.apply_overrides(*_standin(spark, sf), _wishes(spark, sf))[1])


@query(sql("SELECT label_path, count(*) AS kept_annotations, string_agg(class_id || ' 0.5 0.5 0.1 0.' || (record_idx % 9 + 1), chr(10) ORDER BY annotation_line) AS content FROM rec JOIN (SELECT record_idx, action FROM mem WHERE action NOT LIKE 'DROP%') USING (record_idx) GROUP BY 1", REC, MEM))
def filtered_labels(spark, sf):
    own = records(spark, sf)
    line = F.format_string("%d 0.5 0.5 0.1 0.%d", "class_id", F.col("record_idx") % 9 + 1)
    files = own.groupBy("label_path").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("annotation_line", line.alias("t")))), lambda x: x["t"]), "\n").alias("content"))
    kept = _standin(spark, sf)[0].where(~F.col("action").startswith("DROP"))
    return reduction.filtered_labels(kept, files)


W = 0.02
CAL = f"""cal0 AS (SELECT record_idx, class_id, class_name, file_name, arg_min(similarity, rank) AS top1_similarity, arg_min(neighbor_idx, rank) AS top1_record_idx, arg_min(nclass, rank) AS top1_class_id, arg_min(nname, rank) AS top1_class_name, arg_min(class_id = nclass, rank) AS top1_same_class, avg((class_id = nclass)::INT) AS topk_same_class_ratio, count(*) AS topk FROM nb GROUP BY 1, 2, 3, 4),
vote AS (SELECT record_idx, nname, count(*) AS n, min(rank) AS r FROM nb GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY record_idx ORDER BY count(*) DESC, min(rank)) = 1),
cal AS (SELECT c.*, v.nname AS topk_majority_class, v.n / c.topk AS topk_majority_ratio, floor(top1_similarity / {W}::DOUBLE) * {W}::DOUBLE AS similarity_bin_start FROM cal0 c JOIN vote v USING (record_idx)),
cald AS (SELECT *, printf('%.3f-%.3f', similarity_bin_start, similarity_bin_start + {W}::DOUBLE) AS similarity_bin FROM cal)"""


def _detail(spark, sf):
    return calibration.detail(neighbors(spark, sf, 10), records(spark, sf), W)


@query(sql("SELECT * EXCLUDE (similarity_bin_start) REPLACE (round(top1_similarity, 6) AS top1_similarity, round(topk_same_class_ratio, 6) AS topk_same_class_ratio, round(topk_majority_ratio, 6) AS topk_majority_ratio) FROM cald", REC, nb(10), CAL))
def calibration_detail(spark, sf):
    rows = _detail(spark, sf).drop("similarity_bin_start")
    for c in ("top1_similarity", "topk_same_class_ratio", "topk_majority_ratio"):
        rows = rows.withColumn(c, F.round(c, 6))
    return rows


@query(sql("SELECT similarity_bin, count(*) AS count, round(avg(top1_same_class::INT) * 100, 2) AS top1_same_class_rate, round(avg(top1_similarity), 4) AS mean_top1_similarity, round(avg(topk_same_class_ratio) * 100, 2) AS mean_topk_same_class_ratio, round(avg(topk_majority_ratio) * 100, 2) AS mean_topk_majority_ratio FROM cald GROUP BY 1", REC, nb(10), CAL))
def calibration_bins(spark, sf):
    return calibration.bins(_detail(spark, sf))


@query(sql("SELECT t AS similarity_threshold, count(*) FILTER (top1_similarity >= t) AS count, round(count(*) FILTER (top1_similarity >= t) * 100.0 / count(*), 2) AS coverage_pct, round(avg(top1_same_class::INT) FILTER (top1_similarity >= t) * 100, 2) AS top1_same_class_rate, round(avg(topk_same_class_ratio) FILTER (top1_similarity >= t) * 100, 2) AS mean_topk_same_class_ratio FROM cald, (SELECT unnest([0.70, 0.75, 0.80, 0.85, 0.88, 0.90, 0.92, 0.95, 0.97, 0.98]::DOUBLE[]) AS t) GROUP BY 1", REC, nb(10), CAL))
def calibration_thresholds(spark, sf):
    return calibration.thresholds(_detail(spark, sf))


@query(sql("SELECT class_id, class_name, count(*) AS count, round(avg(top1_similarity), 4) AS mean_top1_similarity, round(avg(top1_same_class::INT) * 100, 2) AS top1_same_class_rate, round(avg(topk_same_class_ratio) * 100, 2) AS mean_topk_same_class_ratio FROM cald GROUP BY 1, 2", REC, nb(10), CAL))
def calibration_classes(spark, sf):
    return calibration.classes(_detail(spark, sf))


def _ivf(spark, sf, nprobe: int, rerank_k: int):
    rows = full(spark, sf)
    return ivf.build(rows, nlist=8, m=8, train=2_000).search(rows.where("record_idx % 10 = 0"), 10, nprobe, rerank_k)


@query()
def ivf_topk(spark, sf):
    return _ivf(spark, sf, 4, 200)


@query(sql(f"SELECT a.record_idx, b.record_idx AS neighbor_idx, round({_COS}, 6) AS similarity, row_number() OVER (PARTITION BY a.record_idx ORDER BY {_COS} DESC, b.record_idx) AS rank FROM (SELECT vec_id AS record_idx, embedding::DOUBLE[] AS f FROM embeddings WHERE vec_id % 10 = 0) a JOIN (SELECT vec_id AS record_idx, embedding::DOUBLE[] AS f FROM embeddings) b ON a.record_idx <> b.record_idx QUALIFY rank <= 10"))
def ivf_topk_all_cells(spark, sf):
    """The index with all cells probed and all candidates reranked is exact; it is saved and opened again on the way."""
    from cropmill.storage import fresh_path

    rows, path = full(spark, sf), fresh_path(spark, "index")
    ivf.build(rows, nlist=8, m=8, train=2_000).save(path)
    found = ivf.open_index(spark, path).search(rows.where("record_idx % 10 = 0"), 10, 8, 1 << 30)
    return found.select("record_idx", "neighbor_idx", sim(), "rank")
