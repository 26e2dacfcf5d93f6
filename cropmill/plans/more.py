"""Queries of galleries, whole outputs, detections and samples as queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from cropmill.functions import geometry, text
from cropmill.operators import calibration, clustering, curation, galleries, outputs
from cropmill.operators.knn import knn_join
from cropmill.plans import cover
from cropmill.plans.core import CAL, IMAGE_PLAN, TIGHT, W, _detail
from cropmill.plans.extras import _detector_rows
from cropmill.plans.reports import _CL, _OV, _clustered, _groups, _images, _label_files, _near3
from cropmill.plans.views import BOUNDARY, CROSS, GRP, MEM, NEAR, RARE, REC, medoid, members, nb, neighbors, records, sql
from cropmill.sources import labels

QUERIES, ORACLE_SQL = {}, {}


def query(oracle: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLE_SQL[f.__name__] = oracle
        return f

    return add


_DROPS = """dr AS (SELECT m.record_idx, m.reduction_group_id, m.similarity_to_primary, m.action, r.class_name, m.record_idx % 5 = 1 AS user_keep_override, g.group_size
  FROM mem m JOIN rec r USING (record_idx) JOIN grp g USING (reduction_group_id) WHERE m.action LIKE 'DROP%')"""


def _gallery(spark, sf, **options):
    rows = members(spark, sf).where("action like 'DROP%'").join(records(spark, sf).select("record_idx", "class_name"), "record_idx")
    rows = rows.withColumn("user_keep_override", F.col("record_idx") % 5 == 1).withColumn("review_status", F.when(F.col("record_idx") % 3 == 0, "Hold"))
    return galleries.drop_gallery(rows, _groups(spark, sf), **options).select("record_idx", "class_name", "group_size")


@query(sql("SELECT record_idx, class_name, group_size FROM dr WHERE NOT user_keep_override AND similarity_to_primary >= 0.1 ORDER BY similarity_to_primary DESC, record_idx LIMIT 60", REC, MEM, GRP, _DROPS))
def drop_gallery(spark, sf):
    return _gallery(spark, sf, status="Still dropped", min_similarity=0.1)


@query(sql("SELECT record_idx, class_name, group_size FROM dr WHERE class_name = 'class_3' AND record_idx % 3 = 0 ORDER BY md5(record_idx || ':42'), record_idx LIMIT 20", REC, MEM, GRP, _DROPS))
def drop_gallery_held(spark, sf):
    return _gallery(spark, sf, class_name="class_3", status="Hold", sort="Random", limit=20)


@query(sql("SELECT record_idx, class_name, group_size FROM dr WHERE user_keep_override ORDER BY group_size DESC, record_idx LIMIT 30", REC, MEM, GRP, _DROPS))
def drop_gallery_user_keeps(spark, sf):
    return _gallery(spark, sf, status="User keeps", sort="Largest group", limit=30)


@query(sql("SELECT record_idx, top1_record_idx, similarity_bin FROM cald WHERE top1_similarity >= 0.5 ORDER BY top1_same_class, round(top1_similarity, 9) DESC, record_idx LIMIT 24", REC, nb(10), CAL))
def calibration_examples(spark, sf):
    rows = _detail(spark, sf).withColumn("top1_similarity", F.round("top1_similarity", 9))
    return galleries.calibration_examples(rows, 0.5).select("record_idx", "top1_record_idx", "similarity_bin")


@query(sql("SELECT record_idx, top1_record_idx, similarity_bin FROM cald WHERE NOT top1_same_class ORDER BY round(top1_similarity, 9), record_idx LIMIT 10", REC, nb(10), CAL))
def calibration_examples_different(spark, sf):
    rows = _detail(spark, sf).withColumn("top1_similarity", F.round("top1_similarity", 9))
    return galleries.calibration_examples(rows, match="Different class", sort="Lowest similarity", limit=10).select("record_idx", "top1_record_idx", "similarity_bin")


@query(sql("SELECT record_idx, class_name, size_bucket FROM cl WHERE cluster_label = 'G03' ORDER BY class_name, size_bucket, record_id LIMIT 48", REC, _CL))
def cluster_samples(spark, sf):
    return galleries.cluster_samples(_clustered(spark, sf), "cluster_label", "G03").select("record_idx", "class_name", "size_bucket")


@query(sql("SELECT record_idx FROM cl ORDER BY class_name, cluster_label, record_id LIMIT 300", REC, _CL))
def cluster_point_choices(spark, sf):
    return galleries.point_choices(_clustered(spark, sf))


_CROP = "(SELECT record_idx, x1 - 20.5::DOUBLE AS a, y1 - 3.5::DOUBLE AS b, x1 + bbox_width + 10.5::DOUBLE AS c, y1 + bbox_height + 1.5::DOUBLE AS d FROM rec)"


@query(sql(f"SELECT record_idx, greatest(0, least(639, round_even(a, 0)))::INT AS x1, greatest(0, least(479, round_even(b, 0)))::INT AS y1, greatest(0, least(640, round_even(c, 0)))::INT AS x2, greatest(0, least(480, round_even(d, 0)))::INT AS y2 FROM {_CROP}", REC))
def crop_clamp(spark, sf):
    box = geometry.crop_box(F.col("bbox.x1") - 20.5, F.col("bbox.y1") - 3.5, F.col("bbox.x2") + 10.5, F.col("bbox.y2") + 1.5, F.lit(640), F.lit(480))
    return records(spark, sf).select("record_idx", box.alias("c")).select("record_idx", "c.*")


_DS = """ds0 AS (SELECT event_id AS row_id, (event_id // 4 * 37 % 600) AS x, (event_id // 4 * 53 % 440) AS y, event_id AS i FROM events),
ds AS (SELECT row_id, 'class_' || (i % 3) AS name, 65 + i % 40 AS w, 65 + i % 30 AS h, greatest(640, x + 60 + i % 40) AS iw, greatest(480, y + 60 + i % 30) AS ih FROM ds0),
dz AS (SELECT *, w * h / (iw * ih) AS r, CASE WHEN w * h / (iw * ih) < 0.005 THEN 'tiny' WHEN w * h / (iw * ih) < 0.02 THEN 'small' WHEN w * h / (iw * ih) < 0.08 THEN 'medium' WHEN w * h / (iw * ih) < 0.2 THEN 'large' ELSE 'huge' END AS z FROM ds)"""


@query(sql("SELECT row_id, w AS bbox_width, h AS bbox_height, round(r, 10) AS area_ratio, z AS size_bucket, name || ' / ' || z AS grouped, z AS by_size, 'All crops' AS every FROM dz", _DS))
def detection_sizes(spark, sf):
    size = geometry.detection_size(F.col("x1"), F.col("y1"), F.col("x2"), F.col("y2"), F.col("image_width"), F.col("image_height"))
    rows = _detector_rows(spark, sf).withColumn("s", size).withColumn("name", F.concat(F.lit("class_"), F.col("class_id").cast("string")))
    modes = {"grouped": "Class + Size", "by_size": "Size", "every": "all"}
    return rows.select("row_id", "s.bbox_width", "s.bbox_height", F.round("s.area_ratio", 10).alias("area_ratio"), "s.size_bucket", *[geometry.detection_group(m, F.col("name"), F.col("s.size_bucket")).alias(c) for c, m in modes.items()])


@query(sql("SELECT action, CASE WHEN action LIKE 'DROP%' THEN '#f87171' WHEN action LIKE '%PROTECT%' THEN '#fbbf24' ELSE '#34d399' END AS color, count(*) AS n FROM mem GROUP BY 1", REC, MEM))
def action_colors(spark, sf):
    return members(spark, sf).groupBy("action", text.action_color(F.col("action")).alias("color")).agg(F.count("*").alias("n"))


@query("WITH i AS (SELECT DISTINCT vec_id // 3 AS img FROM embeddings) SELECT 'labels/s' || (img % 4) || '/Img_' || lpad(img::VARCHAR, 6, '0') || '.txt' AS label_path, CASE WHEN img % 10 > 0 THEN 'images/s' || (img % 4) || '/img_' || lpad(img::VARCHAR, 6, '0') || '.jpg' WHEN img % 20 = 0 THEN 'images/s' || (img % 4) || '/Img_' || lpad(img::VARCHAR, 6, '0') || '.png' END AS image_path FROM i")
def label_image_fallback(spark, sf):
    files = _label_files(spark, sf).select("label_path")
    number = F.regexp_extract("label_path", r"(\d+)\.txt", 1).cast("int")
    stem = F.regexp_replace(F.regexp_replace("label_path", "^labels/", "images/"), r"\.txt$", "")
    others = files.where(number % 20 == 0).select(F.explode(F.array(*[F.concat(stem, F.lit(s)) for s in (".tif", ".png", ".bak")])).alias("image_path"))
    return labels.match_images(files, _images(spark, sf), others=others)


_SAMPLE = "qs AS (SELECT record_idx FROM rec ORDER BY md5(record_idx || ':42'), record_idx LIMIT 100)"
_SNB = nb(20).replace("nb AS (", "nb0 AS (", 1) + ",\nnb AS (SELECT * FROM nb0 WHERE record_idx IN (SELECT record_idx FROM qs))"
_QREC = "qr AS (SELECT * FROM rec WHERE record_idx IN (SELECT record_idx FROM qs))"


def _sampled(spark, sf):
    own = records(spark, sf)
    queries = curation.sample_rows(own, 100, 42)
    return outputs.curation_outputs(own, queries, knn_join(queries, own, 20), NEAR, CROSS, RARE, BOUNDARY, True)


@query(sql(f"SELECT least(record_idx, neighbor_idx) AS record_idx, greatest(record_idx, neighbor_idx) AS neighbor_idx, class_name FROM nb WHERE similarity >= {NEAR} AND class_id = nclass AND size_bucket = nsize GROUP BY 1, 2, 3", REC, _SAMPLE, _SNB))
def sampled_near_duplicates(spark, sf):
    """A sample as queries against all records."""
    return _sampled(spark, sf)["near_duplicates"].select("record_idx", "neighbor_idx", "class_name")


@query(sql(f"""SELECT 'records_sample' AS report, count(*) AS n FROM qr UNION ALL SELECT 'neighbor_summary', count(DISTINCT record_idx) FROM nb
UNION ALL SELECT 'cross_class_overlap', count(*) FROM nb WHERE similarity >= {CROSS} AND class_id <> nclass
UNION ALL SELECT 'representatives', count(DISTINCT representative_idx) FROM gm
UNION ALL SELECT 'rare_samples', coalesce(sum(n), 0)::BIGINT FROM (SELECT count(*) AS n FROM qr GROUP BY class_id, size_bucket) WHERE n <= {RARE}
UNION ALL SELECT 'boundary_samples', coalesce(sum(least(n, {BOUNDARY})), 0)::BIGINT FROM (SELECT count(*) AS n FROM qr GROUP BY class_id, size_bucket) WHERE n > 1
UNION ALL SELECT 'curation_recommendations', count(*) FROM qr UNION ALL SELECT 'image_recommendations', count(DISTINCT image_path) FROM qr""", REC, _SAMPLE, _SNB, _QREC, medoid("qr", "class_id, class_name, size_bucket", "gm")))
def curation_output_counts(spark, sf):
    tables = _sampled(spark, sf)
    names = ("records_sample", "neighbor_summary", "cross_class_overlap", "representatives", "rare_samples", "boundary_samples", "curation_recommendations", "image_recommendations")
    rows = [tables[n].agg(F.lit(n).alias("report"), F.count("*").alias("n")) for n in names]
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out


def _reduced(spark, sf):
    own = records(spark, sf)
    return outputs.reduction_outputs(own, own, neighbors(spark, sf, 30), NEAR, CROSS, 1, False)


_RED = (REC, nb(30), TIGHT, cover.MEMBERS, cover.RECOMMENDED)


@query(sql("SELECT record_idx, action, action LIKE 'DROP%' AS dropped FROM sr", *_RED))
def reduction_keep_drop(spark, sf):
    tables = _reduced(spark, sf)
    kept = tables["reduction_keep_records"].select("record_idx", "action", F.lit(False).alias("dropped"))
    return kept.unionByName(tables["reduction_drop_records"].select("record_idx", "action", F.lit(True).alias("dropped")))


@query(sql(f"""SELECT (SELECT count(*) FROM rec) AS total_records, (SELECT count(*) FROM rec) AS sampled_query_records, (SELECT count(*) FROM sr) AS planned_records,
(SELECT count(*) FROM sr WHERE action LIKE 'DROP%') AS drop_record_candidates, (SELECT round(count(*) FILTER (action LIKE 'DROP%') * 100.0 / count(*), 6) FROM sr) AS record_reduction_pct_of_planned,
(SELECT count(*) FROM te) AS tight_edges, (SELECT count(DISTINCT reduction_group_id) FROM mem) AS tight_groups, (SELECT count(*) FROM mem) AS grouped_records, (SELECT count(*) FROM mem WHERE is_representative) AS representative_records,
(SELECT count(*) FROM pr) AS protected_records, (SELECT count(*) FROM ip WHERE image_action LIKE 'DROP%') AS image_drop_candidates, (SELECT count(*) FROM ip WHERE image_action LIKE 'DROP%') AS safe_image_drop_candidates,
{NEAR}::DOUBLE AS tight_threshold, {CROSS}::DOUBLE AS protect_cross_class_threshold, true AS same_class_only, true AS same_size_only, false AS partial_plan""", *_RED, IMAGE_PLAN))
def reduction_summary(spark, sf):
    return _reduced(spark, sf)["summary"]


_CAL_SAMPLE = "qs AS (SELECT record_idx FROM rec WHERE class_id = 3 ORDER BY md5(record_idx || ':7'), record_idx LIMIT 20)"
_CAL_NB = nb(10).replace("nb AS (", "nb0 AS (", 1) + ",\nnb AS (SELECT * FROM nb0 WHERE record_idx IN (SELECT record_idx FROM qs))"


@query(sql("SELECT record_idx, top1_record_idx, topk_majority_class, similarity_bin FROM cald", REC, _CAL_SAMPLE, _CAL_NB, CAL))
def calibration_of_a_class(spark, sf):
    """A sample of one class (the sample is the feature) against all records."""
    rows = calibration.sampled_detail(records(spark, sf), 20, 7, "3: class_3", 10, W)
    return rows.select("record_idx", "top1_record_idx", "topk_majority_class", "similarity_bin")


@query(sql("SELECT record_idx, round(distance, 5) AS distance FROM no WHERE record_idx IN (SELECT record_idx FROM sd UNION SELECT other_idx FROM sd) ORDER BY round(distance, 5), record_idx LIMIT 25", REC, _OV))
def overlap_nearest_points(spark, sf):
    return clustering.overlap(_near3(spark, sf), 20, max_points=25)[0].select("record_idx", F.round("distance", 5).alias("distance"))


@query(sql("SELECT least(record_idx, other_idx) AS a, greatest(record_idx, other_idx) AS b, round(min(distance), 5) AS distance FROM sd GROUP BY 1, 2 ORDER BY 3, 1, 2 LIMIT 30", REC, _OV))
def overlap_nearest_pairs(spark, sf):
    return clustering.overlap(_near3(spark, sf), 20, max_pairs=30)[1]
