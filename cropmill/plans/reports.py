"""Queries of geometry, text, sources, review, clustering and validation."""

from __future__ import annotations

from pyspark.sql import functions as F

from cropmill.functions import geometry, text
from cropmill.operators import clustering, curation, review
from cropmill.operators.knn import knn_join
from cropmill.plans.core import full
from cropmill.plans.views import GRP, MEM, REC, members, records, sql, table
from cropmill.sources import catalog, labels, logs
from cropmill.sources import records as store

QUERIES, ORACLE_SQL = {}, {}


def query(oracle: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLE_SQL[f.__name__] = oracle
        return f

    return add


# Label files: one annotation a record, with blank lines, short lines and words among them.
def _label_files(spark, sf):
    i = F.col("vec_id")
    line = F.when(i % 11 == 0, F.lit("")).when(i % 13 == 0, F.lit("nope 0.5 0.5 0.1 0.1")).when(i % 17 == 0, F.lit("1 0.5 0.5")).otherwise(F.format_string("%d %s %s %s %s extra", F.col("label"), ((i % 97) / 97.0).cast("string"), ((i % 89) / 89.0).cast("string"), ((i % 7 + 1) / 20.0).cast("string"), ((i % 5 + 1) / 25.0).cast("string")))
    img = F.floor(i / 3).cast("long")
    name = F.concat(F.lit("labels/s"), (img % 4).cast("string"), F.lit("/Img_"), F.lpad(img.cast("string"), 6, "0"), F.lit(".txt"))
    rows = table(spark, sf, "embeddings").select(name.alias("label_path"), F.struct(i.alias("i"), line.alias("t")).alias("x"))
    return rows.groupBy("label_path").agg(F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["t"]), "\n").alias("content"))


def _images(spark, sf):
    own = records(spark, sf).select("image_path").distinct().where(F.regexp_extract("image_path", r"(\d+)\.jpg", 1).cast("int") % 10 > 0)
    upper = own.where(F.col("image_path").contains("s1/")).select(F.replace("image_path", F.lit(".jpg"), F.lit(".PNG")).alias("image_path"))
    return own.union(upper)


_PARSE = """lab0 AS (SELECT vec_id AS i, label, vec_id // 3 AS img, embedding FROM embeddings),
lab AS (SELECT i, label AS class_id, 'labels/s' || (img % 4) || '/Img_' || lpad(img::VARCHAR, 6, '0') || '.txt' AS label_path, (i % 3)::INT AS annotation_line, img,
  (i % 97) / 97.0::DOUBLE AS cx, (i % 89) / 89.0::DOUBLE AS cy, (i % 7 + 1) / 20.0::DOUBLE AS w, (i % 5 + 1) / 25.0::DOUBLE AS h FROM lab0 WHERE i % 11 <> 0 AND i % 13 <> 0 AND i % 17 <> 0),
e AS (SELECT *, (cx - w / 2) * 640 AS a1, (cy - h / 2) * 480 AS b1, (cx + w / 2) * 640 AS a2, (cy + h / 2) * 480 AS b2 FROM lab),
x AS (SELECT *, a1 - (a2 - a1) * 0.08::DOUBLE / 2 AS ax, a2 + (a2 - a1) * 0.08::DOUBLE / 2 AS ay, b1 - (b2 - b1) * 0.08::DOUBLE / 2 AS bx, b2 + (b2 - b1) * 0.08::DOUBLE / 2 AS by_ FROM e),
box AS (SELECT label_path, annotation_line, class_id, greatest(0, least(639, round_even(ax, 0)))::INT AS x1, greatest(0, least(479, round_even(bx, 0)))::INT AS y1, greatest(0, least(640, round_even(ay, 0)))::INT AS x2, greatest(0, least(480, round_even(by_, 0)))::INT AS y2 FROM x)"""


@query(sql("SELECT *, row_number() OVER (ORDER BY label_path, annotation_line) - 1 AS record_id FROM box WHERE x2 - x1 >= 2 AND y2 - y1 >= 2", _PARSE))
def bbox_from_label_text(spark, sf):
    parsed = labels.parse_labels(_label_files(spark, sf)).withColumn("image_path", F.lit("x")).withColumn("image_width", F.lit(640)).withColumn("image_height", F.lit(480))
    rows = labels.records(parsed, expand=0.08, least=2)
    return rows.select("label_path", "annotation_line", "class_id", "bbox.x1", "bbox.y1", "bbox.x2", "bbox.y2", "record_id")


@query("WITH i AS (SELECT DISTINCT vec_id // 3 AS img FROM embeddings) SELECT 'labels/s' || (img % 4) || '/Img_' || lpad(img::VARCHAR, 6, '0') || '.txt' AS label_path, CASE WHEN img % 10 > 0 THEN 'images/s' || (img % 4) || '/img_' || lpad(img::VARCHAR, 6, '0') || '.jpg' END AS image_path FROM i")
def label_image_match(spark, sf):
    return labels.match_images(_label_files(spark, sf).select("label_path"), _images(spark, sf))


@query(sql("SELECT DISTINCT image_path, 'labels' || image_path[7:-5] || '.txt' AS label_path FROM rec", REC))
def label_path_for_image(spark, sf):
    return records(spark, sf).select("image_path", labels.label_path_for_image(F.col("image_path")).alias("label_path")).distinct()


@query(sql("SELECT 'id' AS choice, count(*) AS n FROM rec WHERE class_id = 3 UNION ALL SELECT 'name', count(*) FROM rec WHERE class_name = 'class_4' UNION ALL SELECT 'all', count(*) FROM rec UNION ALL SELECT 'list', count(*) FROM rec WHERE class_id IN (1, 2)", REC))
def class_filter(spark, sf):
    own = records(spark, sf)
    tests = {"id": text.matches_class("3: class_3", F.col("class_id"), F.col("class_name")), "name": text.matches_class("CLASS_4", F.col("class_id"), F.col("class_name")), "all": text.matches_class(" all ", F.col("class_id"), F.col("class_name")), "list": F.col("class_id").isin(text.class_ids("1, x;2.0"))}
    counts = own.agg(*[F.count_if(c).alias(n) for n, c in tests.items()])
    return counts.select(F.explode(F.array(*[F.struct(F.lit(n).alias("choice"), F.col(n).alias("n")) for n in tests])).alias("x")).select("x.*")


@query(sql("SELECT record_idx, bbox_width, bbox_height, bbox_width * bbox_height AS bbox_area, 640 AS image_width, 480 AS image_height, round(area_ratio, 8) AS area_ratio, round(area_ratio * 100, 6) AS area_pct, round(aspect_ratio, 8) AS aspect_ratio FROM rec", REC))
def bbox_stats(spark, sf):
    return records(spark, sf).select("record_idx", "bbox_width", "bbox_height", "bbox_area", "image_width", "image_height", F.round("area_ratio", 8).alias("area_ratio"), F.round("area_pct", 6).alias("area_pct"), F.round("aspect_ratio", 8).alias("aspect_ratio"))


@query(sql("SELECT record_idx, size_bucket, list_position(['tiny', 'small', 'medium', 'large', 'huge'], size_bucket) - 1 AS size_code, aspect_bucket FROM rec", REC))
def size_aspect_buckets(spark, sf):
    return records(spark, sf).select("record_idx", "size_bucket", geometry.size_code(F.col("size_bucket")).alias("size_code"), "aspect_bucket")


@query("WITH s AS (SELECT vec_id, 200 + vec_id % 900 AS w, 150 + vec_id * 7 % 700 AS h FROM embeddings), r AS (SELECT *, least(640 / h::DOUBLE, 640 / w::DOUBLE) AS k FROM s) SELECT vec_id, round_even(h * k, 0)::INT + ((640 - round_even(h * k, 0)::INT) % 32) AS box_h, round_even(w * k, 0)::INT + ((640 - round_even(w * k, 0)::INT) % 32) AS box_w FROM r")
def letterbox_shape(spark, sf):
    i = F.col("vec_id")
    shape = geometry.letterbox_shape((200 + i % 900).cast("int"), (150 + i * 7 % 700).cast("int"), 640, 640)
    return table(spark, sf, "embeddings").select("vec_id", shape.alias("s")).select("vec_id", F.col("s.h").alias("box_h"), F.col("s.w").alias("box_w"))


@query(sql("SELECT record_idx, greatest(0, least(79, floor((x1 * 0.9::DOUBLE + 4) / 640 * 80)))::INT AS first_x, greatest(greatest(0, least(79, floor((x1 * 0.9::DOUBLE + 4) / 640 * 80)))::INT + 1, least(80, ceil(((x1 + bbox_width) * 0.9::DOUBLE + 4) / 640 * 80))::INT) AS last_x FROM rec", REC))
def fmap_cell_range(spark, sf):
    cells = geometry.cell_range(F.col("bbox.x1"), F.col("bbox.x2"), F.lit(0.9), F.lit(4), 640, 80)
    return records(spark, sf).select("record_idx", cells.alias("c")).select("record_idx", F.col("c.first").alias("first_x"), F.col("c.last").alias("last_x"))


@query(sql("SELECT class_id || ': ' || class_name AS class_key, count(*) AS n FROM rec GROUP BY 1", REC))
def class_counts(spark, sf):
    return records(spark, sf).groupBy(F.concat_ws(": ", F.col("class_id").cast("string"), "class_name").alias("class_key")).agg(F.count("*").alias("n"))


@query(sql("SELECT b AS size_bucket, count(record_idx) AS n FROM (SELECT unnest(['tiny', 'small', 'medium', 'large', 'huge']) AS b) LEFT JOIN (SELECT * FROM rec WHERE class_id = 1 AND size_bucket <> 'huge') ON size_bucket = b GROUP BY 1", REC))
def size_counts_zero_filled(spark, sf):
    own = records(spark, sf).where("class_id = 1 and size_bucket <> 'huge'").groupBy("size_bucket").agg(F.count("*").alias("n"))
    every = spark.createDataFrame([(s,) for s in geometry.SIZES], "size_bucket string")
    return every.join(own, "size_bucket", "left").select("size_bucket", F.coalesce("n", F.lit(0).cast("long")).alias("n"))


@query("WITH e AS (SELECT event_id, event_type, value, row_number() OVER (ORDER BY event_id) - 1 AS det_id FROM events WHERE event_id % 7 = 0 AND event_id < 700) SELECT * FROM e")
def frame_stride_sample(spark, sf):
    rows = table(spark, sf, "events").select("event_id", "event_type", "value")
    return store.sample_frames(rows, 7, max_frames=100, frame_col="event_id")


@query("SELECT event_type, CASE WHEN value < 50 THEN 'low' ELSE 'high' END AS band, count(*) AS n FROM events GROUP BY 1, 2")
def video_class_size_counts(spark, sf):
    return table(spark, sf, "events").groupBy("event_type", F.when(F.col("value") < 50, "low").otherwise("high").alias("band")).agg(F.count("*").alias("n"))


@query(sql("SELECT count(*) AS records, count(DISTINCT image_path) AS images FROM rec", REC))
def shard_colocation(spark, sf):
    """Images counted by shard: the sum is the number of images only if none is split."""
    return store.shard_counts(records(spark, sf), 4).agg(F.sum("records").alias("records"), F.sum("images").alias("images"))


@query("WITH s AS (SELECT vec_id, vec_id % 4 AS shard, row_number() OVER (PARTITION BY vec_id % 4 ORDER BY vec_id) - 1 AS local_idx FROM embeddings), c AS (SELECT shard, count(*) AS n FROM s GROUP BY 1) SELECT s.*, coalesce((SELECT sum(n) FROM c WHERE c.shard < s.shard), 0)::BIGINT + local_idx AS record_idx FROM s")
def merge_reindex(spark, sf):
    from pyspark.sql import Window

    rows = table(spark, sf, "embeddings").select("vec_id", (F.col("vec_id") % 4).alias("shard"))
    rows = rows.withColumn("local_idx", F.row_number().over(Window.partitionBy("shard").orderBy("vec_id")) - 1)
    return store.merge_shards(rows)


@query("SELECT 'dim' AS field, 2 AS \"values\"")
def shard_config_mismatch(spark, sf):
    rows = spark.createDataFrame([(0, "64", "a/b"), (1, "64", "a\\b/"), (2, "32", "a/b")], "shard int, dim string, repo_path string")
    return store.mismatched_configs(rows, ["dim", "repo_path"])


# Log lines of four shards.
def _logs(spark, sf):
    i = F.col("event_id")
    line = F.when(i % 5 == 0, F.lit("loading records=1,200")).otherwise(F.format_string("%s%% | encode %d/%d crops | elapsed=%dm %ds eta=%dh %dm %ds", F.format_number((i % 1000) / 10.0, 1), i, F.lit(10000), i % 60, i % 59, i % 3, i % 47, i % 31))
    return table(spark, sf, "events").select((i % 4).alias("shard"), i.alias("line_no"), line.alias("line"))


_LOG = """lg AS (SELECT event_id % 4 AS shard, event_id AS line_no, event_id AS i FROM events WHERE event_id % 5 <> 0),
pr AS (SELECT shard, line_no, round((i % 1000) / 10.0::DOUBLE, 1) AS pct, 'encode ' || i || '/10000 crops' AS message, i AS done, 10000::BIGINT AS total, (i % 60) || 'm ' || (i % 59) || 's' AS elapsed, (i % 3) || 'h ' || (i % 47) || 'm ' || (i % 31) || 's' AS eta, (i % 3) * 3600 + (i % 47) * 60 + i % 31 AS eta_seconds FROM lg)"""


@query(sql("SELECT * FROM pr", _LOG))
def progress_parse(spark, sf):
    return _logs(spark, sf).select("shard", "line_no", *text.progress(F.col("line"))).where("pct is not null")


@query(sql("SELECT shard, arg_max(pct, line_no) AS pct, arg_max(message, line_no) AS message, arg_max(done, line_no) AS done, arg_max(total, line_no) AS total, arg_max(elapsed, line_no) AS elapsed, arg_max(eta, line_no) AS eta, arg_max(eta_seconds, line_no) AS eta_seconds FROM pr GROUP BY 1", _LOG))
def progress_last(spark, sf):
    return logs.last_progress(_logs(spark, sf))


@query("SELECT event_id % 4 AS shard, 1200::BIGINT AS value FROM events WHERE event_id % 5 = 0 GROUP BY 1")
def progress_last_number(spark, sf):
    return logs.last_number(_logs(spark, sf), r"records=([\d,]+)")


@query(sql("SELECT count(*) AS shards, sum(done)::BIGINT AS done, sum(total)::BIGINT AS total, max(eta_seconds) AS eta_seconds, 'Encoding features' AS stage, round(sum(done) / sum(total), 6) AS pct FROM (SELECT shard, arg_max(done, line_no) AS done, arg_max(total, line_no) AS total, arg_max(eta_seconds, line_no) AS eta_seconds FROM pr GROUP BY 1)", _LOG))
def build_progress_rollup(spark, sf):
    return logs.build_summary(logs.last_progress(_logs(spark, sf)).withColumn("exit_code", F.lit(None).cast("int")), bounded=False)


@query("WITH d AS (SELECT event_id, event_id * 37 % 20000 AS s FROM events) SELECT event_id, CASE WHEN s >= 3600 THEN printf('%dh %02dm %02ds', s // 3600, s % 3600 // 60, s % 60) WHEN s >= 60 THEN printf('%dm %02ds', s // 60, s % 60) ELSE printf('%ds', s) END AS said, s AS back FROM d")
def duration_round_trip(spark, sf):
    said = text.duration_text(F.col("event_id") * 37 % 20000)
    return table(spark, sf, "events").select("event_id", said.alias("said"), text.duration_seconds(said).alias("back"))


@query("WITH c AS (SELECT 'config_rows' AS item UNION ALL SELECT 'record_rows' UNION ALL SELECT 'dimension' UNION ALL SELECT 'vectors_present') SELECT item, 'PASS' AS status, printf('records=%d features=%d', (SELECT count(*) FROM embeddings), (SELECT count(*) FROM embeddings)) AS detail FROM c")
def validation_report(spark, sf):
    own = full(spark, sf)
    return catalog.validation({"num_records": own.count(), "dim": 64}, own, own, 64)


@query(sql("SELECT record_idx, 'external/' || array_to_string(string_split('data/' || image_path, '/')[-6:], '/') AS outside, image_path[8:] AS inside FROM rec", REC))
def safe_relative_path(spark, sf):
    return records(spark, sf).select("record_idx", text.relative_path(F.concat(F.lit("/data/"), F.col("image_path")), "/mnt", "external").alias("outside"), text.relative_path(F.col("image_path"), "images", "external").alias("inside"))


@query("SELECT DISTINCT c_mktsegment AS name, coalesce(nullif(regexp_replace(regexp_replace(trim('. ' || c_mktsegment || ' #1 '), '[^0-9A-Za-z가-힣_.-]+', '_', 'g'), '^[._-]+|[._-]+$', '', 'g'), ''), 'project') AS slug FROM customer")
def slugify(spark, sf):
    return table(spark, sf, "customer").select(F.col("c_mktsegment").alias("name")).distinct().select("name", text.slug(F.concat(F.lit(". "), F.col("name"), F.lit(" #1 "))).alias("slug"))


@query("SELECT d AS dim, max(k) AS divisor FROM (SELECT unnest([64, 1792, 97, 384]) AS d) JOIN (SELECT unnest(range(1, 65)) AS k) ON d % k = 0 AND k <= 64 GROUP BY 1")
def pq_divisor(spark, sf):
    return spark.createDataFrame([(d, geometry.largest_divisor(d, 64)) for d in (64, 1792, 97, 384)], "dim int, divisor int")


@query("SELECT event_id, coalesce(try_cast(json_extract_string(props, '$.k') AS DOUBLE), -1) AS k, coalesce(CAST(trunc(try_cast(json_extract_string(props, '$.k') AS DOUBLE)) AS INT), -1) AS ki, event_type IN ('true', 'yes') AS flag FROM events")
def tolerant_casts(spark, sf):
    k = F.get_json_object("props", "$.k")
    return table(spark, sf, "events").select("event_id", text.safe_double(k, -1.0).alias("k"), text.safe_int(k, -1).alias("ki"), text.truthy(F.col("event_type")).alias("flag"))


@query(sql("SELECT record_idx, 'bbox: [' || x1 || ', ' || y1 || ', ' || (x1 + bbox_width) || ', ' || (y1 + bbox_height) || ']' AS said, x1, y1, x1 + bbox_width AS x2, y1 + bbox_height AS y2 FROM rec", REC))
def box_text_round_trip(spark, sf):
    said = F.format_string("bbox: [%d, %d, %d, %d]", "bbox.x1", "bbox.y1", "bbox.x2", "bbox.y2")
    rows = records(spark, sf).select("record_idx", said.alias("said")).withColumn("n", text.box_numbers(F.col("said")))
    return rows.select("record_idx", "said", *[F.col("n")[i].alias(c) for i, c in enumerate(("x1", "y1", "x2", "y2"))])


@query("WITH c AS (SELECT o_custkey AS name, 'v' || o_orderkey AS settings, o_orderkey AS w FROM orders) SELECT name::VARCHAR AS name, arg_max(settings, w) AS settings, min(w) AS created_at, max(w) AS updated_at, name::VARCHAR AS slug FROM c GROUP BY 1")
def catalog_upsert(spark, sf):
    rows = table(spark, sf, "orders").select(F.col("o_custkey").cast("string").alias("name"), F.concat(F.lit("v"), F.col("o_orderkey").cast("string")).alias("settings"), F.col("o_orderkey").alias("at"))
    empty = rows.where("false").select("name", "settings", F.col("at").alias("created_at"), F.col("at").alias("updated_at"))
    return catalog.upsert(empty, rows)


@query("SELECT arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS latest FROM orders")
def latest_report(spark, sf):
    return store.latest(table(spark, sf, "orders"), "o_orderkey", "o_orderdate")


# Review.
def _groups(spark, sf):
    from cropmill.operators.reduction import reduction_groups

    return reduction_groups(members(spark, sf), records(spark, sf))


def _frame(spark, sf):
    own = records(spark, sf)
    wishes = own.where("record_idx % 5 = 1").select("record_idx")
    states = own.where("record_idx % 6 = 2").select("record_idx", F.when(F.col("record_idx") % 4 == 2, "Keep").otherwise("Hold").alias("review_status"))
    return review.explorer_frame(members(spark, sf), _groups(spark, sf), own, wishes, states)


FRAME = """fr0 AS (SELECT m.*, r.class_id, r.class_name, r.size_bucket, r.image_path, r.file_name, g.group_size, m.record_idx % 5 = 1 AND m.action LIKE 'DROP%' AS user_keep_override, CASE WHEN m.record_idx % 6 <> 2 THEN 'Unreviewed' WHEN m.record_idx % 4 = 2 THEN 'Keep' ELSE 'Hold' END AS review_status FROM mem m JOIN rec r USING (record_idx) JOIN grp g USING (reduction_group_id)),
fr AS (SELECT * EXCLUDE (action), action AS original_action, CASE WHEN user_keep_override THEN 'KEEP_USER_OVERRIDE' ELSE action END AS action FROM fr0),
ex AS (SELECT *, CASE WHEN action LIKE '%USER_OVERRIDE%' THEN 'User keep' WHEN action LIKE 'DROP%' THEN 'Drop candidate' WHEN action LIKE '%REPRESENTATIVE%' THEN 'Representative' WHEN action LIKE '%PROTECTED%' THEN 'Protected' ELSE 'Keep' END AS action_group, action LIKE 'DROP%' AS is_drop, similarity_to_primary AS sim FROM fr)"""
_REV = (REC, MEM, GRP)


@query(sql("SELECT * FROM grph", *_REV))
def group_stats(spark, sf):
    return _groups(spark, sf)


@query(sql("SELECT reduction_group_id, class_name, drop_candidates, mean_similarity_to_primary FROM grph QUALIFY row_number() OVER (PARTITION BY class_name ORDER BY drop_candidates DESC, mean_similarity_to_primary DESC, reduction_group_id) = 1", *_REV))
def board_top_group_per_class(spark, sf):
    return review.board(_groups(spark, sf), limit=20, top_per_class=True).select("reduction_group_id", "class_name", "drop_candidates", "mean_similarity_to_primary")


@query(sql("SELECT reduction_group_id, group_size, mean_similarity_to_primary FROM grph WHERE class_name = 'class_2' ORDER BY mean_similarity_to_primary DESC, drop_candidates DESC, reduction_group_id LIMIT 5", *_REV))
def board_by_similarity(spark, sf):
    return review.board(_groups(spark, sf), "similarity", "class_2", 5).select("reduction_group_id", "group_size", "mean_similarity_to_primary")


@query(sql("SELECT reduction_group_id, mean_similarity_to_primary FROM (SELECT * FROM grph ORDER BY drop_candidates DESC, mean_similarity_to_primary DESC, reduction_group_id LIMIT 40) WHERE mean_similarity_to_primary >= 0.3 ORDER BY drop_candidates DESC, mean_similarity_to_primary DESC, reduction_group_id LIMIT 10", *_REV))
def evidence_wall(spark, sf):
    return review.wall(_groups(spark, sf), 0.3, 10).select("reduction_group_id", "mean_similarity_to_primary")


@query(sql("SELECT reduction_group_id FROM grph WHERE reduction_group_id IN (SELECT reduction_group_id FROM mem WHERE action LIKE '%PROTECTED%')", *_REV))
def protected_wall(spark, sf):
    return review.protected_wall(_groups(spark, sf), members(spark, sf)).select("reduction_group_id")


@query(sql("SELECT reduction_group_id, record_idx, action, row_number() OVER (PARTITION BY reduction_group_id ORDER BY is_representative DESC, action LIKE 'DROP%' DESC, similarity_to_primary DESC, record_idx) - 1 AS pick FROM mem QUALIFY pick <= 2", *_REV))
def group_samples(spark, sf):
    return review.group_samples(members(spark, sf), 2).select("reduction_group_id", "record_idx", "action", "pick")


@query(sql("SELECT record_idx, reduction_group_id, action, action_group, review_status, sim, row_number() OVER (ORDER BY is_drop DESC, sim DESC, record_idx) AS place FROM ex WHERE (sim >= 0.1 OR is_representative) AND size_bucket = 'medium' AND (reduction_group_id::VARCHAR LIKE '%1%' OR lower(file_name) LIKE '%1%') AND (lower(file_name) LIKE '%img%' OR lower(action) LIKE '%img%')", *_REV, FRAME))
def explorer_filter_sort(spark, sf):
    return review.explore(_frame(spark, sf), size="medium", min_similarity=0.1, group_query="1", text_query="IMG", sort="Drop first").select("record_idx", "reduction_group_id", "action", "action_group", "review_status", "sim", "place")


@query(sql("SELECT * FROM (SELECT record_idx, action, row_number() OVER (ORDER BY reduction_group_id, is_representative DESC, sim DESC, record_idx) AS place FROM ex) WHERE place BETWEEN 21 AND 40", *_REV, FRAME))
def explorer_page(spark, sf):
    return review.page(review.explore(_frame(spark, sf)), 2, 20).select("record_idx", "action", "place")


@query(sql("SELECT record_idx, sim, row_number() OVER (ORDER BY sim DESC, group_size DESC, record_idx) AS place FROM ex WHERE action_group = 'Drop candidate' AND (sim >= 0.995 OR is_representative)", *_REV, FRAME))
def explorer_preset(spark, sf):
    return review.explore(_frame(spark, sf), **review.PRESETS["High similarity drops"]).select("record_idx", "sim", "place")


@query(sql("SELECT * FROM (SELECT 'class_name' AS field, class_name AS value, count(*) AS n FROM ex GROUP BY 2 ORDER BY n DESC, value LIMIT 8) UNION ALL SELECT * FROM (SELECT 'action_group', action_group, count(*) AS n FROM ex GROUP BY 2 ORDER BY n DESC, 2 LIMIT 6)", *_REV, FRAME))
def facets(spark, sf):
    return review.facets(_frame(spark, sf), {"class_name": 8, "action_group": 6})


@query(sql("SELECT count(*) AS filtered, count(*) FILTER (is_drop) AS drops, count(*) FILTER (user_keep_override) AS user_keeps, count(*) FILTER (review_status <> 'Unreviewed') AS reviewed, count(DISTINCT reduction_group_id) AS groups, round(avg(sim), 6) AS mean_similarity FROM ex", *_REV, FRAME))
def explorer_kpis(spark, sf):
    return review.kpis(_frame(spark, sf))


@query(sql("SELECT class_id, class_name, count(*) AS grouped, count(*) FILTER (is_representative) AS representatives, count(*) FILTER (is_protected) AS protected, count(*) FILTER (action LIKE 'DROP%') AS drops, round(count(*) FILTER (action LIKE 'DROP%') * 100.0 / count(*), 2) AS drop_pct FROM mem JOIN rec USING (record_idx) GROUP BY 1, 2", *_REV))
def class_action_overview(spark, sf):
    return review.class_overview(members(spark, sf), records(spark, sf))


@query(sql("SELECT action, class_name, count(*) AS n FROM mem JOIN rec USING (record_idx) GROUP BY 1, 2", *_REV))
def action_class_counts(spark, sf):
    return members(spark, sf).join(records(spark, sf).select("record_idx", "class_name"), "record_idx").groupBy("action", "class_name").agg(F.count("*").alias("n"))


@query(sql("SELECT action, action_group, count(*) AS n FROM ex GROUP BY 1, 2", *_REV, FRAME))
def action_groups(spark, sf):
    return _frame(spark, sf).groupBy("action", text.action_group(F.col("action")).alias("action_group")).agg(F.count("*").alias("n"))


@query(sql("SELECT round(min(s), 6) AS q0, round(quantile_cont(s, 0.25), 6) AS q25, round(quantile_cont(s, 0.5), 6) AS q50, round(quantile_cont(s, 0.75), 6) AS q75, round(max(s), 6) AS q100 FROM (SELECT similarity_to_primary AS s FROM mem WHERE similarity_to_primary > 0)", *_REV))
def similarity_quantiles(spark, sf):
    return review.similarity_quantiles(members(spark, sf))


@query(sql("SELECT action_group, least(40, floor((sim - low) / (1 - low) * 41))::INT AS bin, count(*) AS n FROM (SELECT CASE WHEN action LIKE 'DROP%' THEN 'Drop candidate' WHEN action LIKE '%REPRESENTATIVE%' THEN 'Representative' ELSE 'Protected' END AS action_group, similarity_to_primary AS sim FROM mem WHERE similarity_to_primary > 0), (SELECT greatest(0, min(similarity_to_primary) - 0.001::DOUBLE) AS low FROM mem WHERE similarity_to_primary > 0) GROUP BY 1, 2", *_REV))
def similarity_histogram(spark, sf):
    return review.similarity_histogram(members(spark, sf))


@query("WITH c AS (SELECT event_id, user_id % 40 AS record_idx, CASE WHEN event_id % 4 = 0 THEN 'Unreviewed' WHEN event_id % 4 = 1 THEN 'Keep' WHEN event_id % 4 = 2 THEN 'Hold' ELSE 'Drop confirmed' END AS s FROM events), l AS (SELECT record_idx, arg_max(s, event_id) AS review_status FROM c GROUP BY 1) SELECT *, review_status IN ('Keep', 'Hold') AS keeps FROM l WHERE review_status <> 'Unreviewed'")
def review_status_upsert(spark, sf):
    e = F.col("event_id") % 4
    changes = table(spark, sf, "events").select((F.col("user_id") % 40).alias("record_idx"), F.when(e == 0, "other").when(e == 1, "Keep").when(e == 2, "Hold").otherwise("Drop confirmed").alias("review_status"), F.col("event_id").alias("at"))
    return review.upsert_statuses(changes.where("false"), changes)


# Clusters. Labels by arithmetic where the result must be the same everywhere.
def _clustered(spark, sf):
    return records(spark, sf).withColumn("cluster_label", F.format_string("G%02d", F.col("record_idx") % 7))


_CL = "cl AS (SELECT *, printf('G%02d', record_idx % 7) AS cluster_label FROM rec)"


def _mix(c: str, many: str, top: str, purity: str, mix: str) -> str:
    return f"(SELECT cluster_label, count(*) AS {many}, arg_min({c}, k) AS {top}, round(max(n) / sum(n), 4) AS {purity}, string_agg({c} || ':' || n, ', ' ORDER BY k) FILTER (k <= 5) AS {mix} FROM (SELECT cluster_label, {c}, count(*) AS n, row_number() OVER (PARTITION BY cluster_label ORDER BY count(*) DESC, {c}) AS k FROM cl GROUP BY 1, 2) GROUP BY 1)"


@query(sql(f"SELECT * FROM (SELECT cluster_label, count(*) AS count, round(avg(area_ratio) * 100, 3) AS avg_area_pct FROM cl GROUP BY 1) JOIN {_mix('class_name', 'n_classes', 'dominant_class', 'class_purity', 'class_mix')} USING (cluster_label) JOIN {_mix('size_bucket', 'n_size_buckets', 'dominant_size', 'size_purity', 'size_mix')} USING (cluster_label)", REC, _CL))
def cluster_summary(spark, sf):
    return clustering.summarize(_clustered(spark, sf))


@query(sql("SELECT cluster_label, class_name, size_bucket, count(*) AS n FROM cl GROUP BY 1, 2, 3", REC, _CL))
def cluster_class_size_counts(spark, sf):
    return _clustered(spark, sf).groupBy("cluster_label", "class_name", "size_bucket").agg(F.count("*").alias("n"))


def _cluster_query(method: str, scope: str = "global"):
    def run(spark, sf):
        return clustering.cluster(records(spark, sf), method, 6, scope).select("record_idx", "class_name", "cluster_label", "cluster_id")

    run.__name__ = f"{method}_clusters" if scope == "global" else f"{method}_clusters_{scope}"
    return run


for _m, _s in (("kmeans", "global"), ("kmeans", "per_class"), ("kmeans", "class_size"), ("bisecting", "global"), ("birch", "global"), ("hdbscan", "global")):
    query()(_cluster_query(_m, _s))


@query()
def pca_projection(spark, sf):
    rows = clustering.projection(full(spark, sf), 3)
    return rows.select("record_idx", *[F.round(F.col("pc")[i], 6).alias(c) for i, c in enumerate("xyz")])


def _coords(spark, sf):
    """The first three components as coordinates; nearest by distance is largest q.x - |x|^2 / 2."""
    return records(spark, sf).withColumn("xyz", F.slice("feature", 1, 3))


def _near3(spark, sf, depth: int = 50):
    rows = _coords(spark, sf)
    from cropmill.operators.knn import dot

    up = rows.select("record_idx", F.concat("xyz", F.array(-dot("xyz", "xyz") / 2)).alias("feature"))
    ask = rows.select("record_idx", F.concat("xyz", F.array(F.lit(1.0))).alias("feature"))
    found = knn_join(ask, up, depth - 1)
    d = rows.select("record_idx", F.col("xyz").alias("a"))
    both = found.join(d, "record_idx").join(d.select(F.col("record_idx").alias("neighbor_idx"), F.col("a").alias("b")), "neighbor_idx")
    distance = F.sqrt(F.aggregate(F.zip_with("a", "b", lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))
    return clustering.nearest_other_class(both.withColumn("distance", distance), rows)


_OV = """p AS (SELECT record_idx, class_id, class_name, f[1:3] AS v FROM rec),
pd AS (SELECT a.record_idx, a.class_id, a.class_name, b.record_idx AS other_idx, b.class_name AS other_class, list_distance(a.v, b.v) AS distance, row_number() OVER (PARTITION BY a.record_idx ORDER BY list_distance(a.v, b.v), b.record_idx) AS rank FROM p a JOIN p b ON a.record_idx <> b.record_idx QUALIFY rank <= 49),
no AS (SELECT record_idx, class_id, class_name, arg_min(other_idx, rank) AS other_idx, arg_min(other_class, rank) AS other_class, arg_min(distance, rank) AS distance FROM pd WHERE class_name <> other_class GROUP BY 1, 2, 3),
th AS (SELECT quantile_cont(distance, 0.2) AS bound FROM no),
sd AS (SELECT no.* FROM no, th WHERE distance <= bound)"""


@query(sql("SELECT least(record_idx, other_idx) AS a, greatest(record_idx, other_idx) AS b, round(min(distance), 5) AS distance FROM sd GROUP BY 1, 2", REC, _OV))
def overlap_pairs(spark, sf):
    return clustering.overlap(_near3(spark, sf), 20)[1]


@query(sql("SELECT class_id, class_name, count(*) AS count, round(avg(distance), 5) AS mean_distance, round(min(distance), 5) AS min_distance FROM no WHERE record_idx IN (SELECT record_idx FROM sd UNION SELECT other_idx FROM sd) GROUP BY 1, 2", REC, _OV))
def overlap_class_summary(spark, sf):
    points = clustering.overlap(_near3(spark, sf), 20)[0].join(records(spark, sf).select("record_idx", "class_id", "class_name"), "record_idx")
    return points.groupBy("class_id", "class_name").agg(F.count("*").alias("count"), F.round(F.avg("distance"), 5).alias("mean_distance"), F.round(F.min("distance"), 5).alias("min_distance"))


@query(sql("SELECT class_name, other_class, count(*) AS count, round(avg(distance), 5) AS mean_distance FROM no WHERE record_idx IN (SELECT record_idx FROM sd UNION SELECT other_idx FROM sd) GROUP BY 1, 2", REC, _OV))
def overlap_class_pairs(spark, sf):
    own = records(spark, sf).select("record_idx", "class_name")
    points = clustering.overlap(_near3(spark, sf), 20)[0].join(own, "record_idx").join(own.select(F.col("record_idx").alias("other_idx"), F.col("class_name").alias("other_class")), "other_idx")
    return points.groupBy("class_name", "other_class").agg(F.count("*").alias("count"), F.round(F.avg("distance"), 5).alias("mean_distance"))


@query(sql("SELECT record_idx, class_name FROM rec ORDER BY md5(record_idx || ':7'), record_idx LIMIT 50", REC))
def hash_ordered_sample(spark, sf):
    return curation.sample_rows(records(spark, sf), 50, 7).select("record_idx", "class_name")
