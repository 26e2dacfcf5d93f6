"""Stand-in record, neighbour and plan tables over the standard tables, as DataFrames and as SQL for the comparison."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cropmill.functions.geometry import box_stats
from cropmill.functions.text import file_name
from cropmill.operators.knn import dot, knn_join
from cropmill.operators.reduction import member_action

#: Thresholds that exercise every action on the stand-in vectors.
NEAR, CROSS, RARE, BOUNDARY, TOP_K = 0.95, 0.995, 5, 2, 50


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each embedding as a record: boxes, images and labels by integer arithmetic, and its first four components as a unit vector."""
    i = F.col("vec_id")
    last = i % 10
    w = F.when(last.isin(0, 1, 7), 64).when(last.isin(2, 3, 4, 5), 128).when(last == 6, 24).when(last == 8, 224).otherwise(320)
    h = F.when(last.isin(0, 1, 7), 64).when(last.isin(2, 3, 4, 5), 96).when(last == 6, 24).when(last == 8, 192).otherwise(240)
    img = F.floor(i / 3).cast("long")
    stem = F.concat(F.lit("/s"), (img % 4).cast("string"), F.lit("/img_"), F.lpad(img.cast("string"), 6, "0"))
    rows = table(spark, sf_dir, "embeddings").select(i.alias("record_idx"), i.alias("record_id"), F.col("label").alias("class_id"), F.concat(F.lit("class_"), F.col("label").cast("string")).alias("class_name"), F.concat(F.lit("images"), stem, F.lit(".jpg")).alias("image_path"), F.concat(F.lit("labels"), stem, F.lit(".txt")).alias("label_path"), (i % 3).cast("int").alias("annotation_line"), w.alias("bw"), h.alias("bh"), (37 * i % (641 - w)).cast("int").alias("x1"), (53 * i % (481 - h)).cast("int").alias("y1"), "embedding", F.slice(F.col("embedding").cast("array<double>"), 1, 4).alias("c"))
    rows = rows.withColumn("x2", F.col("x1") + F.col("bw")).withColumn("y2", F.col("y1") + F.col("bh"))
    stats = box_stats(F.col("x1"), F.col("y1"), F.col("x2"), F.col("y2"), F.lit(640), F.lit(480))
    feature = F.transform("c", lambda x: x / F.sqrt(dot("c", "c")))
    return rows.select("record_idx", "record_id", "class_id", "class_name", "image_path", "label_path", file_name(F.col("image_path")).alias("file_name"), "annotation_line", F.struct("x1", "y1", "x2", "y2").alias("bbox"), *stats, "embedding", feature.alias("feature"))


def neighbors(spark: SparkSession, sf_dir: str, k: int = TOP_K) -> DataFrame:
    own = records(spark, sf_dir)
    return knn_join(own, own, k)


def members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stand-in plan: groups of four neighbouring ids, the first of them the representative."""
    rows = records(spark, sf_dir).withColumn("g", F.floor(F.col("record_idx") / 4).cast("long"))
    heads = rows.where("record_idx % 4 = 0").select("g", F.col("record_idx").alias("primary_representative_idx"), F.col("feature").alias("head"))
    own = rows.join(heads, "g")
    rep, prot = F.col("record_idx") % 4 == 0, F.col("record_idx") % 7 == 3
    return own.select((F.col("g") + 1).alias("reduction_group_id"), "record_idx", "primary_representative_idx", rep.alias("is_representative"), prot.alias("is_protected"), F.when(rep, 1.0).otherwise(F.round(dot("feature", "head"), 6)).alias("similarity_to_primary"), member_action(rep, prot).alias("action"))


REC = """rec0 AS (SELECT vec_id AS i, label, embedding, vec_id // 3 AS img,
  CASE WHEN vec_id % 10 IN (0,1,7) THEN 64 WHEN vec_id % 10 IN (2,3,4,5) THEN 128 WHEN vec_id % 10 = 6 THEN 24 WHEN vec_id % 10 = 8 THEN 224 ELSE 320 END AS bw,
  CASE WHEN vec_id % 10 IN (0,1,7) THEN 64 WHEN vec_id % 10 IN (2,3,4,5) THEN 96 WHEN vec_id % 10 = 6 THEN 24 WHEN vec_id % 10 = 8 THEN 192 ELSE 240 END AS bh,
  list_transform(embedding[1:4], lambda x: x::DOUBLE) AS c FROM embeddings),
rec AS (SELECT i AS record_idx, i AS record_id, label AS class_id, 'class_' || label AS class_name,
  'images/s' || (img % 4) || '/img_' || lpad(img::VARCHAR, 6, '0') || '.jpg' AS image_path,
  'labels/s' || (img % 4) || '/img_' || lpad(img::VARCHAR, 6, '0') || '.txt' AS label_path,
  'img_' || lpad(img::VARCHAR, 6, '0') || '.jpg' AS file_name, (i % 3)::INT AS annotation_line,
  ((37 * i) % (641 - bw))::INT AS x1, ((53 * i) % (481 - bh))::INT AS y1, bw AS bbox_width, bh AS bbox_height,
  (bw * bh) / (640 * 480) AS area_ratio, bw / bh AS aspect_ratio,
  CASE WHEN (bw * bh) / (640 * 480) < 0.005 THEN 'tiny' WHEN (bw * bh) / (640 * 480) < 0.02 THEN 'small' WHEN (bw * bh) / (640 * 480) < 0.08 THEN 'medium' WHEN (bw * bh) / (640 * 480) < 0.2 THEN 'large' ELSE 'huge' END AS size_bucket,
  CASE WHEN bw / bh >= 1.8 THEN 'wide' WHEN bw / bh <= 0.56 THEN 'tall' ELSE 'balanced' END AS aspect_bucket,
  embedding, list_transform(c, lambda x: x / sqrt(list_inner_product(c, c))) AS f FROM rec0)"""


def nb(k: int = TOP_K) -> str:
    return f"""nb AS (SELECT a.record_idx, b.record_idx AS neighbor_idx, list_inner_product(a.f, b.f) AS similarity,
  row_number() OVER (PARTITION BY a.record_idx ORDER BY list_inner_product(a.f, b.f) DESC, b.record_idx) AS rank,
  a.class_id, a.class_name, a.size_bucket, a.file_name, b.class_id AS nclass, b.class_name AS nname, b.size_bucket AS nsize
  FROM rec a JOIN rec b ON a.record_idx <> b.record_idx QUALIFY rank <= {k})"""


MEM = """mem AS (SELECT r.record_idx // 4 + 1 AS reduction_group_id, r.record_idx, h.record_idx AS primary_representative_idx, r.record_idx % 4 = 0 AS is_representative, r.record_idx % 7 = 3 AS is_protected,
  CASE WHEN r.record_idx % 4 = 0 THEN 1.0::DOUBLE ELSE round(list_inner_product(r.f, h.f), 6) END AS similarity_to_primary,
  CASE WHEN r.record_idx % 4 = 0 THEN 'KEEP_REPRESENTATIVE' WHEN r.record_idx % 7 = 3 THEN 'KEEP_PROTECTED_CROSS_CLASS' ELSE 'DROP_TIGHT_DUPLICATE' END AS action
  FROM rec r JOIN rec h ON h.record_idx = 4 * (r.record_idx // 4))"""

GRP = """grp AS (SELECT m.reduction_group_id, count(*) AS group_size, count(*) FILTER (m.action LIKE 'DROP%') AS drop_candidates, count(*) FILTER (m.action NOT LIKE 'DROP%') AS keep_count,
  round(count(*) FILTER (m.action LIKE 'DROP%') * 100.0 / count(*), 6) AS natural_record_reduction_pct, min(m.primary_representative_idx) AS primary_representative_idx,
  string_agg(DISTINCT r.class_id || ': ' || r.class_name, ', ' ORDER BY r.class_id || ': ' || r.class_name) AS classes, string_agg(DISTINCT r.size_bucket, ', ' ORDER BY r.size_bucket) AS size_buckets,
  round(min(m.similarity_to_primary), 6) AS min_similarity_to_primary, round(avg(m.similarity_to_primary), 8) AS mean_similarity_to_primary
  FROM mem m JOIN rec r USING (record_idx) GROUP BY 1),
grph AS (SELECT g.*, r.class_id, r.class_name, r.image_path AS representative_image_path FROM grp g JOIN rec r ON r.record_idx = g.primary_representative_idx)"""

EDGES = f"""nd AS (SELECT least(record_idx, neighbor_idx) AS a, greatest(record_idx, neighbor_idx) AS b, arg_min({{'s': similarity, 'c': class_id, 'n': class_name, 'z': size_bucket}}, record_idx) AS e
  FROM nb WHERE similarity >= {NEAR} AND class_id = nclass AND size_bucket = nsize GROUP BY 1, 2),
und AS (SELECT a, b FROM nd UNION ALL SELECT b, a FROM nd)"""

#: Components of the near-duplicate edges; recursive.
CC = """reach(node, r) AS (SELECT a, a FROM und UNION SELECT u.b, reach.r FROM reach JOIN und u ON u.a = reach.node),
cc AS (SELECT node AS record_idx, min(r) AS root FROM reach GROUP BY 1)"""


def medoid(rows: str, keys: str, out: str) -> str:
    """CTEs ``{out}_s`` (members with their centroid scores) and ``{out}`` (keys, representative_idx) over ``rows(keys.., record_idx, f)``."""
    return f"""{out}_u AS (SELECT {keys}, unnest(f) AS x, unnest(range(1, len(f) + 1)) AS p FROM {rows}),
{out}_a AS (SELECT {keys}, p, sum(x) AS x FROM {out}_u GROUP BY ALL),
{out}_c AS (SELECT {keys}, list(x ORDER BY p) AS c FROM {out}_a GROUP BY ALL),
{out}_s AS (SELECT m.*, round(list_inner_product(m.f, list_transform(c.c, lambda x: x / greatest(sqrt(list_inner_product(c.c, c.c)), 1e-12))), 10) AS score FROM {rows} m JOIN {out}_c c USING ({keys})),
{out} AS (SELECT {keys}, record_idx AS representative_idx FROM {out}_s QUALIFY row_number() OVER (PARTITION BY {keys} ORDER BY score DESC, record_idx) = 1)"""


def sql(body: str, *ctes: str) -> str:
    return "WITH RECURSIVE " + ",\n".join(ctes) + "\n" + body if ctes else body
