"""Queries of single groups and records, media and text."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from cropmill.functions import text
from cropmill.operators import clustering, features, review
from cropmill.plans.core import STANDIN, _standin
from cropmill.plans.reports import _OV, _REV, FRAME, _frame, _near3
from cropmill.plans.views import MEM, REC, members, records, sql, table
from cropmill.sources import export, logs, media

QUERIES, ORACLE_SQL = {}, {}


def query(oracle: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLE_SQL[f.__name__] = oracle
        return f

    return add


@query(sql("SELECT record_idx, action, row_number() OVER (ORDER BY is_representative DESC, action, similarity_to_primary DESC, record_idx) AS place FROM mem WHERE reduction_group_id = 12", *_REV))
def group_compare(spark, sf):
    return review.group_compare(members(spark, sf), 12).select("record_idx", "action", "place")


@query(sql("SELECT record_idx, row_number() OVER (ORDER BY is_representative DESC, is_drop DESC, sim DESC, record_idx) AS place FROM ex WHERE reduction_group_id = (SELECT reduction_group_id FROM ex WHERE record_idx = 42) AND record_idx <> 42 QUALIFY place <= 8", *_REV, FRAME))
def record_inspector(spark, sf):
    return review.inspect_record(_frame(spark, sf), 42).select("record_idx", "place")


@query(sql("SELECT record_idx, class_name, size_bucket, image_path FROM rec WHERE record_idx IN (3, 77)", REC))
def two_point_compare(spark, sf):
    return records(spark, sf).where(F.col("record_idx").isin(3, 77)).select("record_idx", "class_name", "size_bucket", "image_path")


@query(sql("SELECT count(*) AS planned, count(*) FILTER (is_representative) AS representatives, count(*) FILTER (is_protected AND NOT is_representative) AS protected, count(*) FILTER (action LIKE 'DROP%') AS drops, 0::BIGINT AS other FROM mem", REC, MEM))
def record_flow(spark, sf):
    own = members(spark, sf)
    return review.record_flow(own, own.count())


@query(sql("SELECT count(*) AS images, count(*) FILTER (image_action LIKE 'DROP%') AS dropped, count(*) FILTER (image_action NOT LIKE 'DROP%') AS kept, count(*) FILTER (drop_record_candidates > 0 AND drop_record_candidates < planned_records) AS partial_labels FROM ip", REC, MEM, STANDIN))
def export_preview(spark, sf):
    return review.export_preview(_standin(spark, sf)[1])


@query(sql("SELECT image_path FROM ip WHERE image_action NOT LIKE 'DROP%'", REC, MEM, STANDIN))
def export_manifest(spark, sf):
    return export.manifests(_standin(spark, sf)[1])["keep_images"]


@query(sql("SELECT image_action, drop_safety, count(*) AS n FROM ip GROUP BY 1, 2", REC, MEM, STANDIN))
def image_action_counts(spark, sf):
    return _standin(spark, sf)[1].groupBy("image_action", "drop_safety").agg(F.count("*").alias("n"))


@query(sql("SELECT DISTINCT image_path FROM ex WHERE action_group = 'Drop candidate' ORDER BY image_path LIMIT 5000", *_REV, FRAME))
def selected_paths(spark, sf):
    return _frame(spark, sf).where("action_group = 'Drop candidate'").select("image_path").distinct().orderBy("image_path").limit(5000)


@query(sql("SELECT record_idx FROM no WHERE record_idx IN (SELECT record_idx FROM no WHERE class_name = 'class_3' OR other_class = 'class_3' UNION SELECT other_idx FROM no WHERE class_name = 'class_3' OR other_class = 'class_3')", REC, _OV))
def overlap_focus(spark, sf):
    own = records(spark, sf).select("record_idx", "class_name")
    points = _near3(spark, sf).join(own, "record_idx").join(own.select(F.col("record_idx").alias("other_idx"), F.col("class_name").alias("other_class")), "other_idx")
    return review.focus(points, "class_3").select("record_idx")


@query("SELECT event_id, CASE WHEN length(props) > 8 THEN props[1:5] || '...' ELSE props END AS short FROM events")
def ellipsized(spark, sf):
    return table(spark, sf, "events").select("event_id", text.ellipsis(F.col("props"), 8).alias("short"))


@query("SELECT event_id, CASE WHEN event_id % 1000 = 0 THEN 'encode | elapsed 7s' ELSE 'encode | ' || printf('%5.1f', event_id % 1000 / 10.0::DOUBLE) || '% | elapsed 7s | ETA ' || (SELECT CASE WHEN s >= 3600 THEN printf('%dh %02dm %02ds', s // 3600, s % 3600 // 60, s % 60) WHEN s >= 60 THEN printf('%dm %02ds', s // 60, s % 60) ELSE printf('%ds', s) END FROM (SELECT trunc((1000 - event_id % 1000) / (greatest(event_id % 1000, 1) / 7.0::DOUBLE))::BIGINT AS s)) END AS said FROM events")
def progress_eta_text(spark, sf):
    said = logs.progress_text(F.col("event_id") % 1000, F.lit(1000), F.lit("encode"), F.lit(7.0))
    return table(spark, sf, "events").select("event_id", said.alias("said"))


@query("SELECT event_id, CASE WHEN event_id % 3 = 0 THEN event_type WHEN event_id % 3 = 1 THEN event_type || ' / ' || CASE WHEN value < 50 THEN 'small' ELSE 'large' END ELSE 'All crops' END AS grouped FROM events")
def detection_groups(spark, sf):
    e, size = F.col("event_id") % 3, F.when(F.col("value") < 50, "small").otherwise("large")
    name = F.when(e == 0, F.col("event_type")).when(e == 1, F.concat_ws(" / ", "event_type", size)).otherwise("All crops")
    return table(spark, sf, "events").select("event_id", name.alias("grouped"))


def _detector_rows(spark, sf):
    i = F.col("event_id")
    g = F.floor(i / 4)
    x, y = (g * 37 % 600).cast("double"), (g * 53 % 440).cast("double")
    return table(spark, sf, "events").select(F.floor(i / 20).alias("frame_index"), i.alias("row_id"), (x - 5).alias("x1"), (y - 5).alias("y1"), (x + 60 + i % 40).alias("x2"), (y + 60 + i % 30).alias("y2"), ((i * 7 % 100) / 100.0).alias("confidence"), (i % 3).cast("int").alias("class_id"), F.lit(640).alias("image_width"), F.lit(480).alias("image_height"))


_DET = """dt AS (SELECT event_id AS row_id, event_id // 20 AS frame_index, (event_id // 4 * 37 % 600)::DOUBLE AS x, (event_id // 4 * 53 % 440)::DOUBLE AS y, event_id AS i, (event_id * 7 % 100) / 100.0::DOUBLE AS confidence FROM events),
d AS (SELECT row_id, frame_index, greatest(0, x - 5)::INT AS x1, greatest(0, y - 5)::INT AS y1, least(640, x + 60 + i % 40)::INT AS x2, least(480, y + 60 + i % 30)::INT AS y2, confidence, i % 3 AS class_id FROM dt WHERE confidence >= 0.25)"""

#: Detections of a frame by falling confidence; each is kept unless it overlaps a kept one of its class by more than 0.45.
_NMS = """dk AS (SELECT *, row_number() OVER (PARTITION BY frame_index ORDER BY confidence DESC, row_id) AS k, (x2 - x1) * (y2 - y1) AS area FROM d),
kp(frame_index, k, kept) AS (
  SELECT DISTINCT frame_index, 0::BIGINT, []::STRUCT(row_id BIGINT, x1 INT, y1 INT, x2 INT, y2 INT, area INT, class_id BIGINT)[] FROM dk
  UNION ALL
  SELECT frame_index, dk.k, CASE WHEN len(list_filter(kept, lambda b: b.class_id = dk.class_id AND greatest(0, least(b.x2, dk.x2) - greatest(b.x1, dk.x1)) * greatest(0, least(b.y2, dk.y2) - greatest(b.y1, dk.y1))
    / (b.area + dk.area - greatest(0, least(b.x2, dk.x2) - greatest(b.x1, dk.x1)) * greatest(0, least(b.y2, dk.y2) - greatest(b.y1, dk.y1)))::DOUBLE > 0.45)) = 0
    THEN list_append(kept, {'row_id': row_id, 'x1': x1, 'y1': y1, 'x2': x2, 'y2': y2, 'area': area, 'class_id': class_id}) ELSE kept END
  FROM kp JOIN dk USING (frame_index) WHERE dk.k = kp.k + 1),
nms AS (SELECT unnest(list_transform(arg_max(kept, k), lambda b: b.row_id)) AS row_id FROM kp GROUP BY frame_index)"""
_BOX = "row_id, frame_index, x1, y1, x2, y2"


@query(sql(f"SELECT {_BOX} FROM d", _DET))
def detector_rows(spark, sf):
    return media.detections(_detector_rows(spark, sf)).select("row_id", "frame_index", "x1", "y1", "x2", "y2")


@query(sql(f"SELECT {_BOX} FROM d JOIN nms USING (row_id)", _DET, _NMS))
def suppressed_detections(spark, sf):
    return media.suppressed(media.detections(_detector_rows(spark, sf)), order_col="row_id").select("row_id", "frame_index", "x1", "y1", "x2", "y2")


def _toy_encoder():
    def encode(path: str, boxes: list[tuple]) -> list[np.ndarray]:
        seed = sum(path.encode())
        maps = [np.random.default_rng(seed + n).normal(size=(8, n, n)) for n in (80, 40, 20)]
        return [features.joined_levels(maps, b, (640, 640), 1.0, (0.0, 80.0)) for b in boxes]

    return encode


@query()
def encoded_boxes(spark, sf):
    return features.encode_records(records(spark, sf), _toy_encoder)


@query()
def reduction_projection(spark, sf):
    """A sample in two dimensions with the distance from its centre."""
    rows = clustering.projection(clustering.sampled(records(spark, sf), 300, 3), 2)
    return rows.select("record_idx", F.round(F.sqrt(F.col("pc")[0] ** 2 + F.col("pc")[1] ** 2), 6).alias("distance"))


@query("SELECT event_type, count(*) AS n FROM events WHERE event_id % 7 = 0 GROUP BY 1")
def streamed_frame_counts(spark, sf):
    """Sampled frames read as a stream; its batches are written to the shared folder."""
    from cropmill.storage import fresh_path
    from cropmill.streaming.frames import sampled_frames

    schema = table(spark, sf, "events").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf)
    at, marks = fresh_path(spark, "frames"), fresh_path(spark, "frames-checkpoint")
    sampled_frames(stream, 7, "event_id").writeStream.format("parquet").option("path", at).option("checkpointLocation", marks).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(schema).parquet(at).groupBy("event_type").agg(F.count("*").alias("n"))


@query()
def feature_cluster_report(spark, sf):
    """Filter, sample, project, cluster, summarise: the clusters of a bounded sample (the sample is the feature; see ``clustering``)."""
    own = records(spark, sf).where("class_id < 3")
    rows = clustering.cluster(clustering.projection(clustering.sampled(own, 5_000, 1), 3), "bisecting", 4)
    return clustering.summarize(rows)
