"""Record tables: readers, writers, shards and their merge, media frames, reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cropmill.sources.labels import dense_ids


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """Records of a ``.jsonl`` file (one object a line), a ``.json`` array, or a Parquet table; boxes become structs."""
    if path.endswith(".jsonl"):
        rows = spark.read.json(path)
    elif path.endswith(".json"):
        rows = spark.read.option("multiLine", True).json(path)
    else:
        rows = spark.read.parquet(path)
    if "bbox_xyxy" in rows.columns:
        rows = rows.withColumn("bbox", F.struct(*[F.col("bbox_xyxy")[i].cast("int").alias(c) for i, c in enumerate(("x1", "y1", "x2", "y2"))])).drop("bbox_xyxy")
    return rows


def open_store(spark: SparkSession, path: str) -> DataFrame:
    """The records of an index folder: of ``records.parquet``, ``records.json`` and ``records.jsonl`` the first that is there."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    files = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for name in ("records.parquet", "records.json", "records.jsonl"):
        if files.exists(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder, name)):
            return read_records(spark, f"{path.rstrip('/')}/{name}")
    raise FileNotFoundError(f"no records in {path}")


def fetch(store: DataFrame, *ids: int) -> DataFrame:
    """The records of some ids; on Parquet the filter reaches the scan, which skips row groups."""
    return store.where(F.col("record_idx").isin(*ids))


def write_records(rows: DataFrame, path: str, kind: str = "parquet") -> None:
    """Parquet, or JSON lines with boxes as arrays of four."""
    if kind == "json":
        rows.withColumn("bbox_xyxy", F.array("bbox.x1", "bbox.y1", "bbox.x2", "bbox.y2")).drop("bbox").write.json(path)
    else:
        rows.write.parquet(path)


def shard_of(image_path: F.Column, shards: int) -> F.Column:
    """A shard that depends on the image only, so that an image's boxes stay together."""
    return F.pmod(F.xxhash64(image_path), F.lit(shards))


def write_shards(rows: DataFrame, path: str, shards: int) -> None:
    rows.withColumn("shard", shard_of(F.col("image_path"), shards)).repartition("shard").write.partitionBy("shard").parquet(path)


def shard_counts(rows: DataFrame, shards: int) -> DataFrame:
    return rows.groupBy(shard_of(F.col("image_path"), shards).alias("shard")).agg(F.count("*").alias("records"), F.count_distinct("image_path").alias("images"))


def merge_shards(rows: DataFrame, shard_col: str = "shard", local_col: str = "local_idx", out: str = "record_idx") -> DataFrame:
    """Rows of all shards with dense ids: the rows of the shards before, and the place within the shard."""
    before = rows.groupBy(shard_col).agg(F.count("*").alias("n")).withColumn("before", F.coalesce(F.sum("n").over(Window.orderBy(shard_col).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return rows.join(F.broadcast(before), shard_col).withColumn(out, F.col("before") + F.col(local_col)).drop("n", "before")


def mismatched_configs(configs: DataFrame, fields: list[str]) -> DataFrame:
    """``(field, values)`` of fields in which shards differ, paths compared with one kind of slash."""
    value = lambda c: F.rtrim(F.regexp_replace(F.col(c).cast("string"), r"\\", "/"), F.lit("/"))
    long = configs.select(F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.coalesce(value(c), F.lit("")).alias("value")) for c in fields])).alias("x")).select("x.*")
    return long.groupBy("field").agg(F.count_distinct("value").alias("values")).where("values > 1")


def joined_index(records: DataFrame, features: DataFrame) -> DataFrame:
    """Records with their vectors, those that have both."""
    return records.join(features, "record_idx")


def sample_frames(detections: DataFrame, stride: int, max_frames: int = 0, max_detections: int = 0, frame_col: str = "frame_index", order_cols: tuple[str, ...] = ()) -> DataFrame:
    """Detections of every ``stride``-th frame, of the first frames and detections only if bounded; ``det_id`` counts from 0 in frame order.

    Detections of one frame are ordered by ``order_cols``, or by all other columns. Numbers come from a range sort, not from one task.
    """
    rows = detections.where(F.pmod(F.col(frame_col), F.lit(stride)) == 0)
    if max_frames:
        rows = rows.where(F.col(frame_col) < max_frames * stride)
    order = [frame_col, *(order_cols or [c for c in detections.columns if c != frame_col])]
    return dense_ids(rows, order, "det_id", max_detections)


def read_frame(frames: DataFrame, video: str, frame_index: int) -> DataFrame:
    """The one row of a table of frames (``video``, ``frame_index``, ``content``) that a seek would read; none if it is out of range."""
    return frames.where((F.col("video") == video) & (F.col("frame_index") == frame_index)).limit(1)


def read_summary(spark: SparkSession, path: str) -> DataFrame:
    """The summary or metadata object of a report: one row of a JSON file; an empty table if there is none."""
    from pyspark.errors import AnalysisException

    try:
        return spark.read.option("multiLine", True).json(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], "summary string")


def read_report(spark: SparkSession, path: str, schema: str, rows: int = 0) -> DataFrame:
    """A report written as CSV with a header; its first ``rows`` only if given."""
    table = spark.read.csv(path, header=True, schema=schema, multiLine=True, escape='"')
    return table.limit(rows) if rows else table


def write_reports(tables: dict[str, DataFrame], path: str) -> None:
    """Each table as CSV with a header below ``path``; the summary as JSON."""
    for name, table in tables.items():
        flat = table.select([F.to_json(c).alias(c) if kind.startswith(("struct", "array", "map")) else F.col(c) for c, kind in table.dtypes])
        if name == "summary":
            table.coalesce(1).write.json(f"{path}/{name}")
        else:
            flat.write.csv(f"{path}/{name}", header=True, escape='"')


def latest(listing: DataFrame, path_col: str = "path", time_col: str = "mtime") -> DataFrame:
    """The newest path of a listing; ties go to the larger path."""
    return listing.agg(F.max_by(path_col, F.struct(time_col, path_col)).alias("latest"))
