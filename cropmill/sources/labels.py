"""Label files and their images: listing, parsing, matching, boxes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cropmill.functions.geometry import box_from_center, large_enough
from cropmill.storage import settle

# Image suffixes, in the order in which a fallback tries them.
SUFFIXES = (".jpg", ".jpeg", ".png", ".bmp", ".webp", ".tif", ".tiff")


def find_images(spark: SparkSession, root: str) -> DataFrame:
    """``image_path`` of all images below a folder, suffixes in any case; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    return files.select(F.col("path").alias("image_path"), F.col("length").alias("bytes")).where(F.lower("path").rlike(r"\.(" + "|".join(s[1:] for s in SUFFIXES) + ")$"))


def read_labels(spark: SparkSession, root: str) -> DataFrame:
    """``(label_path, content)`` of all ``.txt`` files below a folder."""
    return spark.read.format("text").option("wholetext", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*.txt").load(root).select(F.col("_metadata.file_path").alias("label_path"), F.col("value").alias("content"))


def label_pairs(spark: SparkSession, root: str) -> DataFrame:
    """``(images_root, labels_root)``: folders below ``root`` that hold ``labels`` beside ``JPEGImages`` or ``images``.

    Folders come from Spark's own listing of files, on any file system it knows. Pairs inside such payload folders don't count.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    payload = r"^(.*)/(JPEGImages|images|labels)/"
    # The first payload folder of a path is greedy-free: what stands before it holds none.
    head = F.regexp_extract("path", r"^(.*?)/(?:JPEGImages|images|labels)/", 1)
    kind = F.regexp_extract("path", r"^.*?/(JPEGImages|images|labels)/", 1)
    found = files.where(F.col("path").rlike(payload)).select(head.alias("head"), kind.alias("kind")).distinct()
    labels = found.where("kind = 'labels'").select("head")
    pairs = found.where("kind <> 'labels'").join(labels, "head")
    return pairs.select(F.concat_ws("/", "head", "kind").alias("images_root"), F.concat_ws("/", "head", F.lit("labels")).alias("labels_root"))


def image_label_sources(spark: SparkSession, images_root: str, labels_root: str = "", layout: str = "single") -> DataFrame:
    """``(image_path, images_root, labels_root)`` of a dataset: one pair of folders, or with layout ``nested`` every pair below ``images_root``."""
    if layout != "nested":
        return find_images(spark, images_root).select("image_path", F.lit(images_root).alias("images_root"), F.lit(labels_root).alias("labels_root"))
    pairs = label_pairs(spark, images_root)
    images = find_images(spark, images_root).select("image_path", F.regexp_extract("image_path", r"^(.*?/(?:JPEGImages|images))/", 1).alias("images_root"))
    return images.join(pairs, "images_root").select("image_path", "images_root", "labels_root")


def stem_key(path: F.Column, root: str) -> list[F.Column]:
    """Relative folder and lower-case stem of a path below ``root``."""
    rel = F.regexp_replace(F.regexp_replace(path, "^.*?" + root.rstrip("/") + "/", ""), r"\.[^./]*$", "")
    return [F.regexp_replace(rel, r"(^|/)[^/]*$", "").alias("rel_dir"), F.lower(F.regexp_extract(rel, r"([^/]*)$", 1)).alias("stem")]


def match_images(labels: DataFrame, images: DataFrame, labels_root: str = "labels", images_root: str = "images", others: DataFrame | None = None) -> DataFrame:
    """Label rows with their ``image_path``: same relative folder and stem in any case; of several the first lower-case name wins. Null if none.

    ``others`` (``image_path``) are files that the listing of images left out, links or late arrivals say; a label without an image takes
    the one of its very stem whose suffix comes first in ``SUFFIXES``.
    """
    key = ["rel_dir", "stem"]
    found = images.select("image_path", *stem_key(F.col("image_path"), images_root))
    first = found.groupBy(*key).agg(F.min_by("image_path", F.struct(F.lower("image_path"), "image_path")).alias("image_path"))
    out = labels.select("*", *stem_key(F.col("label_path"), labels_root)).join(first, key, "left")
    if others is not None:
        own = ["rel_dir", "name"]
        name = lambda c: F.regexp_extract(c, r"([^/]*)\.[^./]*$", 1).alias("name")
        suffix = F.lower(F.concat(F.lit("."), F.regexp_extract("image_path", r"\.([^./]*)$", 1)))
        more = others.select("image_path", *stem_key(F.col("image_path"), images_root)[:1], name("image_path"), F.array_position(F.lit(list(SUFFIXES)), suffix).alias("place")).where("place > 0")
        more = more.groupBy(*own).agg(F.min_by("image_path", F.struct("place", "image_path")).alias("fallback"))
        out = out.withColumn("name", name("label_path")).join(more, own, "left").withColumn("image_path", F.coalesce("image_path", "fallback")).drop("name", "fallback")
    return out.drop(*key)


def depth_first(path: F.Column) -> F.Column:
    """A sort key that lists a folder's files before its subfolders, both by name, as a walk from the top does."""
    parts = F.split(path, "/")
    folders = F.transform(F.slice(parts, 1, F.size(parts) - 1), lambda p: F.concat(F.lit("1"), p))
    return F.concat(folders, F.array(F.concat(F.lit("0"), F.element_at(parts, -1))))


def label_path_for_image(path: F.Column, images_root: str = "images", labels_root: str = "labels") -> F.Column:
    return F.regexp_replace(F.regexp_replace(path, f"(^|/){images_root}/", f"$1{labels_root}/"), r"\.[^./]*$", ".txt")


def parse_labels(files: DataFrame, class_filter: list[int] | None = None) -> DataFrame:
    """``files`` rows by annotation: ``annotation_line`` (from 0, blank lines count), class and centre box; lines that aren't five finite numbers are left out."""
    lines = files.select("*", F.posexplode(F.split("content", "\r\n|\n|\r")).alias("annotation_line", "line")).drop("content")
    token = F.split(F.trim(F.regexp_replace("line", r"\s+", " ")), " ")
    numbers = F.transform(F.slice(token, 1, 5), lambda x: x.try_cast("double"))
    rows = lines.withColumn("n", numbers).where((F.size("n") == 5) & F.forall("n", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))
    rows = rows.select(*[c for c in lines.columns if c != "line"], F.get("n", F.lit(0)).cast("int").alias("class_id"), *[F.get("n", F.lit(i + 1)).alias(c) for i, c in enumerate(("cx", "cy", "w", "h"))])
    return rows.where(F.col("class_id").isin(class_filter)) if class_filter else rows


def records(parsed: DataFrame, class_names: DataFrame | None = None, expand: float = 0.0, least: int = 2, max_records: int = 0) -> DataFrame:
    """Records of parsed labels with ``image_width`` and ``image_height``: pixel boxes, small ones left out, ids dense in the order of a walk from the top, then of lines."""
    box = box_from_center(F.col("cx"), F.col("cy"), F.col("w"), F.col("h"), F.col("image_width"), F.col("image_height"), expand)
    rows = parsed.where("image_path is not null and image_width is not null").withColumn("bbox", box).where(large_enough(F.col("bbox"), least)).drop("cx", "cy", "w", "h")
    if class_names is not None:
        rows = rows.join(class_names, "class_id", "left").withColumn("class_name", F.coalesce("class_name", F.col("class_id").cast("string")))
    else:
        rows = rows.withColumn("class_name", F.col("class_id").cast("string"))
    ordered = dense_ids(rows.withColumn("walk_", depth_first(F.col("label_path"))), ["walk_", "annotation_line"], "record_id", max_records)
    return ordered.drop("walk_")


def dense_ids(rows: DataFrame, order: list[str], out: str, most: int = 0) -> DataFrame:
    """Dense numbers from 0 in the given order: a range sort, and the counts of the parts before."""
    cut = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("p_", F.spark_partition_id()).withColumn("i_", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)))
    cut = settle(cut, "ids")
    before = cut.groupBy("p_").agg(F.count("*").alias("n_")).withColumn("b_", F.coalesce(F.sum("n_").over(Window.orderBy("p_").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    done = cut.join(F.broadcast(before), "p_").withColumn(out, F.col("b_") + F.col("i_")).drop("p_", "i_", "b_", "n_")
    return done.where(F.col(out) < most) if most else done


def class_names(spark: SparkSession, path: str) -> DataFrame:
    """``(class_id, class_name)`` from the ``names`` of a data file: a list, or a mapping of ids, block or inline."""
    text = "\n".join(r.value for r in spark.read.text(path).collect())
    rows, inside = [], False
    import re

    for line in text.splitlines():
        if m := re.match(r"names:\s*(.*)$", line):
            inside, body = True, m[1].strip()
            if body.startswith("["):
                rows = [(i, x.strip().strip("'\"")) for i, x in enumerate(body.strip("[]").split(","))]
            elif body.startswith("{"):
                rows = [(int(a), b.strip().strip("'\"")) for a, b in (x.split(":", 1) for x in body.strip("{}").split(","))]
        elif inside and (m := re.match(r"\s+(\d+)\s*:\s*(.+)$", line)):
            rows.append((int(m[1]), m[2].strip().strip("'\"")))
        elif inside and (m := re.match(r"\s*-\s+(.+)$", line)):
            rows.append((len(rows), m[1].strip().strip("'\"")))
        elif inside and line.strip():
            inside = False
    return spark.createDataFrame(rows, "class_id int, class_name string")
