"""Image headers, suppression, exports, and the command line."""

import struct
import zlib

import numpy as np
from pyspark.sql import functions as F

from cropmill import cli
from cropmill.operators import features, reduction
from cropmill.plans import views
from cropmill.sources import export, labels, media


def png(w, h):
    return b"\x89PNG\r\n\x1a\n" + struct.pack(">I", 13) + b"IHDR" + struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)


def jpeg(w, h):
    return b"\xff\xd8\xff\xe0" + struct.pack(">H", 16) + b"JFIF\0" + bytes(9) + b"\xff\xc0" + struct.pack(">HBHHB", 17, 8, h, w, 3) + bytes(9)


def test_headers():
    assert media.header_size(png(7, 9)) == (7, 9)
    assert media.header_size(jpeg(640, 480)) == (640, 480)
    assert media.header_size(b"BM" + bytes(16) + struct.pack("<ii", 5, -6)) == (5, 6)
    assert media.header_size(b"RIFF\0\0\0\0WEBPVP8X" + bytes(8) + (9).to_bytes(3, "little") + (19).to_bytes(3, "little")) == (10, 20)
    assert media.header_size(b"II*\0\x08\0\0\0\x02\0" + struct.pack("<HHII", 256, 4, 1, 30) + struct.pack("<HHII", 257, 4, 1, 40)) == (30, 40)
    assert media.header_size(b"") is media.header_size(b"\xff\xd8\xff") is media.header_size(zlib.compress(b"x")) is None


def test_sizes_are_read_once(spark, tmp_path):
    (tmp_path / "a.png").write_bytes(png(3, 4))
    known = spark.createDataFrame(media.image_sizes(spark, str(tmp_path)).collect(), "path string, mtime timestamp, bytes long, width int, height int").withColumn("width", F.lit(99))
    (tmp_path / "b.jpg").write_bytes(jpeg(5, 6))
    got = {r.path[-5:]: (r.width, r.height) for r in media.image_sizes(spark, str(tmp_path), known).collect()}
    assert got == {"a.png": (99, 4), "b.jpg": (5, 6)}
    assert labels.find_images(spark, str(tmp_path)).count() == 2


def test_suppression():
    boxes = np.array([[0, 0, 10, 10], [1, 1, 10, 10], [0, 0, 10, 10], [50, 50, 60, 60]], float)
    assert media.suppress(boxes, np.array([0.5, 0.9, 0.8, 0.1]), np.array([1, 1, 2, 1]), 0.45) == [1, 2, 3]


def test_pooling():
    m = np.arange(16.0).reshape(1, 4, 4)
    assert features.pool_box(m, (0, 0, 2, 2), (4, 4), 1.0, (0, 0)) == [2.5]
    assert features.pool_box(m, (3.9, 3.9, 3.9, 3.9), (4, 4), 1.0, (0, 0)) == [15.0]


def test_export(spark, sf, tmp_path):
    for kind in ("images", "labels"):
        (tmp_path / kind).mkdir()
    rows = []
    for i in range(4):
        (tmp_path / "images" / f"{i}.png").write_bytes(png(2, 2))
        (tmp_path / "labels" / f"{i}.txt").write_text("1 a\n2 b\n3 c\n")
        rows += [(3 * i + k, f"{tmp_path}/images/{i}.png", f"{tmp_path}/labels/{i}.txt", k, "c", "DROP_X" if i == 0 or k == 1 else "KEEP") for k in range(3)]
    reco = spark.createDataFrame(rows, "record_idx long, image_path string, label_path string, annotation_line int, class_name string, action string")
    images = reduction.image_plan(reco)
    export.write_manifests(images, f"{tmp_path}/m")
    assert spark.read.text(f"{tmp_path}/m/keep_images").count() == 3
    export.copy_images(images, f"{tmp_path}/out", f"{tmp_path}/images")
    assert sorted(p.name for p in (tmp_path / "out/images").iterdir()) == ["1.png", "2.png", "3.png"]
    files = labels.read_labels(spark, f"{tmp_path}/labels").withColumn("label_path", F.regexp_replace("label_path", "^file:/+", "/"))
    export.write_labels(export.label_plan(reco.where("action = 'KEEP'"), images, files, f"{tmp_path}/labels"), f"{tmp_path}/out")
    assert (tmp_path / "out/labels/2.txt").read_text() == "1 a\n3 c\n"
    assert export.label_policy("filtered", True) == "original_partial_plan"


def test_command_line(spark, sf, tmp_path):
    views.records(spark, sf).drop("feature", "embedding").where("record_idx < 60").write.parquet(f"{tmp_path}/r")
    views.records(spark, sf).select("record_idx", "feature").write.parquet(f"{tmp_path}/f")
    base = ["--records", f"{tmp_path}/r", "--features", f"{tmp_path}/f", "--near", "0.9", "--cross", "0.99"]
    for command in ("curate", "reduce", "shards", "metadata", "index"):
        cli.main([command, *base, "--out", f"{tmp_path}/{command}"])
    assert spark.read.csv(f"{tmp_path}/curate/curation_recommendations", header=True).count() == 60
    assert spark.read.parquet(f"{tmp_path}/shards").count() == 60
