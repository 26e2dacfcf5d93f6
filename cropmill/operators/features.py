"""Vectors of boxes: a pluggable encoder over images, box pooling on feature maps."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cropmill.functions.geometry import letterbox_shape
from cropmill.operators.knn import knn_join

#: Vector lengths of the named encoders that a caller may plug in.
DIMENSIONS = {"resnet18": 512, "resnet50": 2048, "dinov2_vits14": 384, "detector_p3_p5": 1792}


def pool_box(feature_map: np.ndarray, box: tuple[float, float, float, float], tensor_hw: tuple[int, int], ratio: float, pad: tuple[float, float]) -> np.ndarray:
    """Mean over the cells of a (channels, height, width) map that a box covers, one cell at least."""
    _, fh, fw = feature_map.shape
    (x1, y1, x2, y2), (th, tw) = box, tensor_hw

    def cells(lo: float, hi: float, p: float, size: int, n: int) -> tuple[int, int]:
        a = int(np.floor((lo * ratio + p) / max(1, size) * n))
        b = int(np.ceil((hi * ratio + p) / max(1, size) * n))
        a = max(0, min(n - 1, a))
        return a, max(a + 1, min(n, b))

    (ax, bx), (ay, by) = cells(x1, x2, pad[0], tw, fw), cells(y1, y2, pad[1], th, fh)
    return feature_map[:, ay:by, ax:bx].mean(axis=(1, 2))


def joined_levels(maps: list[np.ndarray], box: tuple, tensor_hw: tuple[int, int], ratio: float, pad: tuple[float, float]) -> np.ndarray:
    """A box's pooled vectors of all levels, concatenated and normalised."""
    v = np.concatenate([pool_box(m, box, tensor_hw, ratio, pad) for m in maps])
    return v / max(float(np.sqrt((v * v).sum())), 1e-12)


def encode_records(records: DataFrame, make_encoder: Callable[[], Callable[[str, list[tuple]], list[np.ndarray]]], img_size: int = 640, attempts: int = 4) -> DataFrame:
    """``(record_idx, feature)``: ``make_encoder`` builds, once a task, a function from an image path and its boxes to their vectors.

    An image's boxes meet in one task, and images of one letterbox shape follow each other. An image that can't be read after
    ``attempts`` tries gives null vectors.
    """
    shape = letterbox_shape(F.col("image_width"), F.col("image_height"), img_size, img_size)
    rows = records.select("record_idx", "image_path", F.col("bbox.x1").alias("x1"), F.col("bbox.y1").alias("y1"), F.col("bbox.x2").alias("x2"), F.col("bbox.y2").alias("y2"), shape.alias("shape"))
    dealt = rows.repartition("image_path").sortWithinPartitions("shape", "image_path", "record_idx").drop("shape")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = make_encoder()

        def done(rows: pd.DataFrame) -> pd.DataFrame:
            out = []
            for path, group in rows.groupby("image_path", sort=False):
                vectors = [None] * len(group)
                for _ in range(attempts):
                    try:
                        vectors = [np.asarray(v, float).tolist() for v in encode(path, list(group[["x1", "y1", "x2", "y2"]].itertuples(index=False, name=None)))]
                        break
                    except OSError:
                        continue
                out.append(pd.DataFrame({"record_idx": group["record_idx"], "feature": vectors}))
            return pd.concat(out) if out else pd.DataFrame({"record_idx": [], "feature": []})

        held = None
        for frame in frames:
            rows = frame if held is None else pd.concat([held, frame])
            last = rows["image_path"] == rows["image_path"].iloc[-1] if len(rows) else rows["image_path"] == ""
            held = rows[last]  # the last image may go on in the next batch
            if not last.all():
                yield done(rows[~last])
        if held is not None and len(held):
            yield done(held)

    return dealt.mapInPandas(run, "record_idx long, feature array<double>")


def search_box(spark: SparkSession, base: DataFrame, make_encoder: Callable[[], Callable[[str, list[tuple]], list[np.ndarray]]], image_path: str, size: tuple[int, int], box: tuple | None = None, k: int = 10) -> DataFrame:
    """``(neighbor_idx, similarity, rank)``: records of ``base`` most like a box of an image, or the whole image (a crop) without a box."""
    x1, y1, x2, y2 = box or (0, 0, *size)
    row = [(-1, image_path, (int(x1), int(y1), int(x2), int(y2)), size[0], size[1])]
    ask = spark.createDataFrame(row, "record_idx long, image_path string, bbox struct<x1:int,y1:int,x2:int,y2:int>, image_width int, image_height int")
    return knn_join(encode_records(ask, make_encoder), base, k, exclude_self=False).select("neighbor_idx", "similarity", "rank")


def batch_size(memory_gb: float | None) -> int:
    """Images that an accelerator of so much memory encodes at once; without one, one."""
    if memory_gb is None:
        return 1
    # Least memory and batch.
    return next((n for least, n in ((23, 8), (15, 6), (10, 4)) if memory_gb >= least), 2)
