"""Image sizes from file headers, with a table of known sizes; detector rows and their suppression."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cropmill.functions.geometry import clamp
from cropmill.storage import small_batches


def header_size(data: bytes) -> tuple[int, int] | None:
    """Width and height of a PNG, JPEG, BMP, WebP or TIFF file; null for anything else or a cut header."""
    try:
        if data[:8] == b"\x89PNG\r\n\x1a\n":
            return struct.unpack(">II", data[16:24])
        if data[:2] == b"BM":
            w, h = struct.unpack("<ii", data[18:26])
            return w, abs(h)
        if data[:4] == b"RIFF" and data[8:12] == b"WEBP":
            kind = data[12:16]
            if kind == b"VP8X":
                return 1 + int.from_bytes(data[24:27], "little"), 1 + int.from_bytes(data[27:30], "little")
            if kind == b"VP8L":
                bits = int.from_bytes(data[21:25], "little")
                return 1 + (bits & 0x3FFF), 1 + (bits >> 14 & 0x3FFF)
            w, h = struct.unpack("<HH", data[26:30])
            return w & 0x3FFF, h & 0x3FFF
        if data[:2] == b"\xff\xd8":
            at = 2
            while at + 9 < len(data):
                if data[at] != 0xFF:
                    at += 1
                    continue
                mark = data[at + 1]
                if 0xC0 <= mark <= 0xCF and mark not in (0xC4, 0xC8, 0xCC):
                    h, w = struct.unpack(">HH", data[at + 5 : at + 9])
                    return w, h
                at += 2 if 0xD0 <= mark <= 0xD9 or mark in (0x01, 0xFF) else 2 + struct.unpack(">H", data[at + 2 : at + 4])[0]
            return None
        if data[:4] in (b"II*\0", b"MM\0*"):
            order = "<" if data[:1] == b"I" else ">"
            at = struct.unpack(order + "I", data[4:8])[0]
            found = {}
            for i in range(struct.unpack(order + "H", data[at : at + 2])[0]):
                tag, kind, _, value = struct.unpack(order + "HHII", data[at + 2 + 12 * i : at + 14 + 12 * i])
                found[tag] = value if kind == 4 or order == "<" else value >> 16
            return found[256], found[257]
    except (struct.error, KeyError, IndexError):
        pass
    return None


def image_sizes(spark: SparkSession, root: str, known: DataFrame | None = None) -> DataFrame:
    """``(path, mtime, bytes, width, height)`` of all files below ``root``; only those not in ``known`` (same path, time and length) are read."""
    small_batches(spark)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).withColumnRenamed("modificationTime", "mtime").withColumnRenamed("length", "bytes")
    key = ["path", "mtime", "bytes"]
    fresh = files if known is None else files.join(known.select(*key), key, "left_anti")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = [header_size(x.as_py() or b"") or (None, None) for x in batch.column("content")]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in key), pa.array([w for w, _ in sizes], pa.int32()), pa.array([h for _, h in sizes], pa.int32())], names=[*key, "width", "height"])

    read = fresh.select(*key, "content").mapInArrow(run, "path string, mtime timestamp, bytes long, width int, height int")
    return read if known is None else read.unionByName(known.join(files.select(*key), key, "left_semi").select(*read.columns))


def detections(rows: DataFrame, least: float = 0.25) -> DataFrame:
    """Detector rows ``(x1, y1, x2, y2, confidence, class_id, image_width, image_height)``: confident ones, clamped to the image, not empty."""
    box = [clamp(F.bround(F.col(c)).cast("int"), 0, F.col("image_width" if c[0] == "x" else "image_height")).alias(c) for c in ("x1", "y1", "x2", "y2")]
    rest = [c for c in rows.columns if c not in ("x1", "y1", "x2", "y2")]
    return rows.where(F.col("confidence") >= least).select(*rest, *box).where("x2 > x1 and y2 > y1")


def suppress(boxes: np.ndarray, scores: np.ndarray, classes: np.ndarray, overlap: float) -> list[int]:
    """Rows that stay: by falling score, without those of one class that overlap a kept one by more."""
    order, kept = np.lexsort((np.arange(len(scores)), -scores)).tolist(), []
    area = (boxes[:, 2] - boxes[:, 0]) * (boxes[:, 3] - boxes[:, 1])
    for i in order:
        near = [j for j in kept if classes[j] == classes[i]]
        if near:
            w = np.minimum(boxes[near, 2], boxes[i, 2]) - np.maximum(boxes[near, 0], boxes[i, 0])
            h = np.minimum(boxes[near, 3], boxes[i, 3]) - np.maximum(boxes[near, 1], boxes[i, 1])
            both = np.maximum(w, 0) * np.maximum(h, 0)
            if (both / np.maximum(area[near] + area[i] - both, 1e-9) > overlap).any():
                continue
        kept.append(i)
    return kept


def suppressed(rows: DataFrame, frame_col: str = "frame_index", overlap: float = 0.45, order_col: str | None = None) -> DataFrame:
    """Detections left after suppression within each frame; equal confidences are settled by ``order_col``, or by the boxes."""
    ties = [order_col] if order_col else ["x1", "y1", "x2", "y2", "class_id"]

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(ties, kind="stable").reset_index(drop=True)
        return frame.iloc[suppress(frame[["x1", "y1", "x2", "y2"]].to_numpy(float), frame["confidence"].to_numpy(), frame["class_id"].to_numpy(), overlap)]

    return rows.groupBy(frame_col).applyInPandas(run, rows.schema)
