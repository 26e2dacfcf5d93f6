"""Detections and logs as streams: stateless sampling, search against a stored table in each batch, windowed counts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from cropmill.operators.knn import knn_join


def sampled_frames(stream: DataFrame, stride: int, frame_col: str = "frame_index") -> DataFrame:
    return stream.where(F.pmod(F.col(frame_col), F.lit(stride)) == 0)


def class_counts(stream: DataFrame, time_col: str = "ts", class_col: str = "class_name", every: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts of classes by tumbling window; rows later than ``late`` are left out."""
    return stream.withWatermark(time_col, late).groupBy(F.window(time_col, every).alias("w"), class_col).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), class_col, "n")


def search_each_batch(stream: DataFrame, base: DataFrame, k: int, sink: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """The ``k`` nearest stored records of each streamed query, batch by batch."""

    def run(batch: DataFrame, number: int) -> None:
        if not batch.isEmpty():
            sink(knn_join(batch, base, k), number)

    return stream.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).start()
