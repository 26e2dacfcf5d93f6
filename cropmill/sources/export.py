"""Export of a reduced dataset: manifests, files of kept images, rewritten labels."""

from __future__ import annotations

import json
import os
import shutil
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cropmill.functions.text import relative_path
from cropmill.operators.reduction import filtered_labels, split_images
from cropmill.sources.labels import class_names
from cropmill.storage import settle, write_small


def manifests(images: DataFrame) -> dict[str, DataFrame]:
    """Kept image and label paths, and the rows of dropped images."""
    split = split_images(images)
    kept = split.where("not is_dropped")
    return {"keep_images": kept.select("image_path"), "keep_labels": kept.select("label_path"), "drop_image_candidates": split.where("is_dropped")}


def write_manifests(images: DataFrame, path: str) -> None:
    tables = manifests(images)
    for name in ("keep_images", "keep_labels"):
        tables[name].write.text(f"{path}/{name}")
    tables["drop_image_candidates"].write.csv(f"{path}/drop_image_candidates", header=True)


def copy_files(rows: DataFrame, target: str, mode: str = "copy") -> DataFrame:
    """``(source, target, status)`` of files ``(source, rel)`` put below ``target``: ``copied``, ``linked``, ``kept`` (was there) or ``missing``.

    Done where the rows are, so all executors must see both folders under these paths; a repeated task finds its files in place.
    """

    def run(part: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in part:
            said = []
            for source, rel in zip(frame["source"], frame["rel"], strict=True):
                to = os.path.join(target, rel)
                if not source or not os.path.exists(source):
                    said.append((source, to, "missing"))
                    continue
                os.makedirs(os.path.dirname(to), exist_ok=True)
                try:
                    if mode == "hardlink" and os.path.exists(to):
                        said.append((source, to, "kept"))
                        continue
                    if mode == "hardlink":
                        os.link(source, to)
                        said.append((source, to, "linked"))
                        continue
                except OSError:
                    pass  # another device: a copy serves
                shutil.copy2(source, to)
                said.append((source, to, "copied"))
            yield pd.DataFrame(said, columns=["source", "target", "status"])

    return rows.mapInPandas(run, "source string, target string, status string")


def copy_images(images: DataFrame, target: str, root: str, mode: str = "copy") -> DataFrame:
    """Copy or hard-link kept images below ``target``; what became of each file."""
    rows = manifests(images)["keep_images"].select(F.col("image_path").alias("source"), relative_path(F.col("image_path"), root, "external_images").alias("rel"))
    return settle(copy_files(rows, os.path.join(target, "images"), mode), "copied")


def reduced_yaml(spark: SparkSession, data_yaml: str, target: str) -> str:
    """The data file of a reduced dataset: its folder, and the class names of the full one."""
    names = class_names(spark, data_yaml).orderBy("class_id").collect()
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    return "\n".join([f"path: {quoted(target)}", "train: images", "val: images", "names:", *[f"  {r.class_id}: {quoted(r.class_name)}" for r in names]]) + "\n"


def export_reduced(spark: SparkSession, images: DataFrame, target: str, images_root: str = "", labels_root: str = "", data_yaml: str = "", mode: str = "manifest") -> DataFrame:
    """Manifests, files if ``mode`` is ``copy`` or ``hardlink``, the data file, and a summary row, which is returned and written too."""
    write_manifests(images, target)
    split = split_images(images)
    summary = split.agg(F.count_if(~F.col("is_dropped")).alias("kept_images"), F.count_if("is_dropped").alias("drop_image_candidates"))
    if mode in ("copy", "hardlink"):
        labels = manifests(images)["keep_labels"].select(F.col("label_path").alias("source"), relative_path(F.col("label_path"), labels_root, "external_labels").alias("rel"))
        for kind, done in (("images", copy_images(images, target, images_root, mode)), ("labels", settle(copy_files(labels, os.path.join(target, "labels"), mode), "copied"))):
            present = F.count_if(F.col("status") != "missing").alias(f"copied_{kind}")
            summary = summary.join(F.broadcast(done.agg(present, F.count_if(F.col("status") == "missing").alias(f"missing_{kind}"))))
    if data_yaml:
        write_small(spark, f"{target}/reduced_data.yaml", reduced_yaml(spark, data_yaml, target))
    summary = settle(summary.withColumn("mode", F.lit(mode)), "summary")
    write_small(spark, f"{target}/reduced_dataset_summary.json", json.dumps(summary.first().asDict()))
    return summary


def label_policy(wished: str, partial: bool) -> str:
    """``filtered`` or ``original``; a partial plan never filters labels."""
    policy = wished.lower() if wished and wished.lower() in ("filtered", "original") else "filtered"
    return "original_partial_plan" if partial and policy == "filtered" else policy


def label_plan(kept_records: DataFrame, images: DataFrame, files: DataFrame, root: str) -> DataFrame:
    """``(label_path, target, kept_annotations, content)``: labels of kept records on kept images, and where they go."""
    on_kept = kept_records.join(manifests(images)["keep_images"], "image_path", "left_semi")
    return filtered_labels(on_kept, files).withColumn("target", relative_path(F.col("label_path"), root, "external_labels"))


def write_labels(plan: DataFrame, target: str) -> None:
    """Write the label texts below ``target``, which all executors must see under this path."""

    def run(part: Iterator) -> None:
        for r in part:
            to = os.path.join(target, "labels", r.target)
            os.makedirs(os.path.dirname(to), exist_ok=True)
            with open(to, "w", encoding="utf-8") as f:
                f.write(r.content + "\n")

    plan.foreachPartition(run)
