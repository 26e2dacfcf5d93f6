"""Command line: curation reports, reduction plans, exports, metadata and shards over record and vector tables."""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cropmill.functions.text import matches_class
from cropmill.operators import calibration, clustering, curation, ivf, knn, outputs, reduction
from cropmill.sources import catalog, export, labels, media
from cropmill.sources import records as store
from cropmill.storage import settle


def loaded(spark: SparkSession, args: argparse.Namespace) -> DataFrame:
    """All records, joined with their vectors if there are any."""
    rows = store.read_records(spark, args.records)
    return store.joined_index(rows, spark.read.parquet(args.features)) if args.features else rows


def chosen(rows: DataFrame, args: argparse.Namespace) -> DataFrame:
    """The queries: records of the class and size that are asked for, and of those a sample if it is bounded."""
    rows = rows.where(matches_class(args.class_filter, F.col("class_id"), F.col("class_name")))
    rows = rows.where(F.col("size_bucket") == args.size) if args.size else rows
    return curation.sample_rows(rows, args.max_records, args.seed)


def searched(rows: DataFrame, args: argparse.Namespace) -> tuple[DataFrame, DataFrame, bool]:
    """Queries, their neighbours among all records, and whether they are but a part of these."""
    queries = chosen(rows, args)
    partial = reduction.is_partial(args.max_records, rows.count(), bool(args.class_filter or args.size))
    return queries, knn.knn_join(queries, rows, args.top_k, width=knn.search_width(1 << 62, args.top_k, args.rerank_k, 1)), partial


def curate(spark: SparkSession, args: argparse.Namespace) -> None:
    rows = loaded(spark, args)
    queries, near, partial = searched(rows, args)
    store.write_reports(outputs.curation_outputs(rows, queries, near, args.near, args.cross, args.rare, args.boundary, partial), args.out)


def reduce_(spark: SparkSession, args: argparse.Namespace) -> None:
    rows = loaded(spark, args)
    queries, near, partial = searched(rows, args)
    store.write_reports(outputs.reduction_outputs(rows, queries, near, args.near, args.cross, args.representatives, partial), args.out)


def calibrate(spark: SparkSession, args: argparse.Namespace) -> None:
    rows = loaded(spark, args)
    detail = settle(calibration.detail(searched(rows, args)[1], rows), "calibration")
    store.write_reports({"detail": detail, "bins": calibration.bins(detail), "thresholds": calibration.thresholds(detail), "classes": calibration.classes(detail)}, args.out)


def cluster(spark: SparkSession, args: argparse.Namespace) -> None:
    rows = clustering.projection(chosen(loaded(spark, args), args), 3)
    done = settle(clustering.cluster(rows, args.method, args.clusters, args.scope, args.seed), "clusters")
    store.write_reports({"points": done.drop("feature"), "clusters": clustering.summarize(done)}, args.out)


def search(spark: SparkSession, args: argparse.Namespace) -> None:
    rows = loaded(spark, args)
    found = knn.knn_join(rows.where(F.col("record_idx") == args.record), rows, args.top_k)
    store.write_reports({"neighbors": curation.with_sides(found, rows, "class_name", "size_bucket", "image_path").orderBy("rank")}, args.out)


def export_(spark: SparkSession, args: argparse.Namespace) -> None:
    """A reduced dataset from a plan's images, read from the report in ``--records``."""
    images = spark.read.csv(args.records, header=True, escape='"')
    export.export_reduced(spark, images, args.out, args.images_root, args.labels_root, args.data_yaml, args.mode)


def validate(spark: SparkSession, args: argparse.Namespace) -> None:
    rows, features = store.read_records(spark, args.records), spark.read.parquet(args.features)
    catalog.validation({"num_records": rows.count(), "dim": args.dim}, rows, features, args.dim).coalesce(1).write.csv(args.out, header=True)


def scan(spark: SparkSession, args: argparse.Namespace) -> None:
    """Label files and their images below ``--records`` (labels) and ``--images-root``, as records."""
    images = labels.find_images(spark, args.images_root)
    sizes = media.image_sizes(spark, args.images_root).select(F.col("path").alias("image_path"), F.col("width").alias("image_width"), F.col("height").alias("image_height"))
    parsed = labels.parse_labels(labels.match_images(labels.read_labels(spark, args.records), images))
    store.write_records(labels.records(parsed.join(sizes, "image_path"), max_records=args.max_records), args.out)


def shards(spark: SparkSession, args: argparse.Namespace) -> None:
    store.write_shards(loaded(spark, args), args.out, args.shards)


def metadata(spark: SparkSession, args: argparse.Namespace) -> None:
    rows = loaded(spark, args)
    store.write_reports({"classes": rows.groupBy("class_id", "class_name").count(), "sizes": rows.groupBy("size_bucket").count()}, args.out)


def index(spark: SparkSession, args: argparse.Namespace) -> None:
    rows = loaded(spark, args)
    plan = ivf.plan(rows.count())
    if plan["type"] == "flat":
        rows.select("record_idx", "feature").write.parquet(args.out)
    else:
        ivf.build(rows, plan["nlist"], plan["m"], plan["train"]).save(args.out)


COMMANDS = {"curate": curate, "reduce": reduce_, "calibrate": calibrate, "cluster": cluster, "search": search, "export": export_, "validate": validate, "scan": scan, "shards": shards, "metadata": metadata, "index": index}


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(prog="cropmill")
    p.add_argument("command", choices=COMMANDS)
    p.add_argument("--records", required=True)
    p.add_argument("--features")
    p.add_argument("--out", required=True)
    p.add_argument("--top-k", type=int, default=50)
    p.add_argument("--near", type=float, default=0.98)
    p.add_argument("--cross", type=float, default=0.90)
    p.add_argument("--rare", type=int, default=5)
    p.add_argument("--boundary", type=int, default=2)
    p.add_argument("--representatives", type=int, default=1)
    p.add_argument("--max-records", type=int, default=0)
    p.add_argument("--seed", type=int, default=42)
    p.add_argument("--class-filter", default="")
    p.add_argument("--size", default="")
    p.add_argument("--shards", type=int, default=8)
    p.add_argument("--rerank-k", type=int, default=200)
    p.add_argument("--record", type=int, default=0)
    p.add_argument("--method", default="kmeans", choices=("kmeans", "bisecting", "birch", "hdbscan"))
    p.add_argument("--scope", default="global", choices=("global", "per_class", "class_size"))
    p.add_argument("--clusters", type=int, default=8)
    p.add_argument("--dim", type=int, default=1792)
    p.add_argument("--mode", default="manifest", choices=("manifest", "copy", "hardlink"))
    p.add_argument("--images-root", default="")
    p.add_argument("--labels-root", default="")
    p.add_argument("--data-yaml", default="")
    args = p.parse_args(argv)
    COMMANDS[args.command](SparkSession.builder.getOrCreate(), args)


if __name__ == "__main__":
    main()
