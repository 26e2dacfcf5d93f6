"""The project catalogue: a small table in which the last write of a name counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cropmill.functions.text import slug


def upsert(projects: DataFrame, changes: DataFrame) -> DataFrame:
    """Projects ``(name, settings, created_at, updated_at)`` after changes ``(name, settings, at)``; a project keeps its creation time."""
    rows = projects.select("name", "settings", F.col("created_at"), F.col("updated_at").alias("at")).unionByName(changes.select("name", "settings", F.col("at").alias("created_at"), "at"))
    out = rows.groupBy("name").agg(F.max_by("settings", "at").alias("settings"), F.min("created_at").alias("created_at"), F.max("at").alias("updated_at"))
    return out.withColumn("slug", slug(F.col("name")))


def delete(projects: DataFrame, names: list[str]) -> DataFrame:
    return projects.where(~F.col("name").isin(names))


def validation(config: dict, records: DataFrame, features: DataFrame, dim: int) -> DataFrame:
    """``(item, status, detail)``: whether counts and dimensions of config, records and vectors agree."""
    r = records.agg(F.count("*").alias("r"))
    f = features.agg(F.count("*").alias("f"), F.count_if(F.size("feature") != dim).alias("bad"), F.count_if(F.col("feature").isNull()).alias("none"))
    both = r.join(F.broadcast(f))
    checks = [("config_rows", F.lit(config.get("num_records")) == F.col("f")), ("record_rows", F.col("r") == F.col("f")), ("dimension", (F.col("bad") == 0) & (F.lit(config.get("dim")) == dim)), ("vectors_present", F.col("none") == 0)]
    rows = F.array(*[F.struct(F.lit(n).alias("item"), F.when(c, "PASS").otherwise("FAIL").alias("status"), F.format_string("records=%d features=%d", "r", "f").alias("detail")) for n, c in checks])
    return both.select(F.explode(rows).alias("x")).select("x.*")
