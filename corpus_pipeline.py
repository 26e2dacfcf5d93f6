"""A corpus pipeline over ``documents``: quality, near copies, benchmark passages, secrets, packing.

Each stage takes ``(spark, docs, sf_dir)`` and is judged on its own input; all but the last return the columns of ``documents``, and
other columns, whatever their names, are left out. A null text is an empty one, rows of null or repeated ids are rows like others, and an
empty table gives an empty table; what else a stage does with such rows stands in its docstring.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cropmill.llm import nearcopies, packing, quality, secretscan, winnowing
from cropmill.llm.queries import table, tokenizer_path
from cropmill.storage import fresh_path

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose chance of quality label 1 is at least one half; others go. Repeated rows are judged alike."""
    forest = quality.learn(docs, table(spark, sf_dir, "labels"))
    return quality.scored(docs, forest, out="quality_score").where("quality_score >= 0.5").select(*COLUMNS)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of each group of near copies: five-word shingles of similarity 0.8 or more.

    SimHash links come first; an exact join finds what they miss. Null and empty texts are copies of each other; null ids count as
    largest; of equal rows one stays.
    """
    return nearcopies.deduplicated(docs, shingle=5, similarity=0.8).select(*COLUMNS)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that share no run of ten words with (and hold no shorter whole) benchmark item; others go.

    A null text shares nothing, so its row stays as it is.
    """
    bench = table(spark, sf_dir, "benchmark").select("item_id", "text")
    found = winnowing.matched_runs(docs.select(F.struct(*COLUMNS).alias("row"), "text"), bench, id_col="row")
    return found.where(F.size("runs") == 0).select("row.*")


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, every secret in their texts replaced by a mark; ``n_chars`` follows the text. Null texts stay null."""
    model = secretscan.train(secretscan.labelled_samples(docs))
    found = secretscan.secret_spans(docs, model, out="secret_spans")
    # The new text has a name of its own: within one select, a lambda's column may mean another column's alias.
    clean = found.withColumn("clean", secretscan.redacted(F.col("text"), F.col("secret_spans")))
    n = F.when(F.size("secret_spans") > 0, F.length("clean").cast("long")).otherwise(F.col("n_chars"))
    return clean.select("doc_id", F.col("clean").alias("text"), "lang", "source", n.alias("n_chars"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of all documents that are left, in sequences without padding. A null text has one token, the end mark."""
    return packing.packed(docs, tokenizer_path())


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", keep_quality),
    ("near_duplicates", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("secrets", redact_secrets),
    ("packing", pack),
]

#: The classifier, the fingerprints and the tokenizer are beyond SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's rows are written to the shared folder and read again by the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = fresh_path(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
