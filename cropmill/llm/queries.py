"""The thin queries over the standard tables, one for each operator of the subpackage, and the SQL they are checked against."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cropmill.llm import chat, licenses, oracles, packing, quality, secretscan, simhash, suffixes, vptree, warc, winnowing
from cropmill.storage import fresh_path


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"), threshold=0.8)


def op2_repeated_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.without_repeats(table(spark, sf_dir, "documents"), span=400, passage_words=50).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "n_passage_words")


def op3_simhash_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"), shingle=4, bits=4)


def op4_pack_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(table(spark, sf_dir, "documents"), tokenizer_path(), capacity=2048)


def op5_quality_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    forest = quality.learn(docs, table(spark, sf_dir, "labels"), label_col="quality", sample=20_000)
    return quality.scored(docs, forest).select("doc_id", quality.held_out("doc_id").alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op6_warc_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_path(spark, "warc")
    warc.write_archives(table(spark, sf_dir, "pages"), path)
    return warc.read_archives(spark, path).where("not gap").select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op7_secret_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = secretscan.train(secretscan.labelled_samples(docs))
    found = secretscan.secret_spans(docs, model)
    spans = F.col("secrets")
    counts = [F.size(secretscan.of_kind(spans, k)).cast("long").alias(f"n_{k}") for k in secretscan.KINDS]
    base = F.filter(spans, lambda s: s["kind"] < 3)
    return found.select("doc_id", *counts, F.sha2(secretscan.written(base), 256).alias("base_sha256"), secretscan.written(spans).alias("spans"))


def op8_winnow_contamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = winnowing.matched_runs(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), window=10, k=5)
    return found.select("doc_id", "n_words", winnowing.hit_words().alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256")).withColumn("contaminated", F.col("n_hit") > 0)


def op9_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    more = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    done = chat.formatted(rows.unionByName(more))
    read = done.select("conv_id", "formatted", chat.read_back(F.col("formatted")).alias("turns"), chat.under_mask(F.col("formatted"), F.col("loss_mask")).alias("loss"))
    said_by = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said_by, 256).alias("turns_sha256"), F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"))


def op10_vptree_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return vptree.nearest(rows, rows.where(F.col("vec_id") % 20 == 0), k=20, factor=1.0)


QUERIES = {f.__name__: f for f in (op1_license_scan, op2_repeated_strings, op3_simhash_components, op4_pack_sequences, op5_quality_scores, op6_warc_round_trip, op7_secret_spans, op8_winnow_contamination, op9_chat_formatting, op10_vptree_neighbours)}

#: Fingerprints, tokens, scores and trained models (3, 4, 5, 7) are beyond SQL; tests compare those with brute force.
ORACLE_SQL: dict[str, str] = {
    "op1_license_scan": oracles.LICENSES,
    "op2_repeated_strings": oracles.REPEATS,
    "op6_warc_round_trip": oracles.WARC,
    "op8_winnow_contamination": oracles.CONTAMINATION,
    "op9_chat_formatting": oracles.CHAT,
    "op10_vptree_neighbours": oracles.NEIGHBOURS,
}
