"""The corpus pipeline: language ID, near duplicates, decontamination, secrets, tokens.

Each stage takes (spark, docs, sf_dir) and returns a frame; ``run`` writes each
stage's result as Parquet to the shared folder and reads it again for the next.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from memloom.llm import byte_bpe, decontaminate, jaccard_join, language_id, secret_scan
from memloom.llm.common import stage

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: A prediction of a lower posterior is a rejection.
LEAST_SCORE = 0.5


def _like_input(docs: DataFrame, out: DataFrame) -> DataFrame:
    return out.select(*docs.columns)


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a recognised language stay; texts without a letter, and
    those between languages, go. The label in ``lang`` trains, it decides nothing."""
    model = language_id.train(docs, public_tokenizers.path("piece_bpe_32k.model"))
    return language_id.recognised(docs, model, LEAST_SCORE)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near duplicates one document stays, the one of the
    smallest id; where rows repeat that id, the least of them by text. Documents
    without a word, or of null id, are linked with nothing and stay."""
    found = stage(jaccard_join.link(docs).where("n_shingles > 0 and doc_id is not null"), "links")
    first = found.where("component_id = doc_id")
    again = first.groupBy("group_key").count().where("count > 1")
    again = first.join(again, "group_key", "left_semi").select("doc_id", "text_hash", "group_key").distinct()
    gone = found.where("component_id <> doc_id").select("doc_id", "text_hash").union(again.select("doc_id", "text_hash")).distinct()
    gone = gone.select(F.col("doc_id").alias("_gone_id"), F.col("text_hash").alias("_gone_hash"))
    same = (F.col("doc_id") == F.col("_gone_id")) & (F.xxhash64("text") == F.col("_gone_hash"))
    kept = docs.join(gone, same, "left_anti")
    rest = again.select(F.col("doc_id").alias("_gone_id"), F.col("text_hash").alias("_gone_hash"), F.col("group_key").alias("_group"))
    rows = docs.select("doc_id", "text", F.struct(*docs.columns).alias("_row")).join(rest, same)
    one = rows.groupBy("_group").agg(F.min_by("_row", F.struct("doc_id", "text")).alias("_row")).select("_row.*")
    return _like_input(docs, kept).union(_like_input(docs, one))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    found = decontaminate.contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select(F.col("doc_id").alias("_found_id"))
    return _like_input(docs, docs.join(found, F.col("doc_id") == F.col("_found_id"), "left_anti"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every secret is replaced by a mark; all documents stay. n_chars, if there is
    one, follows the text; all other columns pass through."""
    model = secret_scan.train(secret_scan.labelled_samples(spark, docs.select("doc_id", "text")))
    packed = docs.select("doc_id", "text", F.struct(*[c for c in docs.columns if c not in ("doc_id", "text")], F.lit(0).alias("_none")).alias("_rest"))
    found = secret_scan.scan(packed, model, extra=("text", "_rest"))
    clean = found.select("doc_id", secret_scan.redact(F.col("text"), F.col("spans")).alias("text"), "_rest")
    clean = clean.select("doc_id", "text", "_rest.*")
    if "n_chars" in docs.columns:
        clean = clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return _like_input(docs, clean)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, checked by decoding them."""
    out = byte_bpe.encode_documents(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return out.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "round_trip")


STAGES = [
    ("language_id", identify_language),
    ("jaccard_join", drop_near_duplicates),
    ("decontaminate", drop_contaminated),
    ("secret_scan", redact_secrets),
    ("byte_bpe", encode),
]

#: SQL cannot express the language model's and the tokenizer's stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, step in STAGES:
        docs = stage(step(spark, docs, sf_dir), name)
    return docs
