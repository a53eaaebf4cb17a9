"""One thin query per operator of this package; each takes (spark, sf_dir), reads whole tables
and whole texts, and only the columns that it names: others, whatever they are called, are ignored."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import byte_bpe, chat_format, collocations, decontaminate, jaccard_join, language_id, license_scan, masked_lm, prefix_trie, secret_scan, token_files, toxicity, vector_topk
from .common import crc_fold, read_table, stage, stage_path


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text's toxicity. Null and empty texts score the base rate, texts of any length are read whole,
    repeated rows get a row each, an empty table gives none; only ids and texts of ``documents`` are read."""
    docs, labels = read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels")
    model = toxicity.train(docs.select("doc_id", "text"), labels.where(crc_fold("doc_id", 3) != 1).select("doc_id", "toxic"))
    out = toxicity.score(docs, model, threshold=0.7)
    return out.select("doc_id", (crc_fold("doc_id", 3) == 1).alias("held_out"), "score", "predicted")


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids and round trip of every text. A null text is empty (no ids), invalid surrogates are encoded as the
    library would, repeated rows get a row each, an empty table gives none."""
    docs = read_table(spark, sf_dir, "documents")
    out = byte_bpe.encode_documents(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, keep_ids=False)
    return out.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


def op3_masked_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pseudo-log-likelihood of every text. A null text, or one without words, scores 0 with a null
    ``per_token``; repeated rows get equal rows, an empty table gives none."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return masked_lm.train_and_score(docs)


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every text. A null text is empty (no spans); overlapping kinds are all listed, ties by
    kind; repeated rows get a row each, an empty table gives none."""
    docs = read_table(spark, sf_dir, "documents")
    model = secret_scan.train(secret_scan.labelled_samples(spark, docs.select("doc_id", "text")))
    return secret_scan.digest(secret_scan.scan(docs, model))


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold benchmark items, one row per id. Null and empty texts hold nothing; rows that
    repeat an id are one document; an empty table on either side gives none."""
    found = decontaminate.contaminated(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_items", F.concat_ws(",", F.col("items").cast("array<string>")).alias("items"), "covered", "changed")


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token files of every text, read back. A null text has the end id only; rows of null id are not
    written, rows that repeat an id stand next to each other; an empty table gives no file and no row."""
    docs = read_table(spark, sf_dir, "documents")
    path, folder = public_tokenizers.path("word_bpe_49k.json"), stage_path(spark, "tokens")
    manifest = token_files.write(docs, path, folder, end_id=2)
    return token_files.digest(token_files.read(manifest, folder, token_files.encoder(path).dtype))


def op7_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Canonical chats of every conversation, in parts of 256 turn numbers that make one chat in order. Null
    roles and texts count as empty, repeated rows are repeated turns, an empty table gives none."""
    raw = stage(chat_format.transcripts(read_table(spark, sf_dir, "conversations")), "transcripts")
    hmm = chat_format.train(raw.where(crc_fold("c", 4) != 2))
    out = chat_format.format_chats(raw, hmm)
    return out.select(F.col("c").alias("conv_id"), "part", (crc_fold("c", 4) == 2).alias("held_out"), "n_turns", "roles", "chat")


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every text. A null text, or one without a letter, is ``und`` with 0; ties go to the
    smaller code; repeated rows get a row each, an empty table gives none."""
    docs = read_table(spark, sf_dir, "documents")
    model = language_id.train(docs.where(crc_fold("doc_id", 4) != 2), public_tokenizers.path("piece_bpe_32k.model"))
    out = language_id.identify(docs, model)
    return out.select("doc_id", (crc_fold("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score")


def op9_vector_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best of every fiftieth vector. Vectors that are null, empty or hold null or non-finite
    components take no part; ties go to the smaller id; an empty table gives none."""
    vectors = vector_topk.integer_vectors(read_table(spark, sf_dir, "embeddings"))
    return vector_topk.top_k(vectors, vectors.where(F.col("id") % 50 == 0), k=5)


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Component of near duplicates of every text. Null texts and texts without words are linked with
    nothing; rows that repeat an id get a row each; an empty table gives none."""
    return jaccard_join.link(read_table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The trie of rebuilt conversations. Null roles and texts are empty, null turns come first, equal turns go
    by role and text, repeated rows are repeated turns, rows of null conv_id are left out; an empty table gives no node."""
    return prefix_trie.trie(read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text"))


def op12_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License phrases and fuzzy notices of every text. A null text is empty (no word, empty labels, score 0);
    places of different phrases may overlap and count each; repeated rows get a row each; an empty table gives none."""
    return license_scan.digest(license_scan.scan(read_table(spark, sf_dir, "documents")))


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 2000 strongest phrases of every language. A null text is empty, a null language is ``und``;
    repeated rows count each; ties go by count, then by the phrase's bytes; an empty table gives none."""
    return collocations.mine(read_table(spark, sf_dir, "documents"), at_least=10, top=2000)


QUERIES = {
    "op1_toxicity": op1_toxicity,
    "op2_byte_bpe": op2_byte_bpe,
    "op3_masked_lm": op3_masked_lm,
    "op4_secret_scan": op4_secret_scan,
    "op5_decontaminate": op5_decontaminate,
    "op6_token_files": op6_token_files,
    "op7_chat_format": op7_chat_format,
    "op8_language_id": op8_language_id,
    "op9_vector_topk": op9_vector_topk,
    "op10_jaccard_join": op10_jaccard_join,
    "op11_prefix_trie": op11_prefix_trie,
    "op12_license_scan": op12_license_scan,
    "op13_collocations": op13_collocations,
}
