"""The queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import embedding_dedup, langid, ngram_join, packing, quality, secrets, sentencepieces, suffix_dedup, token_counts, token_files
from .common import delete, drop_stored, shared_folder, stored, table
from .oracles import ORACLE_SQL


def vocabulary(name: str) -> str:
    """Path of a public tokenizer's file on this machine and its executors."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = langid.remainder(F.col("doc_id")) == 1
    model = langid.train(docs.where(~held_out).select(F.col("doc_id").alias("id"), "text", "lang"))
    rows = docs.select("doc_id", held_out.alias("held_out"), "text")
    return langid.identify(rows, model).select("doc_id", "held_out", "lang_pred", "score")


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    rows = secrets.scan(docs.select("doc_id", "text"), secrets.train(docs)).select("doc_id", "secret_spans")
    of = lambda kind: F.size(F.filter("secret_spans", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("secret_spans", lambda x: x["kind"] != "crf")
    digest = F.sha2(secrets.joined(base).cast("binary"), 256).alias("base_sha256")
    return rows.select("doc_id", of("assign"), of("access"), of("hex"), digest, secrets.joined(F.col("secret_spans")).alias("spans"))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    trusted = table(spark, sf_dir, "labels").where("quality = 1")
    columns = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "score"]
    return quality.assess(table(spark, sf_dir, "documents"), trusted).select(*columns)


def op4_sentencepieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = vocabulary("piece_bpe_32k.model")
    ids = sentencepieces.encode(table(spark, sf_dir, "documents"), path)
    rows = sentencepieces.decode(ids, path)
    return rows.select("doc_id", "n_pieces", F.crc32("ids").alias("ids_crc32"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_folder(spark)}/token-files-{uuid.uuid4().hex}"
    token_files.write_token_files(table(spark, sf_dir, "documents"), path, vocabulary("byte_bpe_50k.json"))
    rows = token_files.read_token_files(spark, path)
    out = stored(rows.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32")))
    delete(spark, path)
    return out


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = stored(packing.token_pieces(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json")))
    packed = packing.pack(pieces)
    drop_stored(pieces)
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    edited = token_counts.masking_edits(table(spark, sf_dir, "documents"))
    return token_counts.count_edited(edited, vocabulary("byte_bpe_50k.json"))


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = suffix_dedup.dedup(table(spark, sf_dir, "documents"))
    joined = lambda name: F.concat_ws(",", F.transform(name, lambda x: F.concat_ws(":", x["start"], x["end"]))).alias(name)
    return rows.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", joined("spans"), joined("passages"), "passage_bytes")


def op9_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.dedup(table(spark, sf_dir, "embeddings"))


def op10_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.join(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_language_id": op1_language_id,
    "op2_secret_scan": op2_secret_scan,
    "op3_quality_rules": op3_quality_rules,
    "op4_sentencepieces": op4_sentencepieces,
    "op5_token_files": op5_token_files,
    "op6_best_fit_packing": op6_best_fit_packing,
    "op7_token_counts": op7_token_counts,
    "op8_suffix_dedup": op8_suffix_dedup,
    "op9_embedding_dedup": op9_embedding_dedup,
    "op10_ngram_join": op10_ngram_join,
}

__all__ = ["ORACLE_SQL", "QUERIES", "vocabulary"]
