"""A corpus pipeline of five stages, each on all that the one before kept.

1. language_id: documents without a letter go, and those whose best language has a calibrated probability under MIN_SCORE. The
   bound is low and the same for any number of languages, so that short texts and texts in two languages stay; where no language
   reaches it, the text is of none of them. The model learns from the stage's own labelled documents, as op1 does; without any
   label only documents without a letter go.
2. ngram_join: documents whose sets of SHINGLE-word shingles have a similarity of PERCENT / 100 or more are linked; of each
   group of linked documents the one with the smallest doc_id stays; of equal rows one stays.
3. suffix_dedup: passages of more than WORDS words that stand elsewhere too are cut out: the runs of so many words that
   repeated strings of PASSAGE bytes cover. Documents that lose all their bytes go.
4. secret_scan: secrets are replaced by a mask.
5. best_fit_packing: the documents' tokens in sequences of at most 2048.

n_chars follows the text where a stage changes it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import langid, ngram_join, packing, secrets, suffix_dedup
from tidemark.llm.common import drop_stored, fresh, prepare, stored, table
from tidemark.llm.queries import vocabulary

MIN_SCORE = 0.3
#: Of the near-duplicate stage; op10's contract has its own.
SHINGLE, PERCENT = 5, 80


def _with_length(docs: DataFrame) -> DataFrame:
    if "n_chars" not in docs.columns:
        return docs
    return docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    prepare(spark)
    learn = docs.where(langid.remainder(F.col("doc_id")) != 1)
    model = langid.train(learn.select(F.col("doc_id").alias("id"), "text", "lang"))
    language, score = fresh(docs, "lang_pred", "score")
    found = langid.identify(docs, model, language=language, score=score)
    if model.languages:
        good = (F.col(language) != langid.UNKNOWN) & (F.col(score) >= MIN_SCORE)
    else:
        good = F.coalesce(F.col("text"), F.lit("")).rlike(r"\p{L}")
    return found.where(good).select(*docs.columns)


def ngram_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    prepare(spark)
    rows = ngram_join.join(docs.select("doc_id", "text"), size=SHINGLE, percent=PERCENT)
    others = rows.where("component_id <> doc_id").select("doc_id").distinct()
    return docs.join(others, "doc_id", "left_anti").dropDuplicates(["doc_id", "text"]).select(*docs.columns)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    prepare(spark)
    return _with_length(suffix_dedup.cleaned(docs, suffix_dedup.PASSAGE, suffix_dedup.WORDS))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    prepare(spark)
    return _with_length(secrets.redact(docs, secrets.train(docs)))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    prepare(spark)
    pieces = stored(packing.token_pieces(docs, vocabulary("word_bpe_49k.json")))
    packed = packing.pack(pieces)
    drop_stored(pieces)
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language_id),
    ("ngram_join", ngram_dedup),
    ("suffix_dedup", cut_repeats),
    ("secret_scan", mask_secrets),
    ("best_fit_packing", pack),
]

#: The learned stages and the tokens can't be had in SQL; tests/llm holds run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, old = table(spark, sf_dir, "documents"), None
    for _, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir))
        if old is not None:
            drop_stored(old)
        old = docs
    return docs
