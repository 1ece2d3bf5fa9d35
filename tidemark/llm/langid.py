"""Language of a text: sparse multinomial logistic regression on TF-IDF character n-grams.

Features are counts of letter 1-, 2- and 3-grams (lower case, anything but letters as one blank), hashed to BUCKETS,
weighted by 1+ln(count) and by the inverse document frequency over *all* training documents, then scaled to length one.
Weights are fitted by follow-the-regularised-leader with elastic-net penalties on at most SAMPLE_ROWS training rows, as many
of each language (all, where it has fewer), chosen by a hash; a fifth of them sets the temperature of the softmax. The model
knows the languages of these rows, SAMPLE_ROWS at most, with BUCKETS weights each, whatever the input's size.

Nulls, empties, ties: a text that is null or has no letter is `und` with score 0; rows without a language don't train; equal
scores go to the language first in the alphabet; without any training row all texts are `und`. Other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Batches, prepare, spare_memory, texts_of

BUCKETS = 1 << 14
#: Bound of the rows that the weights are fitted on.
SAMPLE_ROWS = 2000
#: Languages whose counts are broadcast (some 40 bytes each); more are joined by a shuffle.
MOST_BROADCAST = 100_000
UNKNOWN = "und"
#: Letters counted at once; longer texts are counted in blocks.
BLOCK = 1 << 20
_MULTIPLIERS = np.array([0x9E3779B1, 0x85EBCA6B, 0xC2B2AE35], np.uint64)
_LETTERS: list[np.ndarray] = []


def _letters() -> np.ndarray:
    if not _LETTERS:
        _LETTERS.append(np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000))
    return _LETTERS[0]


def ngram_counts(text: str) -> np.ndarray:
    """Counts of the hashed n-grams of one text; all zero if it has no letter."""
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = _letters()[codes]
    if not letter.any():
        return np.zeros(BUCKETS, np.int64)
    codes = np.concatenate([[32], np.where(letter, codes, 32), [32]]).astype(np.uint64)
    blank = codes == 32
    codes = codes[~np.concatenate([[False], blank[1:] & blank[:-1]])]
    counts = np.zeros(BUCKETS, np.int64)
    for at in range(0, len(codes), BLOCK):
        part = codes[at : at + BLOCK + 2]
        grams = part * _MULTIPLIERS[0]
        own = grams[: min(BLOCK, len(part))]
        counts += np.bincount(_bucket(own[part[: len(own)] != 32]), minlength=BUCKETS)
        for n in (1, 2):
            grams = (grams[:-1] ^ (grams[:-1] >> np.uint64(29))) * _MULTIPLIERS[n] + part[n:]
            counts += np.bincount(_bucket(grams[:BLOCK]), minlength=BUCKETS)
    return counts


def _bucket(grams: np.ndarray) -> np.ndarray:
    return (((grams * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - 14))).astype(np.int64)


@dataclass
class Model:
    languages: list[str]
    idf: np.ndarray
    weights: np.ndarray  # languages x (BUCKETS + 1), the last for the bias
    temperature: float

    def features(self, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return _features(counts, self.idf)

    def predict(self, text: str | None) -> tuple[str, float]:
        counts = ngram_counts(text or "")
        at, x = self.features(counts)
        if not len(at) or not self.languages:
            return UNKNOWN, 0.0
        p = _softmax((self.weights[:, at] @ x + self.weights[:, -1]) / self.temperature)
        k = int(p.argmax())
        return self.languages[k], float(min(1.0, p[k]))


def _features(counts: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.flatnonzero(counts)
    x = (1 + np.log(counts[at])) * idf[at]
    length = np.sqrt(x @ x)
    return at, x / length if length else x


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max())
    return e / e.sum()


def fit_weights(rows: list[tuple[np.ndarray, np.ndarray, int]], n: int, alpha=0.5, beta=1.0, l1=1e-3, l2=1e-3, epochs=3) -> np.ndarray:
    """Follow-the-regularised-leader, a step for each row: rows hold feature places, values and the class."""
    z, g2 = np.zeros((n, BUCKETS + 1)), np.zeros((n, BUCKETS + 1))

    def weights(zs: np.ndarray, gs: np.ndarray) -> np.ndarray:
        return np.where(np.abs(zs) <= l1, 0, -(zs - np.sign(zs) * l1) / ((beta + np.sqrt(gs)) / alpha + l2))

    rng = np.random.default_rng(7)
    for _ in range(epochs):
        for k in rng.permutation(len(rows)):
            at, x, label = rows[k]
            at, x = np.append(at, BUCKETS), np.append(x, 1.0)
            zs, gs = z[:, at], g2[:, at]
            w = weights(zs, gs)
            p = _softmax(w @ x)
            p[label] -= 1
            g = p[:, None] * x
            z[:, at] = zs + g - (np.sqrt(gs + g * g) - np.sqrt(gs)) / alpha * w
            g2[:, at] = gs + g * g
    return weights(z, g2)


def fit_temperature(logits: list[np.ndarray], labels: list[int]) -> float:
    """The temperature with the least log loss on held-back rows."""
    if not logits:
        return 1.0
    z, y = np.array(logits), np.array(labels)

    def loss(t: float) -> float:
        s = z / t
        s = s - s.max(axis=1, keepdims=True)
        return float(np.mean(np.log(np.exp(s).sum(axis=1)) - s[np.arange(len(y)), y]))

    return float(min(np.geomspace(0.05, 5, 100), key=loss))


def train(labelled: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Model:
    """Fit on labelled (id, text, lang). Document frequencies cover all its rows, weights a sample of sample_rows at most."""
    prepare(labelled.sparkSession)
    rows = labelled.select(F.col("id"), F.col("text").cast("string"), "lang").where(F.col("lang").isNotNull() & F.col("text").isNotNull())

    def frequencies(batches: Batches) -> Batches:
        seen, docs = np.zeros(BUCKETS, np.int64), 0
        for batch in batches:
            spare_memory()
            for text in texts_of(batch.column(0)):
                seen += ngram_counts(text) > 0
                docs += 1
        at = np.flatnonzero(seen)
        yield pa.record_batch([pa.array(np.append(at, -1)), pa.array(np.append(seen[at], docs))], ["bucket", "n"])

    found = rows.select("text").mapInArrow(frequencies, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    n_docs, df = 0, np.zeros(BUCKETS)
    for r in found:  # BUCKETS + 1 rows at most
        if r["bucket"] < 0:
            n_docs = r["n"]
        else:
            df[r["bucket"]] = r["n"]
    idf = np.log((1 + n_docs) / (1 + df)) + 1

    by_lang = rows.groupBy(F.col("lang").alias("lang_")).agg(F.count(F.lit(1)).alias("rows_"))
    n_languages = by_lang.count()
    if not n_languages:
        return Model([], idf, np.zeros((0, BUCKETS + 1)), 1.0)
    by_lang = F.broadcast(by_lang) if n_languages <= MOST_BROADCAST else by_lang
    # a share of each language by a hash, somewhat more than is needed, then exactly as many of each
    each = max(1, sample_rows // n_languages)
    order = F.shiftrightunsigned(F.xxhash64("id", "text"), 11) / float(1 << 53)
    some = rows.select("text", "lang", order.alias("order_")).join(by_lang, F.col("lang") == F.col("lang_")).where(F.col("order_") * F.col("rows_") < 2 * each + 100)
    ranked = some.withColumn("rank_", F.row_number().over(Window.partitionBy("lang").orderBy("order_", "text"))).where(F.col("rank_") <= each)
    picked = ranked.orderBy("order_", "text", "lang").limit(sample_rows)

    def encoded(batches: Batches) -> Batches:
        for batch in batches:
            counts = [ngram_counts(t) for t in texts_of(batch.column(0))]
            at = [np.flatnonzero(c) for c in counts]
            yield pa.record_batch(
                [batch.column(1), pa.array([a.astype("<i4").tobytes() for a in at], pa.binary()), pa.array([c[a].astype("<i4").tobytes() for c, a in zip(counts, at, strict=True)], pa.binary())],
                ["lang", "at", "n"],
            )

    sample = []
    for r in picked.select("text", "lang").mapInArrow(encoded, "lang string, at binary, n binary").collect():
        counts = np.zeros(BUCKETS, np.int64)
        counts[np.frombuffer(r["at"], "<i4")] = np.frombuffer(r["n"], "<i4")
        if counts.any():
            sample.append((*_features(counts, idf), r["lang"]))
    languages = sorted({lang for _, _, lang in sample})
    sample = [(at, x, languages.index(lang)) for at, x, lang in sample]
    held = sample[::5]
    weights = fit_weights([r for k, r in enumerate(sample) if k % 5], len(languages))
    logits = [weights[:, at] @ x + weights[:, -1] for at, x, _ in held]
    return Model(languages, idf, weights, fit_temperature(logits, [y for _, _, y in held]))


def identify(docs: DataFrame, model: Model, text: str = "text", language: str = "lang_pred", score: str = "score") -> DataFrame:
    """docs with the predicted language and its calibrated probability added, as columns named by language and score.

    Columns of docs that have these names already are replaced.
    """
    docs = docs.drop(language, score)
    spark = prepare(docs.sparkSession)
    held = spark.sparkContext.broadcast(model)  # BUCKETS weights a language
    at = docs.columns.index(text)
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema), f"`{language}` string", f"`{score}` double"])

    def predict(batches: Batches) -> Batches:
        for batch in batches:
            spare_memory()
            found = [held.value.predict(t) for t in batch.column(at).to_pylist()]
            columns = [*batch.columns, pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64())]
            yield pa.record_batch(columns, [*batch.schema.names, language, score])

    return docs.mapInArrow(predict, schema)


def remainder(doc_id: Column) -> Column:
    """crc32 of doc_id as text, mod 3; a null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 3
