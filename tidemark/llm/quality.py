"""Quality rules: word and repetition counts, and a log-likelihood ratio of hashed n-grams. DataFrame functions only.

The ratio compares two multinomials over BUCKETS hashed word 1- and 2-grams: one of trusted texts, one of the raw corpus,
both with one added to every count, so it is defined for any text. A text's score is the mean of ln(p_trusted / p_raw)
over its n-grams; it is kept if no fixed rule fails and the score is at least THRESHOLD. Every document is scored, and the
same tables give the same verdicts. THRESHOLD is a parameter, not learned: the default says that on average an n-gram of a kept
text is at most e ** 0.25 = 1.28 times likelier in the raw corpus than in trusted text.

The counts are BUCKETS pairs of numbers whatever the input's size; they reach the scan as one constant array. Words of a text are handled inside its row, so nothing but the counts is shuffled.

Nulls, empties, ties: a null or empty text has no word, counts of zero, score 0 and fails the rule on words. Repeated rows
are scored alike. Without trusted texts the trusted multinomial is uniform, and
THRESHOLD still applies. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BUCKETS = 1 << 16
THRESHOLD = -0.25
MIN_WORDS = 20
WINDOW = 8
#: Trusted ids are broadcast up to this many (16 bytes each), beyond it joined by a shuffle.
MOST_BROADCAST = 1_000_000
# fixed values
SPACE = r"[\x20\x09-\x0D]"
NOT_SPACE = r"[^\x20\x09-\x0D]"
SYMBOLS = r"[#*$%&|<>]"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def words(text: Column) -> Column:
    """Split at runs of white space, in one pass over the text; only the first and the last part can be empty."""
    return F.array_remove(F.split(text, f"{SPACE}+"), "")


def hashes(text: Column) -> Column:
    """64-bit hash of each word."""
    return F.transform(words(text), lambda w: F.xxhash64(w))


def buckets(h: Column) -> Column:
    """Buckets of the 1- and 2-grams of words with hashes h."""
    ones = F.transform(h, lambda x: F.pmod(x, F.lit(BUCKETS)).cast("int"))
    twos = F.transform(h, lambda x, i: F.pmod(F.xxhash64(x, F.get(h, i + 1)), F.lit(BUCKETS)).cast("int"))
    return F.concat(ones, F.slice(twos, F.lit(1), F.greatest(F.size(h) - 1, F.lit(0))))


def repeat_words(h: Column) -> Column:
    """Words in windows of WINDOW words that the text has twice or more, the first included."""
    windows = F.transform(F.slice(h, F.lit(1), F.greatest(F.size(h) - (WINDOW - 1), F.lit(0))), lambda _, i: F.xxhash64(F.slice(h, i + 1, F.lit(WINDOW))))

    def starts(s: Column) -> Column:
        """Of (hash, start) in order: the starts of those that share their hash, in order."""
        before = lambda x, i: (i > 0) & (F.get(s, F.greatest(i - 1, F.lit(0)))["w"] == x["w"])
        after = lambda x, i: F.coalesce(F.get(s, i + 1)["w"] == x["w"], F.lit(False))
        return F.sort_array(F.transform(F.filter(s, lambda x, i: before(x, i) | after(x, i)), lambda x: x["i"]))

    def covered(p: Column) -> Column:
        """Words under the windows that start at p: each up to the next start or its own end."""
        return F.aggregate(p, F.struct(F.lit(0).cast("long").alias("n"), F.lit(-WINDOW).alias("last")), lambda a, x: F.struct((a["n"] + F.least(F.lit(WINDOW), x - a["last"])).alias("n"), x.alias("last")), lambda a: a["n"])

    exact = lambda w: let(F.sort_array(F.transform(w, lambda x, i: F.struct(x.alias("w"), i.alias("i")))), lambda s: let(starts(s), covered))
    return let(windows, lambda w: F.when(F.size(F.array_distinct(w)) == F.size(w), F.lit(0).cast("long")).otherwise(exact(w)))


def duplicate_lines(text: Column) -> Column:
    """Lines with a word that equal an earlier line."""
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(NOT_SPACE))
    return let(lines, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long"))


def ratios(docs: DataFrame, trusted: DataFrame) -> Column:
    """ln(p_trusted / p_raw) of each bucket, as a constant array; trusted has the doc_id of trusted documents.

    The array comes as one string of BUCKETS numbers of four decimals, which Catalyst folds to an array once.
    """
    ids = trusted.select(F.col("doc_id").alias("trusted_id")).where(F.col("trusted_id").isNotNull()).distinct()
    if ids.limit(MOST_BROADCAST + 1).count() <= MOST_BROADCAST:
        ids = F.broadcast(ids)
    marked = docs.select("doc_id", "text").join(ids, F.col("doc_id") == F.col("trusted_id"), "left")
    text = F.coalesce("text", F.lit(""))
    grams = marked.select(F.col("trusted_id").isNotNull().cast("long").alias("t"), F.explode(let(hashes(text), buckets)).alias("bucket"))
    counts = grams.groupBy("bucket").agg(F.count(F.lit(1)).alias("raw"), F.sum("t").alias("target"))
    every = docs.sparkSession.range(0, BUCKETS, 1, 4).select(F.col("id").cast("int").alias("bucket"))
    full = every.join(counts, "bucket", "left").select("bucket", F.coalesce("raw", F.lit(0)).alias("raw"), F.coalesce("target", F.lit(0)).alias("target"))
    listed = full.agg(F.sort_array(F.collect_list(F.struct("bucket", "raw", "target"))).alias("x"), F.sum("raw").alias("n_raw"), F.sum("target").alias("n_target"))
    p = lambda of, n: (of + 1).cast("double") / (F.col(n) + BUCKETS)
    number = lambda r: F.format_string("%.4f", F.ln(p(r["target"], "n_target") / p(r["raw"], "n_raw")))
    return F.split(F.lit(listed.select(F.array_join(F.transform("x", number), ",")).first()[0]), ",").cast("array<double>")


def assess(docs: DataFrame, trusted: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Rows (doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, score, kept)."""
    ratio = ratios(docs, trusted)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))

    def row(t: Column, h: Column) -> Column:
        b = buckets(h)
        total = let(b, lambda x: F.aggregate(x, F.lit(0.0), lambda a, k: a + F.get(ratio, k)) / F.greatest(F.size(x), F.lit(1)))
        return F.struct(
            F.size(h).cast("long").alias("n_words"),
            (F.length(t) - F.regexp_count(t, F.lit(SPACE))).cast("long").alias("word_chars"),
            F.regexp_count(t, F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
            duplicate_lines(t).alias("n_dup_lines"),
            repeat_words(h).alias("n_repeat_words"),
            total.alias("score"),
        )

    rows = docs.select("doc_id", F.inline(F.transform(F.array(text), lambda t: let(hashes(t), lambda h: row(t, h)))))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    return rows.withColumn("base_failed", failed).withColumn("kept", ~failed & (F.col("score") >= threshold))
