"""SentencePiece encoding and decoding from a relational lattice of words.

A text is written with a blank before it and blanks as U+2581; a word is a run of those signs and what follows up to the next.
No piece goes over a word's end. The lattice of words: their substrings of at most the longest piece's length are exploded,
equi-joined to the piece table, and grouped by word; a fold with Spark's higher-order aggregate over the edges gives the ids.

* Unigram models: the fold is Viterbi, the best sum of scores at each end (`viterbi_ids`).
* BPE models: the best sum is not what the model means, as it merges the best-scored neighbours first; on the public model the
  sum of scores gives other ids for most words. So the fold is over merges: each step joins the two neighbouring
  edges whose joint edge scores best, leftmost first, until none is left (`merge_ids`).

Characters in no piece become the byte pieces of their UTF-8 bytes.

The words of a corpus are too many to join each occurrence with its ids by a shuffle (see README), so the lattice of the most
frequent words (COMMON at most, by counts over the whole corpus) is folded once in Spark and broadcast, and other words are
folded where they stand, by the same rule. The ids are the same either way.

Nulls, empties, ties: a null or empty text has no id and decodes to the empty text. Equal scores go to the leftmost pair.
Repeated rows are encoded alike. Other columns are ignored.
"""

from __future__ import annotations

import heapq
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Batches, prepare, stored, texts_of

BLANK = "▁"
COMMON = 1 << 16
#: Words of the lattice are folded in Spark up to this length; longer ones where they stand.
LONGEST_WORD = 48
#: Ids of words kept in a worker.
MOST_KEPT = 400_000
_WORD = re.compile(f"{BLANK}+[^{BLANK}]*")


@dataclass
class Pieces:
    """The piece table of a model: id and score of each ordinary piece, ids of bytes."""

    ids: dict[str, int]
    scores: dict[str, float]
    bytes: list[int]
    texts: list[str]
    longest: int

    @classmethod
    def load(cls, path: str) -> Pieces:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        if model.normalize("a  Ａ") != f"{BLANK}a{BLANK}{BLANK}Ａ":
            raise ValueError("only models without normalisation and with a blank put before the text are supported")
        n = model.get_piece_size()
        special = [model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i) for i in range(n)]
        texts = [model.id_to_piece(i) for i in range(n)]
        ids = {texts[i]: i for i in range(n) if not special[i]}
        scores = {t: model.get_score(i) for t, i in ids.items()}
        return cls(ids, scores, [model.piece_to_id(f"<0x{b:02X}>") for b in range(256)], texts, max(map(len, ids)))


def words(text: str) -> list[str]:
    return _WORD.findall(BLANK + text.replace(" ", BLANK)) if text else []


def keys(text: str) -> list[str]:
    """The words of a text without the blank's sign where they have just one; with it where they have more."""
    if not text:
        return []
    if "  " not in text and BLANK not in text and text[0] != " " and text[-1] != " ":
        return text.split(" ")
    return [w if w[1:2] == BLANK else w[1:] for w in words(text)]


def word_of(key: str) -> str:
    return key if key.startswith(BLANK) else BLANK + key


def merge_word(word: str, pieces: Pieces) -> list[int]:
    """Ids of a word by best merge first, leftmost among equals."""
    segments = _merged_short(word, pieces.scores) if len(word) <= 64 else _merged_long(word, pieces.scores)
    out = []
    for x in segments:
        if (i := pieces.ids.get(x)) is None:
            out += [pieces.bytes[b] for b in x.encode()]
        else:
            out.append(i)
    return out


def _merged_short(word: str, scores: dict[str, float]) -> list[str]:
    segments, none = list(word), float("-inf")
    pairs = [scores.get(a + b, none) for a, b in zip(segments[:-1], segments[1:], strict=True)]
    while pairs and (best := max(pairs)) > none:
        k = pairs.index(best)
        segments[k : k + 2] = [segments[k] + segments[k + 1]]
        del pairs[k]
        if k:
            pairs[k - 1] = scores.get(segments[k - 1] + segments[k], none)
        if k < len(pairs):
            pairs[k] = scores.get(segments[k] + segments[k + 1], none)
    return segments


def _merged_long(word: str, scores: dict[str, float]) -> list[str]:
    """With a heap, for words of any length."""
    n = len(word)
    ends, starts, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
    heap = [(-s, k, k + 2) for k in range(n - 1) if (s := scores.get(word[k : k + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, a, e = heapq.heappop(heap)
        if not alive[a] or ends[a] >= n or not alive[b := ends[a]] or ends[b] != e:
            continue
        ends[a], alive[b] = e, False
        if e < n:
            starts[e] = a
            if (s := scores.get(word[a : ends[e]])) is not None:
                heapq.heappush(heap, (-s, a, ends[e]))
        if (p := starts[a]) >= 0 and (s := scores.get(word[p:e])) is not None:
            heapq.heappush(heap, (-s, p, e))
    out, k = [], 0
    while k < n:
        out.append(word[k : ends[k]])
        k = ends[k]
    return out


def viterbi_word(word: str, pieces: Pieces, unknown: float = -1e6) -> list[int]:
    """Ids of a word with the best sum of scores, by brute force over ends; the test of viterbi_ids."""
    best: list[tuple[float, list[int]]] = [(0.0, [])]
    for end in range(1, len(word) + 1):
        options = []
        for a in range(max(0, end - pieces.longest), end):
            p = word[a:end]
            if p in pieces.ids:
                options.append((best[a][0] + pieces.scores[p], best[a][1] + [pieces.ids[p]]))
            elif end - a == 1:
                options.append((best[a][0] + unknown, best[a][1] + [pieces.bytes[x] for x in p.encode()]))
        best.append(max(options, key=lambda x: x[0]))
    return best[-1][1]


def piece_table(spark: SparkSession, pieces: Pieces) -> DataFrame:
    """Rows (piece, id, score): as many as the model has pieces, which bounds what is broadcast."""
    return spark.createDataFrame(pa.table({"piece": list(pieces.ids), "id": list(pieces.ids.values()), "score": [pieces.scores[p] for p in pieces.ids]}))


def lattice(word_rows: DataFrame, table: DataFrame, longest: int) -> DataFrame:
    """Rows (word, edges) of rows (word); edges holds (start, end, id, score) of all pieces in the word, by start, then end.

    Substrings of 1 to `longest` characters are exploded and equi-joined to the piece table; single characters stay without a
    piece (id -1).
    """
    n = F.length("word")
    spans = F.flatten(F.transform(F.sequence(F.lit(0), n - 1), lambda a: F.transform(F.sequence(F.lit(1), F.least(F.lit(longest), n - a)), lambda k: F.struct(a.cast("int").alias("start"), (a + k).cast("int").alias("end")))))
    each = word_rows.where(n > 0).select("word", F.inline(spans))
    each = each.withColumn("piece", F.substring("word", F.col("start") + 1, F.col("end") - F.col("start")))
    joined = each.join(F.broadcast(table), "piece", "left").where("id is not null or end = start + 1")
    edge = F.struct("start", "end", F.coalesce(F.col("id").cast("int"), F.lit(-1)).alias("id"), F.coalesce("score", F.lit(-1e30)).alias("score"))
    return joined.groupBy("word").agg(F.sort_array(F.collect_list(edge)).alias("edges"))


def merge_ids(edges: Column, n: Column) -> Column:
    """(start, end) of a word's segments by best merge first; a fold with at most n - 1 steps."""
    none = F.struct(F.lit(-1e300).alias("score"), F.lit(0).alias("at"))

    def step(cuts: Column) -> Column:
        """Cuts between segments without the one whose removal joins the best-scored pair."""
        inner = F.sequence(F.lit(1), F.size(cuts) - 2)
        scored = F.transform(inner, lambda k: F.struct(F.coalesce(F.try_element_at(F.transform(F.filter(edges, lambda x: (x["start"] == F.get(cuts, k - 1)) & (x["end"] == F.get(cuts, k + 1)) & (x["id"] >= 0)), lambda x: x["score"]), F.lit(1)), F.lit(-1e300)).alias("score"), F.get(cuts, k).alias("at")))
        best = F.aggregate(scored, none, lambda a, x: F.when(x["score"] > a["score"], x).otherwise(a))
        return F.when(F.size(cuts) < 3, cuts).otherwise(F.get(F.transform(F.array(best), lambda b: F.when(b["score"] > -1e300, F.array_remove(cuts, b["at"])).otherwise(cuts)), F.lit(0)))

    cuts = F.aggregate(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), F.sequence(F.lit(0), n), lambda c, _: step(c))
    return F.get(F.transform(F.array(cuts), lambda c: F.transform(F.slice(c, F.lit(1), F.size(c) - 1), lambda a, k: F.struct(a.alias("start"), F.get(c, k + 1).alias("end")))), F.lit(0))


def viterbi_ids(edges: Column, n: Column) -> Column:
    """(start, end) of a word's segments with the best sum of scores; a fold over the edges in the order of their starts.

    State: for each place the best sum so far and the best segments up to it.
    """
    unknown = lambda x: F.when(x["id"] < 0, F.lit(-1e6)).otherwise(x["score"])
    empty = F.array().cast("array<struct<start:int,end:int>>")
    first = F.transform(F.sequence(F.lit(0), n), lambda k: F.struct(F.when(k == 0, F.lit(0.0)).otherwise(F.lit(-1e300)).alias("sum"), empty.alias("path")))

    def step(state: Column, x: Column) -> Column:
        source = F.get(state, x["start"])
        total = source["sum"] + unknown(x)
        better = total > F.get(state, x["end"])["sum"]
        new = F.struct(total.alias("sum"), F.concat(source["path"], F.array(F.struct(x["start"].alias("start"), x["end"].alias("end")))).alias("path"))
        return F.when(better, F.transform(state, lambda s, k: F.when(k == x["end"], new).otherwise(s))).otherwise(state)

    return F.get(F.aggregate(edges, first, step), n)["path"]


def fold_words(word_rows: DataFrame, pieces: Pieces, fold=merge_ids) -> DataFrame:
    """Rows (word, ids) of distinct words through the lattice, wholly in Spark; -1 - byte for bytes without a piece.

    word_rows: (word), each of at most LONGEST_WORD characters.
    """
    spark = prepare(word_rows.sparkSession)
    edges = lattice(word_rows, piece_table(spark, pieces), pieces.longest)
    segments = edges.select("word", "edges", F.inline(F.array(F.struct(fold(F.col("edges"), F.length("word")).alias("segments")))))
    found = lambda s: F.element_at(F.filter("edges", lambda x: (x["start"] == s["start"]) & (x["end"] == s["end"])), 1)["id"]
    texts = F.transform("segments", lambda s: F.struct(found(s).alias("id"), F.substring(F.col("word"), s["start"] + 1, s["end"] - s["start"]).alias("text")))
    raw = lambda t: F.transform(F.regexp_extract_all(F.hex(t), F.lit("(..)")), lambda h: -1 - F.conv(h, 16, 10).cast("int"))
    return segments.select("word", F.flatten(F.transform(texts, lambda x: F.when(x["id"] >= 0, F.array(x["id"])).otherwise(raw(x["text"])))).alias("ids"))


def common_words(docs: DataFrame, n: int = COMMON) -> DataFrame:
    """Rows (word) of the most frequent words, n at most, counted over all documents.

    The least count taken is read off a histogram of counts (sixteen steps to an octave), so no task sorts or gathers words.
    """

    def count(batches: Batches) -> Batches:
        from collections import Counter

        for batch in batches:
            seen: Counter = Counter()
            for t in texts_of(batch.column(0)):
                seen.update(keys(t))
            yield pa.record_batch([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], ["key", "n"])

    counts = docs.select(F.col("text").cast("string")).mapInArrow(count, "key string, n long").groupBy("key").agg(F.sum("n").alias("n"))
    counts = stored(counts.where((F.col("n") > 1) & (F.length("key") < LONGEST_WORD)).select("key", F.floor(16 * F.log2(F.col("n").cast("double"))).alias("step")))
    least, total = None, 0
    for r in sorted(counts.groupBy("step").count().collect(), key=lambda r: -r["step"]):  # some hundred rows
        total += r["count"]
        if total > n:
            break
        least = r["step"]
    rows = counts.where(F.col("step") >= least) if least is not None else counts.limit(0)
    return rows.select(F.when(F.col("key").startswith(BLANK), F.col("key")).otherwise(F.concat(F.lit(BLANK), "key")).alias("word"))


def encode(docs: DataFrame, path: str, common: int = COMMON) -> DataFrame:
    """Rows (doc_id, n_pieces, ids binary) of docs (doc_id, text); ids little-endian unsigned 32-bit."""
    spark = prepare(docs.sparkSession)
    pieces = Pieces.load(path)
    rows = stored(fold_words(common_words(docs, common), pieces)).toArrow()  # `common` rows at most
    known = {(w if w[1:2] == BLANK else w[1:]): np.array([pieces.bytes[-1 - i] if i < 0 else i for i in ids], "<u4").tobytes() for w, ids in zip(rows.column("word").to_pylist(), rows.column("ids").to_pylist(), strict=True)}
    held = spark.sparkContext.broadcast((pieces, known))

    def run(batches: Batches) -> Batches:
        pieces, known = held.value

        class Words(dict):
            def __missing__(self, key: str) -> bytes:
                self[key] = ids = np.array(merge_word(word_of(key), pieces), "<u4").tobytes()
                return ids

        here = Words(known)
        for batch in batches:
            if len(here) > len(known) + MOST_KEPT:
                here = Words(known)
            texts = texts_of(batch.column(1))
            ids = [b"".join(map(here.__getitem__, keys(t))) for t in texts]
            yield pa.record_batch([batch.column(0), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary())], ["doc_id", "n_pieces", "ids"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, n_pieces long, ids binary")


def decode_ids(ids: np.ndarray, raw: list[bytes]) -> str:
    """The text of ids; raw holds the bytes of each piece."""
    text = b"".join([raw[i] for i in ids.tolist()]).decode("utf-8", "replace").replace(BLANK, " ")
    return text[1:] if text.startswith(" ") else text


def decode(rows: DataFrame, path: str) -> DataFrame:
    """rows (..., ids binary) with the decoded text added, as column decoded."""
    spark = prepare(rows.sparkSession)
    pieces = Pieces.load(path)
    raw = [t.encode() for t in pieces.texts]
    for b, i in enumerate(pieces.bytes):
        raw[i] = bytes([b])
    held = spark.sparkContext.broadcast(raw)
    at = rows.columns.index("ids")
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema), "decoded string"])

    def run(batches: Batches) -> Batches:
        for batch in batches:
            texts = [decode_ids(np.frombuffer(x, "<u4"), held.value) for x in batch.column(at).to_pylist()]
            yield pa.record_batch([*batch.columns, pa.array(texts, pa.string())], [*batch.schema.names, "decoded"])

    return rows.mapInArrow(run, schema)
