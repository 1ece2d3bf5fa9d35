"""Jaccard join of documents on word n-grams: rare-first prefix filtering, then verification once per pair.

A document's set holds its distinct SHINGLE-word shingles (words: runs of other characters than ASCII white space, A-Z in
lower case) as 64-bit hashes, which mix 64-bit hashes of the words; a document of fewer words has one shingle of all its words; one without words has none and
links with nothing. Two documents link when 100 * intersection >= PERCENT * union.

1. Frequencies: all shingles of the corpus are counted in ORDER_BUCKETS hashed counters, of fixed size. Any total order makes
   prefix filtering exact; this one (counter, then hash) puts what is common last.
2. Nodes: documents with equal sets are one node, the smallest doc_id, whatever their number.
3. Prefixes: linked sets of n and m shingles share one of the first n - ceil(n * t) + 1 of each. Shingles in one prefix only
   are dropped.
4. Shingles in the prefixes of up to HOT nodes: pairs within, by the length filter and the positional filter; each pair once;
   then the suffix filter: sets are cut in halves by a bit of their hashes, and these again, six times, and the lesser sizes of
   each two parts bound the intersection; then the sets.
5. Shingles in more prefixes: among nodes of like size, these shingles are grouped if some node has both, and the nodes of
   each group are dealt to blocks of BLOCK nodes. Each two blocks meet in one task, which verifies all its pairs from the sets and returns a
   spanning forest of the links, never the pairs. No task holds more than two blocks, and none is skipped. The intersections
   of all pairs of two blocks are counted at once, so filters of single pairs have nothing to spare there.
6. Components of the links.

Nulls, empties, ties: null texts are empty. Rows that repeat a doc_id count as one document. Rows without a doc_id take
part in no link and have no component. An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Batches, added_up, bit_map, drop_stored, has_bit, prepare, stored, text_buffers
from .graph import components
from .hashing import U, Rolling, groups, mix

SHINGLE, PERCENT = 4, 85
ORDER_BUCKETS = 1 << 20
#: Counters that travel in one row.
CHUNK = 1 << 12
HOT = 48
#: Bytes of words that are hashed by BLAKE2b; sums modulo 2**64 have collisions made of a pattern, but none so short.
LONG_WORD = 24
#: Nodes and shingles of a block.
BLOCK, BLOCK_SHINGLES = 512, 500_000
SKETCH = 64
#: Bits of the maps that say which nodes' sets may be needed and which shingles several prefixes may have; a bit too many costs time only.
MAP_BITS = 1 << 23

_ROLLING: list[Rolling] = []
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def shingles(column: pa.Array, size: int = SHINGLE) -> list[np.ndarray]:
    """Hashes of each text's shingles in the order of the text, repeats included."""
    if not _ROLLING:
        _ROLLING.append(Rolling(10))
    rolling, (data, offsets), out = _ROLLING[0], text_buffers(column), []
    for first, last in groups(offsets):
        at = offsets[first : last + 1] - offsets[first]
        part = _LOWER[data[offsets[first] : offsets[last]]]
        inside = ~_SPACE[part]
        opens, closes = inside.copy(), inside.copy()
        opens[1:] &= ~inside[:-1]
        closes[:-1] &= ~inside[1:]
        cuts = at[1:-1]
        cuts = cuts[(cuts > 0) & (cuts < len(part))]
        opens[cuts] = inside[cuts]
        closes[cuts - 1] = inside[cuts - 1]
        starts, ends = np.flatnonzero(opens), np.flatnonzero(closes) + 1
        words = rolling.stretches(rolling.prefixes(part), starts, ends)
        long = np.flatnonzero(ends - starts >= LONG_WORD)
        if len(long):
            raw = part.tobytes()
            found = [hashlib.blake2b(raw[a:b], digest_size=8).digest() for a, b in zip(starts[long].tolist(), ends[long].tolist(), strict=True)]
            words[long] = np.frombuffer(b"".join(found), U)
        chain = mix(words)
        for k in range(1, size):
            if len(words) > k:
                chain = mix(chain[: len(words) - k] * U(0x9E3779B97F4A7C15) + words[k:])
        bounds = np.searchsorted(starts, at)
        for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            if b - a >= size:
                out.append(chain[a : b - size + 1])
            elif b > a:
                whole = mix(words[a : a + 1] + U(b - a))
                for k in range(a + 1, b):
                    whole = mix(whole * U(0x9E3779B97F4A7C15) + words[k])
                out.append(whole)
            else:
                out.append(words[:0])
    return out


def _least(n: int, percent: int) -> int:
    """Least intersection of a set of n with any set that it links with."""
    return -(-percent * n // 100)


def frequencies(docs: DataFrame, size: int) -> np.ndarray:
    def count(batches: Batches) -> Batches:
        total = np.zeros(ORDER_BUCKETS, np.int64)
        for batch in batches:
            found = shingles(batch.column(0), size)
            if found:
                total += np.bincount(_counter(np.concatenate(found)), minlength=ORDER_BUCKETS)
        yield pa.record_batch([pa.array(np.arange(ORDER_BUCKETS // CHUNK)), pa.array([x.tobytes() for x in total.reshape(-1, CHUNK)], pa.binary())], ["chunk", "counts"])

    total = np.zeros((ORDER_BUCKETS // CHUNK, CHUNK), np.int64)
    for k, x in added_up(docs.select("text").mapInArrow(count, "chunk long, counts binary"), "counts", sum, np.int64).items():
        total[k] = x
    return total.ravel()


def _counter(s: np.ndarray) -> np.ndarray:
    return (s >> U(64 - ORDER_BUCKETS.bit_length() + 1)).astype(np.int64)


def _documents(docs: DataFrame, size: int, percent: int) -> DataFrame:
    """Rows (doc_id, sig, n, prefix, sketch) of all documents; prefix in the order of rarity."""
    order = docs.sparkSession.sparkContext.broadcast(frequencies(docs, size))  # ORDER_BUCKETS numbers

    def rows(batches: Batches) -> Batches:
        for batch in batches:
            sig, ns, prefix, sketch = [], [], [], []
            for s in shingles(batch.column(1), size):
                s = np.unique(s)
                n = len(s)
                ns.append(n)
                sig.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if n else None)
                first = np.lexsort((s, order.value[_counter(s)]))[: n - _least(n, percent) + 1 if n else 0]
                prefix.append(s[first].view(np.int64))
                sketch.append(np.minimum(np.bincount((s & U(SKETCH - 1)).astype(np.int64), minlength=SKETCH), 65535).astype("<u2").tobytes() if n else None)
            yield pa.record_batch(
                [batch.column(0), pa.array(sig, pa.binary()), pa.array(ns, pa.int64()), pa.array(prefix, pa.list_(pa.int64())), pa.array(sketch, pa.binary())],
                ["doc_id", "sig", "n", "prefix", "sketch"],
            )

    return docs.select("doc_id", "text").mapInArrow(rows, "doc_id long, sig binary, n long, prefix array<long>, sketch binary")


def _sets(docs: DataFrame, ids: DataFrame, size: int) -> DataFrame:
    """Rows (id, set) of documents whose id is among ids (and of some others), sets as sorted 8-byte numbers."""
    held = bit_map(docs.sparkSession, ids.select(F.pmod(F.xxhash64("id"), F.lit(MAP_BITS)).alias("bit")), MAP_BITS)

    def rows(batches: Batches) -> Batches:
        for batch in batches:
            batch = batch.filter(pa.array(has_bit(held.value, batch.column(2).to_numpy())))
            sets = [np.unique(s).tobytes() for s in shingles(batch.column(1), size)]
            yield pa.record_batch([batch.column(0), pa.array(sets, pa.binary())], ["id", "set"])

    marked = docs.select("doc_id", "text", F.pmod(F.xxhash64("doc_id"), F.lit(MAP_BITS)).alias("bit"))
    return marked.mapInArrow(rows, "id long, set binary")


def _maybe_shared(nodes: DataFrame, shared: DataFrame) -> DataFrame:
    """Rows (id, n, pos, h) of the prefixes' shingles that are in shared, and of some others."""
    held = bit_map(nodes.sparkSession, shared.select(F.pmod("h", F.lit(MAP_BITS)).alias("bit")), MAP_BITS)

    def rows(batches: Batches) -> Batches:
        for batch in batches:
            prefix = batch.column(2)
            h, lengths = prefix.flatten().to_numpy(), np.diff(prefix.offsets.to_numpy())
            at = np.flatnonzero(has_bit(held.value, h % MAP_BITS))
            of = np.repeat(np.arange(batch.num_rows), lengths)[at]
            pos = at - (np.cumsum(lengths) - lengths)[of]
            columns = [batch.column(0).to_numpy()[of], batch.column(1).to_numpy()[of], pos, h[at]]
            yield pa.record_batch([pa.array(c) for c in columns], ["id", "n", "pos", "h"])

    return nodes.select("id", "n", "prefix").mapInArrow(rows, "id long, n long, pos long, h long").select("id", F.col("n").cast("int").alias("n"), F.col("pos").cast("int").alias("pos"), "h")


def _bounded(batch: pa.RecordBatch) -> np.ndarray:
    """Which pairs of sketches (columns 2 and 3) leave an intersection large enough for the sizes (columns 4 and 5)."""
    a, b = (np.frombuffer(b"".join(batch.column(k).to_pylist()), "<u2").reshape(-1, SKETCH) for k in (2, 3))
    either = (a == 65535) | (b == 65535)
    most = np.where(either, 1 << 30, np.minimum(a, b).astype(np.int64)).sum(axis=1)
    return most


def links_within(sets: list[np.ndarray], side: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """A spanning forest, as places in sets, of the links between the two sides (0 and 1), or within one side if side is all 0."""
    m = len(sets)
    sizes = np.array([len(s) for s in sets], np.int64)
    tokens, owners = np.concatenate(sets), np.repeat(np.arange(m), sizes)
    order = np.argsort(tokens, kind="stable")
    tokens, owners = tokens[order], owners[order]
    starts = np.flatnonzero(np.concatenate([[True], tokens[1:] != tokens[:-1]]))
    df = np.diff(np.append(starts, len(tokens)))
    common = np.zeros((m, m), np.int64)
    for d in np.unique(df[(df > 1) & (df < 24)]).tolist():  # few owners: by their pairs
        members = owners[starts[df == d][:, None] + np.arange(d)]
        for i in range(d):
            for j in range(i + 1, d):
                common += np.bincount(members[:, i] * m + members[:, j], minlength=m * m).reshape(m, m)
    common += common.T
    many = np.flatnonzero(df >= 24)  # many owners: by products of 0/1 matrices
    for k in range(0, len(many), 2048):
        part = many[k : k + 2048]
        has = np.zeros((m, len(part)), np.float32)
        for c, t in enumerate(part.tolist()):
            has[owners[starts[t] : starts[t] + df[t]], c] = 1
        common += (has @ has.T).astype(np.int64)
    linked = 100 * common >= percent * (sizes[:, None] + sizes[None, :] - common)
    if side.any():
        linked &= side[:, None] != side[None, :]
    np.fill_diagonal(linked, False)
    seen, out = np.zeros(m, bool), []
    for root in range(m):
        if not seen[root]:
            seen[root], stack = True, [root]
            while stack:
                x = stack.pop()
                new = np.flatnonzero(linked[x] & ~seen)
                seen[new] = True
                out += [(x, y) for y in new.tolist()]
                stack += new.tolist()
    return out


def _hot_links(flagged: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) among nodes that share shingles of more than HOT prefixes.

    Sizes fall into classes such that linked sets are of one class or of neighbours; a window holds a class (left) and the
    next (right). Within a window, shingles that a node has both are one group, and so are their nodes.
    """
    size_class = F.floor(F.ln(F.col("n").cast("double")) / math.log(100 / percent))
    hot = flagged.where(F.col("holders") > HOT).select("id", "n", "h", size_class.alias("class"))
    hot = hot.select("id", "n", "class", F.explode(F.array("class", F.col("class") - 1)).alias("w"), "h").withColumn("h", F.xxhash64("h", "w"))
    first = hot.groupBy("id", "n", "class", "w").agg(F.min("h").alias("least"))
    ties = hot.select("id", "w", "h").join(first, ["id", "w"]).select(F.col("least").alias("a"), F.col("h").alias("b"))
    placed = first.join(components(ties), F.col("least") == F.col("node"), "left")
    member = stored(placed.select("id", "n", (F.col("class") == F.col("w")).alias("left"), F.coalesce("component", "least").alias("g")))
    blocks = lambda of: F.greatest(F.ceil(F.count(F.when(of, 1)) / BLOCK), F.ceil(F.sum(F.when(of, F.col("n")).otherwise(0)) / BLOCK_SHINGLES)).cast("int")
    sizes = member.groupBy("g").agg(blocks(F.col("left")).alias("l"), blocks(~F.col("left")).alias("r"), blocks(F.lit(True)).alias("all"), F.count(F.lit(1)).alias("members"))
    sizes = sizes.where("l > 0 and members > 1").select("g", "l", F.when(F.col("all") == 1, 0).otherwise(F.col("r")).alias("r"))
    spot = lambda n: F.pmod(F.xxhash64("id"), F.greatest(F.col(n), F.lit(1))).cast("int")
    own = F.when(F.col("left") | (F.col("r") == 0), spot("l")).otherwise(F.col("l") + spot("r"))
    dealt = member.join(sizes, "g").select("id", "g", "l", "r", own.alias("own")).join(sets, "id")
    other = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("l") + F.col("r") - 1)))
    met = other.select("g", "l", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "id", "set").where("i < l").drop("l")

    def verify(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["id", "set"])
        side = (pdf["own"] != pdf["i"]).to_numpy().astype(int)
        if (pdf["i"] != pdf["j"]).any() and len(set(side.tolist())) < 2:
            return pd.DataFrame({"a": [], "b": []}, dtype="int64")
        ids = pdf["id"].tolist()
        found = links_within([np.frombuffer(x, U) for x in pdf["set"]], side, percent)
        return pd.DataFrame({"a": [ids[x] for x, _ in found], "b": [ids[y] for _, y in found]}, dtype="int64")

    return met.groupBy("g", "i", "j").applyInPandas(verify, "a long, b long")


def join(docs: DataFrame, size: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """Rows (doc_id, n_shingles, component_id, sig) of docs (doc_id, text); sig is equal for equal sets."""
    prepare(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    whole = stored(_documents(docs, size, percent))
    every = stored(whole.select("doc_id", "sig", "n"))
    nodes = stored(
        whole.where("sig is not null and doc_id is not null").groupBy("sig").agg(F.min("doc_id").alias("id"), F.first("n").alias("n"), F.first("prefix").alias("prefix"), F.first("sketch").alias("sketch"))
    )
    drop_stored(whole)
    places = nodes.select("id", F.explode("prefix").alias("h"))
    # stored before it is joined: an aggregate in the join's own stage would keep Spark from splitting hot keys
    shared = stored(places.groupBy("h").agg(F.count(F.lit(1)).alias("holders")).where("holders > 1"))
    flagged = stored(_maybe_shared(nodes, shared).join(shared, "h"))

    # up to HOT holders: their pairs, by length and by position
    lists = flagged.where(F.col("holders") <= HOT).groupBy("h").agg(F.collect_list(F.struct("id", "n", "pos")).alias("x"))
    fits = lambda a, b: (
        (a["id"] < b["id"])
        & (100 * F.least(a["n"], b["n"]) >= percent * F.greatest(a["n"], b["n"]))
        & ((100 + percent) * (1 + F.least(a["n"] - a["pos"], b["n"] - b["pos"]) - 1) >= percent * (a["n"] + b["n"]))
    )
    couples = F.flatten(F.transform("x", lambda a: F.transform(F.filter("x", lambda b: fits(a, b)), lambda b: F.struct(a["id"].alias("a"), b["id"].alias("b")))))
    pairs = lists.select(F.inline(couples)).distinct()
    side = lambda s: nodes.select(F.col("id").alias(s), F.col("sketch").alias(f"sketch_{s}"), F.col("n").alias(f"n_{s}"))
    known = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "sketch_a", "sketch_b", "n_a", "n_b")

    def suffix(batches: Batches) -> Batches:
        for batch in batches:
            total = batch.column(4).to_numpy() + batch.column(5).to_numpy()
            keep = (100 + percent) * _bounded(batch) >= percent * total if batch.num_rows else np.zeros(0, bool)
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    pairs = stored(known.mapInArrow(suffix, "a long, b long"))
    ids = pairs.select(F.col("a").alias("id")).unionAll(pairs.select("b")).unionAll(flagged.where(F.col("holders") > HOT).select("id"))
    sets = stored(_sets(docs, ids, size))
    drop_stored(shared)
    left = pairs.join(sets.select(F.col("id").alias("a"), F.col("set").alias("set_a")), "a")
    both = left.join(sets.select(F.col("id").alias("b"), F.col("set").alias("set_b")), "b").select("a", "b", "set_a", "set_b")

    def verify(batches: Batches) -> Batches:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                x, y = np.frombuffer(x.as_buffer(), U), np.frombuffer(y.as_buffer(), U)
                common = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * common >= percent * (len(x) + len(y) - common))
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    links = stored(both.mapInArrow(verify, "a long, b long").unionAll(_hot_links(flagged, sets, percent)))
    for old in (flagged, pairs, sets):
        drop_stored(old)
    found = components(links)
    of_sig = nodes.select("sig", "id").join(found, F.col("id") == F.col("node"), "left").select("sig", F.coalesce("component", "id").alias("component"))
    result = every.select("doc_id", "sig", "n").join(of_sig, "sig", "left")
    own = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    out = stored(result.select("doc_id", F.col("n").alias("n_shingles"), own.alias("component_id"), "sig"))
    for old in (every, nodes, links, found):
        drop_stored(old)
    return out
