"""Removal of byte strings of a given length that start anywhere else too, by prefix-free parsing.

Texts are parsed at triggers: places where the rolling hash of `trigger` bytes is the least of some `spread` places in a row.
With length = trigger + spread - 1, every string of `length` bytes has a trigger, and equal strings have theirs at equal places.
Two neighbouring triggers bound a phrase that begins and ends with a trigger's bytes, of length + 1 bytes at most, which is
what makes the parse prefix-free. Equal strings lie at equal places around one trigger string, so the corpus order of suffixes
is needed only among the occurrences of one trigger string, and only as far as `length` bytes reach:

1. Dictionary: trigger strings that occur once in the corpus can't be part of a repeat; only their hashes are shuffled to
   find that. This leaves the repeated part of the parse.
2. Parse: each occurrence left is put with those of equal context, the bytes within reach of any string of `length` bytes that
   holds the trigger. Two or more in one class: all those strings are repeats (`whole`).
3. Where classes of one trigger string differ, at the ends of repeats: one member of each class brings what stands behind and
   before its trigger. Both are sorted, the latter read backwards: suffix arrays of what follows a trigger and of what leads to
   it, with the lengths that neighbours share. Together they give, for each of the `spread` places where a string around the
   trigger can start, which classes share it (`shared_places`).
4. Trigger strings of more than MOST_CLASSES classes are not brought to one task. A string that starts in one half of the
   `spread` places holds all bytes that every string of that half has in common, so contexts meet by the trigger and those
   bytes, once for either half. A group of them is treated as that of a trigger: contexts that are equal as far as the half's
   strings reach are one class and share them all, a group with few classes is sorted, and one with too many is halved again,
   down to single places if need be. Rows grow with the contexts: two for each context of a group that is halved.

The rolling hash only chooses triggers and brings equal ones together. What counts as equal is told by the bytes (3) or by
BLAKE2b digests of them: 64 bits among the contexts of one trigger string, 128 bits for the bytes of a half and for texts.

Rows of copies are counted, not paired, and counts are formed before shuffles. Texts are matched to their repeats by a
128-bit digest, so texts without any repeat are never moved.

`dedup` looks for strings of PASSAGE bytes first, in all texts, and for those of LENGTH bytes only inside the runs found: a
longer string that repeats is made of shorter ones that do.

Nulls, empties, ties: a null text is empty; texts under the length lose nothing. Repeated rows are documents of their own,
so copies of that length or more lose all. An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Batches, bit_map, drop_stored, fresh, has_bit, prepare, stored, text_buffers
from .hashing import U, Rolling, groups, mix

#: Strings that count for op8, and shorter ones that find passages: WORDS words and more have some 200 bytes at least.
LENGTH, PASSAGE, SPREAD, WORDS = 400, 200, 128, 50
#: Bits of the map that says which texts may have a repeat; a bit too many costs time only.
MARK_BITS = 1 << 23
#: Classes of one trigger string that are sorted in one task, and contexts that are sorted at once.
MOST_CLASSES, TOGETHER = 1 << 12, 1 << 13
WHOLE, ENDS, HOT = 1, 2, 4
_BITS = 3
_ROLLING: list[Rolling] = []


@dataclass(frozen=True)
class Shape:
    """Length of the strings, and how many places in a row share a trigger."""

    length: int = LENGTH
    spread: int = SPREAD

    @property
    def trigger(self) -> int:
        return self.length - self.spread + 1

    def reach(self, at: np.ndarray, begin: np.ndarray | int, end: np.ndarray | int) -> tuple[np.ndarray, np.ndarray]:
        """The bytes of all strings that hold the trigger at a place, within its text."""
        return np.maximum(begin, at - (self.spread - 1)), np.minimum(end, at + self.length)


def _rolling() -> Rolling:
    if not _ROLLING:
        _ROLLING.append(Rolling(8))
    return _ROLLING[0]


def sliding(x: np.ndarray, size: int, best: Callable) -> np.ndarray:
    """best (minimum or maximum) of each `size` values in a row."""
    done = 1
    while 2 * done <= size:
        x = best(x[:-done], x[done:])
        done *= 2
    return best(x[: len(x) - (size - done)], x[size - done :]) if done < size else x


class Parse:
    """Triggers of some texts that lie one behind the other in data, from bounds[k] to bounds[k+1]."""

    def __init__(self, shape: Shape, data: np.ndarray, bounds: np.ndarray):
        self.shape, self.bounds, n = shape, bounds, len(data)
        self.at = self.text = np.zeros(0, np.int64)
        if n < shape.length:
            return
        self.hashes = _rolling().windows(_rolling().prefixes(data), shape.trigger) | U(1)
        least = sliding(self.hashes, shape.spread, np.minimum)
        step = np.zeros(n + 1, np.int32)  # strings that would cross a text's end have no trigger
        np.add.at(step, np.maximum(bounds[:-1], bounds[1:] - (shape.length - 1)), 1)
        np.add.at(step, bounds[1:], -1)
        least[np.cumsum(step)[: len(least)] > 0] = 0
        edge = np.zeros(shape.spread - 1, U)
        self.least = least
        self.at = np.flatnonzero(self.hashes == sliding(np.concatenate([edge, least, edge]), shape.spread, np.maximum))
        self.text = np.searchsorted(bounds, self.at, "right") - 1

    def contexts(self, data: np.ndarray) -> np.ndarray:
        """A digest of the context of each trigger and of the trigger's place in it."""
        lo, hi = self.shape.reach(self.at, self.bounds[self.text], self.bounds[self.text + 1])
        return _digest(data.tobytes(), lo, hi, 8).view(U)[:, 0] ^ mix((self.at - lo).astype(U))


def _digest(raw: bytes, starts: np.ndarray, ends: np.ndarray, size: int) -> np.ndarray:
    """BLAKE2b digests of raw[start:end], as rows of size / 8 numbers."""
    one = partial(hashlib.blake2b, digest_size=size)
    found = [one(raw[a:b]).digest() for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
    return np.frombuffer(b"".join(found), np.int64).reshape(-1, size // 8)


def parses(shape: Shape, column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, Parse]]:
    """First and last row, bytes and parse of some rows of a text column at a time."""
    data, offsets = text_buffers(column)
    for first, last in groups(offsets):
        bounds = offsets[first : last + 1] - offsets[first]
        part = data[offsets[first] : offsets[last]]
        yield first, last, part, Parse(shape, part, bounds)


def digests(column: pa.Array) -> np.ndarray:
    """128-bit digest of each text, as two numbers; null counts as empty."""
    data, offsets = text_buffers(column)
    return _digest(data[offsets[0] : offsets[-1]].tobytes(), offsets[:-1] - offsets[0], offsets[1:] - offsets[0], 16)


def _numbers(*columns: np.ndarray) -> list[pa.Array]:
    return [pa.array(np.ascontiguousarray(c)) for c in columns]


def _hashes(shape: Shape, batches: Batches) -> Batches:
    for batch in batches:
        for _, _, _, parse in parses(shape, batch.column(0)):
            if len(parse.at):
                yield pa.record_batch(_numbers(parse.hashes[parse.at].view(np.int64)), ["h"])


def _occurrences(shape: Shape, batches: Batches) -> Batches:
    for batch in batches:
        every = digests(batch.column(0))
        for first, _, data, parse in parses(shape, batch.column(0)):
            if len(parse.at):
                own = every[first + parse.text]
                columns = [parse.hashes[parse.at].view(np.int64), parse.contexts(data).view(np.int64), own[:, 0], own[:, 1], parse.at - parse.bounds[parse.text]]
                yield pa.record_batch(_numbers(*columns), ["h", "c", "s1", "s2", "at"])


def _digested(batches: Batches) -> Batches:
    for batch in batches:
        own = digests(batch.column(1))
        yield pa.record_batch([batch.column(0), *_numbers(own[:, 0], own[:, 1]), *batch.columns[2:]], ["doc_id", "s1", "s2", "n_bytes", "sha"])


def _marked_texts(texts: DataFrame, marks: DataFrame) -> DataFrame:
    """Rows (s1, s2, n, z, marks) of each different text that has marks; z is the text, compressed, n how many rows hold it."""
    held = bit_map(texts.sparkSession, marks.select(F.pmod("s1", F.lit(MARK_BITS)).alias("bit")), MARK_BITS)

    def rows(batches: Batches) -> Batches:
        import zstandard

        squeeze = zstandard.ZstdCompressor(level=1).compress
        for batch in batches:
            own = digests(batch.column(0))
            data, offsets = text_buffers(batch.column(0))
            at = np.flatnonzero(has_bit(held.value, own[:, 0] % MARK_BITS))
            z = [squeeze(data[offsets[k] : offsets[k + 1]].tobytes()) for k in at.tolist()]
            yield pa.record_batch([*_numbers(own[at, 0], own[at, 1]), pa.array(z, pa.binary())], ["s1", "s2", "z"])

    each = texts.mapInArrow(rows, "s1 long, s2 long, z binary").groupBy("s1", "s2").agg(F.count(F.lit(1)).alias("n"), F.first("z").alias("z"))
    return each.join(marks, ["s1", "s2"])


def _opened(z: bytes) -> bytes:
    import zstandard

    return zstandard.ZstdDecompressor().decompress(z)


def _at(marks: list[int], bits: int) -> np.ndarray:
    """Places of the marks that have just these bits, but for WHOLE."""
    marks = np.array(marks, np.int64)
    return marks[marks & (ENDS | HOT) == bits] >> _BITS


_CONTEXT = ["g", "before", "behind", "s1", "s2", "at"]
_CONTEXT_SQL = "g long, before binary, behind binary, s1 long, s2 long, at long"
_MASK_SQL = "s1 long, s2 long, at long, mask binary"


def _contexts(shape: Shape, bits: int, batches: Batches) -> Batches:
    """Rows (g, before, behind, s1, s2, at) of triggers with these bits: a digest of the trigger, and the bytes within reach on
    either side of it, those before it backwards."""
    for batch in batches:
        for s1, s2, z, marks in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
            at = _at(marks, bits)
            if not len(at):
                continue
            text = _opened(z)
            g = _digest(text, at, at + shape.trigger, 8)[:, 0]
            lo, hi = (x.tolist() for x in shape.reach(at, 0, len(text)))
            before = [text[a:k][::-1] for a, k in zip(lo, at.tolist(), strict=True)]
            behind = [text[k + shape.trigger : b] for k, b in zip(at.tolist(), hi, strict=True)]
            n = len(at)
            yield pa.record_batch([*_numbers(g), pa.array(before, pa.binary()), pa.array(behind, pa.binary()), *_numbers(np.full(n, s1), np.full(n, s2), at)], _CONTEXT)


def _prefix_classes(group: np.ndarray, strings: list[bytes], most: int) -> tuple[np.ndarray, np.ndarray]:
    """For each length up to `most` and each string: a number, equal for strings of one group that share that many first bytes.

    From the sorted order of the strings and what neighbours share. Where a string is shorter its number means nothing.
    Returned with the strings' lengths.
    """
    n = len(strings)
    held = group.tolist()
    order = np.array(sorted(range(n), key=lambda k: (held[k], strings[k])), np.int64)
    lengths = np.array([len(x) for x in strings], np.int64)
    symbols = np.frombuffer(b"".join(x.ljust(most, b"\0") for x in strings), np.uint8).reshape(n, most).astype(np.int16)
    symbols[np.arange(most) >= lengths[:, None]] = -1
    symbols, sorted_group = symbols[order], group[order]
    differ = symbols[1:] != symbols[:-1]
    shared = np.where(differ.any(axis=1), differ.argmax(axis=1), most)
    shared[sorted_group[1:] != sorted_group[:-1]] = -1
    classes = np.zeros((most + 1, n), np.int32)
    classes[:, order[1:]] = np.cumsum(shared < np.arange(most + 1)[:, None], axis=1, dtype=np.int32)
    return classes, lengths


def shared_places(shape: Shape, group: np.ndarray, before: list[bytes], behind: list[bytes]) -> np.ndarray:
    """For each j below spread and each context: whether another of its group has the same string from j bytes before the trigger."""
    most, n = shape.spread - 1, len(group)
    left, n_left = _prefix_classes(group, before, most)
    right, n_right = _prefix_classes(group, behind, most)
    out = np.zeros((shape.spread, n), bool)
    for j in range(shape.spread):
        at = np.flatnonzero((n_left >= j) & (n_right >= most - j))
        key = left[j, at].astype(np.int64) * n + right[most - j, at]
        order = np.argsort(key, kind="stable")
        key = key[order]
        equal = np.concatenate([[False], key[1:] == key[:-1], [False]])
        out[j, at[order]] = equal[1:] | equal[:-1]
    return out


def _shared(shape: Shape, batches: Batches) -> Batches:
    """Rows (s1, s2, at, mask) of contexts that share strings, from rows in the order of g; mask has a bit for each place."""

    def rows(table: pa.Table) -> pa.RecordBatch:
        found = shared_places(shape, table.column(0).to_numpy(), table.column(1).to_pylist(), table.column(2).to_pylist())
        some = np.flatnonzero(found.any(axis=0))
        masks = np.packbits(found[:, some], axis=0).T
        return pa.record_batch([*_numbers(*(table.column(k).to_numpy()[some] for k in (3, 4, 5))), pa.array([x.tobytes() for x in masks], pa.binary())], ["s1", "s2", "at", "mask"])

    held: list[pa.RecordBatch] = []
    n = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        n += batch.num_rows
        if n >= TOGETHER:
            every = pa.Table.from_batches(held)
            g = every.column(0).to_numpy()
            last = int(np.flatnonzero(g == g[-1])[0])  # the last group may go on
            if last:
                yield rows(every.slice(0, last))
            held, n = every.slice(last).to_batches(), every.num_rows - last
    if held:
        yield rows(pa.Table.from_batches(held))


def _halved(shape: Shape, batches: Batches) -> Batches:
    """Contexts with places lo to hi, once for each half of the places where they have a string.

    g becomes a digest of the trigger's and of all bytes that the half's strings have in common. r1 and r2 are a digest of all bytes
    that they reach; mask has a bit for each of them.
    """
    most = shape.spread - 1
    for batch in batches:
        rows = []
        for g, before, behind, s1, s2, at, lo, hi in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            middle = (lo + hi) // 2
            for a, b in ((lo, middle), (middle + 1, hi)):
                first, last = max(a, most - len(behind)), min(b, len(before))
                if first > last:
                    continue
                own = f"{g},{a},{b},".encode()
                common = hashlib.blake2b(own + before[:a] + behind[: most - b], digest_size=8).digest()
                reached = hashlib.blake2b(own + b"%d," % last + before[:b] + behind[: most - a], digest_size=16).digest()
                places = np.zeros(shape.spread, bool)
                places[first : last + 1] = True
                numbers = (int.from_bytes(x, "little", signed=True) for x in (common, reached[:8], reached[8:]))
                rows.append((before, behind, s1, s2, at, a, b, *numbers, np.packbits(places).tobytes()))
        if rows:
            kinds = [pa.binary(), pa.binary(), *[pa.int64()] * 8, pa.binary()]
            columns = [pa.array(list(c), k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]
            yield pa.record_batch(columns, ["before", "behind", "s1", "s2", "at", "lo", "hi", "g", "r1", "r2", "mask"])


def _sorted_masks(shape: Shape, contexts: DataFrame) -> DataFrame:
    """Rows (s1, s2, at, mask) of contexts that share strings; a group's contexts are sorted in one task."""
    return contexts.select(*_CONTEXT).repartition("g").sortWithinPartitions("g").mapInArrow(partial(_shared, shape), _MASK_SQL)


def masks_by_halves(shape: Shape, contexts: DataFrame) -> list[DataFrame]:
    """Stored rows (s1, s2, at, mask) of contexts that share strings, whatever the groups' size.

    A group in which a half's strings are a single place has one class, so that there are as many rounds as a group can be
    halved at most, and as many as are needed.
    """
    found: list[DataFrame] = []
    held = stored(contexts.select(*_CONTEXT, F.lit(0).cast("long").alias("lo"), F.lit(shape.spread - 1).cast("long").alias("hi")))
    rows = held
    while not rows.isEmpty():
        half = stored(rows.mapInArrow(partial(_halved, shape), "before binary, behind binary, s1 long, s2 long, at long, lo long, hi long, g long, r1 long, r2 long, mask binary"))
        drop_stored(held)
        one = F.min(F.struct("s1", "s2", "at")).alias("one")
        classed = stored(half.groupBy("g", "r1", "r2").agg(F.count(F.lit(1)).alias("n"), one))
        several = stored(classed.groupBy("g").agg(F.count(F.lit(1)).alias("k")).where("k > 1"))
        classes = stored(classed.join(several, "g", "left").where("n > 1 or k > 1"))
        known = half.join(classes, ["g", "r1", "r2"]).withColumn("k", F.when(F.struct("s1", "s2", "at") == F.col("one"), F.col("k")))
        held = stored(known.where("n > 1 or k > 1").select(*_CONTEXT, "lo", "hi", "mask", "n", "k"))
        for old in (half, classed, several, classes):
            drop_stored(old)
        equal = held.where("n > 1").select("s1", "s2", "at", "mask")
        found.append(stored(equal.unionByName(_sorted_masks(shape, held.where(F.col("k").between(2, MOST_CLASSES))))))
        rows = held.where(F.col("k") > MOST_CLASSES).select(*_CONTEXT, "lo", "hi")
    drop_stored(held)
    return found


def covered(shape: Shape, n: int, marks: np.ndarray, ends: np.ndarray) -> list[tuple[int, int]]:
    """Maximal runs of removed bytes: strings at triggers marked WHOLE, and single strings that start at ends."""
    at = marks[marks & WHOLE > 0] >> _BITS
    lo, hi = shape.reach(at, 0, n)
    keep = hi - lo >= shape.length
    step = np.zeros(n + 1, np.int64)
    np.add.at(step, np.concatenate([lo[keep], ends]), 1)
    np.add.at(step, np.concatenate([hi[keep], ends + shape.length]), -1)
    gone = np.concatenate([[False], np.cumsum(step)[:n] > 0, [False]])
    edges = np.flatnonzero(gone[1:] != gone[:-1])
    return list(zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True))


_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
_SPANS_SQL = "array<struct<start:bigint,end:bigint>>"


def _listed(spans: list[tuple[int, int]]) -> list[dict]:
    return [{"start": a, "end": b} for a, b in spans]


def _pairs(spans: list[dict] | None) -> list[tuple[int, int]]:
    return [(x["start"], x["end"]) for x in spans or []]


def _without(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    return b"".join(text[a:b] for a, b in zip([0, *(e for _, e in spans)], [*(s for s, _ in spans), len(text)], strict=True))


def _runs(shape: Shape, batches: Batches) -> Batches:
    for batch in batches:
        spans = []
        for z, marks, masks in zip(*(batch.column(k).to_pylist() for k in (3, 4, 5)), strict=True):
            starts = [np.zeros(0, np.int64)]
            starts += [x["at"] - np.flatnonzero(np.unpackbits(np.frombuffer(x["mask"], np.uint8))) for x in masks or []]
            spans.append(_listed(covered(shape, len(_opened(z)), np.array(marks, np.int64), np.concatenate(starts))))
        yield pa.record_batch([*batch.columns[:4], pa.array(spans, _SPANS)], ["s1", "s2", "n", "z", "spans"])


def repeats(docs: DataFrame, shape: Shape = Shape()) -> DataFrame:
    """Rows (s1, s2, n, z, spans) of each different text that has repeats: its digest, the rows that hold it, the text
    (compressed) and the maximal runs of bytes that repeated strings cover.

    text may be a string or binary. The rows are in the shared folder, what led to them is deleted.
    """
    prepare(docs.sparkSession)
    texts = docs.select(F.col("text").cast("binary").alias("text"))
    # counted tables are stored before they are joined: an aggregate in the join's own stage would keep Spark from splitting hot keys
    twice = stored(texts.mapInArrow(partial(_hashes, shape), "h long").groupBy("h").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("h"))
    left = stored(texts.mapInArrow(partial(_occurrences, shape), "h long, c long, s1 long, s2 long, at long").join(twice, "h"))
    drop_stored(twice)
    # copies of a text count, and are one occurrence from here on
    classed = stored(left.groupBy("h", "c").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("s1", "s2", "at")).alias("one")))
    several = stored(classed.groupBy("h").agg(F.count(F.lit(1)).alias("k")).where("k > 1").select("h", F.when(F.col("k") > MOST_CLASSES, ENDS | HOT).otherwise(ENDS).alias("ends")))
    classes = stored(classed.join(several, "h", "left").select("h", "c", "n", "one", F.coalesce("ends", F.lit(0)).alias("ends")))
    whole = F.when(F.col("n") > 1, WHOLE).otherwise(0)
    ends = F.when(F.struct("s1", "s2", "at") == F.col("one"), F.col("ends")).otherwise(0)
    mark = F.col("at") * (1 << _BITS) + whole + ends
    placed = left.join(classes, ["h", "c"]).select("s1", "s2", mark.alias("mark")).where(F.col("mark") % (1 << _BITS) > 0)
    # a copy's marks are those of its text: equal rows, kept once, the representative's with more bits set
    once = placed.groupBy("s1", "s2", F.shiftright("mark", _BITS).alias("at")).agg(F.bit_or("mark").alias("mark"))
    marks = stored(once.groupBy("s1", "s2").agg(F.sort_array(F.collect_list("mark")).alias("marks")))
    for old in (left, classed, several, classes):
        drop_stored(old)
    marked = stored(_marked_texts(texts, marks))
    drop_stored(marks)
    at_ends = marked.where(F.exists("marks", lambda x: x.bitwiseAND(F.lit(ENDS)) > 0)).select("s1", "s2", "z", "marks")
    hot = at_ends.where(F.exists("marks", lambda x: x.bitwiseAND(F.lit(HOT)) > 0))
    of_hot = masks_by_halves(shape, hot.mapInArrow(partial(_contexts, shape, ENDS | HOT), _CONTEXT_SQL))
    masks = _sorted_masks(shape, at_ends.mapInArrow(partial(_contexts, shape, ENDS), _CONTEXT_SQL))
    for more in of_hot:
        masks = masks.unionByName(more)
    masks = masks.groupBy("s1", "s2").agg(F.collect_list(F.struct("at", "mask")).alias("masks"))
    every = marked.join(masks, ["s1", "s2"], "left").select("s1", "s2", "n", "z", "marks", "masks")
    out = stored(every.mapInArrow(partial(_runs, shape), f"s1 long, s2 long, n long, z binary, spans {_SPANS_SQL}").where(F.size("spans") > 0))
    for old in (marked, *of_hot):
        drop_stored(old)
    return out


def passages(text: bytes, spans: list[tuple[int, int]], words: int) -> list[tuple[int, int]]:
    """The spans that hold more than so many words."""
    return [(a, b) for a, b in spans if len(text[a:b].split()) > words]


def cleaned(docs: DataFrame, length: int = LENGTH, words: int = 0) -> DataFrame:
    """docs with what repeats removed from text, in all their columns; documents that lose all their bytes go.

    Removed are the maximal runs of bytes that repeated strings of `length` bytes cover, if they hold more than `words` words.
    Where a removed run cuts a character in two, the rest of that character goes too. Texts that lose nothing are as they
    were and are not shuffled.
    """
    spark = prepare(docs.sparkSession)

    def cut(batches: Batches) -> Batches:
        for batch in batches:
            rows = []
            for s1, s2, z, spans in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                if gone := passages(text := _opened(z), _pairs(spans), words):
                    rows.append((s1, s2, _without(text, gone)))
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 3
            yield pa.record_batch([pa.array(list(c), k) for c, k in zip(columns, (pa.int64(), pa.int64(), pa.binary()), strict=True)], ["s1", "s2", "kept"])

    runs = repeats(docs, Shape(length))
    lost = stored(runs.select("s1", "s2", "z", "spans").mapInArrow(cut, "s1 long, s2 long, kept binary"))
    drop_stored(runs)
    held = bit_map(spark, lost.select(F.pmod("s1", F.lit(MARK_BITS)).alias("bit")), MARK_BITS)
    at, own_names = docs.columns.index("text"), docs.columns
    names = fresh(docs, "s1_", "s2_", "maybe_", "s1", "s2", "kept")
    lost = lost.toDF(*names[3:])
    maybe, kept = F.col(names[2]), F.col(names[5])

    def digest(batches: Batches) -> Batches:
        for batch in batches:
            own = digests(batch.column(at))
            maybe = has_bit(held.value, own[:, 0] % MARK_BITS)
            yield pa.record_batch([*batch.columns, *_numbers(own[:, 0], own[:, 1]), pa.array(maybe)], [*batch.schema.names, *names[:3]])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema), f"`{names[0]}` long, `{names[1]}` long, `{names[2]}` boolean"])
    every = docs.mapInArrow(digest, schema)
    some = every.where(maybe).join(lost, (F.col(names[0]) == F.col(names[3])) & (F.col(names[1]) == F.col(names[4])), "left")

    def decode(batches: Batches) -> Batches:
        for batch in batches:
            texts = [t if kept is None else kept.decode("utf-8", "ignore") for t, kept in zip(batch.column(at).to_pylist(), batch.column(len(own_names)).to_pylist(), strict=True)]
            columns = list(batch.columns[: len(own_names)])
            columns[at] = pa.array(texts, pa.string())
            yield pa.record_batch(columns, own_names)

    some = some.where(kept.isNull() | (F.octet_length(kept) > 0)).select(*docs.columns, kept)
    return every.where(~maybe).select(*docs.columns).unionByName(some.mapInArrow(decode, docs.schema))


def digested(docs: DataFrame) -> DataFrame:
    """Rows (doc_id, s1, s2, n_bytes, sha) of docs (doc_id, text), to be joined with repeats by s1 and s2."""
    prepare(docs.sparkSession)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.octet_length(text).cast("long").alias("n_bytes"), F.sha2(text.cast("binary"), 256).alias("sha"))
    return rows.mapInArrow(_digested, "doc_id long, s1 long, s2 long, n_bytes long, sha string")


def _long_runs(batches: Batches) -> Batches:
    """Rows (s1, s2, start, t1, t2, text) of runs that may hold a string of LENGTH bytes; twice where several rows hold their text."""
    for batch in batches:
        for s1, s2, n, z, spans in zip(*(batch.column(k).to_pylist() for k in range(5)), strict=True):
            text = _opened(z)
            rows = [(a, text[a:b]) for a, b in _pairs(spans) if b - a >= LENGTH for _ in range(min(n, 2))]
            if rows:
                runs = pa.array([x for _, x in rows], pa.binary())
                own = digests(runs)
                columns = _numbers(np.full(len(rows), s1), np.full(len(rows), s2), np.array([a for a, _ in rows], np.int64), own[:, 0], own[:, 1])
                yield pa.record_batch([*columns, runs], ["s1", "s2", "start", "t1", "t2", "text"])


def _summed(batches: Batches) -> Batches:
    """Spans, their count and bytes, the rest's sha256 and the passages of each text; parts holds (start of a run, spans in it)."""
    for batch in batches:
        rows = []
        for s1, s2, z, spans, parts in zip(*(batch.column(k).to_pylist() for k in range(5)), strict=True):
            text = _opened(z)
            gone = sorted({(p["start"] + a, p["start"] + b) for p in parts or [] for a, b in _pairs(p["spans"])})
            found = passages(text, _pairs(spans), WORDS)
            rows.append((s1, s2, _listed(gone), sum(b - a for a, b in gone), len(gone), hashlib.sha256(_without(text, gone)).hexdigest(), _listed(found), sum(b - a for a, b in found)))
        kinds = [pa.int64(), pa.int64(), _SPANS, pa.int64(), pa.int64(), pa.string(), _SPANS, pa.int64()]
        columns = list(zip(*rows, strict=True)) if rows else [[]] * 8
        yield pa.record_batch([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], ["s1", "s2", "spans", "removed", "k", "kept_sha", "passages", "passage_bytes"])


def dedup(docs: DataFrame) -> DataFrame:
    """Rows (doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans, passages, passage_bytes) of docs (doc_id, text).

    The first five and spans are of strings of LENGTH bytes. passages are the runs of more than WORDS words that repeated strings
    of PASSAGE bytes cover, which are found first; passage_bytes counts their bytes.
    """
    runs = repeats(docs, Shape(PASSAGE))
    long = stored(runs.select("s1", "s2", "n", "z", "spans").mapInArrow(_long_runs, "s1 long, s2 long, start long, t1 long, t2 long, text binary"))
    inner = repeats(long.select("text"))
    found = inner.select(F.col("s1").alias("t1"), F.col("s2").alias("t2"), F.col("spans").alias("inside"))
    parts = long.select("s1", "s2", "start", "t1", "t2").join(found, ["t1", "t2"])
    parts = parts.groupBy("s1", "s2").agg(F.collect_set(F.struct("start", F.col("inside").alias("spans"))).alias("parts"))
    kind = f"s1 long, s2 long, spans {_SPANS_SQL}, removed long, k long, kept_sha string, passages {_SPANS_SQL}, passage_bytes long"
    lost = stored(runs.join(parts, ["s1", "s2"], "left").select("s1", "s2", "z", "spans", "parts").mapInArrow(_summed, kind))
    for old in (runs, long, inner):
        drop_stored(old)
    rows = digested(docs).join(lost, ["s1", "s2"], "left")
    none = F.lit(0).cast("long")
    number = lambda name: F.coalesce(name, none)
    return rows.select(
        "doc_id",
        "n_bytes",
        number("removed").alias("n_removed"),
        number("k").alias("n_spans"),
        F.coalesce("kept_sha", "sha").alias("kept_sha256"),
        "spans",
        "passages",
        number("passage_bytes").alias("passage_bytes"),
    )
