"""Best-fit packing of token sequences, with lower bounds that certify the number of bins.

Documents longer than the capacity are cut into full pieces and a rest; no other is cut. The pieces are dealt by a hash to
groups of bounded size, each packed by best-fit decreasing. Dual-feasible functions give a lower bound on the bins of each
group and of all pieces together (from the counts by length, at most `capacity` of them). While there are more bins than
the bound over all, the pieces of bins with room left are exchanged: dealt anew to groups that are GROW times as large, up to
MOST times the first size, and packed again, until the bound is met, a round with the largest groups saves no bin, or all of
them are in one group. If they would fit in one, they are packed with a bounded share of the full bins too. So no task packs more
than some MOST * GROUP pieces, whatever the table's size. A round's outcome is kept only if it has fewer bins than
before; where the bound isn't met, the groups' own bounds and bins stand in the rows.

Nulls, empties, ties: pieces of any length from 1 to the capacity are packed, none is lost; ties are broken by doc_id and
piece, and repeated rows are pieces of their own. An empty table gives an empty result.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Batches, drop_stored, give_back, prepare, stored, texts_of
from .tokens import encoder

CAPACITY = 2048
#: Seconds between two times that a task returns freed memory, which it soon needs again.
GIVE_BACK = 2
#: Pieces dealt to a group on average: what one task packs at once.
GROUP = 4096
#: How much the groups grow each round, and up to how many times GROUP.
GROW, MOST = 4, 64
#: Attempts to save the last bins, each with this many groups' pieces in one task.
TRIES, WIDE = 3, 4


def token_pieces(docs: DataFrame, tokenizer: str, style: str = "word", end_id: int = 0, capacity: int = CAPACITY) -> DataFrame:
    """Rows (doc_id, piece, start, length, ids_crc32) of docs (doc_id, text); a null text is empty."""
    prepare(docs.sparkSession)

    def cut(batches: Batches) -> Batches:
        import zlib

        end = np.array([end_id], "<u4").tobytes()
        give_back()
        for batch in batches:
            rows = []
            for d, ids in zip(batch.column(0).to_pylist(), encoder(tokenizer, style).encode(texts_of(batch.column(1))), strict=True):
                ids += end
                rows += [(d, k, k * capacity, len(p := ids[4 * k * capacity : 4 * (k + 1) * capacity]) // 4, zlib.crc32(p)) for k in range(math.ceil(len(ids) / 4 / capacity))]
            columns = zip(*rows, strict=True) if rows else [[]] * 5
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.record_batch([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"])
            give_back(GIVE_BACK)

    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return docs.mapInArrow(cut, "doc_id long, piece int, start long, length long, ids_crc32 long")


def lower_bound(counts: np.ndarray, capacity: int = CAPACITY) -> int:
    """Least number of bins for counts[length] pieces, by dual-feasible functions.

    Each function maps lengths so that whatever fits in a bin still does; the mapped total over the mapped capacity is
    then a bound. Used: the identity; for each a <= capacity/2, lengths over capacity-a count whole and those under a
    nothing; and for each k, rounding of (k+1)*length/capacity downwards unless it is whole.
    """
    at = np.flatnonzero(counts)
    if not len(at):
        return 0
    n = counts[at].astype(np.int64)
    best = -(-int(n @ at) // capacity)
    for a in np.unique(np.concatenate([at[at <= capacity // 2], capacity - at[at > capacity // 2] + 1])):
        mapped = np.where(at > capacity - a, capacity, np.where(at < a, 0, at))
        best = max(best, -(-int(n @ mapped) // capacity))
    for k in range(1, 101):
        mapped = np.where((k + 1) * at % capacity == 0, at * k, (k + 1) * at // capacity * capacity)
        best = max(best, -(-int(n @ mapped) // (capacity * k)))
    return best


def best_fit_decreasing(lengths: list[int], capacity: int = CAPACITY) -> tuple[list[int], list[int], list[int]]:
    """Bin and offset of each length, and what each bin holds. Longest first; each goes where least room is left."""
    order = sorted(range(len(lengths)), key=lengths.__getitem__, reverse=True)
    bins, offsets, levels = [0] * len(lengths), [0] * len(lengths), []
    open_bins: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms = 0  # bit r: some bin has room r
    for i in order:
        size = lengths[i]
        fitting = rooms >> size
        if fitting:
            room = size + (fitting & -fitting).bit_length() - 1
            b = open_bins[room].pop()
            if not open_bins[room]:
                rooms &= ~(1 << room)
        else:
            room, b = capacity, len(levels)
            levels.append(0)
        bins[i], offsets[i] = b, levels[b]
        levels[b] += size
        left = room - size
        if left:
            open_bins[left].append(b)
            rooms |= 1 << left
    return bins, offsets, levels


def pack(pieces: DataFrame, capacity: int = CAPACITY, group: int = GROUP) -> DataFrame:
    """pieces (doc_id, piece, length, ...) with sequence_id and offset added, and the group's lower bound and bins."""
    prepare(pieces.sparkSession)
    schema = pieces.schema
    names = schema.names
    plain = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)

    def pack_group(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["length", "doc_id", "piece"], ascending=[False, True, True], kind="stable")
        lengths = pdf["length"].tolist()
        bins, offsets, levels = best_fit_decreasing(lengths, capacity)
        bins = np.array(bins, np.int64)
        base = (int(pdf["round_"].iloc[0]) << 58) + (int(pdf["group_"].iloc[0]) << 22)
        return pdf[names].assign(
            sequence_id=base + bins,
            offset=np.array(offsets, np.int64),
            level=np.array(levels, np.int64)[bins],
            group_bins=len(levels),
            group_bound=lower_bound(np.bincount(lengths, minlength=capacity + 1), capacity),
        )

    out = f"{plain}, sequence_id long, offset long, level long, group_bins long, group_bound long"

    def packed(rows: DataFrame, n: int, round_: int) -> DataFrame:
        key = F.pmod(F.xxhash64("doc_id", "piece", F.lit(round_)), F.lit(n))
        dealt = rows.select(*names, key.alias("group_"), F.lit(round_).alias("round_"))
        return dealt.groupBy("group_").applyInPandas(pack_group, out)

    def tally(rows: DataFrame) -> tuple[int, int]:
        """Bins, and pieces in bins with room left."""
        open_ = F.col("level") < capacity
        row = rows.agg(F.sum(F.when(F.col("offset") == 0, 1)).alias("bins"), F.sum(F.when(open_, 1)).alias("open")).first()
        return row["bins"] or 0, row["open"] or 0

    by_length = pieces.groupBy("length").count().collect()  # at most `capacity` rows
    counts = np.zeros(capacity + 1, np.int64)
    for r in by_length:
        counts[r["length"]] += r["count"]
    bound, total = lower_bound(counts, capacity), int(counts.sum())
    n, size, round_ = max(1, math.ceil(total / group)), group, 0
    now = stored(packed(pieces, n, 0))
    written = [now]
    bins, open_pieces = tally(now)
    done: list[DataFrame] = []
    settled = 0
    while bins + settled > bound and open_pieces and n > 1:
        size, largest = min(GROW * size, MOST * group), size >= MOST * group
        n, round_ = math.ceil(open_pieces / size), round_ + 1
        full, rest = now.where(F.col("level") == capacity), now.where(F.col("level") < capacity)
        was = tally(rest)[0]
        again = stored(packed(rest.select(*names), n, round_))
        written.append(again)
        got, left = tally(again)
        if got >= was:
            if largest:
                break
            continue
        done.append(full)
        settled += bins - was
        now, bins, open_pieces = again, got, left
    result = now
    for part in done:
        result = result.unionByName(part)
    # the last few bins: those with room left once more, together with other bins of many pieces
    total_bins = bins + settled
    for salt in range(TRIES):
        if total_bins <= bound or open_pieces > MOST * group:
            break
        share = F.pmod(F.xxhash64("sequence_id", F.lit(salt)), F.lit(max(1, math.ceil(total / (WIDE * group))))) == 0
        pick = (F.col("length") < capacity) & ((F.col("level") < capacity) | share)
        was = tally(result.where(pick))[0]
        round_ += 1
        again = stored(packed(result.where(pick).select(*names), 1, round_))
        written.append(again)
        got, left = tally(again)
        if got < was:
            result = result.where(~pick).unionByName(again)
            total_bins, open_pieces = total_bins - (was - got), left
    out_rows = stored(result)
    for old in written:
        drop_stored(old)
    return out_rows
