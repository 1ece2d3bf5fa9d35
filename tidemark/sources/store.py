"""A store of samples: immutable Parquet blocks below one folder, and a manifest that says which of them count.

A manifest version lists the blocks, as JSON written by Spark; a reader takes the newest complete version, so what it reads
doesn't change under it, and a write that dies before its manifest leaves nothing that counts. Blocks of level 0 hold
accepted batches (the head); flush() turns what is old enough into blocks of level 1, aligned to the block's duration;
compact() merges blocks; retain() drops old ones. Blocks are in the order of their creation: where two hold the same series
and time, the later block counts.

A block that was replaced or dropped is only marked so. Its files stay for `grace` milliseconds, so that frames which were
made before still read it, and are deleted by the next change or clean() after that; a frame is to be read within that time.

Beside its samples a block has a table of its series (metric, labels, first and last time, newest time). Look-ups of series and
labels, and the newest times that new samples must exceed, read these tables: rows in number of series, not of samples.
"""

from __future__ import annotations

import json
import threading
import time
import uuid
from dataclasses import asdict, dataclass, field, replace

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..errors import ClosedError, WriteError
from ..model import MAX_TIME, MIN_TIME, SAMPLES_SCHEMA
from .requests import MOST_ERRORS, as_samples, request_rows

HOUR = 3_600_000
# fixed values: duration of a block, and the ladder of durations that blocks are merged to
BLOCK = 2 * HOUR
#: Numbers of samples whose order is checked in one task, where a batch is split.
RUN = 1 << 20
#: How long the files of a replaced block stay, in milliseconds.
GRACE = 15 * 60_000
LADDER = (2 * HOUR, 6 * HOUR, 18 * HOUR, 54 * HOUR, 162 * HOUR, 486 * HOUR)


@dataclass
class Block:
    """min_time and max_time are of its samples, both included. parents: the blocks it replaced; sources: the first ones of them."""

    id: str
    min_time: int
    max_time: int
    samples: int
    level: int = 1
    parents: list[str] = field(default_factory=list)
    sources: list[str] = field(default_factory=list)
    seq: int = 0
    #: When it was replaced or dropped (milliseconds since 1970); None while it counts.
    gone: int | None = None


@dataclass
class Written:
    accepted: int
    rejected: int
    errors: list[str]


def plan_compaction(blocks: list[Block], ladder: tuple[int, ...] = LADDER) -> list[Block]:
    """The blocks to merge next, none if nothing is due.

    Blocks that overlap come first. Else, for each duration from the shortest: blocks shorter than it that start in the same
    window, aligned to the epoch, two at least, which together span half of it or more.
    """
    blocks = sorted(blocks, key=lambda b: b.min_time)
    run: list[Block] = []
    reach = MIN_TIME
    for b in blocks:
        if run and b.min_time <= reach:
            run.append(b)
        elif len(run) > 1:
            break
        else:
            run, reach = [b], MIN_TIME
        reach = max(reach, b.max_time)
    if len(run) > 1:
        return run
    for size in ladder:
        groups: list[list[Block]] = [[]]
        for b in blocks:
            if b.max_time - b.min_time >= size:
                groups.append([])
                continue
            if groups[-1] and groups[-1][-1].min_time // size != b.min_time // size:
                groups.append([])
            groups[-1].append(b)
        for g in groups:
            if len(g) > 1 and sum(b.max_time - b.min_time for b in g) >= size // 2:
                return g
    return []


def later_wins(samples: DataFrame, order: str = "seq") -> DataFrame:
    """One row for each series and time: that of the highest order. By partial aggregation, so copies don't meet in one task."""
    return samples.groupBy("labels", "t").agg(F.first("metric").alias("metric"), F.max_by("v", order).alias("v")).select("metric", "labels", "t", "v")


def _split_running(samples: DataFrame, good: Column, order: str, run: Column) -> DataFrame:
    """before_: the greatest good time of all earlier samples of the series, within the run and by the maxima of earlier runs."""
    within = Window.partitionBy("labels", "run_").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    rows = samples.withColumn("run_", run)
    tops = rows.groupBy("labels", "run_").agg(F.max(good).alias("top_"))
    earlier = Window.partitionBy("labels").orderBy("run_").rowsBetween(Window.unboundedPreceding, -1)
    tops = tops.select("labels", "run_", F.max("top_").over(earlier).alias("runs_"))
    rows = rows.withColumn("before_", F.max(good).over(within)).join(tops, ["labels", "run_"], "left")
    return rows.withColumn("before_", F.greatest("before_", "runs_")).drop("run_", "runs_")


def in_order(samples: DataFrame, newest: DataFrame | None, floor: int, order: str = "seq", runs: Column | None = None) -> DataFrame:
    """samples with reason set where t is below the floor, or not above all earlier samples of its series.

    newest: (labels, newest) of what is stored. A sample that is refused doesn't move the newest time, as it lies at or below it.
    runs: a column that grows with the order. It cuts a series into runs, of which each task holds one, so that a series with very
    many samples in one batch is no task of its own.
    """
    window = Window.partitionBy("labels").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    good = F.when(F.col("reason").isNull(), F.col("t"))
    rows = samples.withColumn("before_", F.max(good).over(window)) if runs is None else _split_running(samples, good, order, runs)
    rows = rows.join(newest, "labels", "left") if newest is not None else rows.withColumn("newest", F.lit(None).cast("long"))
    limit = F.greatest("before_", "newest")
    late = F.when(F.col("t") < floor, F.lit("sample is older than the head's floor")).when(F.col("t") <= limit, F.lit("out of order sample"))
    return rows.withColumn("reason", F.coalesce("reason", late)).drop("before_", "newest")


def observed(seen: Observation) -> dict | None:
    """What was observed; None where Spark found out on the way that there was nothing to do, and then observes nothing."""
    try:
        return seen.get
    except Py4JJavaError:
        return None


class Store:
    """One writer at a time."""

    def __init__(self, spark: SparkSession, path: str, block: int = BLOCK, ladder: tuple[int, ...] = LADDER, retention: int | None = None, grace: int = GRACE):
        self.spark, self.path, self.block, self.ladder, self.retention, self.grace = spark, path.rstrip("/"), block, ladder, retention, grace
        self._lock = threading.RLock()
        self._closed = False
        self.version, state = self._newest()
        every = [Block(**b) for b in state.get("blocks", [])]
        self.blocks = [b for b in every if b.gone is None]
        self.old = [b for b in every if b.gone is not None]
        self.floor: int = state.get("floor", MIN_TIME)
        self._seq: int = state.get("seq", 0)
        self._done: list = state.get("batches", [])

    # files

    def _fs(self, path: str):
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def _newest(self) -> tuple[int, dict]:
        fs, p = self._fs(f"{self.path}/manifest")
        if not fs.exists(p):
            return 0, {}
        done = [int(s.getPath().getName()) for s in fs.listStatus(p) if fs.exists(self._fs(f"{s.getPath()}/_SUCCESS")[1])]
        if not done:
            return 0, {}
        text = self.spark.read.text(f"{self.path}/manifest/{max(done)}", wholetext=True).first()[0]
        return max(done), json.loads(text)

    def _publish(self) -> None:
        self.version += 1
        late = [b for b in self.old if b.gone <= self._now() - self.grace]
        self.old = [b for b in self.old if b not in late]
        state = {"blocks": [asdict(b) for b in [*self.blocks, *self.old]], "floor": self.floor, "seq": self._seq, "batches": self._done[-100:]}
        row = self.spark.createDataFrame([(json.dumps(state),)], "value string").coalesce(1)
        row.write.mode("overwrite").text(f"{self.path}/manifest/{self.version}")
        for b in late:
            for kind in ("blocks", "series"):
                fs, p = self._fs(f"{self.path}/{kind}/block_id={b.id}")
                fs.delete(p, True)

    @staticmethod
    def _now() -> int:
        return int(time.time() * 1000)

    def _retire(self, blocks: list[Block]) -> None:
        """Marks blocks as replaced or dropped from now on; to be published."""
        ids = {b.id for b in blocks}
        self.blocks = [b for b in self.blocks if b.id not in ids]
        self.old += [replace(b, gone=self._now()) for b in blocks]

    def clean(self) -> int:
        """Delete the files of blocks that went longer than the grace time ago; how many blocks."""
        self._open()
        with self._lock:
            before = len(self.old)
            if any(b.gone <= self._now() - self.grace for b in self.old):
                self._publish()
            return before - len(self.old)

    def _open(self) -> None:
        if self._closed:
            raise ClosedError("the store is closed")

    def close(self) -> None:
        self._closed = True

    # blocks

    def _write(self, samples: DataFrame, level: int, parents: list[Block]) -> Block | None:
        """A new block of samples, partitioned by time and sorted by series; None if there are none. Its bounds are observed as it is written."""
        id_ = f"{self._now():013d}-{uuid.uuid4().hex[:12]}"
        path = f"{self.path}/blocks/block_id={id_}"
        start = F.col("t") - F.pmod("t", F.lit(self.block).cast("long"))
        seen = Observation()
        rows = samples.observe(seen, F.min("t").alias("min"), F.max("t").alias("max"), F.count(F.lit(1)).alias("n")).select("metric", "labels", "t", "v", start.alias("block_start"))
        rows.repartition("block_start", F.pmod(F.xxhash64("labels"), F.lit(16))).sortWithinPartitions("block_start", "labels", "t").write.partitionBy("block_start").option("compression", "zstd").parquet(path)
        row = observed(seen)
        if row is None:
            fs, p = self._fs(path)
            kept = [s for s in fs.listStatus(p) if s.isDirectory()]
            row = self.spark.read.schema(SAMPLES_SCHEMA).parquet(path).agg(F.min("t").alias("min"), F.max("t").alias("max"), F.count(F.lit(1)).alias("n")).first().asDict() if kept else {}
        if not row.get("n"):
            fs, p = self._fs(path)
            fs.delete(p, True)
            return None
        held = self.spark.read.schema(SAMPLES_SCHEMA).parquet(path)
        series = held.groupBy("labels").agg(F.first("metric").alias("metric"), F.min("t").alias("first"), F.max("t").alias("last"))
        series.select("metric", "labels", "first", "last").write.parquet(f"{self.path}/series/block_id={id_}")
        self._seq += 1
        sources = sorted({s for b in parents for s in (b.sources or [b.id])}) or [id_]
        return Block(id_, row["min"], row["max"], row["n"], level, [b.id for b in parents], sources, self._seq)

    def _read(self, blocks: list[Block]) -> DataFrame:
        """Rows (metric, labels, t, v, block_start, seq) of some blocks, by one scan; seq comes from the folder that names the block."""
        return self._scan("blocks", "metric string, labels array<struct<name:string,value:string>>, t long, v double, block_start long", blocks)

    def _scan(self, kind: str, schema: str, blocks: list[Block]) -> DataFrame:
        """The files of some blocks by one scan, with the blocks' seq."""
        if not blocks:
            return self.spark.createDataFrame([], schema + ", seq long")
        root = f"{self.path}/{kind}"
        rows = self.spark.read.schema(schema + ", block_id string").option("basePath", root).parquet(*[f"{root}/block_id={b.id}" for b in blocks])
        if len(blocks) == 1:
            return rows.drop("block_id").withColumn("seq", F.lit(blocks[0].seq).cast("long"))
        seqs = self.spark.createDataFrame([(b.id, b.seq) for b in blocks], "block_id string, seq long")  # a row a block, as in the manifest
        return rows.join(F.broadcast(seqs), "block_id").drop("block_id")

    def series(self, first: int = MIN_TIME, last: int = MAX_TIME) -> DataFrame:
        """Rows (metric, labels, first, last) of each series' samples in each block that overlaps the range; samples aren't read."""
        self._open()
        blocks = [b for b in self.blocks if b.min_time <= last and b.max_time >= first]
        rows = self._scan("series", "metric string, labels array<struct<name:string,value:string>>, first long, last long", blocks)
        return rows.where((F.col("first") <= last) & (F.col("last") >= first)).drop("seq")

    def samples(self, first: int = MIN_TIME, last: int = MAX_TIME) -> DataFrame:
        """Rows (metric, labels, t, v) from first to last: a snapshot of the blocks that now overlap the range.

        Rows are only compared with each other where blocks overlap in time; elsewhere they are read as they are.
        """
        self._open()
        blocks = [b for b in self.blocks if b.min_time <= last and b.max_time >= first]
        meets = [b for b in blocks if any(a is not b and a.min_time <= b.max_time and b.min_time <= a.max_time for a in blocks)]
        alone = [b for b in blocks if b not in meets]
        cut = lambda df: df.where((F.col("block_start") <= last) & (F.col("block_start") > first - self.block) & F.col("t").between(first, last))
        out = cut(self._read(alone)).select("metric", "labels", "t", "v")
        if meets:
            out = out.unionByName(later_wins(cut(self._read(meets))).select("metric", "labels", "t", "v"))
        return out

    # writing

    def ingest(self, rows: DataFrame, batch: str | None = None, split: bool = False) -> Written:
        """Store the good samples of rows (labels map, t, v, seq) and say why others were not taken.

        batch names a batch of a stream: one that was stored already counts nothing again. split: for batches in which one series may
        have very many samples; seq is then a number, and the order is checked in runs of RUN of it.
        """
        self._open()
        with self._lock:
            if batch is not None and batch in self._done:
                return Written(0, 0, [])
            heads = [b for b in self.blocks if b.level == 0]
            newest = self._scan("series", "labels array<struct<name:string,value:string>>, last long", heads).groupBy("labels").agg(F.max("last").alias("newest")) if heads else None
            runs = F.floor(F.col("seq") / RUN) if split else None
            checked = in_order(as_samples(rows), newest, self.floor, runs=runs)
            seen = Observation()
            counted = [F.count(F.when(F.col("reason").isNull(), 1)).alias("good"), F.count("reason").alias("bad")]
            block = self._write(checked.observe(seen, *counted).where("reason is null"), 0, [])
            counts, errors = observed(seen) or checked.agg(*counted).first().asDict(), []
            if counts["bad"]:
                refused = checked.where("reason is not null").orderBy("seq").limit(MOST_ERRORS + 1)
                errors = [f"{r['reason']} (at {r['t']})" for r in refused.select("reason", "t").collect()]
                if len(errors) > MOST_ERRORS:
                    errors = [*errors[: MOST_ERRORS - 1], "and more that aren't listed"]
            if batch is not None:
                self._done.append(batch)
            if block or batch is not None:
                self.blocks += [block] if block else []
                self._publish()
            return Written(counts["good"], counts["bad"], errors)

    def write_request(self, body: bytes) -> Written:
        """Store one request body. A series without samples adds nothing, as in a batch."""
        return self.ingest(request_rows(self.spark, body))

    # maintenance

    def flush(self, everything: bool = False) -> Block | None:
        """Turn the head below the aligned boundary of its newest sample into a block, if it spans a block's duration; or all of it."""
        self._open()
        with self._lock:
            heads = [b for b in self.blocks if b.level == 0]
            if not heads:
                return None
            least, most = min(b.min_time for b in heads), max(b.max_time for b in heads)
            boundary = most + 1 if everything else most - most % self.block
            if not everything and most - least < self.block or boundary <= least:
                return None
            rows = later_wins(self._read(heads))
            block = self._write(rows.where(F.col("t") < boundary), 1, [])
            rest = self._write(rows.where(F.col("t") >= boundary), 0, []) if boundary <= most else None
            self._retire(heads)
            self.blocks += [b for b in (block, rest) if b]
            self.floor = max(self.floor, boundary)
            self._publish()
            return block

    def compact(self) -> Block | None:
        """Merge the blocks that the plan names, the later winning; the new block lists its parents."""
        self._open()
        with self._lock:
            group = plan_compaction([b for b in self.blocks if b.level], self.ladder)
            if not group:
                return None
            block = self._write(later_wins(self._read(group)), max(b.level for b in group) + 1, group)
            block.seq = max(b.seq for b in group)  # later blocks outside the group still win
            self._retire(group)
            self.blocks.append(block)
            self._publish()
            return block

    def retain(self, now: int) -> int:
        """Drop the blocks that end before now less the retention; how many."""
        self._open()
        if self.retention is None or self.retention <= 0:
            return 0
        with self._lock:
            old = [b for b in self.blocks if b.level and b.max_time < now - self.retention]
            if old:
                self._retire(old)
                self._publish()
            return len(old)

    def maintain(self, now: int) -> None:
        self.flush()
        self.compact()
        self.retain(now)
        self.clean()

    def force_compact(self) -> Block | None:
        self.flush(everything=True)
        return self.compact()

    def stats(self) -> dict:
        """Counts and bounds, from the manifest only."""
        heads = [b for b in self.blocks if b.level == 0]
        full = [b for b in self.blocks if b.level]
        bounds = lambda x: {"minTime": min((b.min_time for b in x), default=None), "maxTime": max((b.max_time for b in x), default=None)}
        return {"head": {"batches": len(heads), "samples": sum(b.samples for b in heads)} | bounds(heads), "blocks": [asdict(b) for b in full], "floor": self.floor} | bounds(self.blocks)


__all__ = ["BLOCK", "LADDER", "Block", "Store", "Written", "WriteError", "in_order", "later_wins", "plan_compaction"]
