"""What the corpus operators share: table paths, the shared folder, and Arrow access to text."""

from __future__ import annotations

import ctypes
import math
import os
import tempfile
import time
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def prepare(spark: SparkSession) -> SparkSession:
    """Settings of a running session that the Python stages need.

    Batches are bounded by rows, so that a batch of long texts stays in the worker's memory, and workers
    find this package by the same path as the driver.
    """
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "512")
    env = spark.sparkContext.environment
    known = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if ROOT not in known:
        env["PYTHONPATH"] = os.pathsep.join([ROOT, *known])
    return spark


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, with underscores added where df has such a column (in any case)."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Only a local session without it gets a temporary one."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = f"file://{tempfile.mkdtemp(prefix='tidemark-')}"
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def stored(df: DataFrame) -> DataFrame:
    """Write df to the shared folder and read it back, which cuts its lineage."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/stored-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_stored(df: DataFrame) -> None:
    """Delete the files behind a stored() frame that nothing reads any more."""
    for folder in {os.path.dirname(f) for f in df.inputFiles()}:
        delete(df.sparkSession, folder)


def delete(spark: SparkSession, folder: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


#: Sums over tasks are formed in this many parts first, so that no task adds up the tables of all tasks.
SPREAD_SUMS = 64
_CHUNK_BITS = 1 << 17


def added_up(tables: DataFrame, value: str, add: Callable[[list[np.ndarray]], np.ndarray], kind: type) -> dict[int, np.ndarray]:
    """Joins the tables of tasks, rows (chunk, value: binary), chunk by chunk; tasks of the scan stay as they are.

    In two levels: the tasks' rows of a chunk are joined in SPREAD_SUMS parts by the task's number, then these. A joining task
    holds one array and a batch of rows. The finished chunks, of which there is a fixed number, come to the driver.
    """

    def join(batches: Batches) -> Batches:
        held: dict[tuple, np.ndarray] = {}
        for batch in batches:
            for chunk, part, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                new = np.frombuffer(raw.as_buffer(), kind)
                held[chunk, part] = add([held[chunk, part], new]) if (chunk, part) in held else new.copy()
        yield pa.record_batch([pa.array([c for c, _ in held], pa.int64()), pa.array([p for _, p in held], pa.int64()), pa.array([x.tobytes() for x in held.values()], pa.binary())], ["chunk", "part", value])

    sql = f"chunk long, part long, {value} binary"
    rows = tables.select("chunk", F.pmod(F.spark_partition_id(), F.lit(SPREAD_SUMS)).cast("long").alias("part"), value)
    rows = rows.repartition("chunk", "part").mapInArrow(join, sql).withColumn("part", F.lit(0).cast("long"))
    found = rows.repartition("chunk").mapInArrow(join, sql).toArrow()
    return {c: np.frombuffer(x, kind) for c, x in zip(found.column("chunk").to_pylist(), found.column(value).to_pylist(), strict=True)}


def bit_map(spark: SparkSession, bits: DataFrame, size: int) -> Broadcast:
    """A broadcast map of `size` bits, those in bits (one column) set: size / 8 bytes whatever the input's size.

    It only spares work: what looks a bit up must be right where too many are set. Tasks send their parts of the map, which
    are joined by part; the driver gets the finished parts.
    """

    def parts(batches: Batches) -> Batches:
        marked = np.zeros(size, bool)
        for batch in batches:
            marked[batch.column(0).to_numpy()] = True
        chunks = marked.reshape(-1, min(size, _CHUNK_BITS))
        some = np.flatnonzero(chunks.any(axis=1))
        yield pa.record_batch([pa.array(some), pa.array([np.packbits(chunks[k]).tobytes() for k in some.tolist()], pa.binary())], ["chunk", "bits"])

    packed = np.zeros((max(1, size // _CHUNK_BITS), min(size, _CHUNK_BITS) // 8), np.uint8)
    for k, x in added_up(bits.mapInArrow(parts, "chunk long, bits binary"), "bits", np.bitwise_or.reduce, np.uint8).items():
        packed[k] = x
    return spark.sparkContext.broadcast(packed.ravel())


def has_bit(held: np.ndarray, bit: np.ndarray) -> np.ndarray:
    return (held[bit >> 3] >> (7 - (bit & 7)).astype(np.uint8) & 1).astype(bool)


def text_bytes(df: DataFrame, text: str = "text") -> int:
    """Catalyst's estimate of df's size (for parquet the files' size); where it has none, the texts' bytes, counted."""
    known = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return known if known < 1 << 60 else df.agg(F.sum(F.octet_length(text))).first()[0] or 0


def partitions_for(df: DataFrame, bytes_each: int) -> int:
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(least, math.ceil(text_bytes(df) / bytes_each))


GIVE_BACK = 0.5
_given = float("-inf")
#: Of glibc; other C libraries have none.
_TRIM = getattr(ctypes.CDLL(None), "malloc_trim", None)
#: Tables that operators keep in a Python worker from task to task.
KEPT: list[dict] = []


def give_back(seconds: float = GIVE_BACK) -> None:
    """Returns what this worker has freed to the system, which malloc and Arrow don't by themselves; not if it was done less than so many seconds ago."""
    global _given
    if time.monotonic() >= _given + seconds:
        pa.default_memory_pool().release_unused()
        if _TRIM is not None:
            _TRIM(0)
        _given = time.monotonic()


def spare_memory() -> None:
    """Empties what other operators have kept in this worker: workers are used again, and their memory adds up."""
    for kept in KEPT:
        kept.clear()
    give_back()


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts in one array and the bounds of each; null counts as empty. Nothing is copied."""
    spare_memory()
    offsets = np.frombuffer(column.buffers()[1], np.int64 if pa.types.is_large_string(column.type) else np.int32)
    offsets = offsets[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = column.buffers()[2]
    data = np.zeros(0, np.uint8) if data is None else np.frombuffer(data, np.uint8)
    if len(offsets) == 0:
        offsets = np.zeros(1, np.int64)
    return data, offsets


def texts_of(column: pa.Array) -> list[str]:
    return [t or "" for t in column.to_pylist()]


Batches = Iterator[pa.RecordBatch]
