"""Token ids in binary files: independent zstandard frames, a trailing seek table, a checksum for each frame.

A file holds documents in ascending doc_id order and is itself a valid zstandard stream:

    frame, gap, frame, gap, ..., seek table (in a skippable frame), gap

* A frame holds the ids (little-endian unsigned 32-bit) of consecutive documents, about FRAME_IDS of them; it is
  compressed on its own with zstandard's content checksum.
* A gap is an empty skippable frame of 8 bytes. Spark's text sink writes it as the line separator, which lets the sink's
  commit protocol (and so recovery from lost executors) apply to binary files on any Hadoop file system.
* The seek table lists frames (place, compressed size, ids, crc32 of the compressed bytes), then documents (doc_id, whether
  it is null, frame, first id in that frame, ids), then a fixed footer: frames, documents, all ids, crc32 of the table, magic.

A reader needs the table and then only the frames of the documents it wants. The order across files is their part number.

Nulls, empties, ties: a null text is empty; an empty text still has its end id. Null doc_ids come first. Repeated doc_ids
stay next to each other, in the order of a hash of their texts, by which a doc_id of very many rows is dealt to several files. An empty table gives no document. Other columns are ignored.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Batches, partitions_for, prepare, spare_memory
from .tokens import encoder

#: Fixed values of the format.
SKIPPABLE = 0x184D2A5E
GAP = struct.pack("<II", 0x184D2A50, 0)
FOOTER = struct.Struct("<IQQI4s")
MAGIC = b"TMT1"
FRAME_IDS = 1 << 16
FRAMES = np.dtype([("at", "<u8"), ("size", "<u8"), ("ids", "<u8"), ("crc", "<u4")])
DOCS = np.dtype([("doc_id", "<i8"), ("null", "u1"), ("frame", "<u4"), ("first", "<u8"), ("ids", "<u8")])
#: Input bytes for each file, so that a file fits in a task many times over.
FILE_BYTES = 16 << 20
#: Texts encoded together.
BATCH_BYTES = 4 << 20
#: Files whose ids are summed in one task.
RUN = 4096
#: Files whose first ids are broadcast (16 bytes each); more are joined by a shuffle.
MOST_BROADCAST = 1_000_000


class Frames:
    """Collects the documents of one file; yields each frame's bytes when it is full, and the table at the end."""

    def __init__(self):
        import zstandard

        self.compressor = zstandard.ZstdCompressor(level=3, write_checksum=True)
        self.frames, self.docs, self.pending, self.ids, self.at, self.total = [], [], [], 0, 0, 0

    def add(self, doc_id: int | None, ids: bytes) -> bytes | None:
        n = len(ids) // 4
        self.docs.append((doc_id or 0, doc_id is None, len(self.frames), self.ids, n))
        self.pending.append(ids)
        self.ids += n
        return self.flush() if self.ids >= FRAME_IDS else None

    def flush(self) -> bytes:
        frame = self.compressor.compress(b"".join(self.pending))
        self.frames.append((self.at, len(frame), self.ids, zlib.crc32(frame)))
        self.at += len(frame) + len(GAP)
        self.total += self.ids
        self.pending, self.ids = [], 0
        return frame

    def table(self) -> bytes:
        body = np.array(self.frames, FRAMES).tobytes() + np.array(self.docs, DOCS).tobytes()
        body += FOOTER.pack(len(self.frames), len(self.docs), self.total, zlib.crc32(body), MAGIC)
        return struct.pack("<II", SKIPPABLE, len(body)) + body


def seek_table(content: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Frames and documents of a file; raises ValueError if the table is damaged."""
    end = len(content) - len(GAP)
    if end < FOOTER.size or content[end:] != GAP:
        raise ValueError("not a token file, or cut short")
    frames, docs, _, crc, magic = FOOTER.unpack(content[end - FOOTER.size : end])
    begin = end - FOOTER.size - frames * FRAMES.itemsize - docs * DOCS.itemsize
    body = content[max(0, begin) : end - FOOTER.size]
    if magic != MAGIC or begin < 0 or zlib.crc32(body) != crc:
        raise ValueError("the seek table is damaged")
    cut = frames * FRAMES.itemsize
    return np.frombuffer(body[:cut], FRAMES), np.frombuffer(body[cut:], DOCS)


def frame_ids(content: bytes, frame: np.void) -> bytes:
    """The ids of one frame; raises ValueError if it doesn't match its checksum."""
    import zstandard

    at, size = int(frame["at"]), int(frame["size"])
    raw = content[at : at + size]
    if zlib.crc32(raw) != int(frame["crc"]):
        raise ValueError("a frame is damaged")
    return zstandard.ZstdDecompressor().decompress(raw, max_output_size=4 * int(frame["ids"]))


def together(batches: Batches) -> Batches:
    """Small batches joined up to BATCH_BYTES, as their texts share parts."""
    held, size = [], 0
    for batch in batches:
        if held and size + batch.nbytes > BATCH_BYTES:
            yield pa.concat_batches(held)
            held, size = [], 0
        held.append(batch)
        size += batch.nbytes
    if held:
        yield pa.concat_batches(held)


def write_token_files(docs: DataFrame, path: str, tokenizer: str, style: str = "byte", end_id: int = 0) -> None:
    """Encode docs (doc_id, text), append end_id to each, and write them below path in ascending doc_id order."""
    prepare(docs.sparkSession)

    def frames(batches: Batches) -> Batches:
        out, end = Frames(), np.array([end_id], "<u4").tobytes()
        for batch in together(batches):
            ids = encoder(tokenizer, style).encode_column(batch.column(1))
            full = [f for d, x in zip(batch.column(0).to_pylist(), ids, strict=True) if (f := out.add(d, x + end))]
            if full:
                yield pa.record_batch([pa.array(full, pa.binary())], ["frame"])
        if out.docs:
            rest = [out.flush()] if out.ids else []
            yield pa.record_batch([pa.array([*rest, out.table()], pa.binary())], ["frame"])

    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text")]
    docs = docs.repartitionByRange(partitions_for(docs, FILE_BYTES), *order).sortWithinPartitions(*order)
    rows = docs.mapInArrow(frames, "frame binary").select(F.col("frame").cast("string").alias("value"))
    rows.write.option("lineSep", GAP.decode("ascii")).option("compression", "none").text(path)


def read_token_files(spark: SparkSession, path: str, doc_ids: list[int] | None = None) -> DataFrame:
    """Rows (doc_id, start, n_tokens, ids binary) of all documents, or of doc_ids: then only their frames are decompressed.

    start counts the ids of all documents before this one. Damaged files raise.
    """
    prepare(spark)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).where("length > 0")
    part = F.regexp_extract("path", r"part-(\d+)", 1).cast("long").alias("part")
    wanted = None if doc_ids is None else np.unique(np.array(doc_ids, np.int64))

    def documents(batches: Batches) -> Batches:
        spare_memory()
        for batch in batches:
            for number, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                content = content.as_py()
                frames, docs = seek_table(content)
                before = np.cumsum(docs["ids"]) - docs["ids"]
                keep = np.arange(len(docs)) if wanted is None else np.flatnonzero(np.isin(docs["doc_id"], wanted) & (docs["null"] == 0))
                for k in np.unique(docs["frame"][keep]).tolist():
                    raw, of = frame_ids(content, frames[k]), keep[docs["frame"][keep] == k]
                    ids = [raw[4 * a : 4 * (a + n)] for a, n in zip(docs["first"][of].tolist(), docs["ids"][of].tolist(), strict=True)]
                    yield pa.record_batch(
                        [
                            pa.array(np.full(len(of), number, np.int64)),
                            pa.array(docs["doc_id"][of], pa.int64(), mask=docs["null"][of] == 1),
                            pa.array(before[of].astype(np.int64)),
                            pa.array(docs["ids"][of].astype(np.int64)),
                            pa.array(ids, pa.binary()),
                        ],
                        ["part", "doc_id", "before", "n_tokens", "ids"],
                    )

    # all ids of a file stand at a fixed place of its footer, as 8 little-endian bytes: hex digits, reversed pair by pair
    place = len(GAP) + FOOTER.size - 12
    backwards = F.reverse(F.hex(F.expr(f"substring(content, cast(length as int) - {place - 1}, 8)")))
    pairs = F.regexp_replace(backwards, "(.)(.)", "$2$1")
    totals = files.select(part, F.conv(pairs, 16, 10).cast("long").alias("total"))
    # sums over the files before each: within runs of RUN files, and over the runs
    runs = totals.withColumn("run", F.floor(F.col("part") / RUN))
    before = runs.groupBy("run").agg(F.sum("total").alias("of_run"))
    before = before.select("run", (F.sum("of_run").over(Window.orderBy("run")) - F.col("of_run")).alias("base"))
    within = F.sum("total").over(Window.partitionBy("run").orderBy("part")) - F.col("total")
    bases = runs.withColumn("within", within).join(before, "run").select("part", (F.col("base") + F.col("within")).alias("base"))
    if files.count() <= MOST_BROADCAST:
        bases = F.broadcast(bases)
    rows = files.select(part, "content").mapInArrow(documents, "part long, doc_id long, before long, n_tokens long, ids binary")
    return rows.join(bases, "part").select("doc_id", (F.col("base") + F.col("before")).alias("start"), "n_tokens", "ids")
