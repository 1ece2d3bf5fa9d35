"""Ingest of write requests as a stream.

Each micro-batch is checked against the stored newest time of its series and against the floor, in the order of its samples,
and becomes one block of the head. The store remembers the batches it has taken, so a batch that runs again after a failure
counts once.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..sources.requests import request_files
from ..sources.store import Store, Written


def request_stream(spark: SparkSession, path: str, files_per_batch: int = 1000) -> DataFrame:
    """A stream of requests: files below path with one JSON request a line, oldest first."""
    return spark.readStream.option("maxFilesPerTrigger", files_per_batch).text(path)


def start_ingest(requests: DataFrame, store: Store, checkpoint: str, on_batch: Callable[[int, Written], None] | None = None, available_now: bool = False, interval: str = "10 seconds") -> StreamingQuery:
    """Ingest a stream of requests (column value). available_now: stop when all that is there was taken."""

    def take(batch: DataFrame, number: int) -> None:
        written = store.ingest(request_files(batch), f"{checkpoint}#{number}")
        if written.accepted:
            store.flush()
        if on_batch:
            on_batch(number, written)

    writer = requests.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime=interval)).start()
