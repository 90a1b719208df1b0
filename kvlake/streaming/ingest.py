"""Structured Streaming over the store: batches become log appends and runs; the latest view is a stateful aggregate."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from kvlake.operators import lww
from kvlake.plans.store import KVStore


def ingest_stream(stream: DataFrame, store: KVStore, checkpoint: str, order: str | None = None, flush: bool = True, **trigger) -> StreamingQuery:
    """Each micro-batch is applied once (by its id) and flushed as one run. `stream` has key, value, tombstone."""
    def land(batch: DataFrame, batch_id: int) -> None:
        if store.ingest(batch, checkpoint, batch_id, order) and flush:
            store.flush()

    return stream.writeStream.foreachBatch(land).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def latest_view(stream: DataFrame) -> DataFrame:
    """The latest version per key as a streaming aggregate, for update or complete mode. State holds every key; for
    unbounded key sets land runs with `ingest_stream` and read the snapshot instead."""
    return lww.latest(stream)
