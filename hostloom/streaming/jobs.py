"""Structured Streaming jobs. Each takes a streaming DataFrame and starts a query."""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from hostloom.operators.ingest import accepted, drop_greetings, reduce_to_latest
from hostloom.operators.registry import watch
from hostloom.session import configured, scratch
from hostloom.sinks.base import Sink, fan_out
from hostloom.sinks.snapshots import SnapshotTable
from hostloom.streaming.leases import lease_events


def _batch_name(checkpoint: str, batch_id: int) -> str:
    """Name of a micro-batch. Batch ids start over with a new checkpoint, so it is part of the name."""
    return f"{hashlib.sha256(checkpoint.encode()).hexdigest()[:12]}-{batch_id:012d}"


def _start(writer, checkpoint: str, available_now: bool) -> StreamingQuery:
    writer = writer.option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def ingest(envelopes: DataFrame, sinks: Sequence[Sink], checkpoint: str,
           delivery_log: str | None = None, on_error: str = "continue",
           available_now: bool = False) -> StreamingQuery:
    """Envelopes to all sinks, at least once.

    ``delivery_log`` is a folder for the rows and bytes of each batch and the outcome of
    each sink. With
    ``on_error="fail"`` a failing sink fails the batch, which is then replayed.
    """
    def each(batch: DataFrame, batch_id: int) -> None:
        name = _batch_name(checkpoint, batch_id)
        outcomes = fan_out(batch, sinks, name, on_error, received=bool(delivery_log))
        if delivery_log:
            outcomes.coalesce(1).write.mode("overwrite").parquet(f"{delivery_log.rstrip('/')}/batch={name}")

    rows = drop_greetings(envelopes)
    return _start(rows.writeStream.foreachBatch(each), checkpoint, available_now)


def latest(envelopes: DataFrame, table: SnapshotTable, checkpoint: str,
           available_now: bool = False) -> StreamingQuery:
    """Latest snapshot per machine, continuously; the table is the state.

    A micro-batch is reduced to one row per machine before it meets the table, and only
    buckets of machines that reported are written.
    """
    def each(batch: DataFrame, batch_id: int) -> None:
        with scratch(batch.sparkSession):
            changed = reduce_to_latest(accepted(batch).drop("doc"), batch)
            table.upsert_reduced(changed, _batch_name(checkpoint, batch_id))

    return _start(envelopes.writeStream.foreachBatch(each), checkpoint, available_now)


def watch_events(changes: DataFrame, key: str, out: str, checkpoint: str, prefix: bool = False,
                 available_now: bool = False) -> StreamingQuery:
    """Put and delete events of a key or prefix, appended to Parquet files."""
    rows = watch(changes, key, prefix)
    return _start(rows.writeStream.format("parquet").option("path", out), checkpoint, available_now)


def lease_spans(changes: DataFrame, out: str, checkpoint: str, delay: str = "10 seconds",
                available_now: bool = False) -> StreamingQuery:
    """Lease spans as they end, appended to Parquet files.

    Timers need a state store with column families, which Spark's default one does not have.
    """
    rows = lease_events(changes, delay)
    with configured(changes.sparkSession, "spark.sql.streaming.stateStore.providerClass"):
        return _start(rows.writeStream.format("parquet").option("path", out), checkpoint, available_now)
