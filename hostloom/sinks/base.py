"""What a sink is, and how one batch reaches several of them."""

from __future__ import annotations

import logging
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from hostloom.operators.ingest import classified, payload_bytes
from hostloom.schemas import OUTCOME
from hostloom.session import scratch, scratch_dir

log = logging.getLogger(__name__)


@dataclass(frozen=True)
class Sink:
    """``wants`` tells a sink's rows among judged envelopes, ``put`` writes them.

    Judged envelopes are envelopes with ``reason``. ``put`` gets the rows and
    the name of the batch. It may read the rows more than once and must be safe
    to repeat for the same batch.
    """

    type: str
    wants: Column
    put: Callable[[DataFrame, str], None]


def judged(envelopes: DataFrame) -> DataFrame:
    return classified(envelopes).drop("doc")


class FanOutError(RuntimeError):
    """At least one sink failed and the caller asked to be told."""


def _volumes(sinks: Sequence[Sink]) -> list[Column]:
    """Rows and bytes each sink wants, as aggregates over the judged rows."""
    size = payload_bytes().cast("bigint")
    return [c for i, sink in enumerate(sinks) for c in (
        F.count_if(F.coalesce(sink.wants, F.lit(False))).alias(f"rows{i}"),
        F.coalesce(F.sum(F.when(sink.wants, size)), F.lit(0)).alias(f"bytes{i}"))]


def staged(rows: DataFrame, counts: Sequence[Column]) -> tuple[DataFrame, dict]:
    """Judge a batch once: write it by reason and count it on the way.

    A sink that wants some reasons only reads their files alone.
    """
    seen = Observation()
    path = scratch_dir(rows.sparkSession, "batch")
    schema = rows.schema
    rows.observe(seen, *counts).write.partitionBy("reason").parquet(path)
    return rows.sparkSession.read.schema(schema).parquet(path), seen.get


# the outcome row of the batch itself
RECEIVED = "received"


def fan_out(envelopes: DataFrame, sinks: Sequence[Sink], batch: str = "0",
            on_error: str = "continue", received: bool = False) -> DataFrame:
    """Give every row to every sink in order; return one outcome row per sink.

    With ``received`` a first row tells how many rows and bytes the batch had.

    The batch is judged, written and counted once; sinks read what was written, so
    neither their number nor a failing one costs another pass over the source. A
    failing sink does not stop the others. With ``on_error="continue"`` the call
    succeeds all the same; with ``"fail"`` it raises once all sinks have been tried,
    so that a stream replays the batch. The written batch goes when all sinks are done.
    """
    spark = envelopes.sparkSession
    rows = judged(envelopes)
    if not sinks and not received:
        write_noop(rows)
        return spark.createDataFrame([], OUTCOME)
    sinks = [Sink(RECEIVED, F.lit(True), lambda rows, batch: None)] * received + list(sinks)
    outcomes, errors = [], []
    with scratch(spark):
        rows, volumes = staged(rows, _volumes(sinks))
        for i, sink in enumerate(sinks):
            status, error = "success", None
            try:
                sink.put(rows.filter(sink.wants), batch)
            except Exception as exc:  # noqa: BLE001 - any failure of a sink is an outcome
                log.warning("sink %s failed on batch %s: %s", sink.type, batch, exc)
                status, error = "error", str(exc)
                errors.append(sink.type)
            outcomes.append((sink.type, status, int(volumes[f"rows{i}"]), int(volumes[f"bytes{i}"]), error))
    if errors and on_error == "fail":
        raise FanOutError(f"sinks failed: {', '.join(errors)}")
    return spark.createDataFrame(outcomes, OUTCOME)


def write_noop(rows: DataFrame) -> None:
    """No sink configured: receive the rows and drop them."""
    rows.write.format("noop").mode("overwrite").save()
