"""Reports over operation and delivery logs, and id assignment."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hostloom.functions.duration import epoch_micros
from hostloom.functions.ids import MAX_SEQUENCE, encode_id
from hostloom.functions.order import place_of
from hostloom.operators.scan import RUN, across, cut, earlier, inside, stored, upto, with_outside


def throughput(operations: DataFrame, by: Sequence[str], failed: Column, ts: str = "ts") -> DataFrame:
    """Operations, errors and operations per second for each group.

    Only successful operations count as ``ops``; the time runs from the first
    to the last row of the group.
    """
    micros = epoch_micros(F.col(ts))
    seconds = (F.max(micros) - F.min(micros)) / F.lit(1_000_000.0)
    ops = F.count_if(~failed)
    return operations.groupBy(*by).agg(
        ops.alias("ops"), F.count_if(failed).alias("errors"),
        F.try_divide(ops.cast("double"), seconds).alias("ops_per_second"))


def delivery(sent: DataFrame, by: Sequence[str], watcher: str, received: Column) -> DataFrame:
    """Received events per watcher (average, least, most) and the loss rate in percent.

    ``sent`` has one row per event and watcher it was meant for.
    """
    per_watcher = sent.groupBy(*by, watcher).agg(
        F.count(F.lit(1)).alias("_sent"), F.count_if(received).alias("_received"))
    total = F.sum("_sent")
    return per_watcher.groupBy(*by).agg(
        F.count(F.lit(1)).alias("watchers"),
        F.avg("_received").alias("avg_received"),
        F.min("_received").alias("min_received"),
        F.max("_received").alias("max_received"),
        ((total - F.sum("_received")) * 100.0 / total).alias("loss_percent"))


def out_of_order(events: DataFrame, key: str, order: Sequence[str], value: str, runs: int | None = None) -> DataFrame:
    """Per key, how many values are smaller than the one that arrived before.

    Each run counts its own; between two runs of a key only the last value of one and
    the first of the next are compared.
    """
    parts = cut(events.select(key, *order, value), [key], order, runs)
    at = place_of(parts, order)
    counted = parts.withColumn("_previous", F.lag(value).over(inside([key], order))).groupBy(key, RUN).agg(
        F.count(F.lit(1)).alias("_n"), F.count_if(F.col(value) < F.col("_previous")).alias("_falls"),
        F.min_by(value, at).alias("_first"), F.max_by(value, at).alias("_last"))
    falls = F.coalesce(F.col("_first") < F.lag("_last").over(across([key])), F.lit(False)).cast("bigint")
    return counted.withColumn("_falls", F.col("_falls") + falls).groupBy(key).agg(
        F.sum("_n").alias("total"), F.sum("_falls").alias("out_of_order"))


def assign_ids(rows: DataFrame, machine: str, unix_ms: str, order: Sequence[str], epoch_ms: int,
               runs: int | None = None) -> DataFrame:
    """Give rows time-ordered ids: add ``id``, ``sequence`` and ``waited``.

    A millisecond starts at the low bits of its own offset and counts up to
    4095. Rows behind that wait for the next one, as does a row whose clock is
    behind an id already given; ``waited`` marks rows with a later time than their own.

    With slots counted through all milliseconds, a row's slot is the greater of
    the one after the row before and the first of its own millisecond, which is
    its row number plus a running maximum. A run hands on how many rows it has and
    how far its slots are ahead of its own row numbers.
    """
    keys = [machine]
    parts = stored(rows, keys, order, runs)
    offset_ms = F.col(unix_ms) - F.lit(epoch_ms)
    first = offset_ms * (MAX_SEQUENCE + 1) + offset_ms.bitwiseAND(F.lit(MAX_SEQUENCE))
    here = parts.withColumn("_n", F.row_number().over(inside(keys, order)).cast("bigint"))
    here = here.withColumn("_ahead", F.max(first - F.col("_n")).over(upto(inside(keys, order))))
    ends = here.groupBy(*keys, RUN).agg(F.max("_n").alias("_rows"), F.max("_ahead").alias("_ahead"))
    ends = ends.withColumn("_before", F.coalesce(F.sum("_rows").over(earlier(across(keys))), F.lit(0)))
    outside = ends.select(
        *keys, RUN, "_before", F.max(F.col("_ahead") - F.col("_before")).over(earlier(across(keys))).alias("_earlier"))
    placed = with_outside(here, outside, keys)
    slot = F.greatest(F.col("_ahead") - F.col("_before"), F.col("_earlier")) + F.col("_before") + F.col("_n")
    at_ms = F.floor(slot / F.lit(MAX_SEQUENCE + 1)).cast("bigint") + F.lit(epoch_ms)
    sequence = F.pmod(slot, F.lit(MAX_SEQUENCE + 1))
    return placed.select(
        *rows.columns, sequence.alias("sequence"), (at_ms > F.col(unix_ms)).alias("waited"),
        encode_id(at_ms, F.col(machine), sequence, epoch_ms).alias("id"))
