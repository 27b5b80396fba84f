"""Order-dependent operators as scans over runs.

A window over one key sorts all rows of that key in one task. Here one range shuffle
cuts the order (key, then the order columns) into runs of about equal size, wherever
keys begin and end. Each run is worked on alone; one summary row per key and run is
put in the order of the runs, and what it says about the rows outside is joined back.
So the largest task does not depend on how rows are spread over keys, and order
columns may be sparse: nothing but their order counts.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from hostloom.functions.order import place_of
from hostloom.session import settle

RUN = "_run"
# order of arrival
ARRIVAL = ("ts", "seq")


def cut(rows: DataFrame, keys: Sequence[str], order: Sequence[str], runs: int | None = None) -> DataFrame:
    """Add the number of the run a row is in; for plans that use it once.

    A second evaluation may cut elsewhere, so plans that meet the rows again start
    from ``stored``. ``runs`` defaults to the session's shuffle partitions.
    """
    by = [*keys, *order]
    ranged = rows.repartitionByRange(runs, *by) if runs else rows.repartitionByRange(*by)
    return ranged.withColumn(RUN, F.spark_partition_id())


def stored(rows: DataFrame, keys: Sequence[str], order: Sequence[str], runs: int | None = None) -> DataFrame:
    """Rows with their runs, written to the shared folder: evaluated once and safe from lost executors."""
    return settle(cut(rows, keys, order, runs), "runs")


def inside(keys: Sequence[str], order: Sequence[str]) -> WindowSpec:
    """The rows of a key within a run, in order."""
    return Window.partitionBy(*keys, RUN).orderBy(*order)


def across(keys: Sequence[str]) -> WindowSpec:
    """The summary rows of a key, in the order of their runs: as many as runs at most."""
    return Window.partitionBy(*keys).orderBy(RUN)


def upto(window: WindowSpec) -> WindowSpec:
    return window.rowsBetween(Window.unboundedPreceding, 0)


def earlier(window: WindowSpec) -> WindowSpec:
    return window.rowsBetween(Window.unboundedPreceding, -1)


def with_outside(rows: DataFrame, outside: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Join to each row of a run what is known about the rows outside of it."""
    same = [F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}")) for k in keys] + [F.col(f"l.{RUN}") == F.col(f"r.{RUN}")]
    new = [c for c in outside.columns if c not in (*keys, RUN)]
    return rows.alias("l").join(outside.alias("r"), same, "left").select("l.*", *[F.col(f"r.{c}") for c in new])


def summed(parts: DataFrame, keys: Sequence[str], order: Sequence[str], amount: str, out: str) -> DataFrame:
    """Add ``out`` to stored rows: the sum of column ``amount`` over rows of the same key up to and with this one."""
    totals = parts.groupBy(*keys, RUN).agg(F.sum(amount).alias("_total"))
    outside = totals.select(*keys, RUN, F.sum("_total").over(earlier(across(keys))).alias("_before"))
    here = parts.withColumn("_sum", F.sum(amount).over(upto(inside(keys, order))))
    return with_outside(here, outside, keys).select(
        *[c for c in parts.columns if c != RUN], (F.col("_sum") + F.coalesce("_before", F.lit(0))).alias(out))


def running_sum(rows: DataFrame, keys: Sequence[str], order: Sequence[str], amount: Column, out: str,
                runs: int | None = None) -> DataFrame:
    """Add ``out``: the sum of ``amount`` over rows of the same key up to and with this one."""
    parts = stored(rows.withColumn("_amount", amount), keys, order, runs)
    return summed(parts, keys, order, "_amount", out).drop("_amount")


def neighbour(rows: DataFrame, keys: Sequence[str], order: Sequence[str], columns: Mapping[str, str],
              following: bool = False, runs: int | None = None) -> DataFrame:
    """Add, for each ``out: source``, the value on the previous (or next) row of the key.

    Only the edge row of a run needs a value from outside: that of the nearest run of
    the same key. Columns of fixed width stay in a hash aggregate's buffer.
    """
    parts = stored(rows, keys, order, runs)
    edge_of, step = (F.min_by, F.lead) if following else (F.max_by, F.lag)
    at = place_of(parts, order)
    edges = parts.groupBy(*keys, RUN).agg(*[edge_of(F.col(src), at).alias(out) for out, src in columns.items()])
    outside = edges.select(*keys, RUN, step(F.struct(*columns)).over(across(keys)).alias("_outside"))
    value = F.struct(*[F.col(src).alias(out) for out, src in columns.items()])
    near = parts.withColumn("_inside", step(value).over(inside(keys, order)))
    picked = F.coalesce(F.col("_inside"), F.col("_outside"))
    return with_outside(near, outside, keys).select(*rows.columns, *[picked[out].alias(out) for out in columns])
