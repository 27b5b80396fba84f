"""Counters, gauges, histograms, summaries and their text exposition."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hostloom.functions.text import metric_name
from hostloom.operators.scan import RUN, across, cut, inside, stored, summed, upto


def counter(deltas: DataFrame, labels: Sequence[str], delta: str = "delta") -> DataFrame:
    """Total per label tuple. Negative deltas are invalid and left out."""
    return deltas.filter(F.col(delta) >= 0).groupBy(*labels).agg(F.sum(delta).alias("value"))


def counter_rejects(deltas: DataFrame, delta: str = "delta") -> DataFrame:
    """The deltas ``counter`` leaves out."""
    return deltas.filter(~(F.coalesce(F.col(delta) >= 0, F.lit(False))))


def gauge(ops: DataFrame, series: Sequence[str] = ("series",), order: Sequence[str] = ("seq",),
          runs: int | None = None) -> DataFrame:
    """Value per series after ``set``, ``inc``, ``dec`` and ``add`` in ``order``.

    A run of operations is a function of the value before it: it is set to something or
    not, and then changed by an amount. Runs are folded each on their own, and the
    results of a series in their order: what comes before the last set does not count.
    """
    series, order = list(series), list(order)
    is_set = F.col("op") == "set"
    change = (
        F.when(F.col("op") == "inc", F.lit(1.0))
        .when(F.col("op") == "dec", F.lit(-1.0))
        .when(F.col("op") == "add", F.col("value"))
    )
    parts = cut(ops.select(*series, *order, is_set.alias("_set"), F.when(is_set, F.col("value")).otherwise(change).alias(
        "_amount")), series, order, runs)
    sets = F.count_if("_set")
    parts = parts.withColumn("_sets", sets.over(upto(inside(series, order)))).withColumn(
        "_all", sets.over(Window.partitionBy(*series, RUN)))
    # only the last set of a run and what follows it can count
    folded = parts.filter(F.col("_sets") == F.col("_all")).groupBy(*series, RUN).agg(
        F.max(F.col("_set").cast("int")).alias("_set"), F.sum("_amount").alias("_amount"))
    later = across(series).rowsBetween(1, Window.unboundedFollowing)
    standing = folded.withColumn("_later", F.coalesce(F.max("_set").over(later), F.lit(0))).filter("_later = 0")
    return standing.groupBy(*series).agg(F.sum("_amount").alias("value"))


def histogram(observations: DataFrame, labels: Sequence[str], value: str,
              bounds: Sequence[float]) -> DataFrame:
    """Cumulative bucket counts per label tuple and upper bound ``le`` (inclusive), with ``+Inf``.

    ``observed_sum`` and ``observed_count`` are repeated on each bucket row.
    One pass; the rows of a label tuple meet only as partial counts.
    """
    bounds = sorted(bounds)
    counts = observations.groupBy(*labels).agg(
        *[F.count_if(F.col(value) <= F.lit(float(b))).alias(f"_b{i}") for i, b in enumerate(bounds)],
        F.count(value).alias("observed_count"), F.sum(value).alias("observed_sum"))
    names = [F.lit(format_bound(b)) for b in bounds] + [F.lit("+Inf")]
    cells = [F.col(f"_b{i}") for i in range(len(bounds))] + [F.col("observed_count")]
    bucket = F.array(*[F.struct(n.alias("le"), c.alias("bucket_count")) for n, c in zip(names, cells)])
    return counts.select(*labels, F.inline(bucket), "observed_count", "observed_sum")


def format_bound(bound: float) -> str:
    return str(int(bound)) if float(bound).is_integer() else repr(float(bound))


def summary(observations: DataFrame, labels: Sequence[str], value: str,
            quantiles: Sequence[float], runs: int | None = None) -> DataFrame:
    """Exact quantiles per label tuple: the value at rank ``ceil(q·n)``, with sum and count.

    Equal values are counted first. Distinct values are cut into runs, whose totals give
    the rank of each value; no task orders a whole label tuple. The counted values are
    written once, so this runs a job when called.
    """
    labels = list(labels)
    distinct = observations.filter(F.col(value).isNotNull()).groupBy(*labels, value).agg(F.count(F.lit(1)).alias("_n"))
    parts = stored(distinct, labels, [value], runs)
    ranked = summed(parts, labels, [value], "_n", "_upto")
    totals = parts.groupBy(*labels).agg(
        F.sum("_n").alias("observed_count"), F.sum(F.col(value) * F.col("_n")).alias("observed_sum"))
    same = [F.col(f"r.{c}").eqNullSafe(F.col(f"t.{c}")) for c in labels]
    both = ranked.alias("r").join(totals.alias("t"), same)
    at = F.explode(F.array(*[F.lit(Decimal(str(x))) for x in sorted(quantiles)]))
    rank = _rank(F.col("quantile"), F.col("observed_count"))
    hit = both.select("r.*", "observed_count", "observed_sum", at.alias("quantile")).filter(
        rank.between(F.col("_upto") - F.col("_n") + 1, F.col("_upto")))
    return hit.select(*labels, F.col("quantile").cast("double").alias("quantile"), F.col(value).alias("value"),
                      "observed_count", "observed_sum")


def _rank(quantile: Column, count: Column) -> Column:
    return F.greatest(F.ceil(quantile * count).cast("bigint"), F.lit(1))


def summary_approx(observations: DataFrame, labels: Sequence[str], value: str,
                   objectives: Mapping[float, float]) -> DataFrame:
    """Quantiles within a tolerance each (``{0.99: 0.001}``), from mergeable sketches in one pass."""
    ordered = sorted(objectives.items())
    wide = observations.groupBy(*labels).agg(
        *[F.percentile_approx(value, q, -int(-2 // tol)).alias(f"_q{i}")
          for i, (q, tol) in enumerate(ordered)],
        F.count(value).alias("observed_count"), F.sum(value).alias("observed_sum"))
    cells = F.array(*[F.struct(F.lit(float(q)).alias("quantile"), F.col(f"_q{i}").alias("value"))
                      for i, (q, _) in enumerate(ordered)])
    return wide.select(*labels, F.inline(cells), "observed_count", "observed_sum")


def rank_error(observations: DataFrame, answers: DataFrame, labels: Sequence[str], value: str) -> DataFrame:
    """Add to rows of ``summary_approx`` how far each answer is from its rank, as a share of the observations."""
    labels = list(labels)
    counted = observations.join(answers.select(*labels, "quantile", F.col("value").alias("_answer")), labels)
    places = counted.groupBy(*labels, "quantile").agg(
        F.count_if(F.col(value) < F.col("_answer")).alias("_below"),
        F.count_if(F.col(value) <= F.col("_answer")).alias("_upto"))
    rank = F.ceil(F.col("quantile") * F.col("observed_count"))
    away = F.greatest(F.col("_below") + 1 - rank, rank - F.col("_upto"), F.lit(0))
    return answers.join(places, [*labels, "quantile"]).withColumn(
        "rank_error", away / F.col("observed_count")).drop("_below", "_upto")


def zero_fill(declared: DataFrame, observed: DataFrame, labels: Sequence[str],
              value: str = "value") -> DataFrame:
    """Observed series plus declared label tuples, which show 0 before any update.

    Both sides have one row per label tuple: adding zeros is enough, no join.
    """
    zeros = declared.select(*labels, F.lit(0).cast(observed.schema[value].dataType).alias(value))
    return observed.select(*labels, value).unionByName(zeros).groupBy(*labels).agg(
        F.sum(value).alias(value))


# --- samples and exposition ------------------------------------------------


def as_samples(series: DataFrame, subsystem: str, name: str, labels: Sequence[str],
               value: str = "value") -> DataFrame:
    """Series rows in the common ``metric, labels, value`` shape."""
    pairs = [x for c in labels for x in (F.lit(c), F.col(c).cast("string"))]
    return series.select(
        metric_name(F.lit(subsystem), F.lit(name)).alias("metric"),
        (F.create_map(*pairs) if pairs else F.create_map().cast("map<string,string>")).alias("labels"),
        F.col(value).cast("double").alias("value"))


def format_value(value: Column) -> Column:
    """A whole number without a fraction, anything else as a double."""
    whole = (value == F.floor(value)) & (F.abs(value) < F.lit(float(2 ** 53)))
    return (
        F.when(F.isnan(value), F.lit("NaN"))
        .when(value == float("inf"), F.lit("+Inf"))
        .when(value == float("-inf"), F.lit("-Inf"))
        .when(whole, value.try_cast("bigint").cast("string"))
        .otherwise(value.cast("string"))
    )


def _escaped(text: Column) -> Column:
    text = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    text = F.replace(text, F.lit("\n"), F.lit("\\n"))
    return F.replace(text, F.lit('"'), F.lit('\\"'))


def _line(samples: DataFrame) -> Column:
    pairs = F.array_join(F.transform(
        F.array_sort(F.map_entries("labels")),
        lambda e: F.concat(e["key"], F.lit('="'), _escaped(e["value"]), F.lit('"'))), ",")
    labelled = F.when(F.size("labels") > 0, F.concat(F.lit("{"), pairs, F.lit("}"))).otherwise(F.lit(""))
    return F.concat(F.col("metric"), labelled, F.lit(" "), format_value(F.col("value")))


def _family(subsystem: str, name: str) -> Column:
    return metric_name(F.lit(subsystem), F.lit(name))


def histogram_samples(buckets: DataFrame, subsystem: str, name: str, labels: Sequence[str]) -> DataFrame:
    """Rows of ``histogram`` as samples: ``_bucket`` with ``le``, ``_sum`` and ``_count``."""
    cells = as_samples(buckets, subsystem, f"{name}_bucket", [*labels, "le"], "bucket_count")
    return cells.unionByName(_totals(buckets.filter("le = '+Inf'"), subsystem, name, labels))


def summary_samples(quantiles: DataFrame, subsystem: str, name: str, labels: Sequence[str]) -> DataFrame:
    """Rows of ``summary`` as samples: one per ``quantile``, ``_sum`` and ``_count``."""
    shown = quantiles.withColumn("quantile", format_value(F.col("quantile")))
    one = quantiles.groupBy(*labels).agg(F.max("observed_sum").alias("observed_sum"),
                                         F.max("observed_count").alias("observed_count"))
    return as_samples(shown, subsystem, name, [*labels, "quantile"]).unionByName(
        _totals(one, subsystem, name, labels))


def _totals(rows: DataFrame, subsystem: str, name: str, labels: Sequence[str]) -> DataFrame:
    return as_samples(rows, subsystem, f"{name}_sum", labels, "observed_sum").unionByName(
        as_samples(rows, subsystem, f"{name}_count", labels, "observed_count"))


@dataclass(frozen=True)
class Metric:
    """A metric of table rows: ``labels`` and the ``value`` column it takes.

    With ``bounds`` it is a histogram, with ``quantiles`` a summary, else a counter.
    """

    name: str
    labels: tuple[str, ...]
    value: str
    bounds: tuple[float, ...] = ()
    quantiles: tuple[float, ...] = ()

    def contribution(self, number: int) -> Column:
        """What one row adds: an amount, in a cell of the metric's number and labels."""
        v = F.col(self.value).cast("double")
        cell = F.lit(0.0)
        if self.bounds:
            cell = F.coalesce(*[F.when(v <= b, F.lit(float(b))) for b in sorted(self.bounds)], F.lit(float("inf")))
        elif self.quantiles:
            cell = v
        counted = v.isNotNull() if self.bounds or self.quantiles else v >= 0
        labels = F.array(*[F.col(c).cast("string") for c in self.labels]).cast("array<string>")
        return F.when(counted, F.struct(F.lit(number).alias("number"), labels.alias("tuple"), cell.alias("cell"), v.alias("amount")))

    def _sample(self, suffix: str, value: Column, extra: Mapping[str, str] = {}) -> Column:
        names = F.array(*[F.lit(c) for c in (*self.labels, *extra)]).cast("array<string>")
        texts = F.concat(F.col("tuple"), F.array(*[F.lit(t) for t in extra.values()]).cast("array<string>"))
        return F.struct(F.lit(self.name + suffix).alias("metric"), F.map_from_arrays(names, texts).alias("labels"),
                        value.cast("double").alias("value"))

    def samples(self, number: int) -> tuple[list[Column], Column]:
        """Aggregates over a series' cells, and the samples made of them."""
        total, amount = F.col("observed_count"), F.col("observed_sum")
        if not self.bounds and not self.quantiles:
            return [], F.array(self._sample("", amount))
        both = [self._sample("_sum", amount), self._sample("_count", total)]
        if self.bounds:
            names = [f"m{number}_b{i}" for i in range(len(self.bounds))]
            folds = [F.coalesce(F.max(F.when(F.col("cell") <= float(b), F.col("upto"))), F.lit(0)).alias(n)
                     for n, b in zip(names, sorted(self.bounds))]
            cells = [self._sample("_bucket", F.col(n), {"le": format_bound(b)}) for n, b in zip(names, sorted(self.bounds))]
            return folds, F.array(*cells, self._sample("_bucket", total, {"le": "+Inf"}), *both)
        names = [f"m{number}_q{i}" for i in range(len(self.quantiles))]
        folds = [F.min(F.when(F.col("upto") >= _rank(F.lit(Decimal(str(q))), total), F.col("cell"))).alias(n)
                 for n, q in zip(names, self.quantiles)]
        return folds, F.array(*[self._sample("", F.col(n), {"quantile": format_bound(q)})
                                for n, q in zip(names, self.quantiles)], *both)


def collected(rows: DataFrame, metrics: Sequence[Metric], runs: int | None = None) -> DataFrame:
    """Samples of several metrics of any kind from one pass over ``rows``.

    Each row is turned into what it adds to each metric, and one aggregate folds all of
    it by series and cell: a histogram's bucket, a summary's value. Cells of a series
    are then counted up in their order, cut into runs where they are many.
    """
    added = rows.select(F.explode(F.array(*[m.contribution(i) for i, m in enumerate(metrics)])).alias("c")).filter(
        F.col("c").isNotNull()).select("c.*")
    series = ["number", "tuple"]
    folded = added.groupBy(*series, "cell").agg(F.count(F.lit(1)).alias("n"), F.sum("amount").alias("amount"))
    cells = stored(folded, series, ["cell"], runs)
    totals = cells.groupBy(*series).agg(F.sum("n").alias("observed_count"), F.sum("amount").alias("observed_sum"))
    ranked = summed(cells.drop("amount"), series, ["cell"], "n", "upto")
    made = [m.samples(i) for i, m in enumerate(metrics)]
    known = ranked.join(totals, series)
    done = known.groupBy(*series, "observed_count", "observed_sum").agg(
        F.count(F.lit(1)).alias("cells"), *[f for folds, _ in made for f in folds])
    shown = F.coalesce(*[F.when(F.col("number") == i, out) for i, (_, out) in enumerate(made)])
    return done.select(F.inline(shown))


def exposition(samples: DataFrame, families: Mapping[str, tuple[str, str]] | None = None) -> DataFrame:
    """The text form: ``family, place, line``, to be written in this order.

    ``families`` gives the type and help text of each metric family; its
    ``# HELP`` and ``# TYPE`` lines stand before its series. The series of a
    histogram or summary belong to the family without their suffix.
    """
    families = dict(families or {})
    name = F.col("metric")
    for suffix in ("_bucket", "_sum", "_count"):
        base = F.regexp_replace("metric", f"{suffix}$", "")
        owned = [f for f, (kind, _) in families.items() if kind in ("histogram", "summary")]
        name = F.when(F.endswith("metric", F.lit(suffix)) & base.isin(owned), base).otherwise(name)
    lines = samples.select(name.alias("family"), F.lit(2).alias("place"), _line(samples).alias("line"))
    heads = [row for f, (kind, text) in families.items()
             for row in ((f, 0, f"# HELP {f} " + text.replace("\\", "\\\\").replace("\n", "\\n")),
                         (f, 1, f"# TYPE {f} {kind}"))]
    if not heads:
        return lines
    return samples.sparkSession.createDataFrame(heads, "family string, place int, line string").unionByName(lines)


# Metrics the services declare, and the label tuples that show 0 from the start.
RECORDS_WRITTEN = "databus_records_written_total"
BYTES_WRITTEN = "databus_bytes_written_total"
CONNECTIONS_ACTIVE = "databus_connections_active"
REQUESTS = "controller_requests_total"
AGENTS_ACTIVE = "controller_agent_connections_active"
ADMIN_INFO_VERSION = "v1"
DECLARED = {
    RECORDS_WRITTEN: {"sink_type": "kafka", "status": "success"},
    BYTES_WRITTEN: {"sink_type": "kafka"},
    CONNECTIONS_ACTIVE: {"state": "connected"},
    REQUESTS: {"method": "GET", "status": "200"},
    AGENTS_ACTIVE: {"state": "connected"},
}


def _with_declared(series: DataFrame, metrics: Sequence[str]) -> DataFrame:
    """Series rows ``metric, <labels>, value`` as samples, declared tuples added.

    A label that is NULL does not belong to its metric.
    """
    labels = [c for c in series.columns if c not in ("metric", "value")]
    zeros = [(m, *[DECLARED[m].get(c) for c in labels]) for m in metrics]
    declared = series.sparkSession.createDataFrame(
        zeros, "metric string, " + ", ".join(f"{c} string" for c in labels))
    filled = zero_fill(declared, series, ["metric", *labels])
    pairs = F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).alias("text")) for c in labels])
    present = F.map_from_entries(F.filter(pairs, lambda p: p["text"].isNotNull()))
    return filled.select("metric", present.alias("labels"), "value")


def admin_info(spark) -> DataFrame:
    row = spark.range(1).select(F.lit(ADMIN_INFO_VERSION).alias("version"), F.lit(1.0).alias("value"))
    return as_samples(row, "admin", "info", ["version"])


def _active(metric: str, rows: DataFrame) -> DataFrame:
    """Number of rows as a gauge with state ``connected``."""
    return rows.groupBy(F.lit(metric).alias("metric"), F.lit("connected").alias("state")).agg(
        F.count(F.lit(1)).cast("double").alias("value"))


def databus_metrics(deliveries: DataFrame, active: DataFrame) -> DataFrame:
    """Ingest metrics from delivery rows ``(sink_type, status, rows, bytes)`` and open connections.

    ``active`` has one row per open connection. The delivery rows are read once.
    """
    totals = deliveries.groupBy("sink_type", "status").agg(
        F.sum("rows").cast("double").alias("rows"), F.sum("bytes").cast("double").alias("bytes"))
    written = F.when(F.col("status") == "success", F.col("bytes"))
    series = totals.select(F.inline(F.array(
        F.struct(F.lit(RECORDS_WRITTEN).alias("metric"), "sink_type", "status", F.col("rows").alias("value")),
        F.struct(F.lit(BYTES_WRITTEN).alias("metric"), "sink_type",
                 F.lit(None).cast("string").alias("status"), written.alias("value")),
    ))).filter(F.col("value").isNotNull())
    return _with_declared(series, [RECORDS_WRITTEN, BYTES_WRITTEN]).unionByName(
        _with_declared(_active(CONNECTIONS_ACTIVE, active), [CONNECTIONS_ACTIVE]))


def controller_metrics(requests: DataFrame, active: DataFrame) -> DataFrame:
    """Control-plane metrics from access-log rows ``(method, status)`` and open sessions."""
    total = requests.groupBy(
        F.lit(REQUESTS).alias("metric"), "method", F.col("status").cast("string").alias("status")
    ).agg(F.count(F.lit(1)).cast("double").alias("value"))
    return _with_declared(total, [REQUESTS]).unionByName(
        _with_declared(_active(AGENTS_ACTIVE, active), [AGENTS_ACTIVE]))
