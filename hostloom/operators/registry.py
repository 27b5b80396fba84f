"""The service registry as a change log: current state, lookups, watches, leases."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hostloom.functions.endpoint import with_endpoint
from hostloom.functions.text import SELF_SEGMENT, WHITESPACE
from hostloom.functions.order import place_of
from hostloom.operators.scan import RUN, across, earlier, inside, stored, with_outside
from hostloom.sources.changes import DELETE, PUT

# Fixed value: the shortest lease, in seconds.
MIN_TTL_S = 6


class EmptyKey(ValueError):
    """A watch needs a key."""


def _trimmed(key: str) -> str:
    return key.strip(WHITESPACE)


def current(changes: DataFrame) -> DataFrame:
    """State after all changes: last put per key; a delete removes the key."""
    last = changes.filter(F.col("op").isin(PUT, DELETE)).groupBy("svc_key").agg(
        F.max(F.struct("rev", "op", "val", "ts", "ttl_s")).alias("_last"))
    return last.filter(F.col("_last.op") == PUT).select(
        "svc_key", "_last.rev", "_last.val", "_last.ts", "_last.ttl_s")


def get(changes: DataFrame, key: str) -> DataFrame:
    """Value of one key; no row when it does not exist. The filter reaches the scan."""
    return current(changes.filter(F.col("svc_key") == _trimmed(key))).select("svc_key", "val")


def get_many(changes: DataFrame, requests: DataFrame) -> DataFrame:
    """Answer lookups ``(request_id, svc_key)``: ``status`` is ``ok`` or ``not_found``."""
    asked = requests.withColumn("svc_key", F.btrim("svc_key", F.lit(WHITESPACE)))
    # one row per key on the right; Spark splits a hot key's requests by measured size
    found = asked.join(current(changes).select("svc_key", "val", F.lit(True).alias("_found")), "svc_key", "left")
    return found.select(
        *requests.columns, "val",
        F.when(F.col("_found"), F.lit("ok")).otherwise(F.lit("not_found")).alias("status"))


def get_prefix(changes: DataFrame, prefix: str) -> DataFrame:
    """Key/value pairs below a prefix. It is plain text and knows no path segments."""
    return current(changes.filter(F.startswith("svc_key", F.lit(_trimmed(prefix))))).select("svc_key", "val")


def watch(changes: DataFrame, key: str, prefix: bool = False, since_rev: int | None = None) -> DataFrame:
    """Put and delete events of a key or prefix; a batch reads those behind ``since_rev``.

    On a stream the rows come in arrival order; a batch consumer orders by ``rev``.
    """
    key = _trimmed(key)
    if not key:
        raise EmptyKey("a watch needs a key")
    name = F.col("svc_key")
    rows = changes.filter(F.startswith(name, F.lit(key)) if prefix else name == key)
    rows = rows.filter(F.col("op").isin(PUT, DELETE))
    if since_rev is not None:
        rows = rows.filter(F.col("rev") > since_rev)
    return rows.select("rev", F.col("op").alias("event"), "svc_key", "val")


def lease_end(ts: Column, ttl_s: Column) -> Column:
    """When a lease runs out; NULL without a lease."""
    seconds = F.greatest(ttl_s, F.lit(MIN_TTL_S)).cast("decimal(18,6)")
    return F.when(ttl_s.isNotNull(), ts + F.make_dt_interval(secs=seconds))


def live(changes: DataFrame, as_of: Column, keepalives: DataFrame | None = None) -> DataFrame:
    """Keys whose lease holds at ``as_of``, or that have none.

    Only changes and ``keepalives`` (``svc_key, ts``) up to ``as_of`` count; a
    keepalive extends a lease from its own time.
    """
    state = current(changes.filter(F.col("ts") <= as_of))
    if keepalives is not None:
        last = keepalives.filter(F.col("ts") <= as_of).groupBy("svc_key").agg(F.max("ts").alias("_kept"))
        state = state.join(last, "svc_key", "left").withColumn(
            "ts", F.greatest(F.col("ts"), F.col("_kept"))).drop("_kept")
    end = lease_end(F.col("ts"), F.col("ttl_s"))
    return state.withColumn("expires_at", end).filter(end.isNull() | (end >= as_of))


def services(changes: DataFrame, root: str, as_of: Column, keepalives: DataFrame | None = None) -> DataFrame:
    """Instances below ``root/self/`` alive at ``as_of``, with their id and listen endpoint."""
    below = f"{_trimmed(root)}/{SELF_SEGMENT}/"
    rows = live(changes.filter(F.startswith("svc_key", F.lit(below))), as_of, keepalives)
    return with_endpoint(rows, "val", "endpoint").select(
        F.substring(F.col("svc_key"), F.lit(len(below) + 1), F.length("svc_key")).alias("service_id"),
        "svc_key", "endpoint.protocol", "endpoint.host", "endpoint.port", "endpoint.reason")


def lease_spans(changes: DataFrame, runs: int | None = None) -> DataFrame:
    """Times in which a key was held by a lease: (svc_key, started_at, ended_at, ended_by, puts).

    Changes count in order of ``rev``, along which ``ts`` does not fall. A put
    with a lease holds its key until the lease ends or the key's next change
    comes, whichever is first, so a later put may also shorten the time. A put
    without a lease ends the span but not the key, a delete ends both. Holds
    that touch are one span. ``ended_by`` is ``revoked`` (a delete), ``kept``
    (a put without a lease) or ``expired``.

    One scan: a run hands on how many spans end in it before its last change and what
    that last change is; whether the last one ends a span depends on the next run.
    """
    keys, order = ["svc_key"], ["rev"]
    parts = stored(changes.filter(F.col("op").isin(PUT, DELETE)).select(
        "svc_key", "rev", "ts", (F.col("op") == DELETE).alias("_deletes"), "ttl_s"), keys, order, runs)
    change = ("ts", "_deletes", "ttl_s")
    here = parts.withColumn("_next", F.lead(F.struct(*change)).over(inside(keys, order)))
    ends = F.col("_next").isNotNull() & (_ended_by(F.col("_next")) != RENEWED)
    at = place_of(parts, order)
    edges = here.groupBy(*keys, RUN).agg(
        F.count_if(ends).alias("_inner"),
        *[pick(c, at).alias(f"{c}{name}") for name, pick in (("", F.max_by), ("_first", F.min_by)) for c in change])
    follower = F.lead(F.struct(*[F.col(f"{c}_first").alias(c) for c in change])).over(across(keys))
    edges = edges.withColumn("_follower", follower)
    total = F.col("_inner") + (_ended_by(F.col("_follower")) != RENEWED).cast("bigint")
    outside = edges.select(*keys, RUN, "_follower", F.coalesce(
        F.sum(total).over(earlier(across(keys))), F.lit(0)).alias("_earlier"))
    # a hold that is not renewed ends its span; the number of ends before a hold names the span
    counted = here.withColumn("_ended", F.count_if(ends).over(earlier(inside(keys, order))))
    rows = with_outside(counted, outside, keys).withColumn("_next", F.coalesce("_next", "_follower"))
    holds = rows.withColumn("_by", _ended_by(F.col("_next"))).filter(_holds())
    end = lease_end(F.col("ts"), F.col("ttl_s"))
    return holds.groupBy("svc_key", (F.col("_earlier") + F.coalesce("_ended", F.lit(0))).alias("_span")).agg(
        F.min("ts").alias("started_at"),
        F.max(F.when(F.col("_next.ts") <= end, F.col("_next.ts")).otherwise(end)).alias("ended_at"),
        F.max(F.when(F.col("_by") != RENEWED, F.col("_by"))).alias("ended_by"),
        F.count(F.lit(1)).alias("puts")).drop("_span")


# how a hold ends
EXPIRED, REVOKED, KEPT, RENEWED = "expired", "revoked", "kept", "renewed"


def _holds() -> Column:
    return ~F.col("_deletes") & F.col("ttl_s").isNotNull()


def _ended_by(change: Column) -> Column:
    """What ends the hold of a row, given the key's next change; ``renewed`` where it goes on or is none."""
    cut = change["ts"].isNotNull() & (change["ts"] <= lease_end(F.col("ts"), F.col("ttl_s")))
    return F.when(~_holds(), RENEWED).when(~cut, EXPIRED).when(change["_deletes"], REVOKED).when(
        change["ttl_s"].isNull(), KEPT).otherwise(RENEWED)
