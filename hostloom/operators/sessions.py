"""Connections and sessions from their event streams.

Event rows carry ``ts`` and ``seq``, whose order is that of arrival (``seq`` alone need
not rise with time), ``what`` (``open``, ``close`` or ``message``) and the connection
or client they belong to.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hostloom.functions.order import place_of
from hostloom.operators.scan import ARRIVAL, neighbour, running_sum, upto

OPEN, CLOSE = "open", "close"


def _edges(events: DataFrame) -> DataFrame:
    """Open and close events, with ``_opens`` in place of a text."""
    return events.filter(F.col("what").isin(OPEN, CLOSE)).withColumn("_opens", F.col("what") == OPEN)


def transitions(events: DataFrame, conn: str, runs: int | None = None) -> DataFrame:
    """Open and close events with ``delta``: +1, −1 or 0.

    Opening an open connection is refused and closing a closed one does
    nothing; both leave the table of connections as it is.
    """
    edges = neighbour(_edges(events), [conn], ARRIVAL, {"_before": "_opens"}, runs=runs)
    was_open, opens = F.coalesce("_before", F.lit(False)), F.col("_opens")
    delta = F.when(opens & ~was_open, 1).when(~opens & was_open, -1).otherwise(0)
    return edges.withColumn("delta", delta.cast("bigint")).drop("_before", "_opens")


def active_connections(events: DataFrame, conn: str, listener: str, runs: int | None = None) -> DataFrame:
    """Number of open connections of a listener after each open or close event."""
    return running_sum(transitions(events, conn, runs), [listener], ARRIVAL, F.col("delta"), "active", runs)


def active_curve(events: DataFrame, conn: str, listener: str, every: str = "hour",
                 runs: int | None = None) -> DataFrame:
    """Open connections of a listener at the end of each time bucket with a change.

    The running sum goes over buckets: a listener has as many rows as its time has buckets.
    """
    buckets = transitions(events, conn, runs).groupBy(
        listener, F.date_trunc(every, "ts").cast("timestamp_ntz").alias("bucket")
    ).agg(F.sum("delta").alias("_delta"))
    return buckets.select(listener, "bucket", F.sum("_delta").over(
        upto(Window.partitionBy(listener).orderBy("bucket"))).alias("active"))


def open_connections(events: DataFrame, conn: str) -> DataFrame:
    """Connections open at the end: their last open or close event is an open."""
    edges = _edges(events)
    return edges.groupBy(conn).agg(F.max_by("_opens", place_of(edges, ARRIVAL)).alias("_last")).filter("_last").drop("_last")


def connection_clients(events: DataFrame, conn: str) -> DataFrame:
    """Client id of each connection: the first non-empty one seen; NULL when none came."""
    named = F.when(F.col("client_id") != "", F.col("seq"))
    return events.groupBy(conn).agg(F.min_by(
        F.when(named.isNotNull(), F.col("client_id")), named).alias("client_id"))


def sessions(events: DataFrame, conn: str, runs: int | None = None) -> DataFrame:
    """Control sessions, one per open event of a connection.

    A client without an id gets ``client-<seq>``. A session ends with the first
    of these: its own connection closes (``closed``), its connection is opened
    again, or a newer session with the same client id starts anywhere
    (``superseded``). A close of another connection leaves it alone, so the
    newest session of a client stays. ``ended_by`` is NULL while it is open.
    """
    edges = _edges(events).select(conn, *ARRIVAL, "client_id", "_opens")
    edges = neighbour(edges, [conn], ARRIVAL, {"_again": "_opens", "_seq": "seq", "_ts": "ts"}, True, runs)
    named = F.coalesce(F.col("client_id"), F.lit("")) != ""
    opens = edges.filter("_opens").withColumn(
        "client_id", F.when(named, F.col("client_id")).otherwise(
            F.concat(F.lit("client-"), F.col("seq").cast("string"))))
    opens = neighbour(opens, ["client_id"], ARRIVAL, {"_newer": "seq", "_newer_ts": "ts"}, True, runs)
    own_first = F.col("_seq").isNotNull() & (
        F.col("_newer").isNull() | (_pair("_ts", "_seq") <= _pair("_newer_ts", "_newer")))
    ended_by = F.when(own_first & ~F.col("_again"), F.lit("closed")).when(
        own_first | F.col("_newer").isNotNull(), F.lit("superseded"))
    return opens.select(
        F.col("seq").alias("session"), "client_id", F.col("ts").alias("opened_at"),
        F.when(own_first, F.col("_ts")).otherwise(F.col("_newer_ts")).alias("closed_at"),
        ended_by.alias("ended_by"))


def _pair(ts: str, seq: str) -> Column:
    return F.struct(F.col(ts).alias("ts"), F.col(seq).alias("seq"))


def session_activity(messages: DataFrame, session: str) -> DataFrame:
    """Metadata and last activity of each session.

    Metadata are the headers of its first message; ``last_active`` is the time
    of its last message, in either direction.
    """
    return messages.groupBy(session).agg(
        F.min_by("headers", "seq").alias("metadata"), F.max("ts").alias("last_active"))
