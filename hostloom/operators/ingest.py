"""From envelopes to the latest snapshot of each machine."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hostloom.bind import bind
from hostloom.functions import payload as P
from hostloom.functions.order import place_of
from hostloom.operators.winners import BROADCAST_BYTES, fetched, keep

# Fixed value: the transport refuses larger messages. It is the one limit of all
# paths: larger payloads are never written as snapshots and end in quarantine.
MAX_MESSAGE_BYTES = 10 * 1024 * 1024

# Reasons a row does not reach the snapshot table, in the order they are checked.
EMPTY_PAYLOAD = "empty_payload"
TOO_LARGE = "too_large"
MALFORMED = "malformed"
OTHER_PLUGIN = "plugin"
NO_CLIENT = "no_client"
NULL_DATA = "null_data"
REASONS = (EMPTY_PAYLOAD, TOO_LARGE, MALFORMED, OTHER_PLUGIN, NO_CLIENT, NULL_DATA)


def payload_bytes(column: str = "payload") -> Column:
    return F.coalesce(F.octet_length(F.col(column)), F.lit(0))


def client_id() -> Column:
    return F.coalesce(F.col("client_id"), F.lit(""))


def drop_greetings(envelopes: DataFrame) -> DataFrame:
    """Drop rows with neither payload nor client id: a connection saying hello."""
    return envelopes.filter(~((payload_bytes() == 0) & (client_id() == "")))


def drop_empty_payload(envelopes: DataFrame) -> DataFrame:
    return envelopes.filter(payload_bytes() > 0)


def within_size(rows: DataFrame, column: str = "payload", cap: int = MAX_MESSAGE_BYTES) -> DataFrame:
    """Keep rows the transport would carry."""
    return rows.filter(payload_bytes(column) <= cap)


def parsed(envelopes: DataFrame) -> DataFrame:
    """Add ``text``, the payload as JSON text, and ``doc``, the same as ``struct<sample, corrupt>``."""
    rows = bind(envelopes, "text", P.payload_text(F.col("payload")))
    return bind(rows, "doc", P.document(F.col("text")))


def reject_reason() -> Column:
    """First failing rule over a parsed row; NULL when the row is accepted."""
    doc = F.col("doc")
    return (
        F.when(payload_bytes() == 0, F.lit(EMPTY_PAYLOAD))
        .when(payload_bytes() > MAX_MESSAGE_BYTES, F.lit(TOO_LARGE))
        .when(~P.is_sound("text", "doc"), F.lit(MALFORMED))
        .when(P.plugin_name(doc) != P.HOST_PLUGIN, F.lit(OTHER_PLUGIN))
        .when(client_id() == "", F.lit(NO_CLIENT))
        .when(~P.has_data(doc), F.lit(NULL_DATA))
    )


def classified(envelopes: DataFrame) -> DataFrame:
    """Add ``doc`` and ``reason``; parsing and the type rules run once per row."""
    judged = parsed(envelopes).withColumn("_reason", reject_reason())
    return bind(judged, "reason", F.col("_reason")).drop("_reason", "text")


def well_formed(envelopes: DataFrame) -> DataFrame:
    """Non-empty payloads that decode, with ``doc``; the others are in ``quarantine``."""
    reason = F.col("reason")
    return classified(envelopes).filter(
        reason.isNull() | ~reason.isin(EMPTY_PAYLOAD, TOO_LARGE, MALFORMED)).drop("reason")


def host_plugin_only(decoded: DataFrame) -> DataFrame:
    """Keep host samples; takes rows with ``doc``."""
    return decoded.filter(P.plugin_name(F.col("doc")) == P.HOST_PLUGIN)


def drop_no_client(envelopes: DataFrame) -> DataFrame:
    return envelopes.filter(client_id() != "")


def drop_null_data(decoded: DataFrame) -> DataFrame:
    """Drop events without data; takes rows with ``doc``."""
    return decoded.filter(P.has_data(F.col("doc")))


def quarantine(envelopes: DataFrame) -> DataFrame:
    """Rows that are not written to the snapshot table, each with its reason."""
    return classified(envelopes).filter(F.col("reason").isNotNull()).drop("doc")


def reason_counts(envelopes: DataFrame) -> DataFrame:
    return (
        classified(envelopes)
        .groupBy(F.coalesce(F.col("reason"), F.lit("accepted")).alias("reason"))
        .agg(F.count(F.lit(1)).alias("n"))
    )


def accepted(envelopes: DataFrame) -> DataFrame:
    """Rows that reach the snapshot table, with ``doc``."""
    return classified(envelopes).filter(F.col("reason").isNull()).drop("reason")


def samples(envelopes: DataFrame) -> DataFrame:
    """Accepted rows with the decoded ``stats`` in place of the payload."""
    rows = accepted(envelopes)
    return bind(rows, "stats", P.decode_stats()).drop("doc", "payload")


def disks(decoded: DataFrame) -> DataFrame:
    """One row per (sample, disk)."""
    keep = [c for c in decoded.columns if c != "stats"]
    return decoded.select(*keep, F.inline("stats.disk"))


def nics(decoded: DataFrame) -> DataFrame:
    """One row per (sample, network interface), with its eight counters."""
    keep = [c for c in decoded.columns if c != "stats"]
    return decoded.select(*keep, F.inline("stats.networks"))


# --- latest snapshot -------------------------------------------------------

RECENCY = ("arrival_ts", "seq")


def reduce_to_latest(rows: DataFrame, among: DataFrame | None = None, limit: int = BROADCAST_BYTES) -> DataFrame:
    """One row per machine from accepted rows (``client_id``, ``arrival_ts``, ``seq``, ``payload``).

    A first pass finds the place and the payload's hash of each machine's last row, in a
    hash aggregate of fixed width. A second pass fetches these rows; payloads of other
    rows are neither sorted nor shuffled. ``among`` may be the envelopes that ``rows`` were
    judged from, so that the second pass need not judge again. Two samples of one
    machine with one place are copies of a row, or one of them wins.
    """
    among = rows if among is None else among
    place = place_of(rows, RECENCY)
    state = keep(rows.groupBy(F.col("client_id").alias("machine_id")).agg(
        F.min("arrival_ts").alias("created_at"), F.max(place).alias("_place"),
        F.max_by(F.xxhash64("payload"), place).alias("_print")), ["machine_id", "_place", "_print"])
    candidates = among.select(
        F.col("client_id").alias("machine_id"), F.col("arrival_ts").alias("updated_at"), "seq", "payload",
        place_of(among, RECENCY).alias("_place"), F.xxhash64("payload").alias("_print"))
    found = fetched(candidates, state, limit)
    copies = Window.partitionBy("machine_id").orderBy("seq")
    return found.withColumn("_copy", F.row_number().over(copies)).filter("_copy = 1").select(
        "machine_id", "created_at", "updated_at", "seq", "payload")


def newest(rows: DataFrame, within: Sequence[str] = ()) -> DataFrame:
    """Fold reduced rows of several batches into one row per machine.

    ``within`` names columns that a machine has one value of and that rows are already dealt by.
    """
    machine = Window.partitionBy(*within, "machine_id")
    recent = machine.orderBy(F.col("updated_at").desc(), F.col("seq").desc(), F.xxhash64("payload"))
    return rows.withColumn("created_at", F.min("created_at").over(machine)).withColumn(
        "_age", F.row_number().over(recent)).filter("_age = 1").drop("_age")


def as_snapshots(latest: DataFrame) -> DataFrame:
    """Decode reduced rows to the snapshot columns."""
    decoded = bind(parsed(latest), "stats", P.decode_stats())
    return decoded.select(
        "machine_id",
        F.col("stats.hostname").alias("host_name"),
        P.collect_ips(F.col("stats.networks")).alias("ips"),
        "stats", "created_at", "updated_at", "seq",
    )


def latest_snapshots(envelopes: DataFrame) -> DataFrame:
    """Latest snapshot per machine: last applied record wins, first one dates the row."""
    return as_snapshots(reduce_to_latest(accepted(envelopes).drop("doc"), envelopes))


def list_hosts(snapshots: DataFrame, n: int = 10) -> DataFrame:
    """The first ``n`` hosts by machine id."""
    return snapshots.orderBy("machine_id").limit(n)
