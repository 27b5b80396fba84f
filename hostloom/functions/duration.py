"""Durations: text or JSON number to nanoseconds, uptime seconds to a label."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Unit names and their length in nanoseconds. The micro sign
# comes in two code points.
UNIT_NS = {
    "ns": 1,
    "us": 1_000,
    "µs": 1_000,
    "μs": 1_000,
    "ms": 1_000_000,
    "s": 1_000_000_000,
    "m": 60_000_000_000,
    "h": 3_600_000_000_000,
}

_UNIT = "(?:" + "|".join(sorted(UNIT_NS, key=len, reverse=True)) + ")"
_NUMBER = r"(?:[0-9]+\.?[0-9]*|\.[0-9]+)"
_TERM = rf"({_NUMBER})({_UNIT})"
_INT64_MAX = 9223372036854775807


def epoch_micros(ts: Column) -> Column:
    """Microseconds from 1970 to a wall-clock time; the session's time zone plays no part."""
    since = ts - F.expr("timestamp_ntz'1970-01-01 00:00:00'")
    return (since.cast("interval second").cast("decimal(20,6)") * 1_000_000).cast("bigint")


def duration_ns(text: Column) -> Column:
    """``1h30m``, ``1.5s``, ``-2ms``, ``0`` → nanoseconds; NULL for other text.

    The text is whole when its terms fill it. No pattern repeats a group, since
    the regex engine takes a stack frame for each repetition.
    """
    body = F.regexp_replace(text, "^[+-]", "")
    parts = F.regexp_extract_all(text, F.lit(_TERM), 0)
    filled = F.aggregate(parts, F.lit(0), lambda acc, x: acc + F.length(x))
    unit_ns = F.create_map(*[F.lit(x) for kv in UNIT_NS.items() for x in kv])
    numbers = F.regexp_extract_all(text, F.lit(_TERM), 1)
    units = F.regexp_extract_all(text, F.lit(_TERM), 2)
    terms = F.zip_with(
        numbers, units,
        lambda n, u: F.floor(n.try_cast("decimal(38,15)") * unit_ns[u].cast("decimal(13,0)")),
    )
    total = F.aggregate(
        terms, F.lit(0).cast("decimal(38,0)"),
        lambda acc, x: (acc + x.cast("decimal(38,0)")).cast("decimal(38,0)"),
    )
    whole = (body == "0") | ((F.size(parts) > 0) & (filled == F.length(body)))
    ok = whole & (total <= F.lit(_INT64_MAX))
    signed = F.when(F.startswith(text, F.lit("-")), -total).otherwise(total)
    return F.when(ok, signed.try_cast("bigint"))


def duration_from_json(json: Column) -> Column:
    """A JSON string is duration text, a JSON number is nanoseconds cut to an integer.

    Anything else is NULL, as are the error cases.
    """
    v = F.try_parse_json(json)
    kind = F.schema_of_variant(v)
    number = F.try_variant_get(v, "$", "double")
    return F.when(
        kind == "STRING", duration_ns(F.try_variant_get(v, "$", "string"))
    ).when(
        F.rlike(kind, F.lit("^(BIGINT|DOUBLE|DECIMAL)")),
        F.when(number >= 0, F.floor(number)).otherwise(F.ceil(number)).try_cast("bigint"),
    )


def uptime_label(seconds: Column) -> Column:
    """``NdNhNm``, ``NhNm`` or ``Nm``."""
    days = F.floor(seconds / F.lit(86400)).cast("bigint")
    hours = F.floor(seconds / F.lit(3600)).cast("bigint") % 24
    minutes = F.floor(seconds / F.lit(60)).cast("bigint") % 60
    return (
        F.when(days > 0, F.concat(days.cast("string"), F.lit("d"), hours.cast("string"),
                                  F.lit("h"), minutes.cast("string"), F.lit("m")))
        .when(hours > 0, F.concat(hours.cast("string"), F.lit("h"), minutes.cast("string"), F.lit("m")))
        .otherwise(F.concat(minutes.cast("string"), F.lit("m")))
    )
