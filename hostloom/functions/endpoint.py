"""Endpoints ``protocol://host:port`` as columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hostloom.functions.text import trim_space
from hostloom.bind import bind

# Error reasons, in the order they are checked.
REASONS = (
    "missing '://'",
    "empty protocol",
    "empty host:port",
    "missing ']'",
    "empty host in brackets",
    "missing port after ']'",
    "missing port",
    "empty host",
    "empty port",
    "invalid port",
    "port out of range",
)


def _after(text: Column, start: Column | int) -> Column:
    return F.substring(text, start if isinstance(start, Column) else F.lit(start), F.length(text))


def _before(text: Column, end: Column) -> Column:
    return F.substring(text, F.lit(1), F.greatest(end - 1, F.lit(0)))


def _scheme(text: Column) -> Column:
    text = F.coalesce(text, F.lit(""))
    at = F.locate("://", text)
    return F.struct(
        (at > 0).alias("found"),
        trim_space(_before(text, at)).alias("protocol"),
        trim_space(_after(text, at + 3)).alias("rest"),
    )


def _authority(scheme: Column) -> Column:
    rest = scheme["rest"]
    bracketed = F.startswith(rest, F.lit("["))
    closing = F.locate("]", rest)
    last = F.substring_index(rest, ":", -1)
    behind = trim_space(_after(rest, closing + 1))
    return F.struct(
        bracketed.alias("bracketed"),
        (closing > 0).alias("closed"),
        F.when(bracketed, F.startswith(behind, F.lit(":")))
        .otherwise(F.contains(rest, F.lit(":"))).alias("has_port"),
        trim_space(F.when(bracketed, F.substring(rest, F.lit(2), F.greatest(closing - 2, F.lit(0))))
                   .otherwise(_before(rest, F.length(rest) - F.length(last)))).alias("host"),
        trim_space(F.when(bracketed, _after(behind, 2)).otherwise(last)).alias("port"),
    )


def _endpoint(scheme: Column, part: Column) -> Column:
    port = F.when(F.rlike(part["port"], F.lit("^[+-]?[0-9]+$")), part["port"].try_cast("bigint"))
    bracketed = part["bracketed"]
    checks = (
        ~scheme["found"],
        scheme["protocol"] == "",
        scheme["rest"] == "",
        bracketed & ~part["closed"],
        bracketed & (part["host"] == ""),
        bracketed & ~part["has_port"],
        ~part["has_port"],
        part["host"] == "",
        part["port"] == "",
        port.isNull(),
        ~port.between(1, 65535),
    )
    reason = F.coalesce(*[F.when(bad, F.lit(why)) for bad, why in zip(checks, REASONS)])
    ok = reason.isNull()
    return F.struct(
        F.when(ok, scheme["protocol"]).alias("protocol"),
        F.when(ok, part["host"]).alias("host"),
        F.when(ok, port.cast("int")).alias("port"),
        reason.alias("reason"),
    )


def with_endpoint(rows: DataFrame, column: str, out: str) -> DataFrame:
    """Add ``out``: ``struct<protocol, host, port, reason>`` of an endpoint text.

    On error ``reason`` is one of ``REASONS`` and the other fields are NULL.
    """
    rows = bind(rows, "_scheme", _scheme(F.col(column)))
    rows = bind(rows, "_part", _authority(F.col("_scheme")))
    rows = bind(rows, out, _endpoint(F.col("_scheme"), F.col("_part")))
    return rows.drop("_scheme", "_part")


def _host_part(host: Column) -> Column:
    return F.when(F.contains(host, F.lit(":")), F.concat(F.lit("["), host, F.lit("]"))).otherwise(host)


def host_port(host: Column, port: Column) -> Column:
    """``host:port``, with brackets round a host that holds a colon."""
    return F.concat(_host_part(host), F.lit(":"), port.cast("string"))


def format_endpoint(protocol: Column, host: Column, port: Column) -> Column:
    return F.concat(protocol, F.lit("://"), host_port(host, port))
