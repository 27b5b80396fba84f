"""Column functions over text: trimming, registry keys, ids, log lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hostloom.bind import bind
from hostloom.functions.duration import duration_ns

# Fixed value: the characters a Unicode-aware trim removes.
WHITESPACE = (
    "\t\n\x0b\x0c\r \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)

# Segments of the registry key tree.
SELF_SEGMENT = "self"
MUTEX_SEGMENT = "mutex"
ELECTION_SEGMENT = "election/leader"

# Statement log rule.
SLOW_STATEMENT_MS = 200.0
LOG_LEVELS = {"silent": 1, "error": 2, "warn": 3, "info": 4}
NOT_FOUND = "record not found"


def trim_space(text: Column) -> Column:
    return F.btrim(text, F.lit(WHITESPACE))


def registry_root(prefix: Column, service_name: Column) -> Column:
    """``prefix/service``; an empty service name leaves the prefix."""
    return F.when(F.coalesce(service_name, F.lit("")) == "", prefix).otherwise(
        F.concat_ws("/", prefix, service_name))


def self_key(root: Column, service_id: Column) -> Column:
    """Key of one instance; without an id it is the root itself."""
    return F.when(F.coalesce(service_id, F.lit("")) == "", root).otherwise(
        F.concat_ws("/", root, F.lit(SELF_SEGMENT), service_id))


def mutex_key(root: Column, key: Column) -> Column:
    return F.concat_ws("/", root, F.lit(MUTEX_SEGMENT), key)


def election_key(root: Column, name: Column) -> Column:
    return F.concat_ws("/", root, F.lit(ELECTION_SEGMENT), name)


def child_key(root: Column, key: Column) -> Column:
    """Key below ``root``: trimmed, prefixed unless it already starts with it.

    An empty key is an error, given as NULL.
    """
    trimmed = trim_space(key)
    return (
        F.when(F.coalesce(trimmed, F.lit("")) == "", F.lit(None).cast("string"))
        .when(F.startswith(trimmed, root), trimmed)
        .otherwise(F.concat_ws("/", root, trimmed))
    )


def os_label(platform: Column, version: Column, os: Column) -> Column:
    platform, version = F.coalesce(platform, F.lit("")), F.coalesce(version, F.lit(""))
    return (
        F.when((platform != "") & (version != ""), F.concat_ws(" ", platform, version))
        .when(platform != "", platform)
        .otherwise(F.coalesce(os, F.lit("")))
    )


def connection_id(remote_addr: Column, n: Column) -> Column:
    return F.concat(remote_addr, F.lit("#"), n.cast("string"))


def metric_name(subsystem: Column, name: Column) -> Column:
    """``subsystem_name``; either part may be empty."""
    return F.concat_ws("_", F.nullif(subsystem, F.lit("")), F.nullif(name, F.lit("")))


# method, path, client address, status, latency; a decoded path may hold spaces
ACCESS_LINE = r"^(\S+) ([^\n]*) (\S*) (\d{1,4}) (\S+)$"


def with_access_fields(rows: DataFrame, column: str = "line") -> DataFrame:
    """Add the columns of an HTTP access-log line; ``reason`` says why a line has none."""
    # one replacement splits a line; a line that does not match is left whole
    parts = F.split(F.regexp_replace(F.col(column), ACCESS_LINE, "$1\n$2\n$3\n$4\n$5"), "\n")
    rows = bind(rows, "_parts", parts)
    rows = bind(rows, "_latency", duration_ns(F.get("_parts", F.lit(4))))
    matched = F.coalesce(F.size("_parts") == 5, F.lit(False))

    def part(i: int) -> Column:
        return F.when(matched, F.get("_parts", F.lit(i)))

    return rows.select(
        *[c for c in rows.columns if c not in ("_parts", "_latency")],
        part(0).alias("method"), part(1).alias("path"), part(2).alias("client_ip"),
        part(3).try_cast("int").alias("status"),
        F.when(matched, F.col("_latency")).alias("latency_ns"),
        F.when(~matched, F.lit("bad_line"))
        .when(F.col("_latency").isNull(), F.lit("bad_latency")).alias("reason"),
    )


def statement_log_class(elapsed_ms: Column, err: Column, level: str = "warn",
                        slow_ms: float = SLOW_STATEMENT_MS,
                        ignore_not_found: bool = True) -> Column:
    """``error``, ``slow`` or ``info`` for a traced statement; NULL when not logged.

    An error is reported at level error or above, a slow statement at warn or
    above, the rest at info. "Record not found" is no error by default.
    """
    at = LOG_LEVELS[level]
    is_error = err.isNotNull()
    if ignore_not_found:
        is_error = is_error & (err != NOT_FOUND)
    label = F.when(F.lit(at >= LOG_LEVELS["error"]) & is_error, F.lit("error"))
    if slow_ms:
        label = label.when(F.lit(at >= LOG_LEVELS["warn"]) & (elapsed_ms > slow_ms), F.lit("slow"))
    return label.when(F.lit(at >= LOG_LEVELS["info"]), F.lit("info"))
