"""Sinks from configuration, and the table they need."""

from __future__ import annotations

import logging
from collections.abc import Mapping, Sequence

from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hostloom.functions.endpoint import with_endpoint
from hostloom.schemas import SNAPSHOT
from hostloom.sinks.base import Sink
from hostloom.sinks.kafka import kafka_sink
from hostloom.sinks.snapshots import TABLE, SnapshotTable, jdbc_sink

log = logging.getLogger(__name__)


class SinkConfigError(ValueError):
    """A known sink with a bad configuration."""


def _text(config: Mapping, key: str) -> str:
    value = config.get(key)
    if not isinstance(value, str) or not value:
        raise SinkConfigError(f"{key!r} must be a non-empty string")
    return value


def _texts(config: Mapping, key: str) -> list[str]:
    value = config.get(key)
    if not isinstance(value, (list, tuple)) or not value or not all(isinstance(v, str) for v in value):
        raise SinkConfigError(f"{key!r} must be a list of strings")
    return list(value)


def _kafka(spark: SparkSession, config: Mapping) -> Sink:
    return kafka_sink(_texts(config, "brokers"), _text(config, "topic"))


def _mysql(spark: SparkSession, config: Mapping) -> Sink:
    url, database = _text(config, "url"), _text(config, "database")
    at = with_endpoint(spark.range(1).select(F.lit(url).alias("url")), "url", "e").first().e
    if at.reason:
        raise SinkConfigError(f"url {url!r}: {at.reason}")
    return jdbc_sink(f"jdbc:mysql://{at.host}:{at.port}/{database}",
                     config.get("username") or "", config.get("password") or "")


def _files(spark: SparkSession, config: Mapping) -> Sink:
    return SnapshotTable(spark, _text(config, "path")).sink()


BUILDERS = {"kafka": _kafka, "mysql": _mysql, "files": _files}


def plan_sinks(spark: SparkSession, configs: Sequence[Mapping]) -> list[Sink]:
    """Sinks in configured order; an empty list means all rows are dropped.

    ``enabled`` missing or true is on. An unknown type is skipped with a
    warning; a known type with a bad configuration is an error.
    """
    sinks = []
    for i, entry in enumerate(configs):
        if entry.get("enabled") is False:
            continue
        build = BUILDERS.get(entry.get("type"))
        if build is None:
            log.warning("unknown sink type %r, skipping", entry.get("type"))
            continue
        config = entry.get("config")
        if config is None:
            raise SinkConfigError(f"sink[{i}] type {entry['type']!r}: config is empty")
        try:
            sinks.append(build(spark, config))
        except SinkConfigError as exc:
            raise SinkConfigError(f"sink[{i}] type {entry['type']!r}: {exc}") from exc
    if configs and not sinks:
        log.warning("no sink from %d entries, rows will be dropped", len(configs))
    return sinks


def ensure_tables(spark: SparkSession, database: str, table: str = TABLE,
                  schema: T.StructType = SNAPSHOT) -> list[str]:
    """Create the database and the snapshot table, or add columns the table lacks.

    Safe to repeat. Returns the columns it added.
    """
    spark.sql(f"CREATE DATABASE IF NOT EXISTS `{database}`")
    name = f"`{database}`.`{table}`"
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
    spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({columns}) USING parquet")
    present = set(spark.table(name).columns)
    missing = [f for f in schema if f.name not in present]
    if missing:
        added = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in missing)
        spark.sql(f"ALTER TABLE {name} ADD COLUMNS ({added})")
    return [f.name for f in missing]
