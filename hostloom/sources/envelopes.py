"""Readers for the envelope stream."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hostloom.schemas import ENVELOPE
from hostloom.sources.mapping import ColumnMapping, load


class UnsupportedSource(ValueError):
    """A source type this package does not read."""


def read_envelopes(spark: SparkSession, path: str, streaming: bool = False,
                   fmt: str = "parquet", max_files_per_trigger: int | None = None,
                   max_bytes_per_trigger: int | None = None, mapping: ColumnMapping | None = None) -> DataFrame:
    """Envelopes landed as files, one row per message.

    A micro-batch takes ``max_files_per_trigger`` files or files of ``max_bytes_per_trigger``
    in all, at least one; waiting rows stay in the source and none is dropped. ``mapping``
    reads files with other columns in place.
    """
    if max_files_per_trigger and max_bytes_per_trigger:
        raise ValueError("a trigger is bounded by files or by bytes, not by both")
    bounds = {"maxFilesPerTrigger": max_files_per_trigger, "maxBytesPerTrigger": max_bytes_per_trigger}
    options = {k: v for k, v in bounds.items() if streaming and v}
    return load(spark, path, ENVELOPE, fmt, streaming, mapping, options)


def read_kafka(spark: SparkSession, brokers: str, topic: str, streaming: bool = True,
               max_offsets_per_trigger: int | None = None) -> DataFrame:
    """Envelopes from a Kafka topic; needs Spark's Kafka package on the class path."""
    reader = (spark.readStream if streaming else spark.read).format("kafka")
    reader = (reader.option("kafka.bootstrap.servers", brokers).option("subscribe", topic)
              .option("includeHeaders", "true"))
    if streaming and max_offsets_per_trigger:
        reader = reader.option("maxOffsetsPerTrigger", max_offsets_per_trigger)
    return envelopes_from_kafka(reader.load())


def envelopes_from_kafka(records: DataFrame) -> DataFrame:
    """Kafka records to envelopes: offset and partition give a unique ``seq``."""
    headers = F.map_from_entries(F.transform(
        F.col("headers"), lambda h: F.struct(h["key"], h["value"].cast("string"))))
    return records.select(
        F.shiftleft(F.col("offset"), 16).bitwiseOR(F.col("partition").cast("bigint")).alias("seq"),
        F.col("timestamp").cast("timestamp_ntz").alias("arrival_ts"),
        F.concat_ws("#", "topic", F.col("partition").cast("string")).alias("conn_id"),
        F.col("key").cast("string").alias("client_id"),
        headers.alias("headers"),
        F.col("value").alias("payload"),
    )


def read_sources(spark: SparkSession, configs: Sequence[Mapping], streaming: bool = False) -> DataFrame:
    """All configured sources as one DataFrame; duplicates are kept.

    Only type ``agent`` is known, with ``path`` and perhaps ``format`` and ``mapping``. One
    bad entry fails the whole build.
    """
    frames = []
    for entry in configs:
        if entry.get("type") != "agent":
            raise UnsupportedSource(f"source type not supported: {entry.get('type')!r}")
        options = dict(entry.get("config") or {})
        if not options.get("path"):
            raise ValueError("source config needs a path")
        frames.append(read_envelopes(spark, options["path"], streaming, options.get("format", "parquet"),
                                     mapping=options.get("mapping")))
    if not frames:
        return spark.createDataFrame([], ENVELOPE)
    return reduce(DataFrame.unionByName, frames)
