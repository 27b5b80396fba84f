"""Kafka sink: key is the client id, value the payload."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hostloom.operators.ingest import client_id, drop_empty_payload, payload_bytes
from hostloom.sinks.base import Sink


def to_kafka_rows(envelopes: DataFrame) -> DataFrame:
    """Key/value records. Empty payloads and headers are dropped; any plugin passes."""
    return drop_empty_payload(envelopes).select(
        client_id().cast("binary").alias("key"), F.col("payload").cast("binary").alias("value"))


def write_kafka(envelopes: DataFrame, brokers: Sequence[str], topic: str) -> None:
    """Write records to a topic; needs Spark's Kafka package on the class path."""
    (to_kafka_rows(envelopes).write.format("kafka")
     .option("kafka.bootstrap.servers", ",".join(brokers)).option("topic", topic).save())


def kafka_sink(brokers: Sequence[str], topic: str) -> Sink:
    return Sink("kafka", payload_bytes() > 0, lambda rows, batch: write_kafka(rows, brokers, topic))


def record_files_sink(path: str) -> Sink:
    """The same records as Parquet files, one folder per batch; replaying a batch replaces it."""
    def put(rows: DataFrame, batch: str) -> None:
        to_kafka_rows(rows).write.mode("overwrite").parquet(f"{path.rstrip('/')}/batch={batch}")

    return Sink("kafka", payload_bytes() > 0, put)
