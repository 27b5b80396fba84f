"""Reader for the registry change log: put and delete events by revision."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from hostloom.schemas import CHANGE
from hostloom.sources.mapping import ColumnMapping, load

PUT = "PUT"
DELETE = "DELETE"


def read_changes(spark: SparkSession, path: str, streaming: bool = False,
                 fmt: str = "parquet", mapping: ColumnMapping | None = None) -> DataFrame:
    """Changes landed as files, or any files with ``mapping`` telling how they are changes."""
    return load(spark, path, CHANGE, fmt, streaming, mapping)
