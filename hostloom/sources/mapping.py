"""Reading given files whose columns have other names and types."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


@dataclass(frozen=True)
class ColumnMapping:
    """How rows of a file become rows of a target schema.

    ``stored`` is the schema of the files as a DDL text. ``columns`` gives each target
    column as SQL over the stored ones; a target column that is not named is NULL.
    ``derived`` are helper columns for them, ``where`` picks the rows of this source.
    All of it is projection and filter: columns nobody needs are not read.
    """

    stored: str
    columns: Mapping[str, str]
    derived: Mapping[str, str] = field(default_factory=dict)
    where: str | None = None

    def apply(self, rows: DataFrame, target: T.StructType) -> DataFrame:
        if self.where:
            rows = rows.filter(self.where)
        if self.derived:
            rows = rows.selectExpr("*", *[f"{sql} AS {name}" for name, sql in self.derived.items()])
        return rows.selectExpr(*[
            f"CAST({self.columns.get(f.name, 'NULL')} AS {f.dataType.simpleString()}) AS {f.name}" for f in target])


def load(spark: SparkSession, path: str, target: T.StructType, fmt: str = "parquet", streaming: bool = False,
         mapping: ColumnMapping | None = None, options: Mapping[str, object] | None = None) -> DataFrame:
    """Rows of ``target`` from files that have this schema or are mapped to it, as a table or a stream."""
    reader = (spark.readStream if streaming else spark.read).format(fmt).schema(mapping.stored if mapping else target)
    rows = reader.options(**{k: str(v) for k, v in (options or {}).items()}).load(path)
    return mapping.apply(rows, target) if mapping else rows
