"""Reading tables, settling intermediate ones, and Arrow batches as plain arrays."""

from __future__ import annotations

import tempfile
import zipfile
from collections.abc import Callable, Iterator
from functools import cache
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hostloom.session import shared_dir


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def settle(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = shared_dir(spark, f"llm-{name}")
    schema = df.schema
    df.write.parquet(path)
    return spark.read.schema(schema).parquet(path)


def row_key(*columns: Column) -> list[Column]:
    """``k1``, ``k2``: 128 bits that name a row by these columns, nulls told apart."""
    told = [c for column in columns for c in (column.isNull(), column)]
    return [F.xxhash64(F.lit(i), *told).alias(f"k{i}") for i in (1, 2)]


def least_by_hash(rows: DataFrame, limit: int, key: str, *ties: str) -> DataFrame:
    """The ``limit`` rows with the least hash of ``key``; little more than these leave their tasks.

    ``rows`` is read up to three times, so it should be a table. A threshold on
    the hash lets enough rows pass, save where many rows share a key.
    """
    mark = F.xxhash64(key)
    n = rows.count()
    if n > limit:
        cut = int((limit + 8 * limit ** 0.5) / n * 2.0 ** 64) - 2 ** 63
        few = rows.filter(mark < F.lit(min(cut, 2 ** 63 - 1)))
        if few.count() >= limit:
            rows = few
    return rows.orderBy(mark, key, *ties).limit(limit)


@cache
def _shipped(app_id: str) -> str:
    """A zip of this package on the driver, for Spark to hand to the executors."""
    package = Path(__file__).resolve().parent.parent
    path = f"{tempfile.mkdtemp(prefix='hostloom-code-')}/hostloom_code.zip"
    with zipfile.ZipFile(path, "w") as out:
        for source in sorted(package.rglob("*.py")):
            out.write(source, source.relative_to(package.parent))
    return path


def ship_code(spark: SparkSession) -> None:
    """Make this package importable in Python workers, once per application."""
    context = spark.sparkContext
    path = _shipped(context.applicationId)
    if not any(Path(path).name in f for f in context.listFiles):
        context.addPyFile(path)


def map_batches(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str) -> DataFrame:
    """Apply ``fn`` to each Arrow batch of a partition."""
    ship_code(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows and (out := fn(batch)) is not None:
                yield out

    return df.mapInArrow(run, schema)


def slices(texts: list[str | None], limit: int = 1 << 17) -> Iterator[tuple[int, int]]:
    """Cut a batch into runs of whole texts of about ``limit`` characters, to bound working memory."""
    start = size = 0
    for i, text in enumerate(texts):
        size += len(text or "") + 1
        if size >= limit:
            yield start, i + 1
            start, size = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


def list_array(values: np.ndarray, width: int) -> pa.Array:
    """Rows of a flat array as an Arrow list column of fixed length."""
    rows = len(values) // width
    return pa.ListArray.from_arrays(pa.array(np.arange(rows + 1, dtype=np.int32) * width), pa.array(values))
