"""Compute an expression once per row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def bind(rows: DataFrame, name: str, value: Column) -> DataFrame:
    """Add a column that is computed once per row, wherever it is used later.

    The optimizer copies a projected expression into every filter above it and
    into every later use of a cheap projection; it does not do so with the
    output of a generator.
    """
    return rows.select("*", F.inline(F.array(F.struct(value.alias(name)))))
