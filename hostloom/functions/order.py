"""One number for the place of a row in its order."""

from __future__ import annotations

from collections.abc import Sequence
from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hostloom.functions.duration import epoch_micros

_SPAN = Decimal(2 ** 64)


def _number(c: Column, kind: T.DataType) -> Column:
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return epoch_micros(c)
    return c.cast("bigint")


def place_of(rows: DataFrame, order: Sequence[str]) -> Column:
    """Time and sequence number, or one of them, as one number that sorts like the two.

    It has a fixed width, so a hash aggregate keeps it in its buffer, which it cannot
    do with a struct. Times up to the year 170,000 fit.
    """
    parts = [_number(F.col(c), rows.schema[c].dataType) for c in order]
    if len(parts) == 1:
        return parts[0]
    if len(parts) != 2:
        raise ValueError("an order has one or two columns")
    major, minor = parts
    high = major.cast("decimal(19,0)") * F.lit(_SPAN)
    return (high + minor.cast("decimal(19,0)") + F.lit(_SPAN // 2)).cast("decimal(38,0)")
