"""The rows that win in their groups, fetched late.

An aggregate that carries whole rows sorts them in every task and, where a task sees
each group once, shuffles them all. Here the aggregate keeps fixed-width state only
(a hash aggregate), and the few rows that won are looked up afterwards.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from hostloom.session import settle

# a wanted list up to this size is sent to all tasks
BROADCAST_BYTES = 64 << 20
# beyond it, a bitmap of this many bits (16 MB at any size) thins the rows before they are shuffled
_BITMAP_BITS = 1 << 27
_BUCKET_BITS = 32_768


@dataclass(frozen=True)
class Wanted:
    """A stored list of winners with distinct keys ``on``, and how many bytes its rows take."""

    rows: DataFrame
    on: tuple[str, ...]
    size: int


def keep(winners: DataFrame, on: Sequence[str]) -> Wanted:
    """Write winners down; their size is measured on the way."""
    texts = [F.coalesce(F.octet_length(c), F.lit(0)) for c, kind in winners.dtypes if kind in ("string", "binary")]
    size = F.sum(sum(texts, F.lit(16 * len(winners.columns))).cast("bigint")).alias("size")
    seen = Observation()
    rows = settle(winners.observe(seen, size), "winners")
    return Wanted(rows, tuple(on), seen.get["size"] or 0)


def _bit(on: Sequence[str]) -> tuple[Column, Column]:
    at = F.pmod(F.xxhash64(*on), F.lit(_BITMAP_BITS))
    bit = F.pmod(at, F.lit(_BUCKET_BITS))
    return ((at - bit) / _BUCKET_BITS).cast("int"), bit


def fetched(rows: DataFrame, wanted: Wanted, limit: int = BROADCAST_BYTES) -> DataFrame:
    """Rows that have a winner's key, with the winner's other columns.

    Up to ``limit`` bytes the list is sent to all tasks and no row of ``rows`` is
    shuffled. A larger one is joined by key, after a bitmap of fixed size has removed
    almost all rows without a winner's key.
    """
    on = list(wanted.on)
    if wanted.size <= limit:
        return rows.join(F.broadcast(wanted.rows), on)
    bucket, bit = _bit(on)
    marks = wanted.rows.groupBy(bucket.alias("_bucket")).agg(F.bitmap_construct_agg(bit).alias("_bits"))
    byte = F.conv(F.hex(F.substring("_bits", (bit / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    marked = F.getbit(byte, F.pmod(bit, F.lit(8)).cast("int")) == 1
    # broadcast: at most 4096 bitmaps of 4 KB
    near = rows.join(F.broadcast(marks), (bucket == F.col("_bucket")) & marked, "left_semi")
    return near.join(wanted.rows, on)
