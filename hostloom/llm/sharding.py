"""Shards by a keyed permutation of global row numbers.

Rows are numbered from 0 in the order of their id, a generalised Feistel network
over Z_a x Z_b (Black and Rogaway, "Ciphers with arbitrary finite domains")
permutes the numbers, and a value outside the rows walks on along its cycle until
it is inside. Place ``p`` is slot ``p div shards`` of shard ``p mod shards``, so
shards differ by one row at most and slots have no gaps. Both directions are plain
arithmetic: ``place`` tells where a row goes, ``row_at`` which row is at a place.

Ids, ties and layout: rows are ordered by id (nulls first), digest of the text and
remaining columns, so numbers depend neither on files nor on partitions; rows equal
in all columns are interchangeable and are dealt over the sort by their place in
the scan. A null text counts as empty. Very long texts pass through as they are
and only once if the caller keeps the column. An empty table has no shards. A
column of ``docs`` with the name of a result column gives way to the result.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from math import isqrt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hostloom.llm.common import settle

ROWS_LAW = "rows"
RESULT = ("size", "text_crc32", "row", "shard", "slot")

# row numbers of a partition in monotonically_increasing_id
_INDEX_BITS = 33
# a walk that is longer than this is finished by a second, exhaustive one
_USUAL_WALK = 16


@dataclass(frozen=True)
class Shuffle:
    """``shards`` to fill, ``seed`` of the permutation, ``rounds`` of its network (an even number)."""

    shards: int = 24
    seed: int = 0
    rounds: int = 8

    def __post_init__(self):
        if self.shards < 1 or self.rounds < 2 or self.rounds % 2:
            raise ValueError("at least one shard and an even number of rounds")


def _sides(n: int) -> tuple[int, int]:
    """The smallest near-square domain that holds ``n`` values: fewer than ``a`` of its values are outside."""
    a = max(isqrt(max(n - 1, 0)) + 1, 1)
    return a, max(-(-n // a), 1)


def _div(value: Column, by: int) -> Column:
    return F.call_function("div", value, F.lit(by))


def _round_value(seed: int, j: Column, half: Column) -> Column:
    """60 bits from the seed, the round and one half."""
    text = F.concat_ws(":", F.lit(str(seed)), j.cast("string"), half.cast("string"))
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("bigint")


def _pair(left: Column, right: Column) -> Column:
    return F.struct(left.cast("bigint").alias("l"), right.cast("bigint").alias("r"))


def _forward(value: Column, n: int, how: Shuffle) -> Column:
    a, b = _sides(n)

    def step(s: Column, j: Column) -> Column:
        side = F.when(j % 2 == 0, F.lit(a)).otherwise(F.lit(b)).cast("bigint")
        return _pair(s["r"], (s["l"] + _round_value(how.seed, j, s["r"]) % side) % side)

    rounds = F.array(*[F.lit(j) for j in range(how.rounds)])
    return F.aggregate(rounds, _pair(value % a, _div(value, a)), step, lambda s: s["r"] * a + s["l"])


def _backward(value: Column, n: int, how: Shuffle) -> Column:
    a, b = _sides(n)

    def step(s: Column, j: Column) -> Column:
        side = F.when(j % 2 == 0, F.lit(a)).otherwise(F.lit(b)).cast("bigint")
        return _pair(F.pmod(s["r"] - _round_value(how.seed, j, s["l"]) % side, side), s["l"])

    rounds = F.array(*[F.lit(j) for j in reversed(range(how.rounds))])
    return F.aggregate(rounds, _pair(value % a, _div(value, a)), step, lambda s: s["r"] * a + s["l"])


def _once(value: Column, use) -> Column:
    """``use`` of a value that is computed a single time."""
    return F.transform(F.array(value), use)[0]


def _walked(value: Column, n: int, how: Shuffle, turn) -> Column:
    """``turn`` once, and on along the cycle while the value is outside.

    A cycle meets every outside value at most once, so as many steps as there are
    outside values always end inside; only values still outside after the usual
    steps take that many.
    """
    a, b = _sides(n)

    def walk(start: Column, steps: int) -> Column:
        return F.aggregate(F.sequence(F.lit(1), F.lit(steps)), start.cast("bigint"),
                           lambda x, _: F.when(x < n, x).otherwise(turn(x, n, how)))

    value = turn(value.cast("bigint"), n, how)
    outside = a * b - n
    if not outside:
        return value
    first = walk(value, min(outside, _USUAL_WALK))
    if outside <= _USUAL_WALK:
        return first
    return _once(first, lambda x: F.when(x < n, x).otherwise(walk(x, outside)))


def place(row: Column, n: int, how: Shuffle = Shuffle()) -> Column:
    """``struct<shard int, slot bigint>`` of row number ``row`` out of ``n``."""
    if n < 1:
        return F.lit(None).cast("struct<shard: int, slot: bigint>")
    return _once(_walked(row, n, how, _forward), lambda p: F.struct(
        (p % how.shards).cast("int").alias("shard"), _div(p, how.shards).alias("slot")))


def row_at(shard: Column, slot: Column, n: int, how: Shuffle = Shuffle()) -> Column:
    """Number of the row at a place; NULL where no row is."""
    at = slot.cast("bigint") * how.shards + shard
    there = (shard >= 0) & (shard < how.shards) & (slot >= 0) & (at < n)
    return F.when(there, _walked(at, n, how, _backward) if n else F.lit(None).cast("bigint"))


def numbered(rows: DataFrame, order: Sequence[str], out: str = "row") -> tuple[DataFrame, int]:
    """Rows with their number from 0 in ``order``, which should tell all rows apart, and how many there are.

    One range shuffle; numbers are places inside a sorted partition plus the rows of
    the partitions before it, of which there are as many as tasks.
    """
    ordered = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    name = settle(ordered.select(F.struct("*").alias("rows"), F.monotonically_increasing_id().alias("at")), "numbered")
    name = name.select("rows", F.shiftright("at", _INDEX_BITS).alias("part"),
                       F.col("at").bitwiseAND(F.lit((1 << _INDEX_BITS) - 1)).alias("index"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = settle(name.groupBy("part").agg(F.count(F.lit(1)).alias("n")).select(
        "part", "n", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first")), "offsets")
    n = parts.agg(F.sum("n")).first()[0] or 0
    # broadcast: one row for each task of the sort
    return name.join(F.broadcast(parts.select("part", "first")), "part").select(
        "rows.*", (F.col("first") + F.col("index")).alias(out)), n


def sharded(docs: DataFrame, how: Shuffle = Shuffle(), columns: Sequence[str] | None = None) -> DataFrame:
    """Documents with ``size, text_crc32, row, shard, slot``.

    ``size`` is the UTF-8 length of the text plus 8, ``text_crc32`` its unsigned
    checksum. ``columns`` are those to keep (all by default); the order of rows looks
    at all of them whatever is kept.
    """
    kept = [c for c in (docs.columns if columns is None else columns) if c not in RESULT]
    text = F.coalesce(F.col("text"), F.lit(""))
    others = [F.col(c) for c in docs.columns if c not in ("doc_id", "text")]
    rows = docs.select(
        F.struct(*[F.col(c) for c in kept]).alias("doc"), F.col("doc_id").alias("id"),
        (F.octet_length(text) + 8).cast("bigint").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"),
        F.md5(text.cast("binary")).alias("digest"),
        F.xxhash64(F.col("text").isNull(), F.to_json(F.struct(*others)) if others else F.lit("")).alias("rest"),
        F.monotonically_increasing_id().alias("scan"))
    # the sort samples its input; written first, the texts are read and hashed once
    rows, n = numbered(settle(rows, "digests"), ["id", "digest", "rest", "scan"])
    placed = rows.withColumn("at", place(F.col("row"), n, how))
    return placed.select("doc.*", "size", "text_crc32", "row", "at.shard", "at.slot")


def write_shards(placed: DataFrame, path: str, rows_per_file: int = 100_000) -> None:
    """Write placed rows to ``path/shard=s/part=p``, each file holding ``rows_per_file`` slots in their order."""
    parts = placed.withColumn("part", _div(F.col("slot"), rows_per_file))
    parts.repartition("shard", "part").sortWithinPartitions("shard", "part", "slot").write.partitionBy(
        "shard", "part").parquet(path)
