"""Hashes and time-ordered ids as bigint expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# FNV-1a with 64 bits. The prime is 2^40 + FNV_PRIME_LOW.
FNV_OFFSET_HIGH = 0xCBF29CE4
FNV_OFFSET_LOW = 0x84222325
FNV_PRIME_LOW = 0x1B3

# Id layout, high to low: milliseconds, machine, sequence.
TIME_BITS = 41
MACHINE_BITS = 10
SEQUENCE_BITS = 12
MAX_MACHINE = (1 << MACHINE_BITS) - 1
MAX_SEQUENCE = (1 << SEQUENCE_BITS) - 1
# Fixed value: 2024-08-01T00:00:00Z, the default epoch.
EPOCH_MS = 1722470400000

_LOW32 = 0xFFFFFFFF


def hash_bits(text: Column, bits: int) -> Column:
    """First 8 bytes of SHA-256 XOR FNV-1a of the digest, cut to the low ``bits`` (1–63).

    The 64-bit state is kept as two 32-bit halves, so no product leaves a bigint.
    """
    if not 1 <= bits <= 63:
        raise ValueError("bits must be between 1 and 63")
    digest = F.sha2(text.cast("binary"), 256)

    def number(start, length) -> Column:
        return F.conv(F.substring(digest, F.lit(start) if isinstance(start, int) else start,
                                  F.lit(length)), 16, 10).cast("bigint")

    def step(acc: Column, i: Column) -> Column:
        low = acc["low"].bitwiseXOR(number((i * 2 + 1).cast("int"), 2))
        product = low * FNV_PRIME_LOW
        return F.struct(
            (acc["high"] * FNV_PRIME_LOW + F.shiftright(product, 32) + F.shiftleft(low, 8))
            .bitwiseAND(F.lit(_LOW32)).alias("high"),
            product.bitwiseAND(F.lit(_LOW32)).alias("low"),
        )

    fnv = F.aggregate(
        F.sequence(F.lit(0), F.lit(31)),
        F.struct(F.lit(FNV_OFFSET_HIGH).cast("bigint").alias("high"),
                 F.lit(FNV_OFFSET_LOW).cast("bigint").alias("low")),
        step,
        lambda acc: F.shiftleft(acc["high"], 32).bitwiseOR(acc["low"]),
    )
    head = F.shiftleft(number(1, 8), 32).bitwiseOR(number(9, 8))
    return head.bitwiseXOR(fnv).bitwiseAND(F.lit((1 << bits) - 1).cast("bigint"))


def encode_id(unix_ms: Column, machine: Column, sequence: Column, epoch_ms: int = EPOCH_MS) -> Column:
    """Time-ordered id; NULL when the machine number does not fit its bits."""
    value = (
        F.shiftleft(unix_ms - F.lit(epoch_ms), MACHINE_BITS + SEQUENCE_BITS)
        .bitwiseOR(F.shiftleft(machine.cast("bigint"), SEQUENCE_BITS))
        .bitwiseOR(sequence.cast("bigint").bitwiseAND(F.lit(MAX_SEQUENCE)))
    )
    return F.when(machine.between(0, MAX_MACHINE), value)


def decode_id(value: Column, epoch_ms: int = EPOCH_MS) -> Column:
    """``struct<unix_ms, machine, sequence>`` of an id."""
    return F.struct(
        (F.shiftrightunsigned(value, MACHINE_BITS + SEQUENCE_BITS) + F.lit(epoch_ms)).alias("unix_ms"),
        F.shiftrightunsigned(value, SEQUENCE_BITS).bitwiseAND(F.lit(MAX_MACHINE)).alias("machine"),
        value.bitwiseAND(F.lit(MAX_SEQUENCE)).alias("sequence"),
    )
