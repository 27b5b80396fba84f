"""Shaping of host samples from interface, address, counter and disk tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hostloom.functions.netfilter import ipv4_of, is_physical
from hostloom.schemas import COUNTER_FIELDS


def physical_nics(nics: DataFrame) -> DataFrame:
    """Interfaces that are up (``flag_up``) and not virtual (``if_name``)."""
    return nics.filter(F.col("flag_up") & is_physical(F.col("if_name")))


def ipv4_rows(addresses: DataFrame, column: str = "addr") -> DataFrame:
    """Add ``ip`` and keep rows whose CIDR string holds a non-loopback IPv4 address."""
    return addresses.withColumn("ip", ipv4_of(F.col(column))).filter(F.col("ip").isNotNull())


def last_per_key(rows: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """The last row per key in ``order``."""
    rest = [c for c in rows.columns if c not in keys]
    last = rows.groupBy(*keys).agg(
        F.max_by(F.struct(*rest), F.col(order)).alias("_last"))
    return last.select(*keys, *[F.col(f"_last.{c}").alias(c) for c in rest])


def with_counters(nics: DataFrame, counters: DataFrame, keys: Sequence[str],
                  order: str | None = None, fields: Sequence[str] = COUNTER_FIELDS) -> DataFrame:
    """Interfaces with their counters; no counter row means zero.

    ``order`` tells which of several counter rows of a key is the last; without
    it the keys of ``counters`` must be unique.
    """
    right = last_per_key(counters, keys, order) if order else counters
    joined = nics.join(right.select(*keys, *fields), list(keys), "left")
    return joined.select(*nics.columns, *[F.coalesce(F.col(f), F.lit(0)).alias(f) for f in fields])


def with_usage(partitions: DataFrame, usage: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Partitions with their usage; a partition without one is dropped."""
    return partitions.join(usage, list(keys), "inner")


def assemble(scalars: DataFrame, disks: DataFrame, nics: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Host samples from parts: scalar columns, a disk list and an interface list.

    ``keys`` name one sample of one host, so a list is as long as the host has
    disks or interfaces. Both carry ``pos``, their place in the list.
    """
    def listed(parts: DataFrame, name: str) -> DataFrame:
        rest = [c for c in parts.columns if c not in keys]
        item = F.struct(F.col("pos"), *[F.col(c) for c in rest if c != "pos"])
        packed = parts.groupBy(*keys).agg(F.array_sort(F.collect_list(item)).alias(name))
        return packed.withColumn(name, F.transform(name, lambda x: x.dropFields("pos")))

    out = scalars.join(listed(disks, "disk"), list(keys), "left").join(
        listed(nics, "networks"), list(keys), "left")
    for name, parts in (("disk", disks), ("networks", nics)):
        out = out.withColumn(name, F.coalesce(F.col(name), F.array().cast(out.schema[name].dataType)))
    return out
