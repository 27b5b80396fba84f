"""Rules for network interfaces and addresses."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The loopback interface and the name prefixes of virtual ones.
LOOPBACK_NAME = "lo"
VIRTUAL_PREFIXES = (
    "veth", "docker", "br-", "virbr", "vb-", "tun", "tap",
    "cali", "flannel", "cni", "kube", "ovs", "vlan",
)

_OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
_IPV4 = rf"{_OCTET}(?:\.{_OCTET}){{3}}"
_MAPPED_HEX = r"^::ffff:([0-9a-f]{1,4}):([0-9a-f]{1,4})$"


def is_physical(if_name: Column) -> Column:
    """Neither ``lo`` (exact case) nor a virtual prefix (any case)."""
    lower = F.lower(if_name)
    virtual = F.lit(False)
    for prefix in VIRTUAL_PREFIXES:
        virtual = virtual | F.startswith(lower, F.lit(prefix))
    return (if_name != LOOPBACK_NAME) & ~virtual


def ipv4_of(cidr: Column) -> Column:
    """Dotted IPv4 address of a CIDR string, NULL when it has none or is loopback.

    An IPv4-mapped IPv6 address counts as IPv4.
    """
    addr = F.lower(F.substring_index(cidr, "/", 1))
    high = F.conv(F.regexp_extract(addr, _MAPPED_HEX, 1), 16, 10).try_cast("int")
    low = F.conv(F.regexp_extract(addr, _MAPPED_HEX, 2), 16, 10).try_cast("int")
    from_hex = F.concat_ws(
        ".",
        F.shiftright(high, 8).cast("string"), high.bitwiseAND(F.lit(255)).cast("string"),
        F.shiftright(low, 8).cast("string"), low.bitwiseAND(F.lit(255)).cast("string"),
    )
    dotted = F.when(F.rlike(addr, F.lit(_MAPPED_HEX)), from_hex).otherwise(
        F.regexp_replace(addr, "^::ffff:", ""))
    return F.when(F.rlike(dotted, F.lit(f"^{_IPV4}$")) & ~F.startswith(dotted, F.lit("127.")), dotted)


def ipv4_addresses(cidrs: Column) -> Column:
    """IPv4 addresses of an array of CIDR strings, order and duplicates kept."""
    return F.filter(F.transform(F.coalesce(cidrs, F.array().cast("array<string>")), ipv4_of),
                    lambda a: a.isNotNull())
