"""Row shapes that cross a boundary: files, Kafka, tables, JSON text.

Schemas are always given to readers and parsers; nothing is inferred.
Unsigned 64-bit counters are decimal(20,0), since a bigint cannot hold 2^64-1.
"""

from __future__ import annotations

from pyspark.sql import types as T

UINT64 = T.DecimalType(20, 0)
UINT64_MAX = 18446744073709551615

COUNTER_FIELDS = (
    "rx_bytes", "tx_bytes", "rx_packets", "tx_packets",
    "rx_errors", "tx_errors", "rx_fifo", "tx_fifo",
)

DISK = T.StructType([
    T.StructField("mountpoint", T.StringType()),
    T.StructField("used_percent", T.DoubleType()),
])

NIC = T.StructType([
    T.StructField("mac", T.StringType()),
    T.StructField("ips", T.ArrayType(T.StringType())),
    T.StructField("if_name", T.StringType()),
    *[T.StructField(name, UINT64) for name in COUNTER_FIELDS],
])

STATS = T.StructType([
    T.StructField("cpu", T.DoubleType()),
    T.StructField("memory", T.DoubleType()),
    T.StructField("disk", T.ArrayType(DISK)),
    T.StructField("networks", T.ArrayType(NIC)),
    T.StructField("uptime", T.StringType()),
    T.StructField("hostname", T.StringType()),
    T.StructField("os", T.StringType()),
    T.StructField("arch", T.StringType()),
    T.StructField("kernel", T.StringType()),
])

PAYLOAD = T.StructType([
    T.StructField("PluginName", T.StringType()),
    T.StructField("EventName", T.StringType()),
    T.StructField("Data", STATS),
])

ENVELOPE = T.StructType([
    T.StructField("seq", T.LongType()),
    T.StructField("arrival_ts", T.TimestampNTZType()),
    T.StructField("conn_id", T.StringType()),
    T.StructField("client_id", T.StringType()),
    T.StructField("headers", T.MapType(T.StringType(), T.StringType())),
    T.StructField("payload", T.BinaryType()),
])

CHANGE = T.StructType([
    T.StructField("rev", T.LongType()),
    T.StructField("ts", T.TimestampNTZType()),
    T.StructField("svc_key", T.StringType()),
    T.StructField("op", T.StringType()),
    T.StructField("val", T.StringType()),
    T.StructField("ttl_s", T.LongType()),
])

SNAPSHOT = T.StructType([
    T.StructField("id", T.LongType()),
    T.StructField("machine_id", T.StringType()),
    T.StructField("host_name", T.StringType()),
    T.StructField("ips", T.StringType()),
    T.StructField("stats", T.StringType()),
    T.StructField("created_at", T.TimestampNTZType()),
    T.StructField("updated_at", T.TimestampNTZType()),
    T.StructField("deleted_at", T.TimestampNTZType()),
    # recency of samples that came at one instant
    T.StructField("seq", T.LongType()),
])

SERVICE_ENDPOINT = T.StructType([
    T.StructField("host", T.StringType()),
    T.StructField("port", T.IntegerType()),
])

SERVICE_INFO = T.StructType([
    T.StructField("id", T.StringType()),
    T.StructField("name", T.StringType()),
    T.StructField("nice", T.IntegerType()),
    T.StructField("ips", T.ArrayType(T.StringType())),
    T.StructField("listen_address", SERVICE_ENDPOINT),
    T.StructField("probe_endpoint", SERVICE_ENDPOINT),
    T.StructField("start_time", T.StringType()),
    T.StructField("uptime", T.StringType()),
    T.StructField("updated_at", T.StringType()),
])

SAMPLE = T.StructType([
    T.StructField("metric", T.StringType()),
    T.StructField("labels", T.MapType(T.StringType(), T.StringType())),
    T.StructField("value", T.DoubleType()),
])

OUTCOME = T.StructType([
    T.StructField("sink_type", T.StringType()),
    T.StructField("status", T.StringType()),
    T.StructField("rows", T.LongType()),
    T.StructField("bytes", T.LongType()),
    T.StructField("error", T.StringType()),
])
