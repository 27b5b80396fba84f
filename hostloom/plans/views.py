"""The inputs of the registered queries, derived from the test tables.

Each view is a plain projection of one table, so filters and column pruning
reach the Parquet scan below it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from hostloom.schemas import CHANGE, ENVELOPE
from hostloom.sources.mapping import ColumnMapping

ENVELOPE_KIND = """
CASE WHEN event_id % 101 = 0 THEN 'greeting'
     WHEN event_id % 83 = 0 THEN 'empty'
     WHEN event_id % 89 = 0 THEN 'malformed'
     WHEN event_type = 'signup' THEN 'heartbeat'
     WHEN event_id % 97 = 0 THEN 'no_client'
     WHEN event_id % 79 = 0 THEN 'null_data'
     ELSE 'host' END
"""

NIC1 = """
CASE WHEN event_id % 3 >= 1 THEN '{"mac":"aa:01","ips":["10.1.0.' || CAST(event_id % 250 AS STRING)
  || '"],"if_name":"eth1","rx_bytes":' || CAST(event_id * 1000 + 1 AS STRING) || '}' ELSE '' END
"""

NIC2 = """
CASE WHEN event_id % 3 = 2 THEN ',{"mac":"aa:02","ips":["10.2.0.' || CAST(event_id % 250 AS STRING)
  || '","10.2.1.1"],"if_name":"eth2","rx_bytes":' || CAST(event_id * 1000 + 2 AS STRING) || '}' ELSE '' END
"""

HOST_PAYLOAD = """
'{"PluginName":"host","EventName":"","Data":{"cpu":' || CAST(value AS STRING)
  || ',"memory":' || CAST(event_id % 100 AS STRING)
  || ',"disk":[{"mountpoint":"/","used_percent":' || CAST(user_id % 100 AS STRING)
  || '},{"mountpoint":"/data","used_percent":' || CAST(event_id % 100 AS STRING) || '}]'
  || ',"networks":[' || nic1 || nic2 || ']'
  || ',"uptime":"' || CAST(event_id % 60 AS STRING) || 'm","hostname":"node-' || CAST(user_id AS STRING)
  || '","os":"linux 1","arch":"x86_64","kernel":"6.1"}}'
"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dealt(rows: DataFrame) -> DataFrame:
    """Rows over as many tasks as ``spark.hostloom.view.partitions`` says; as they are where it is unset."""
    n = rows.sparkSession.conf.get("spark.hostloom.view.partitions", None)
    return rows.repartition(int(n)) if n else rows


EVENT_COLUMNS = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"

ENVELOPES = ColumnMapping(
    EVENT_COLUMNS,
    derived={"kind": ENVELOPE_KIND, "nic1": NIC1, "nic2": NIC2},
    columns={
        "seq": "event_id",
        "arrival_ts": "ts",
        "conn_id": "'10.0.0.' || CAST(user_id % 4 AS STRING) || ':5000#' || CAST(user_id % 8 AS STRING)",
        "client_id": "CASE WHEN kind IN ('greeting', 'no_client') THEN '' ELSE 'host-' || CAST(user_id AS STRING) END",
        "headers": "map('kind', kind)",
        "payload": f"""CASE WHEN kind IN ('greeting', 'empty') THEN ''
              WHEN kind = 'malformed' THEN '{{bad'
              WHEN kind = 'heartbeat' THEN '{{"PluginName":"file","EventName":"file","Data":null}}'
              WHEN kind = 'null_data' THEN '{{"PluginName":"host","EventName":"","Data":null}}'
              ELSE {HOST_PAYLOAD} END""",
    })


def as_envelopes(events: DataFrame) -> DataFrame:
    """Events as envelopes; works on a batch or a streaming DataFrame."""
    return ENVELOPES.apply(events, ENVELOPE)


def envelopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_envelopes(dealt(table(spark, sf_dir, "events")))


def nics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").selectExpr(
        "p_partkey AS nic_id", "p_partkey % 50 AS host", "p_size % 5 <> 0 AS flag_up",
        """CASE p_partkey % 15 WHEN 0 THEN 'lo' WHEN 1 THEN 'eth0' WHEN 2 THEN 'Docker0' WHEN 3 THEN 'veth1'
             WHEN 4 THEN 'br-1' WHEN 5 THEN 'bridge0' WHEN 6 THEN 'VLAN10' WHEN 7 THEN 'ens3' WHEN 8 THEN 'wlan0'
             WHEN 9 THEN 'tun0' WHEN 10 THEN 'cali9' WHEN 11 THEN 'LO' WHEN 12 THEN 'cni0' WHEN 13 THEN 'bond0'
             ELSE 'virbr0' END AS if_name""",
        """CASE p_partkey % 4 WHEN 0 THEN '127.0.0.1/8' WHEN 1 THEN '10.0.0.' || CAST(p_partkey % 250 AS STRING) || '/24'
             WHEN 2 THEN 'fe80::1/64' ELSE '::ffff:10.9.8.7/128' END AS addr""",
    )


def counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").filter("p_partkey % 3 <> 0").selectExpr(
        "p_partkey % 50 AS host", "p_partkey AS nic_id", "CAST(p_size AS BIGINT) * 1000 AS rx_bytes")


def gauge_ops(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").selectExpr(
        "user_id AS series", "event_id AS seq",
        "CASE event_type WHEN 'signup' THEN 'set' WHEN 'click' THEN 'inc' "
        "WHEN 'view' THEN 'dec' ELSE 'add' END AS op",
        "value")


def counter_deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").selectExpr(
        "l_returnflag AS sink_type", "l_linestatus AS status", "l_quantity AS delta")


ORDER_COLUMNS = "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_orderdate timestamp_ntz"

CHANGES = ColumnMapping(
    ORDER_COLUMNS,
    columns={
        # revisions rise with time
        "rev": "CAST(datediff(CAST(o_orderdate AS DATE), DATE'1992-01-01') AS BIGINT) * 10000000 + o_orderkey",
        "ts": "o_orderdate",
        "svc_key": "'/registry/' || CASE WHEN o_custkey % 3 = 0 THEN 'databus' WHEN o_custkey % 3 = 1 THEN 'controller' "
                   "ELSE 'admin' END || '/self/' || CAST(o_custkey AS STRING)",
        "op": "CASE WHEN o_orderstatus = 'F' THEN 'DELETE' ELSE 'PUT' END",
        "val": "CASE WHEN o_orderstatus = 'F' THEN '' ELSE 'tcp://10.0.0.' || CAST(o_custkey % 250 AS STRING) || ':' "
               "|| CAST(1024 + o_orderkey % 60000 AS STRING) END",
        "ttl_s": "CASE WHEN o_custkey % 5 = 0 THEN NULL ELSE 86400 * (1 + o_custkey % 400) END",
    })


def as_changes(orders: DataFrame) -> DataFrame:
    return CHANGES.apply(orders, CHANGE)


def changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_changes(table(spark, sf_dir, "orders"))


def endpoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "supplier").selectExpr(
        "s_suppkey AS id",
        """CASE s_suppkey % 8 WHEN 0 THEN 'tcp://10.0.0.1:' || CAST(s_suppkey + 1 AS STRING)
             WHEN 1 THEN 'http://localhost:80' WHEN 2 THEN 'tcp://[::1]:8080' WHEN 3 THEN '127.0.0.1:8080'
             WHEN 4 THEN 'tcp://127.0.0.1' WHEN 5 THEN 'tcp://127.0.0.1:65536' WHEN 6 THEN 'tcp://[::1:8080'
             ELSE 'tcp://:8080' END AS input""")


def conn_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").selectExpr(
        "event_id AS seq", "ts", "user_id % 8 AS listener", "user_id AS client",
        "CASE event_type WHEN 'signup' THEN 'open' WHEN 'error' THEN 'close' ELSE 'message' END AS what",
        "CASE WHEN event_id % 4 = 0 THEN '' ELSE 'host-' || CAST(user_id AS STRING) END AS client_id")


def access_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dealt(table(spark, sf_dir, "events").select("event_id", "event_type", "user_id")).selectExpr(
        "event_id AS seq",
        """CASE WHEN event_type = 'purchase' THEN 'POST' ELSE 'GET' END || ' /api/' || event_type || ' 10.0.0.'
             || CAST(user_id % 250 AS STRING) || ' ' || CASE WHEN event_type = 'error' THEN '500' ELSE '200' END
             || ' ' || CAST(event_id % 900 + 1 AS STRING) || 'ms' AS line""")


def statement_trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").selectExpr(
        "event_id AS seq", "value * 4 AS elapsed_ms",
        "CASE WHEN event_id % 50 = 0 THEN 'record not found' WHEN event_id % 37 = 0 THEN 'deadlock' "
        "ELSE NULL END AS err")
