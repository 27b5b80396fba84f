"""What each registered query must return, as SQL over the raw tables.

The expected rows come from the raw columns (kind, value, user_id …), not from
the JSON text the queries parse.
"""

from __future__ import annotations

from hostloom.plans.views import ENVELOPE_KIND, HOST_PAYLOAD, NIC1, NIC2

_E = f"e AS (SELECT *, {ENVELOPE_KIND} AS kind, {NIC1} AS nic1, {NIC2} AS nic2 FROM events)"

_CLIENT = "CASE WHEN kind IN ('greeting', 'no_client') THEN '' ELSE 'host-' || user_id END"

_PAYLOAD = f"""CASE WHEN kind IN ('greeting', 'empty') THEN '' WHEN kind = 'malformed' THEN '{{bad'
  WHEN kind = 'heartbeat' THEN '{{"PluginName":"file","EventName":"file","Data":null}}'
  WHEN kind = 'null_data' THEN '{{"PluginName":"host","EventName":"","Data":null}}'
  ELSE {HOST_PAYLOAD} END"""

_V = f"""{_E}, v AS (SELECT *, event_id AS seq, {_CLIENT} AS client_id, {_PAYLOAD} AS payload FROM e)"""

_IPS = """CASE event_id % 3 WHEN 0 THEN '' WHEN 1 THEN '10.1.0.' || event_id % 250
  ELSE '10.1.0.' || event_id % 250 || ',10.2.0.' || event_id % 250 || ',10.2.1.1' END"""

_LATEST = f"""WITH {_E}, h AS (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn,
    min(ts) OVER (PARTITION BY user_id) AS first_ts FROM e WHERE kind = 'host')
SELECT 'host-' || user_id AS machine_id, 'node-' || user_id AS host_name, {_IPS} AS ips,
  value AS cpu, CAST(event_id % 100 AS DOUBLE) AS memory, event_id % 3 AS nics,
  first_ts AS created_at, ts AS updated_at FROM h WHERE rn = 1"""

_CHANGES = """c AS (SELECT date_diff('day', DATE '1992-01-01', CAST(o_orderdate AS DATE)) * 10000000 + o_orderkey AS rev, o_orderdate AS ts,
  '/registry/' || CASE WHEN o_custkey % 3 = 0 THEN 'databus' WHEN o_custkey % 3 = 1 THEN 'controller' ELSE 'admin' END
    || '/self/' || o_custkey AS svc_key, o_custkey AS cust,
  CASE WHEN o_orderstatus = 'F' THEN 'DELETE' ELSE 'PUT' END AS op,
  CASE WHEN o_orderstatus = 'F' THEN '' ELSE 'tcp://10.0.0.' || o_custkey % 250 || ':' || (1024 + o_orderkey % 60000) END AS val,
  CASE WHEN o_custkey % 5 = 0 THEN NULL ELSE 86400 * (1 + o_custkey % 400) END AS ttl_s FROM orders)"""

_CURRENT = f"""{_CHANGES}, s AS (SELECT * FROM (
  SELECT *, row_number() OVER (PARTITION BY svc_key ORDER BY rev DESC) AS rn FROM c) WHERE rn = 1 AND op = 'PUT')"""

_CONN = """c AS (SELECT event_id AS seq, ts, user_id % 8 AS listener, user_id AS client,
  CASE event_type WHEN 'signup' THEN 'open' WHEN 'error' THEN 'close' ELSE 'message' END AS what,
  CASE WHEN event_id % 4 = 0 THEN '' ELSE 'host-' || user_id END AS client_id FROM events)"""

_DELTAS = f"""{_CONN}, d AS (
  SELECT *, CASE WHEN what = 'open' AND coalesce(before, '') <> 'open' THEN 1
                 WHEN what = 'close' AND before = 'open' THEN -1 ELSE 0 END AS delta
  FROM (SELECT *, lag(what) OVER (PARTITION BY client ORDER BY seq) AS before FROM c WHERE what <> 'message'))"""

_SESSIONS = f"""{_CONN},
 t AS (SELECT *, lead(what) OVER w AS own_what, lead(seq) OVER w AS own_seq, lead(ts) OVER w AS own_ts
   FROM c WHERE what <> 'message' WINDOW w AS (PARTITION BY client ORDER BY seq)),
 o AS (SELECT *, CASE WHEN client_id = '' THEN 'client-' || seq ELSE client_id END AS cid FROM t WHERE what = 'open'),
 n AS (SELECT o.*, (SELECT min(x.seq) FROM o x WHERE x.cid = o.cid AND x.seq > o.seq) AS new_seq FROM o),
 s AS (SELECT n.seq, n.cid, n.ts,
     CASE WHEN own_seq <= coalesce(new_seq, own_seq) THEN own_ts ELSE e.ts END AS ended_at,
     CASE WHEN own_what = 'close' AND own_seq <= coalesce(new_seq, own_seq) THEN 'closed'
          WHEN own_seq IS NOT NULL OR new_seq IS NOT NULL THEN 'superseded' END AS ended_by
   FROM n LEFT JOIN c e ON e.seq = n.new_seq)"""

_LIVE = f"""{_CHANGES}, s AS (SELECT *, ts + to_days(CAST(ttl_s // 86400 AS INTEGER)) AS expires_at FROM (
  SELECT *, row_number() OVER (PARTITION BY svc_key ORDER BY rev DESC) AS rn FROM c WHERE ts <= TIMESTAMP '1996-07-01')
  WHERE rn = 1 AND op = 'PUT' AND (ttl_s IS NULL OR ts + to_days(CAST(ttl_s // 86400 AS INTEGER)) >= TIMESTAMP '1996-07-01'))"""

_PHYSICAL = """p_size % 5 <> 0 AND p_partkey % 15 IN (1, 5, 7, 8, 11, 13)"""

_NIC_NAME = """CASE p_partkey % 15 WHEN 0 THEN 'lo' WHEN 1 THEN 'eth0' WHEN 2 THEN 'Docker0' WHEN 3 THEN 'veth1'
  WHEN 4 THEN 'br-1' WHEN 5 THEN 'bridge0' WHEN 6 THEN 'VLAN10' WHEN 7 THEN 'ens3' WHEN 8 THEN 'wlan0'
  WHEN 9 THEN 'tun0' WHEN 10 THEN 'cali9' WHEN 11 THEN 'LO' WHEN 12 THEN 'cni0' WHEN 13 THEN 'bond0' ELSE 'virbr0' END"""

_EVENT_ID = "((epoch_us(ts) // 1000 - 1704067200000) << 22) | (user_id << 12) | (event_id % 4096)"

_UPTIME = """CASE WHEN {s} >= 86400 THEN {s} // 86400 || 'd' || ({s} // 3600) % 24 || 'h' || ({s} // 60) % 60 || 'm'
  WHEN {s} >= 3600 THEN {s} // 3600 || 'h' || ({s} // 60) % 60 || 'm' ELSE {s} // 60 || 'm' END"""

_FNV = """xor(CAST(('0x' || substr(h, 1, 16)) AS UBIGINT)::HUGEINT, list_reduce(
  list_prepend(14695981039346656037::HUGEINT, list_transform(range(0, 32), lambda i: CAST(('0x' || substr(h, 2 * i + 1, 2)) AS HUGEINT))),
  lambda a, b: (xor(a, b) * 1099511628211::HUGEINT) % 18446744073709551616::HUGEINT))"""

_RECORD_LINES = """SELECT family, place, line FROM (VALUES
  ('databus_records_written_total', 0, '# HELP databus_records_written_total Records written by sink and status.'),
  ('databus_records_written_total', 1, '# TYPE databus_records_written_total counter'),
  ('admin_info', 0, '# HELP admin_info Version of the service.'), ('admin_info', 1, '# TYPE admin_info gauge'),
  ('admin_info', 2, 'admin_info{version="v1"} 1'),
  ('databus_batch_size', 0, '# HELP databus_batch_size Rows in a batch.'), ('databus_batch_size', 1, '# TYPE databus_batch_size histogram'),
  ('databus_queue_length', 0, '# HELP databus_queue_length Rows waiting.'), ('databus_queue_length', 1, '# TYPE databus_queue_length summary')
  ) h(family, place, line)
UNION ALL SELECT 'databus_records_written_total', 2, 'databus_records_written_total{sink_type="' || l_returnflag || '",status="' || l_linestatus || '"} '
  || CAST(sum(l_quantity) AS BIGINT) FROM lineitem GROUP BY l_returnflag, l_linestatus
UNION ALL SELECT 'databus_batch_size', 2, 'databus_batch_size_bucket{l_returnflag="' || l_returnflag || '",le="' || le || '"} '
  || count(*) FILTER (WHERE l_quantity <= bound) FROM lineitem, (VALUES ('10', 10.0), ('25', 25.0), ('+Inf', 1e300)) b(le, bound)
  GROUP BY l_returnflag, le
UNION ALL SELECT 'databus_batch_size', 2, 'databus_batch_size_sum{l_returnflag="' || l_returnflag || '"} ' || CAST(sum(l_quantity) AS BIGINT)
  FROM lineitem GROUP BY l_returnflag
UNION ALL SELECT 'databus_batch_size', 2, 'databus_batch_size_count{l_returnflag="' || l_returnflag || '"} ' || count(*)
  FROM lineitem GROUP BY l_returnflag
UNION ALL SELECT 'databus_queue_length', 2, 'databus_queue_length{l_linestatus="' || l_linestatus || '",quantile="0.5"} '
  || CAST(quantile_disc(l_quantity, 0.5) AS BIGINT) FROM lineitem GROUP BY l_linestatus
UNION ALL SELECT 'databus_queue_length', 2, 'databus_queue_length{l_linestatus="' || l_linestatus || '",quantile="0.9"} '
  || CAST(quantile_disc(l_quantity, 0.9) AS BIGINT) FROM lineitem GROUP BY l_linestatus
UNION ALL SELECT 'databus_queue_length', 2, 'databus_queue_length_sum{l_linestatus="' || l_linestatus || '"} ' || CAST(sum(l_quantity) AS BIGINT)
  FROM lineitem GROUP BY l_linestatus
UNION ALL SELECT 'databus_queue_length', 2, 'databus_queue_length_count{l_linestatus="' || l_linestatus || '"} ' || count(*)
  FROM lineitem GROUP BY l_linestatus"""

ORACLES = {
    "src_envelopes": f"""WITH {_V} SELECT seq, ts AS arrival_ts,
  '10.0.0.' || user_id % 4 || ':5000#' || user_id % 8 AS conn_id, client_id, payload FROM v""",
    "src_union": f"""WITH {_V} SELECT seq, '10.0.0.' || user_id % 4 || ':5000#' || user_id % 8 AS conn_id, client_id FROM v""",
    "src_changes": f"WITH {_CHANGES} SELECT rev, ts, svc_key, op, val, CAST(ttl_s AS BIGINT) AS ttl_s FROM c",
    "snk_kafka_rows": f"WITH {_V} SELECT client_id AS key, payload AS value FROM v WHERE payload <> ''",
    "snk_upsert": _LATEST,
    "snk_fanout_counts": f"""WITH {_V}, r AS (SELECT * FROM v WHERE kind <> 'greeting')
SELECT 'kafka' AS sink_type, 'success' AS status, count(*) AS rows, CAST(sum(strlen(payload)) AS BIGINT) AS bytes FROM r WHERE payload <> ''
UNION ALL SELECT 'broken', 'error', count(*), CAST(sum(strlen(payload)) AS BIGINT) FROM r
UNION ALL SELECT 'mysql', 'success', count(*), CAST(sum(strlen(payload)) AS BIGINT) FROM r WHERE kind = 'host'
UNION ALL SELECT 'quarantine', 'success', count(*), CAST(sum(strlen(payload)) AS BIGINT) FROM r WHERE kind <> 'host'""",
    "flt_greeting": f"WITH {_V} SELECT seq, client_id FROM v WHERE kind <> 'greeting'",
    "flt_empty_payload": f"WITH {_V} SELECT seq, client_id FROM v WHERE kind NOT IN ('greeting', 'empty')",
    "flt_malformed": f"WITH {_V} SELECT seq, client_id FROM v WHERE kind NOT IN ('greeting', 'empty', 'malformed')",
    "flt_plugin": f"WITH {_V} SELECT seq, client_id FROM v WHERE kind IN ('host', 'no_client', 'null_data')",
    "flt_no_client": f"WITH {_V} SELECT seq, client_id FROM v WHERE kind NOT IN ('greeting', 'no_client')",
    "flt_null_data": f"WITH {_V} SELECT seq, client_id FROM v WHERE kind IN ('host', 'no_client')",
    "flt_reasons": f"""WITH {_E} SELECT CASE kind WHEN 'greeting' THEN 'empty_payload' WHEN 'empty' THEN 'empty_payload'
  WHEN 'heartbeat' THEN 'plugin' WHEN 'host' THEN 'accepted' ELSE kind END AS reason, count(*) AS n FROM e GROUP BY 1""",
    "flt_physical_nic": f"""SELECT p_partkey AS nic_id, p_partkey % 50 AS host, {_NIC_NAME} AS if_name FROM part WHERE {_PHYSICAL}""",
    "flt_ipv4": """SELECT p_partkey AS nic_id, CASE p_partkey % 4 WHEN 1 THEN '10.0.0.' || p_partkey % 250 ELSE '10.9.8.7' END AS ip
FROM part WHERE p_partkey % 4 IN (1, 3)""",
    "flt_size_cap": "SELECT doc_id, CAST(strlen(text) AS BIGINT) AS n_bytes FROM documents WHERE strlen(text) <= 2000",
    "flt_slow_sql": """SELECT * FROM (SELECT event_id AS seq, CASE WHEN event_id % 50 <> 0 AND event_id % 37 = 0 THEN 'error'
  WHEN value * 4 > 200 THEN 'slow' END AS label FROM events) WHERE label IS NOT NULL""",
    "jsn_encode": f"""SELECT event_id, CASE WHEN event_type = 'signup' THEN '{{"PluginName":"file","EventName":"file","Data":null}}'
  ELSE '{{"PluginName":"host","EventName":"","Data":{{"cpu":' || value || ',"memory":' || event_id % 100
  || '.0,"disk":[{{"mountpoint":"/","used_percent":' || user_id % 100 || '.0}}],"networks":[],"uptime":"' || {_UPTIME.format(s="event_id")}
  || '","hostname":"node-' || user_id || '","os":"linux 1","arch":"x86_64","kernel":"6.1"}}}}' END AS payload FROM events""",
    "jsn_decode": f"""WITH {_E} SELECT event_id AS seq, value AS cpu, CAST(event_id % 100 AS DOUBLE) AS memory,
  event_id % 60 || 'm' AS uptime, 'node-' || user_id AS hostname, 'linux 1' AS os, 'x86_64' AS arch, '6.1' AS kernel,
  CAST(2 AS BIGINT) AS disks, event_id % 3 AS nics FROM e WHERE kind = 'host'""",
    "jsn_nullable": """SELECT event_id, CASE WHEN event_id % 10 IN (0, 1) THEN NULL WHEN event_id % 10 = 2 THEN 0 ELSE k END AS scanned_k,
  CASE WHEN event_id % 10 IN (0, 1, 2) THEN NULL ELSE k END AS unmarshalled_k,
  CASE WHEN event_id % 10 IN (0, 1) THEN NULL WHEN event_id % 10 = 2 THEN '{"k":0}' ELSE '{"k":' || k || '}' END AS stored,
  CASE WHEN event_id % 10 IN (0, 1, 2) THEN 'null' ELSE '{"k":' || k || '}' END AS sent
FROM (SELECT event_id, CAST(regexp_extract(props, '[0-9]+') AS BIGINT) AS k FROM events)""",
    "jsn_service_info": """SELECT s_suppkey, '{"id":"svc-' || s_suppkey || '","name":"' || s_name || '","nice":' || s_nationkey || ',"ips":'
  || CASE WHEN s_suppkey % 4 <> 0 THEN '["10.0.0.1"]' ELSE 'null' END
  || CASE WHEN s_suppkey % 3 <> 0 THEN ',"listen_address":{"host":"10.0.0.1","port":' || (s_suppkey % 60000 + 1) || '}' ELSE '' END
  || ',"start_time":"2024-01-01T00:00:00Z","uptime":"1h","updated_at":"2024-01-01T00:00:00Z"}' AS json, s_name AS name,
  CASE WHEN s_suppkey % 3 <> 0 THEN s_suppkey % 60000 + 1 END AS port FROM supplier""",
    "arr_ips": f"WITH {_E} SELECT event_id AS seq, {_IPS} AS ips FROM e WHERE kind = 'host'",
    "arr_disks": f"""WITH {_E} SELECT event_id AS seq, 'host-' || user_id AS machine_id, '/' AS mountpoint,
  CAST(user_id % 100 AS DOUBLE) AS used_percent FROM e WHERE kind = 'host'
UNION ALL SELECT event_id, 'host-' || user_id, '/data', CAST(event_id % 100 AS DOUBLE) FROM e WHERE kind = 'host'""",
    "arr_nics": f"""WITH {_E} SELECT event_id AS seq, 'host-' || user_id AS machine_id, 'aa:01' AS mac, 'eth1' AS if_name,
  '10.1.0.' || event_id % 250 AS ips, event_id * 1000 + 1 AS rx_bytes, CAST(0 AS BIGINT) AS tx_bytes
  FROM e WHERE kind = 'host' AND event_id % 3 >= 1
UNION ALL SELECT event_id, 'host-' || user_id, 'aa:02', 'eth2', '10.2.0.' || event_id % 250 || ',10.2.1.1',
  event_id * 1000 + 2, 0 FROM e WHERE kind = 'host' AND event_id % 3 = 2""",
    "arr_zero_stats": f"""WITH {_E} SELECT event_id AS seq, CASE WHEN d THEN value ELSE 0.0 END AS cpu,
  CASE WHEN d THEN CAST(event_id % 100 AS DOUBLE) ELSE 0.0 END AS memory, CASE WHEN d THEN 'node-' || user_id ELSE '' END AS hostname,
  CAST(CASE WHEN d THEN 2 ELSE 0 END AS BIGINT) AS disks, CASE WHEN d THEN event_id % 3 ELSE 0 END AS nics
FROM (SELECT *, kind IN ('host', 'no_client') AS d FROM e WHERE kind NOT IN ('greeting', 'empty', 'malformed'))""",
    "arr_assemble": """WITH p AS (SELECT p_partkey % 50 AS host, p_partkey // 400 AS sample, p_partkey // 50 % 8 AS pos, p_partkey, p_size FROM part)
SELECT host, sample, max(p_size) AS cpu,
  coalesce(string_agg('/d' || pos || '=' || p_size, ',' ORDER BY pos) FILTER (WHERE pos < 3), '') AS disks,
  coalesce(string_agg('eth' || pos || '=' || p_partkey, ',' ORDER BY pos) FILTER (WHERE pos >= 3), '') AS nics
FROM p GROUP BY host, sample""",
    "str_endpoint_parse": """SELECT s_suppkey AS id, CASE k WHEN 0 THEN 'tcp' WHEN 1 THEN 'http' WHEN 2 THEN 'tcp' END AS protocol,
  CASE k WHEN 0 THEN '10.0.0.1' WHEN 1 THEN 'localhost' WHEN 2 THEN '::1' END AS host,
  CASE k WHEN 0 THEN s_suppkey + 1 WHEN 1 THEN 80 WHEN 2 THEN 8080 END AS port,
  CASE WHEN k = 0 AND s_suppkey + 1 > 65535 THEN 'port out of range' WHEN k = 3 THEN 'missing ''://''' WHEN k = 4 THEN 'missing port'
    WHEN k = 5 THEN 'port out of range' WHEN k = 6 THEN 'missing '']''' WHEN k = 7 THEN 'empty host' END AS reason
FROM (SELECT s_suppkey, s_suppkey % 8 AS k FROM supplier)""",
    "str_endpoint_format": """SELECT s_suppkey AS id, CASE k WHEN 0 THEN 'tcp://10.0.0.1:' || (s_suppkey + 1) WHEN 1 THEN 'http://localhost:80'
  ELSE 'tcp://[::1]:8080' END AS endpoint, CASE k WHEN 0 THEN '10.0.0.1:' || (s_suppkey + 1) WHEN 1 THEN 'localhost:80'
  ELSE '[::1]:8080' END AS host_port FROM (SELECT s_suppkey, s_suppkey % 8 AS k FROM supplier) WHERE k < 3""",
    "str_registry_key": """SELECT s_suppkey, root || '/self/' || s_suppkey AS self_key, root || '/mutex/' || s_suppkey AS mutex_key,
  root || '/election/leader/' || s_suppkey AS election_key,
  CASE WHEN s_suppkey % 3 IN (0, 1) THEN root || '/' || s_suppkey END AS child_key
FROM (SELECT s_suppkey, CASE WHEN s_nationkey % 3 <> 0 THEN '/registry/databus' ELSE '/registry' END AS root FROM supplier)""",
    "str_os_label": """SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN 'linux' WHEN p_partkey % 4 = 0 THEN p_brand
  ELSE p_brand || ' ' || p_size END AS os FROM part""",
    "str_conn_id": "SELECT event_id, '10.0.0.' || user_id % 4 || ':5000#' || (event_id + 1) AS conn_id FROM events",
    "str_access_log": """SELECT event_id AS seq, CASE WHEN event_type = 'purchase' THEN 'POST' ELSE 'GET' END AS method,
  '/api/' || event_type AS path, '10.0.0.' || user_id % 250 AS client_ip,
  CAST(CASE WHEN event_type = 'error' THEN 500 ELSE 200 END AS BIGINT) AS status,
  (event_id % 900 + 1) * 1000000 AS latency_ns, CAST(NULL AS VARCHAR) AS reason FROM events""",
    "dat_duration": """SELECT event_id, CASE event_id % 5 WHEN 0 THEN (event_id % 30) * 3600000000000 + (event_id % 60) * 60000000000
  WHEN 1 THEN -((event_id % 1000) * 1000000 + 500000) WHEN 2 THEN event_id * 1000 WHEN 3 THEN NULL ELSE 0 END AS text_ns,
  CASE event_id % 4 WHEN 0 THEN event_id * 1000000000 WHEN 1 THEN event_id END AS json_ns FROM events""",
    "dat_uptime": f"SELECT event_id, {_UPTIME.format(s='(event_id * 977)')} AS uptime FROM events",
    "mth_hash": f"""SELECT user_id, CAST(f % 1024 AS BIGINT) AS bucket, CAST(f % 9223372036854775808::HUGEINT AS BIGINT) AS wide
FROM (SELECT user_id, {_FNV} AS f FROM (SELECT DISTINCT user_id, sha256('host-' || user_id) AS h FROM events))""",
    "mth_snowflake_encode": f"SELECT event_id, CASE WHEN user_id <= 1023 THEN {_EVENT_ID} END AS id FROM events",
    "mth_snowflake_decode": """SELECT event_id, CASE WHEN user_id <= 1023 THEN epoch_us(ts) // 1000 END AS unix_ms,
  CASE WHEN user_id <= 1023 THEN user_id END AS machine, CASE WHEN user_id <= 1023 THEN event_id % 4096 END AS sequence FROM events""",
    "mth_snowflake_assign": """WITH n AS (SELECT event_id, user_id % 2 AS machine, event_id // 10000 AS ms,
  row_number() OVER (PARTITION BY user_id % 2 ORDER BY event_id) AS n FROM events),
 r AS (SELECT *, n + max(ms * 4096 + ms % 4096 - n) OVER (PARTITION BY machine ORDER BY event_id) AS slot FROM n)
SELECT event_id, slot % 4096 AS sequence, slot // 4096 > ms AS waited,
  ((slot // 4096) << 22) | (machine << 12) | (slot % 4096) AS id FROM r""",
    "jon_nic_counters": f"""SELECT p_partkey % 50 AS host, p_partkey AS nic_id, {_NIC_NAME} AS if_name,
  CASE WHEN p_partkey % 3 <> 0 THEN CAST(p_size AS BIGINT) * 1000 ELSE 0 END AS rx_bytes FROM part""",
    "jon_disk_usage": "SELECT p_partkey AS nic_id, p_partkey % 50 AS host, CAST(p_size AS DOUBLE) AS used_percent FROM part WHERE p_partkey % 7 <> 0",
    "jon_zero_fill": """SELECT l_returnflag AS sink_type, l_linestatus AS status, sum(l_quantity) AS value FROM (
  SELECT l_returnflag, l_linestatus, l_quantity FROM lineitem
  UNION ALL SELECT * FROM (VALUES ('N', 'F', 0.0), ('R', 'O', 0.0), ('X', 'O', 0.0)) d(a, b, c)) GROUP BY 1, 2""",
    "agg_latest_snapshot": _LATEST,
    "agg_counter": "SELECT l_returnflag AS sink_type, l_linestatus AS status, sum(l_quantity) AS value FROM lineitem GROUP BY 1, 2",
    "agg_gauge": """WITH g AS (SELECT *, max(CASE WHEN event_type = 'signup' THEN event_id END) OVER (PARTITION BY user_id) AS set_at FROM events)
SELECT user_id AS series, round(sum(CASE WHEN event_type = 'signup' THEN value WHEN event_type = 'click' THEN 1
  WHEN event_type = 'view' THEN -1 ELSE value END), 4) AS value
FROM g WHERE set_at IS NULL OR event_id >= set_at GROUP BY user_id""",
    "agg_histogram": """WITH b AS (SELECT * FROM (VALUES ('1000', 1000.0), ('5000', 5000.0), ('10000', 10000.0), ('50000', 50000.0),
  ('100000', 100000.0), ('+Inf', 1e300)) t(le, bound))
SELECT l_returnflag, le, count(*) FILTER (WHERE l_extendedprice <= bound) AS bucket_count, count(*) AS observed_count,
  round(sum(l_extendedprice), 2) AS observed_sum FROM lineitem, b GROUP BY l_returnflag, le""",
    "agg_summary": """WITH r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) AS rn,
  count(*) OVER (PARTITION BY event_type) AS n FROM events),
 s AS (SELECT event_type, count(*) AS observed_count, round(sum(value), 2) AS observed_sum FROM events GROUP BY event_type),
 q AS (SELECT * FROM (VALUES (50), (90), (99)) t(p))
SELECT event_type, CAST(p AS DOUBLE) / 100 AS quantile, value, observed_count, observed_sum
FROM r JOIN q ON rn = (p * n + 99) // 100 JOIN s USING (event_type)""",
    "agg_summary_approx": """SELECT event_type, quantile, count(*) AS observed_count, round(sum(value), 2) AS observed_sum,
  true AS within_tolerance FROM events, (VALUES (0.5::DOUBLE), (0.9::DOUBLE), (0.99::DOUBLE)) q(quantile) GROUP BY event_type, quantile""",
    "agg_databus_metrics": f"""WITH {_V}, r AS (SELECT * FROM v WHERE kind <> 'greeting'), {_CONN}
SELECT 'databus_records_written_total' AS metric, 'sink_type=kafka,status=success' AS labels, CAST(count(*) AS DOUBLE) AS value FROM r WHERE payload <> ''
UNION ALL SELECT 'databus_records_written_total', 'sink_type=mysql,status=success', count(*) FROM r WHERE kind = 'host'
UNION ALL SELECT 'databus_records_written_total', 'sink_type=mysql,status=error', count(*) FROM r WHERE kind = 'malformed'
UNION ALL SELECT 'databus_bytes_written_total', 'sink_type=kafka', sum(strlen(payload)) FROM r WHERE payload <> ''
UNION ALL SELECT 'databus_bytes_written_total', 'sink_type=mysql', sum(strlen(payload)) FROM r WHERE kind = 'host'
UNION ALL SELECT 'databus_connections_active', 'state=connected', count(*) FROM (
  SELECT client FROM c WHERE what <> 'message' GROUP BY client HAVING arg_max(what, seq) = 'open')""",
    "agg_controller_metrics": f"""WITH {_SESSIONS}, q AS (SELECT CASE WHEN event_type = 'purchase' THEN 'POST' ELSE 'GET' END AS method,
  CASE WHEN event_type = 'error' THEN '500' ELSE '200' END AS status FROM events)
SELECT 'controller_requests_total' AS metric, 'method=' || method || ',status=' || status AS labels, CAST(count(*) AS DOUBLE) AS value
FROM q GROUP BY method, status
UNION ALL SELECT 'controller_agent_connections_active', 'state=connected', count(*) FROM s WHERE ended_by IS NULL""",
    "met_exposition": _RECORD_LINES,
    "ext_custom_metrics": f"""{_RECORD_LINES}
UNION ALL SELECT 'custom_events', 2, 'custom_events{{event_type="' || event_type || '"}} ' || count(*) FROM events GROUP BY event_type""",
    "agg_throughput": """SELECT user_id % 4 AS level, event_type AS kind, count(*) FILTER (WHERE event_id % 37 <> 0) AS ops,
  count(*) FILTER (WHERE event_id % 37 = 0) AS errors,
  round(count(*) FILTER (WHERE event_id % 37 <> 0) / ((epoch_us(max(ts)) - epoch_us(min(ts))) / 1000000.0), 9) AS ops_per_second
FROM events GROUP BY 1, 2""",
    "agg_delivery": """WITH w AS (SELECT user_id % 4 AS topic, user_id, count(*) AS sent, count(*) FILTER (WHERE event_type <> 'error') AS got
  FROM events GROUP BY 1, 2)
SELECT topic, count(*) AS watchers, round(avg(got), 4) AS avg_received, min(got) AS min_received, max(got) AS max_received,
  round((sum(sent) - sum(got)) * 100.0 / sum(sent), 4) AS loss_percent FROM w GROUP BY topic""",
    "sta_active_connections": f"""WITH {_DELTAS} SELECT listener, seq, what,
  CAST(sum(delta) OVER (PARTITION BY listener ORDER BY seq) AS BIGINT) AS active FROM d""",
    "sta_active_curve": f"""WITH {_DELTAS}, b AS (SELECT listener, date_trunc('hour', ts) AS bucket, sum(delta) AS delta FROM d GROUP BY 1, 2)
SELECT listener, bucket, CAST(sum(delta) OVER (PARTITION BY listener ORDER BY bucket) AS BIGINT) AS active FROM b""",
    "sta_conn_client": """SELECT user_id AS client, CASE WHEN count(*) FILTER (WHERE event_id % 4 <> 0) > 0 THEN 'host-' || user_id END AS client_id
FROM events GROUP BY user_id""",
    "sta_sessions": f"""WITH {_SESSIONS} SELECT seq AS session, cid AS client_id, ts AS opened_at, ended_at AS closed_at,
  ended_by FROM s""",
    "sta_last_active": f"""WITH {_CONN} SELECT client, arg_min(what, seq) AS first_what, CAST(min(seq) AS VARCHAR) AS first_seq,
  max(ts) AS last_active FROM c GROUP BY client""",
    "reg_current": f"WITH {_CURRENT} SELECT svc_key, rev, val FROM s",
    "reg_get": f"""WITH {_CURRENT} SELECT c_custkey AS request_id, CASE WHEN s.val IS NULL THEN 'not_found' ELSE 'ok' END AS status, s.val
FROM customer LEFT JOIN s ON s.cust = c_custkey AND c_custkey % 3 = 0""",
    "reg_prefix": f"WITH {_CURRENT} SELECT svc_key, val FROM s WHERE cust % 3 = 1 AND CAST(cust AS VARCHAR) LIKE '1%'",
    "reg_watch": f"WITH {_CHANGES} SELECT rev, op AS event, svc_key, val FROM c WHERE cust % 3 = 2 AND rev > 10000000000",
    "reg_live": f"WITH {_LIVE} SELECT svc_key, rev, expires_at FROM s",
    "reg_services": f"""WITH {_LIVE} SELECT CAST(cust AS VARCHAR) AS service_id, 'tcp' AS protocol, '10.0.0.' || cust % 250 AS host,
  1024 + rev % 10000000 % 60000 AS port FROM s WHERE cust % 3 = 0""",
    "reg_lease_spans": f"""WITH {_CHANGES},
 n AS (SELECT *, ts + to_days(CAST(ttl_s // 86400 AS INTEGER)) AS until, lead(ts) OVER w AS next_ts, lead(op) OVER w AS next_op,
   lead(ttl_s) OVER w AS next_ttl FROM c WINDOW w AS (PARTITION BY svc_key ORDER BY rev)),
 h AS (SELECT svc_key, rev, ts, least(until, coalesce(next_ts, until)) AS held_to,
   CASE WHEN next_ts IS NULL OR next_ts > until THEN 'expired' WHEN next_op = 'DELETE' THEN 'revoked'
     WHEN next_ttl IS NULL THEN 'kept' END AS ended FROM n WHERE op = 'PUT' AND ttl_s IS NOT NULL),
 g AS (SELECT *, count(ended) OVER (PARTITION BY svc_key ORDER BY rev) - CAST(ended IS NOT NULL AS INTEGER) AS span FROM h)
SELECT svc_key, min(ts) AS started_at, max(held_to) AS ended_at, max(ended) AS ended_by, count(*) AS puts FROM g GROUP BY svc_key, span""",
    "seq_out_of_order": """WITH l AS (SELECT user_id, value, lag(value) OVER (PARTITION BY user_id ORDER BY event_id) AS before FROM events)
SELECT user_id, count(*) AS total, count(*) FILTER (WHERE value < before) AS out_of_order FROM l GROUP BY user_id""",
    "lim_list_hosts": f"SELECT machine_id, host_name, updated_at FROM ({_LATEST}) ORDER BY machine_id LIMIT 10",
    "stm_ingest": _LATEST,
    "stm_latest": _LATEST,
    "stm_watch": f"WITH {_CHANGES} SELECT rev, op AS event, svc_key, val FROM c WHERE cust % 3 = 0",
}
# the stream's spans are those of the batch
ORACLES["stm_leases"] = ORACLES["reg_lease_spans"]
