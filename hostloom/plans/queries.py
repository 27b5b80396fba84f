"""Registered queries: every operator over the test tables.

A query only joins a view with operators and names its output columns.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hostloom.functions import ids
from hostloom.functions import payload as P
from hostloom.functions import text as X
from hostloom.functions.duration import duration_from_json, duration_ns, epoch_micros, uptime_label
from hostloom.functions.endpoint import format_endpoint, host_port, with_endpoint
from hostloom.operators import hosts as H
from hostloom.operators import ingest as I
from hostloom.operators import metrics as M
from hostloom.operators import registry as R
from hostloom.operators import reports as RP
from hostloom.operators import sessions as S
from hostloom.plans import views as V
from hostloom.schemas import CHANGE, NIC, SERVICE_ENDPOINT, SERVICE_INFO
from hostloom.session import shared_dir
from hostloom.sinks.base import Sink, fan_out
from hostloom.sinks.kafka import record_files_sink, to_kafka_rows
from hostloom.sinks.snapshots import SnapshotTable, quarantine_sink
from hostloom.sources.changes import read_changes
from hostloom.sources.envelopes import read_envelopes, read_sources
from hostloom.streaming import jobs

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

# 2024-01-01T00:00:00Z, before the first event
EPOCH_2024_MS = 1704067200000
AS_OF = "1996-07-01"


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def _text(c: str) -> Column:
    return F.col(c).cast("string").alias(c)


def _joined(c: Column, name: str) -> Column:
    return F.array_join(c, ",").alias(name)


def _files(sf_dir: str, name: str) -> str:
    # written as a pattern, since a stream takes a plain path to be a directory
    return f"{sf_dir}/{name}.parque[t]"


def _envelope_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.dealt(read_envelopes(spark, _files(sf_dir, "events"), streaming=True, mapping=V.ENVELOPES))


def _change_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_changes(spark, _files(sf_dir, "orders"), streaming=True, mapping=V.CHANGES)


def _snapshot_out(snapshots: DataFrame) -> DataFrame:
    return snapshots.select(
        "machine_id", "host_name", _joined(F.col("ips"), "ips"),
        F.col("stats.cpu").alias("cpu"), F.col("stats.memory").alias("memory"),
        F.size("stats.networks").cast("bigint").alias("nics"), "created_at", "updated_at")


# --- sources ---------------------------------------------------------------


@query
def src_envelopes(spark, sf_dir):
    rows = read_envelopes(spark, f"{sf_dir}/events.parquet", mapping=V.ENVELOPES)
    return rows.select("seq", "arrival_ts", "conn_id", "client_id", _text("payload"))


@query
def src_union(spark, sf_dir):
    listeners = (replace(V.ENVELOPES, where=f"event_id % 2 = {i}") for i in (0, 1))
    configs = [{"type": "agent", "config": {"path": f"{sf_dir}/events.parquet", "mapping": m}} for m in listeners]
    return read_sources(spark, configs).select("seq", "conn_id", "client_id")


@query
def src_changes(spark, sf_dir):
    return read_changes(spark, f"{sf_dir}/orders.parquet", mapping=V.CHANGES)


# --- sinks -----------------------------------------------------------------


@query
def snk_kafka_rows(spark, sf_dir):
    return to_kafka_rows(V.envelopes(spark, sf_dir)).select(_text("key"), _text("value"))


@query
def snk_upsert(spark, sf_dir):
    table = SnapshotTable(spark, shared_dir(spark, "upsert"))
    rows = I.accepted(V.envelopes(spark, sf_dir)).drop("doc")
    table.upsert(rows.filter("seq % 2 = 1"), "1")
    table.upsert(rows.filter("seq % 2 = 0"), "2")
    return _snapshot_out(table.read())


@query
def snk_fanout_counts(spark, sf_dir):
    base = shared_dir(spark, "fanout")

    def refuse(rows: DataFrame, batch: str) -> None:
        raise OSError("sink is down")

    sinks = [
        record_files_sink(f"{base}/records"),
        Sink("broken", F.lit(True), refuse),
        SnapshotTable(spark, f"{base}/snapshots").sink(),
        quarantine_sink(f"{base}/quarantine"),
    ]
    outcomes = fan_out(I.drop_greetings(V.envelopes(spark, sf_dir)), sinks)
    return outcomes.select("sink_type", "status", "rows", "bytes")


# --- filters ---------------------------------------------------------------


@query
def flt_greeting(spark, sf_dir):
    return I.drop_greetings(V.envelopes(spark, sf_dir)).select("seq", "client_id")


@query
def flt_empty_payload(spark, sf_dir):
    return I.drop_empty_payload(V.envelopes(spark, sf_dir)).select("seq", "client_id")


@query
def flt_malformed(spark, sf_dir):
    return I.well_formed(V.envelopes(spark, sf_dir)).select("seq", "client_id")


@query
def flt_plugin(spark, sf_dir):
    return I.host_plugin_only(I.well_formed(V.envelopes(spark, sf_dir))).select("seq", "client_id")


@query
def flt_no_client(spark, sf_dir):
    return I.drop_no_client(V.envelopes(spark, sf_dir)).select("seq", "client_id")


@query
def flt_null_data(spark, sf_dir):
    return I.drop_null_data(I.well_formed(V.envelopes(spark, sf_dir))).select("seq", "client_id")


@query
def flt_reasons(spark, sf_dir):
    return I.reason_counts(V.envelopes(spark, sf_dir))


@query
def flt_physical_nic(spark, sf_dir):
    return H.physical_nics(V.nics(spark, sf_dir)).select("nic_id", "host", "if_name")


@query
def flt_ipv4(spark, sf_dir):
    return H.ipv4_rows(V.nics(spark, sf_dir)).select("nic_id", "ip")


@query
def flt_size_cap(spark, sf_dir):
    docs = V.table(spark, sf_dir, "documents")
    return I.within_size(docs, "text", cap=2000).select("doc_id", F.octet_length("text").cast("bigint").alias("n_bytes"))


@query
def flt_slow_sql(spark, sf_dir):
    rows = V.statement_trace(spark, sf_dir)
    label = X.statement_log_class(F.col("elapsed_ms"), F.col("err"))
    return rows.select("seq", label.alias("label")).filter(F.col("label").isNotNull())


# --- JSON and arrays -------------------------------------------------------


@query
def jsn_encode(spark, sf_dir):
    e = V.table(spark, sf_dir, "events")
    nothing = F.array().cast(T.ArrayType(NIC))
    disk = F.array(F.struct(F.lit("/").alias("mountpoint"),
                            (F.col("user_id") % 100).cast("double").alias("used_percent")))
    stats = F.struct(
        F.col("value").alias("cpu"), (F.col("event_id") % 100).cast("double").alias("memory"),
        disk.alias("disk"), nothing.alias("networks"),
        uptime_label(F.col("event_id")).alias("uptime"),
        F.concat(F.lit("node-"), F.col("user_id").cast("string")).alias("hostname"),
        F.lit("linux 1").alias("os"), F.lit("x86_64").alias("arch"), F.lit("6.1").alias("kernel"))
    beat = F.col("event_type") == "signup"
    return e.select("event_id", P.encode_event(
        F.when(beat, F.lit("file")).otherwise(F.lit("host")),
        F.when(beat, F.lit("file")).otherwise(F.lit("")),
        F.when(~beat, stats)).alias("payload"))


@query
def jsn_decode(spark, sf_dir):
    s = F.col("stats")
    return I.samples(V.envelopes(spark, sf_dir)).select(
        "seq", s["cpu"].alias("cpu"), s["memory"].alias("memory"), s["uptime"].alias("uptime"),
        s["hostname"].alias("hostname"), s["os"].alias("os"), s["arch"].alias("arch"),
        s["kernel"].alias("kernel"), F.size(s["disk"]).cast("bigint").alias("disks"),
        F.size(s["networks"]).cast("bigint").alias("nics"))


@query
def jsn_nullable(spark, sf_dir):
    schema = T.StructType([T.StructField("k", T.LongType())])
    stored = V.table(spark, sf_dir, "events").selectExpr(
        "event_id", "CASE event_id % 10 WHEN 0 THEN NULL WHEN 1 THEN '' WHEN 2 THEN 'null' ELSE props END AS doc")
    read = stored.select(
        "event_id", P.json_scan(F.col("doc"), schema).alias("scanned"),
        P.json_unmarshal(F.col("doc"), schema).alias("unmarshalled"))
    return read.select(
        "event_id", F.col("scanned.k").alias("scanned_k"), F.col("unmarshalled.k").alias("unmarshalled_k"),
        P.json_value(F.col("scanned")).alias("stored"), P.json_marshal(F.col("unmarshalled")).alias("sent"))


@query
def jsn_service_info(spark, sf_dir):
    s = V.table(spark, sf_dir, "supplier")
    at = "2024-01-01T00:00:00Z"
    listen = F.struct(F.lit("10.0.0.1").alias("host"), (F.col("s_suppkey") % 60000 + 1).cast("int").alias("port"))
    info = F.struct(
        F.concat(F.lit("svc-"), F.col("s_suppkey").cast("string")).alias("id"),
        F.col("s_name").alias("name"), F.col("s_nationkey").alias("nice"),
        F.when(F.col("s_suppkey") % 4 != 0, F.array(F.lit("10.0.0.1"))).alias("ips"),
        F.when(F.col("s_suppkey") % 3 != 0, listen).alias("listen_address"),
        F.lit(None).cast(SERVICE_ENDPOINT).alias("probe_endpoint"),
        F.lit(at).alias("start_time"), F.lit("1h").alias("uptime"), F.lit(at).alias("updated_at"))
    sent = s.select("s_suppkey", P.encode_service_info(info.cast(SERVICE_INFO)).alias("json"))
    back = P.decode_service_info(F.col("json"))
    return sent.select("s_suppkey", "json", back["name"].alias("name"),
                       back["listen_address"]["port"].cast("bigint").alias("port"))


@query
def arr_ips(spark, sf_dir):
    return I.samples(V.envelopes(spark, sf_dir)).select(
        "seq", _joined(P.collect_ips(F.col("stats.networks")), "ips"))


@query
def arr_disks(spark, sf_dir):
    return I.disks(I.samples(V.envelopes(spark, sf_dir))).select(
        "seq", F.col("client_id").alias("machine_id"), "mountpoint", "used_percent")


@query
def arr_nics(spark, sf_dir):
    return I.nics(I.samples(V.envelopes(spark, sf_dir))).select(
        "seq", F.col("client_id").alias("machine_id"), "mac", "if_name", _joined(F.col("ips"), "ips"),
        F.col("rx_bytes").cast("bigint").alias("rx_bytes"), F.col("tx_bytes").cast("bigint").alias("tx_bytes"))


@query
def arr_zero_stats(spark, sf_dir):
    rows = I.well_formed(V.envelopes(spark, sf_dir))
    stats = F.coalesce(P.decode_stats(), P.zero_stats())
    return rows.select("seq", stats.alias("stats")).select(
        "seq", "stats.cpu", "stats.memory", "stats.hostname",
        F.size("stats.disk").cast("bigint").alias("disks"), F.size("stats.networks").cast("bigint").alias("nics"))


@query
def arr_assemble(spark, sf_dir):
    part = V.table(spark, sf_dir, "part").selectExpr(
        "p_partkey % 50 AS host", "p_partkey div 400 AS sample", "p_partkey div 50 % 8 AS pos", "p_partkey", "p_size")
    keys = ["host", "sample"]
    scalars = part.groupBy(*keys).agg(F.max("p_size").alias("cpu"))
    disks = part.filter("pos < 3").select(
        *keys, "pos", F.concat(F.lit("/d"), F.col("pos").cast("string")).alias("mountpoint"),
        F.col("p_size").alias("used_percent"))
    nics = part.filter("pos >= 3").select(
        *keys, "pos", F.concat(F.lit("eth"), F.col("pos").cast("string")).alias("if_name"),
        F.col("p_partkey").alias("rx_bytes"))
    out = H.assemble(scalars, disks, nics, keys)
    return out.select(
        "host", "sample", "cpu",
        _joined(F.transform("disk", lambda d: F.concat_ws("=", d["mountpoint"], d["used_percent"].cast("string"))), "disks"),
        _joined(F.transform("networks", lambda n: F.concat_ws("=", n["if_name"], n["rx_bytes"].cast("string"))), "nics"))


# --- text, time, ids -------------------------------------------------------


@query
def str_endpoint_parse(spark, sf_dir):
    return with_endpoint(V.endpoints(spark, sf_dir), "input", "e").select(
        "id", "e.protocol", "e.host", F.col("e.port").cast("bigint").alias("port"), "e.reason")


@query
def str_endpoint_format(spark, sf_dir):
    e = with_endpoint(V.endpoints(spark, sf_dir), "input", "e").filter(F.col("e.reason").isNull())
    return e.select("id", format_endpoint(F.col("e.protocol"), F.col("e.host"), F.col("e.port")).alias("endpoint"),
                    host_port(F.col("e.host"), F.col("e.port")).alias("host_port"))


@query
def str_registry_key(spark, sf_dir):
    s = V.table(spark, sf_dir, "supplier").select(
        "s_suppkey", F.col("s_suppkey").cast("string").alias("k"),
        X.registry_root(F.lit("/registry"), F.when(F.col("s_nationkey") % 3 != 0, F.lit("databus"))
                        .otherwise(F.lit(""))).alias("root"))
    asked = (F.when(F.col("s_suppkey") % 3 == 0, F.concat(F.lit("  "), F.col("k"), F.lit(" ")))
             .when(F.col("s_suppkey") % 3 == 1, F.concat(F.col("root"), F.lit("/"), F.col("k")))
             .otherwise(F.lit(" ")))
    return s.select("s_suppkey", X.self_key(F.col("root"), F.col("k")).alias("self_key"),
                    X.mutex_key(F.col("root"), F.col("k")).alias("mutex_key"),
                    X.election_key(F.col("root"), F.col("k")).alias("election_key"),
                    X.child_key(F.col("root"), asked).alias("child_key"))


@query
def str_os_label(spark, sf_dir):
    p = V.table(spark, sf_dir, "part").selectExpr(
        "p_partkey", "CASE WHEN p_partkey % 3 = 0 THEN '' ELSE p_brand END AS platform",
        "CASE WHEN p_partkey % 4 = 0 THEN '' ELSE CAST(p_size AS STRING) END AS version")
    return p.select("p_partkey", X.os_label(F.col("platform"), F.col("version"), F.lit("linux")).alias("os"))


@query
def str_conn_id(spark, sf_dir):
    e = V.table(spark, sf_dir, "events")
    remote = F.concat(F.lit("10.0.0."), (F.col("user_id") % 4).cast("string"), F.lit(":5000"))
    return e.select("event_id", X.connection_id(remote, F.col("event_id") + 1).alias("conn_id"))


@query
def str_access_log(spark, sf_dir):
    return X.with_access_fields(V.access_log(spark, sf_dir)).select(
        "seq", "method", "path", "client_ip", F.col("status").cast("bigint").alias("status"), "latency_ns", "reason")


@query
def dat_duration(spark, sf_dir):
    e = V.table(spark, sf_dir, "events").selectExpr(
        "event_id",
        "CASE event_id % 5 WHEN 0 THEN event_id % 30 || 'h' || event_id % 60 || 'm' "
        "WHEN 1 THEN '-' || event_id % 1000 || '.5ms' WHEN 2 THEN event_id || 'µs' "
        "WHEN 3 THEN event_id || ' s' ELSE '0' END AS txt",
        "CASE event_id % 4 WHEN 0 THEN '\"' || event_id || 's\"' WHEN 1 THEN event_id || '.75' "
        "WHEN 2 THEN 'true' ELSE '\"later\"' END AS js")
    return e.select("event_id", duration_ns(F.col("txt")).alias("text_ns"),
                    duration_from_json(F.col("js")).alias("json_ns"))


@query
def dat_uptime(spark, sf_dir):
    return V.table(spark, sf_dir, "events").select(
        "event_id", uptime_label(F.col("event_id") * 977).alias("uptime"))


@query
def mth_hash(spark, sf_dir):
    name = F.concat(F.lit("host-"), F.col("user_id").cast("string"))
    users = V.table(spark, sf_dir, "events").select("user_id").distinct()
    return users.select("user_id", ids.hash_bits(name, 10).alias("bucket"), ids.hash_bits(name, 63).alias("wide"))


def _event_ms() -> Column:
    return F.floor(epoch_micros(F.col("ts")) / 1000).cast("bigint")


def _event_id() -> Column:
    return ids.encode_id(_event_ms(), F.col("user_id"), F.col("event_id") % 4096, EPOCH_2024_MS)


@query
def mth_snowflake_encode(spark, sf_dir):
    return V.table(spark, sf_dir, "events").select("event_id", _event_id().alias("id"))


@query
def mth_snowflake_decode(spark, sf_dir):
    e = V.table(spark, sf_dir, "events").select("event_id", ids.decode_id(_event_id(), EPOCH_2024_MS).alias("d"))
    return e.select("event_id", "d.unix_ms", "d.machine", "d.sequence")


@query
def mth_snowflake_assign(spark, sf_dir):
    e = V.table(spark, sf_dir, "events").selectExpr(
        "event_id", "ts", "user_id % 2 AS machine", f"{EPOCH_2024_MS} + event_id div 10000 AS unix_ms")
    return RP.assign_ids(e, "machine", "unix_ms", ["ts", "event_id"], EPOCH_2024_MS).select(
        "event_id", "sequence", "waited", "id")


# --- joins -----------------------------------------------------------------


@query
def jon_nic_counters(spark, sf_dir):
    joined = H.with_counters(V.nics(spark, sf_dir).select("host", "nic_id", "if_name"),
                             V.counters(spark, sf_dir), ["host", "nic_id"], fields=["rx_bytes"])
    return joined.select("host", "nic_id", "if_name", "rx_bytes")


@query
def jon_disk_usage(spark, sf_dir):
    part = V.table(spark, sf_dir, "part")
    partitions = V.nics(spark, sf_dir).select("nic_id", "host")
    usage = part.filter("p_partkey % 7 <> 0").selectExpr("p_partkey AS nic_id", "CAST(p_size AS DOUBLE) AS used_percent")
    return H.with_usage(partitions, usage, ["nic_id"]).select("nic_id", "host", "used_percent")


@query
def jon_zero_fill(spark, sf_dir):
    labels = ["sink_type", "status"]
    declared = spark.createDataFrame([("N", "F"), ("R", "O"), ("X", "O")], "sink_type string, status string")
    observed = M.counter(V.counter_deltas(spark, sf_dir), labels)
    return M.zero_fill(declared, observed, labels)


# --- aggregations ----------------------------------------------------------


@query
def agg_latest_snapshot(spark, sf_dir):
    return _snapshot_out(I.latest_snapshots(V.envelopes(spark, sf_dir)))


@query
def agg_counter(spark, sf_dir):
    return M.counter(V.counter_deltas(spark, sf_dir), ["sink_type", "status"])


@query
def agg_gauge(spark, sf_dir):
    return M.gauge(V.gauge_ops(spark, sf_dir)).select("series", F.round("value", 4).alias("value"))


@query
def agg_histogram(spark, sf_dir):
    rows = V.table(spark, sf_dir, "lineitem")
    bounds = [1000, 5000, 10000, 50000, 100000]
    return M.histogram(rows, ["l_returnflag"], "l_extendedprice", bounds).select(
        "l_returnflag", "le", "bucket_count", "observed_count", F.round("observed_sum", 2).alias("observed_sum"))


OBJECTIVES = {0.5: 0.05, 0.9: 0.01, 0.99: 0.001}


@query
def agg_summary(spark, sf_dir):
    rows = V.table(spark, sf_dir, "events")
    return M.summary(rows, ["event_type"], "value", list(OBJECTIVES)).select(
        "event_type", "quantile", "value", "observed_count", F.round("observed_sum", 2).alias("observed_sum"))


@query
def agg_summary_approx(spark, sf_dir):
    rows = V.table(spark, sf_dir, "events")
    answers = M.summary_approx(rows, ["event_type"], "value", OBJECTIVES)
    allowed = F.create_map(*[F.lit(float(x)) for pair in OBJECTIVES.items() for x in pair])
    return M.rank_error(rows, answers, ["event_type"], "value").select(
        "event_type", "quantile", "observed_count", F.round("observed_sum", 2).alias("observed_sum"),
        (F.col("rank_error") <= allowed[F.col("quantile")]).alias("within_tolerance"))


def _labels_text() -> Column:
    return F.array_join(F.transform(
        F.array_sort(F.map_entries("labels")), lambda e: F.concat_ws("=", e["key"], e["value"])), ",").alias("labels")


@query
def agg_databus_metrics(spark, sf_dir):
    rows = I.classified(I.drop_greetings(V.envelopes(spark, sf_dir)))
    size = I.payload_bytes()
    # what each sink makes of a row: Kafka takes any payload, the table judges it
    to_table = F.when(F.col("reason").isNull(), "success").when(F.col("reason") == I.MALFORMED, "error")
    verdicts = F.array(
        F.struct(F.lit("kafka").alias("sink_type"), F.when(size > 0, "success").alias("status")),
        F.struct(F.lit("mysql").alias("sink_type"), to_table.alias("status")))
    deliveries = rows.select(size.alias("bytes"), F.lit(1).alias("rows"), F.inline(verdicts)).filter(
        F.col("status").isNotNull())
    active = S.open_connections(V.conn_events(spark, sf_dir), "client")
    return M.databus_metrics(deliveries, active).select("metric", _labels_text(), "value")


@query
def agg_controller_metrics(spark, sf_dir):
    requests = X.with_access_fields(V.access_log(spark, sf_dir))
    active = S.sessions(V.conn_events(spark, sf_dir), "client").filter(F.col("ended_by").isNull())
    return M.controller_metrics(requests, active).select("metric", _labels_text(), "value")


ITEM_METRICS = (
    M.Metric("databus_records_written_total", ("sink_type", "status"), "delta"),
    M.Metric("databus_batch_size", ("l_returnflag",), "delta", bounds=(10, 25)),
    M.Metric("databus_queue_length", ("l_linestatus",), "delta", quantiles=(0.5, 0.9)),
)


def _exposed(spark, sf_dir) -> DataFrame:
    items = V.table(spark, sf_dir, "lineitem").selectExpr(
        "l_returnflag", "l_linestatus", "l_returnflag AS sink_type", "l_linestatus AS status", "l_quantity AS delta")
    return M.collected(items, ITEM_METRICS).unionByName(M.admin_info(spark))


FAMILIES = {
    "databus_records_written_total": ("counter", "Records written by sink and status."),
    "admin_info": ("gauge", "Version of the service."),
    "databus_batch_size": ("histogram", "Rows in a batch."),
    "databus_queue_length": ("summary", "Rows waiting."),
}


@query
def met_exposition(spark, sf_dir):
    return M.exposition(_exposed(spark, sf_dir), FAMILIES).select("family", "place", "line")


@query
def ext_custom_metrics(spark, sf_dir):
    extra = V.table(spark, sf_dir, "events").groupBy("event_type").agg(
        F.count(F.lit(1)).cast("double").alias("value"))
    return M.exposition(_exposed(spark, sf_dir).unionByName(
        M.as_samples(extra, "custom", "events", ["event_type"])), FAMILIES).select("family", "place", "line")


@query
def agg_throughput(spark, sf_dir):
    ops = V.table(spark, sf_dir, "events").selectExpr(
        "user_id % 4 AS level", "event_type AS kind", "ts", "event_id % 37 = 0 AS failed")
    return RP.throughput(ops, ["level", "kind"], F.col("failed")).select(
        "level", "kind", "ops", "errors", F.round("ops_per_second", 9).alias("ops_per_second"))


@query
def agg_delivery(spark, sf_dir):
    sent = V.table(spark, sf_dir, "events").selectExpr(
        "user_id % 4 AS topic", "user_id AS watcher", "event_type <> 'error' AS received")
    return RP.delivery(sent, ["topic"], "watcher", F.col("received")).select(
        "topic", "watchers", F.round("avg_received", 4).alias("avg_received"), "min_received", "max_received",
        F.round("loss_percent", 4).alias("loss_percent"))


# --- state -----------------------------------------------------------------


@query
def sta_active_connections(spark, sf_dir):
    return S.active_connections(V.conn_events(spark, sf_dir), "client", "listener").select(
        "listener", "seq", "what", "active")


@query
def sta_active_curve(spark, sf_dir):
    return S.active_curve(V.conn_events(spark, sf_dir), "client", "listener").select("listener", "bucket", "active")


@query
def sta_conn_client(spark, sf_dir):
    return S.connection_clients(V.conn_events(spark, sf_dir), "client")


@query
def sta_sessions(spark, sf_dir):
    return S.sessions(V.conn_events(spark, sf_dir), "client")


@query
def sta_last_active(spark, sf_dir):
    events = V.conn_events(spark, sf_dir).withColumn(
        "headers", F.create_map(F.lit("what"), F.col("what"), F.lit("seq"), F.col("seq").cast("string")))
    return S.session_activity(events, "client").select(
        "client", F.col("metadata")["what"].alias("first_what"), F.col("metadata")["seq"].alias("first_seq"),
        "last_active")


@query
def reg_current(spark, sf_dir):
    return R.current(V.changes(spark, sf_dir)).select("svc_key", "rev", "val")


@query
def reg_get(spark, sf_dir):
    keys = V.table(spark, sf_dir, "customer").selectExpr(
        "c_custkey AS request_id", "' /registry/databus/self/' || CAST(c_custkey AS STRING) || ' ' AS svc_key")
    return R.get_many(V.changes(spark, sf_dir), keys).select("request_id", "status", "val")


@query
def reg_prefix(spark, sf_dir):
    return R.get_prefix(V.changes(spark, sf_dir), "/registry/controller/self/1")


@query
def reg_watch(spark, sf_dir):
    return R.watch(V.changes(spark, sf_dir), " /registry/admin/ ", prefix=True, since_rev=1000 * 10_000_000)


@query
def reg_live(spark, sf_dir):
    return R.live(V.changes(spark, sf_dir), F.lit(AS_OF).cast("timestamp_ntz")).select(
        "svc_key", "rev", "expires_at")


@query
def reg_services(spark, sf_dir):
    as_of = F.lit(AS_OF).cast("timestamp_ntz")
    return R.services(V.changes(spark, sf_dir), "/registry/databus", as_of).select(
        "service_id", "protocol", "host", F.col("port").cast("bigint").alias("port"))


@query
def reg_lease_spans(spark, sf_dir):
    return R.lease_spans(V.changes(spark, sf_dir))


@query
def seq_out_of_order(spark, sf_dir):
    return RP.out_of_order(V.table(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], "value")


@query
def lim_list_hosts(spark, sf_dir):
    return I.list_hosts(I.latest_snapshots(V.envelopes(spark, sf_dir))).select("machine_id", "host_name", "updated_at")


# --- streaming -------------------------------------------------------------


@query
def stm_ingest(spark, sf_dir):
    base = shared_dir(spark, "ingest")
    table = SnapshotTable(spark, f"{base}/snapshots")
    sinks = [record_files_sink(f"{base}/records"), table.sink(), quarantine_sink(f"{base}/quarantine")]
    stream = _envelope_stream(spark, sf_dir)
    jobs.ingest(stream, sinks, f"{base}/checkpoint", f"{base}/deliveries", available_now=True).awaitTermination()
    return _snapshot_out(table.read())


@query
def stm_latest(spark, sf_dir):
    base = shared_dir(spark, "latest")
    table = SnapshotTable(spark, f"{base}/snapshots")
    stream = _envelope_stream(spark, sf_dir)
    jobs.latest(stream, table, f"{base}/checkpoint", available_now=True).awaitTermination()
    return _snapshot_out(table.read())


@query
def stm_watch(spark, sf_dir):
    base = shared_dir(spark, "watch")
    stream = _change_stream(spark, sf_dir)
    jobs.watch_events(stream, "/registry/databus/", f"{base}/events", f"{base}/checkpoint",
                      prefix=True, available_now=True).awaitTermination()
    return spark.read.schema("rev bigint, event string, svc_key string, val string").parquet(f"{base}/events")


@query
def stm_leases(spark, sf_dir):
    base = shared_dir(spark, "leases")
    # when the table ends, time moves on until every lease has run out
    spark.createDataFrame([(2**62, datetime(2100, 1, 1), None, "TICK", None, None)], CHANGE).write.parquet(f"{base}/tick")
    tick = read_changes(spark, f"{base}/tick", streaming=True)
    stream = _change_stream(spark, sf_dir).unionByName(tick)
    jobs.lease_spans(stream, f"{base}/spans", f"{base}/checkpoint", available_now=True).awaitTermination()
    return spark.read.schema(
        "svc_key string, started_at timestamp_ntz, ended_at timestamp_ntz, ended_by string, puts bigint").parquet(f"{base}/spans")
