import json

import pytest
from pyspark.sql import functions as F

from hostloom.functions import payload as P
from hostloom.operators import ingest as I
from hostloom.schemas import SERVICE_INFO, STATS


def host(data: str) -> str:
    return '{"PluginName":"host","EventName":"","Data":' + data + "}"


def nic(fields: str) -> str:
    return host('{"networks":[' + fields + "]}")


ACCEPTED = [
    host("{}"),
    ' {"PluginName":"host","Data":{}}\n',
    '{"pluginname":"host","DATA":{"cpu":1}}',
    host('{"hostname":null,"cpu":null,"disk":null,"networks":null}'),
    host('{"extra":{"hostname":5},"list":[1,"a"]}'),
    host('{"hostname":"a \\"cpu\\": \\"x\\" b"}'),
    host('{"hostname":"\\u00e9"}'),
    nic('{"rx_bytes":18446744073709551615}'),
    nic('null,{"ips":null}'),
    nic('{"ips":["10.0.0.1",null]}'),
    nic('{"ips":["a,b","c]d", "e"]}'), nic('{"IPS":["x"],"RX_Bytes":7}'), host('{"CPU":5.5,"HostName":"n1"}'),
    '{"PluginName":"file","pluginname":"host","Data":{}}', host('{"cpu":1e3}'),
]
MALFORMED = [
    "{bad", "[]", "5", '"text"', "{'PluginName':'host'}",
    host("{}") + " x", host("{}") + "}", host("{}") + "]", host("{}") + ",{}",
    host("{}") + ',"more":1', host("{}") + '],"a":[1',
    '{"PluginName":1}', '{"PluginName":"host","EventName":{}}', '{"PluginName":{"a":1}}',
    host("5"), host("[]"), host('"x"'),
    host('{"cpu":"x"}'), host('{"cpu":"1"}'), host('{"cpu":NaN}'), host('{"memory":true}'),
    host('{"hostname":5}'), host('{"os":["linux"]}'),
    host('{"disk":{}}'), host('{"disk":[1]}'), host('{"disk":[{"mountpoint":1}]}'),
    host('{"disk":[{"used_percent":"9"}]}'),
    nic('{"rx_bytes":18446744073709551616}'), nic('{"rx_bytes":-1}'), nic('{"rx_bytes":1.5}'),
    nic('{"tx_fifo":"5"}'), nic('{"tx_errors":1e3}'), nic('{"mac":7}'), nic('{"ips":"10.0.0.1"}'),
    nic('{"ips":[1]}'), nic('{"ips":["a",1]}'), nic('{"ips":["a]",1]}'), nic("5"), nic('{"rx_bytes":1.0}'),
    host('{"cpu":1e400}'), host('{"CPU":"x"}'), nic('{"Mac":7}'), host('{"host\\u006eame":5}'),
]
OTHER = {
    "": I.EMPTY_PAYLOAD,
    "null": I.OTHER_PLUGIN,
    "{}": I.OTHER_PLUGIN,
    '{"PluginName":null}': I.OTHER_PLUGIN,
    '{"PluginName":"Host","Data":{}}': I.OTHER_PLUGIN,
    '{"PluginName":"file","EventName":"file","Data":null}': I.OTHER_PLUGIN,
    '{"PluginName":"host","PluginName":"file","Data":{}}': I.OTHER_PLUGIN,
    '{"PluginName":"host","pluginname":"file","Data":{}}': I.OTHER_PLUGIN,
    '{"PluginName":"file","Data":[1]}': I.MALFORMED,
    host("null"): I.NULL_DATA,
    '{"PluginName":"host"}': I.NULL_DATA,
}


def envelopes(spark, payloads, client="c"):
    rows = [(i, client, p) for i, p in enumerate(payloads)]
    return spark.createDataFrame(rows, "seq long, client_id string, payload string").select(
        "seq", "client_id", F.col("payload").cast("binary").alias("payload"),
        (F.expr("timestamp_ntz'2024-01-01 00:00:00'") + F.make_dt_interval(secs=F.col("seq"))).alias("arrival_ts"))


def test_reasons(spark):
    cases = {**dict.fromkeys(ACCEPTED), **dict.fromkeys(MALFORMED, I.MALFORMED), **OTHER}
    rows = I.classified(envelopes(spark, list(cases))).select(
        F.col("payload").cast("string").alias("p"), "reason").collect()
    assert {r.p: r.reason for r in rows} == cases


def test_null_payload_and_client(spark):
    rows = spark.createDataFrame(
        [(1, None, None), (2, None, bytearray(b"x")), (3, "c", None)], "seq long, client_id string, payload binary")
    assert [r.seq for r in I.drop_greetings(rows).orderBy("seq").collect()] == [2, 3]
    assert [r.seq for r in I.drop_empty_payload(rows).collect()] == [2]


def test_first_failing_rule_is_the_reason(spark):
    rows = I.classified(envelopes(spark, [host("null"), "{bad", host("{}")], client=""))
    assert [r.reason for r in rows.orderBy("seq").collect()] == [I.NO_CLIENT, I.MALFORMED, I.NO_CLIENT]


def test_decode_fills_zero_values(spark):
    text = nic('{"if_name":"eth0","ips":["a",null]},null')
    row = I.samples(envelopes(spark, [text])).first()
    assert row.stats.cpu == 0.0 and row.stats.hostname == "" and row.stats.disk == []
    first, second = row.stats.networks
    assert (first.if_name, first.ips, first.rx_bytes) == ("eth0", ["a", ""], 0)
    assert (second.mac, second.ips, second.tx_fifo) == ("", [], 0)


def test_zero_stats(spark):
    row = spark.range(1).select(P.zero_stats().alias("s")).first().s
    assert row.asDict() == {"cpu": 0.0, "memory": 0.0, "disk": [], "networks": [], "uptime": "",
                            "hostname": "", "os": "", "arch": "", "kernel": ""}


def test_ips_keep_order_and_duplicates(spark):
    text = nic('{"ips":["b","a"]},{"ips":[]},{"ips":["b"]}')
    rows = I.samples(envelopes(spark, [text, host("{}")])).orderBy("seq").select(
        P.collect_ips(F.col("stats.networks")).alias("ips")).collect()
    assert [r.ips for r in rows] == [["b", "a", "b"], []]


def test_encode_keeps_key_order_and_nulls(spark):
    df = spark.range(1).select(P.encode_event(F.lit("file"), F.lit("file"), F.lit(None).cast("string")).alias("j"))
    assert df.first().j == '{"PluginName":"file","EventName":"file","Data":null}'


def test_encoded_sample_decodes_to_itself(spark):
    text = nic('{"mac":"m","ips":["1"],"if_name":"e","rx_bytes":18446744073709551615}')
    once = I.samples(envelopes(spark, [text])).withColumn(
        "payload", P.encode_event(F.lit("host"), F.lit(""), F.col("stats")).cast("binary"))
    twice = I.samples(once.select("seq", "client_id", "payload", "arrival_ts"))
    assert once.first().stats == twice.first().stats


@pytest.mark.parametrize("text,scanned,unmarshalled", [
    (None, None, None), ("", None, None), ("null", 0.0, None), ('{"cpu":2}', 2.0, 2.0)])
def test_nullable_json_columns(spark, text, scanned, unmarshalled):
    df = spark.createDataFrame([(text,)], "t string").select(
        P.json_scan(F.col("t"), STATS).alias("s"), P.json_unmarshal(F.col("t"), STATS).alias("u"))
    row = df.select(F.col("s.cpu").alias("s"), F.col("u.cpu").alias("u"),
                    P.json_value(F.col("u")).alias("v"), P.json_marshal(F.col("u")).alias("m")).first()
    assert (row.s, row.u) == (scanned, unmarshalled)
    assert (row.v is None) == (unmarshalled is None)
    assert (row.m == "null") == (unmarshalled is None)


def test_service_info_round_trip(spark):
    infos = [
        ("a", "n", 5, ["127.0.0.1"], ("0.0.0.0", 8080), ("0.0.0.0", 8081), "t", "1h30m", "t"),
        ("nil-endpoint-test", "test", 0, None, None, None, "", "", ""),
        ("b", "n", 0, [], None, ("h", 1), "", "", ""),
    ]
    df = spark.createDataFrame(infos, SERVICE_INFO).select(F.struct("*").alias("i"))
    rows = df.select("i", P.encode_service_info(F.col("i")).alias("j")).withColumn(
        "back", P.decode_service_info(F.col("j"))).collect()
    assert all(r.i == r.back for r in rows)
    keys = [list(json.loads(r.j)) for r in rows]
    assert "listen_address" in keys[0] and "probe_endpoint" in keys[0]
    assert "listen_address" not in keys[1] and '"ips":null' in rows[1].j
    assert "probe_endpoint" in keys[2]


def test_size_cap_is_inclusive(spark):
    rows = envelopes(spark, ["é" * 3, "abc", "abcdefg"])
    assert [r.seq for r in I.within_size(rows, cap=6).orderBy("seq").collect()] == [0, 1]


def test_latest_breaks_ties_by_seq_and_keeps_first_time(spark):
    rows = envelopes(spark, [host('{"hostname":"a"}'), host('{"hostname":"b"}'), host('{"hostname":"c"}'), "{bad"])
    same_time = rows.withColumn("arrival_ts", F.expr("timestamp_ntz'2024-01-01'"))
    assert I.latest_snapshots(same_time).first().host_name == "c"
    reversed_time = rows.withColumn("arrival_ts", F.expr("timestamp_ntz'2024-01-01'") - F.make_dt_interval(secs=F.col("seq")))
    row = I.latest_snapshots(reversed_time).first()
    assert row.host_name == "a" and row.created_at < row.updated_at


def test_list_hosts_default(spark):
    rows = spark.range(25).select(F.format_string("m%02d", "id").alias("machine_id"))
    assert [r.machine_id for r in I.list_hosts(rows).collect()] == [f"m{i:02d}" for i in range(10)]


def test_reason_is_computed_once(spark):
    env = envelopes(spark, [host("{}")])
    judged = I.accepted(env).drop("doc").groupBy("client_id").agg(F.max("seq"))
    plan = judged._jdf.queryExecution().executedPlan().toString()
    before_shuffle = plan[plan.index("Exchange"):]
    assert before_shuffle.count("from_json(") == 1
    # the rows that won are not judged again, only decoded
    assert I.latest_snapshots(env)._jdf.queryExecution().executedPlan().toString().count("from_json(") == 1


def test_keys_of_any_case_reach_the_sample(spark):
    rows = I.samples(envelopes(spark, [host('{"CPU":5.5,"HostName":"n1","NETWORKS":[{"If_Name":"e"}]}')]))
    stats = rows.first().stats
    assert (stats.cpu, stats.hostname, stats.networks[0].if_name) == (5.5, "n1", "e")


def test_huge_payloads_leave_the_session_alive(spark):
    many = nic('{"ips":[' + ",".join(f'"10.0.{i % 250}.1"' for i in range(100_000)) + "]}")
    mixed = nic('{"ips":[' + ",".join(['"a"'] * 50_000) + ",5]}")
    large = host('{"os":"' + "x" * (10 * 1024 * 1024) + '"}')
    near = host('{"os":"' + "x" * (10 * 1024 * 1024 - 100) + '"}')
    got = I.classified(envelopes(spark, [many, mixed, large, near])).orderBy("seq").select("reason").collect()
    assert [r.reason for r in got] == [None, I.MALFORMED, I.TOO_LARGE, None]
    assert I.quarantine(envelopes(spark, [large])).count() == 1
    assert I.latest_snapshots(envelopes(spark, [large])).count() == 0
    assert spark.range(3).count() == 3
