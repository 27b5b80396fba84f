import hashlib
import random

import pytest
from pyspark.sql import functions as F

from hostloom.functions import ids, netfilter
from hostloom.functions import text as X
from hostloom.functions.duration import duration_from_json, duration_ns, uptime_label
from hostloom.functions.endpoint import format_endpoint, host_port, with_endpoint

ENDPOINTS = {
    "tcp://127.0.0.1:8080": ("tcp", "127.0.0.1", 8080, None),
    "http://localhost:80": ("http", "localhost", 80, None),
    "grpc://0.0.0.0:9090": ("grpc", "0.0.0.0", 9090, None),
    "tcp://host:1": ("tcp", "host", 1, None),
    "tcp://host:65535": ("tcp", "host", 65535, None),
    "tcp://[::1]:8080": ("tcp", "::1", 8080, None),
    "tcp://[2001:db8::1]:80": ("tcp", "2001:db8::1", 80, None),
    "127.0.0.1:8080": "missing '://'",
    "://127.0.0.1:8080": "empty protocol",
    "tcp://:8080": "empty host",
    "tcp://127.0.0.1": "missing port",
    "tcp://127.0.0.1:": "empty port",
    "tcp://127.0.0.1:abc": "invalid port",
    "tcp://127.0.0.1:0": "port out of range",
    "tcp://127.0.0.1:65536": "port out of range",
    "": "missing '://'",
    "tcp://[::1:8080": "missing ']'",
    "tcp://[::1]": "missing port after ']'",
    "tcp://[::1]:": "empty port",
    "tcp://[]:8080": "empty host in brackets",
    # beyond the published cases
    "tcp://": "empty host:port",
    "tcp://  ": "empty host:port",
    " tcp :// \u00a0h : 80 ": ("tcp", "h", 80, None),
    "tcp://[ ::1 ] : 80": ("tcp", "::1", 80, None),
    "tcp://[::1]8080": "missing port after ']'",
    "tcp://a:b:80": ("tcp", "a:b", 80, None),
    "a://b://c:1": ("a", "b://c", 1, None),
    "tcp://h:+80": ("tcp", "h", 80, None),
    "tcp://h:-1": "port out of range",
    "tcp://h:99999999999999999999": "invalid port",
}


def test_endpoints(spark):
    df = spark.createDataFrame([(s,) for s in ENDPOINTS], "s string")
    for row in with_endpoint(df, "s", "e").collect():
        want = ENDPOINTS[row.s]
        want = (None, None, None, want) if isinstance(want, str) else want
        assert tuple(row.e) == want, row.s
    missing = with_endpoint(spark.createDataFrame([(None,)], "s string"), "s", "e").first()
    assert missing.e.reason == "missing '://'"


def test_endpoint_format(spark):
    cases = {("tcp", "127.0.0.1", 8080): "tcp://127.0.0.1:8080", ("tcp", "2001:db8::1", 80): "tcp://[2001:db8::1]:80"}
    df = spark.createDataFrame(list(cases), "p string, h string, n int")
    for row in df.select("*", format_endpoint(F.col("p"), F.col("h"), F.col("n")).alias("e"),
                         host_port(F.col("h"), F.col("n")).alias("hp")).collect():
        assert row.e == cases[(row.p, row.h, row.n)]
        assert row.e == f"{row.p}://{row.hp}"


DURATIONS = {
    "1s": 10**9, "10m": 600 * 10**9, "1h30m": 5400 * 10**9, "1.5s": 1_500_000_000, "-2ms": -2_000_000,
    "+5us": 5000, "3µs": 3000, "3μs": 3000, "0": 0, "-0": 0, "1h1h": 7200 * 10**9, ".5s": 500_000_000, "1.s": 10**9,
    "1.9ns": 1, "100ns": 100, "2562047h47m16.854775807s": 2**63 - 1, "2562048h": None,
    "": None, "5": None, "s": None, "1x": None, "1 s": None, "1s ": None, ".s": None, "--1s": None, "1e3s": None,
    None: None,
}


def test_durations(spark):
    df = spark.createDataFrame([(s,) for s in DURATIONS], "s string")
    got = {r.s: r.ns for r in df.select("s", duration_ns(F.col("s")).alias("ns")).collect()}
    assert got == DURATIONS


def test_durations_in_json(spark):
    cases = {'"1m"': 60 * 10**9, "1500.9": 1500, "-1.9": -1, "7": 7, "true": None, "null": None, '"x"': None, "{": None}
    df = spark.createDataFrame([(s,) for s in cases], "s string")
    got = {r.s: r.ns for r in df.select("s", duration_from_json(F.col("s")).alias("ns")).collect()}
    assert got == cases


def test_uptime(spark):
    cases = {0: "0m", 59: "0m", 60: "1m", 3599: "59m", 3600: "1h0m", 86399: "23h59m", 86400: "1d0h0m", 90061: "1d1h1m"}
    df = spark.createDataFrame([(s,) for s in cases], "s long")
    assert {r.s: r.u for r in df.select("s", uptime_label(F.col("s")).alias("u")).collect()} == cases


def model_hash(text: str, bits: int) -> int:
    digest = hashlib.sha256(text.encode()).digest()
    h = 0xCBF29CE484222325
    for byte in digest:
        h = ((h ^ byte) * 0x100000001B3) % 2**64
    return (int.from_bytes(digest[:8], "big") ^ h) % 2**bits


def test_hash_equals_model(spark):
    texts = ["hello", "world", "", "é", *[f"host-{random.Random(i).random()}" for i in range(50)]]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for bits in (1, 8, 10, 32, 63):
        for row in df.select("t", ids.hash_bits(F.col("t"), bits).alias("h")).collect():
            assert row.h == model_hash(row.t, bits)
    with pytest.raises(ValueError):
        ids.hash_bits(F.lit("x"), 64)


def test_ids_round_trip_and_machine_range(spark):
    cases = [(1_800_000_000_000, 7, 4095), (ids.EPOCH_MS, 0, 0), (ids.EPOCH_MS + 2**41 - 1, 1023, 1)]
    df = spark.createDataFrame([*cases, (1_800_000_000_000, 1024, 0), (1_800_000_000_000, -1, 0)], "ms long, m long, s long")
    rows = df.select("*", ids.encode_id(F.col("ms"), F.col("m"), F.col("s")).alias("id")).withColumn(
        "back", ids.decode_id(F.col("id"))).collect()
    assert [tuple(r.back) for r in rows[:3]] == cases
    assert [r.id for r in rows[3:]] == [None, None]


def test_physical_interfaces(spark):
    cases = {"lo": False, "LO": True, "lo0": True, "eth0": True, "Docker0": False, "bridge0": True, "br-1": False,
             "VLAN10": False, "wlan0": True, "tunl0": False, "kube-ipvs0": False, "vb-1": False, "vb1": True}
    df = spark.createDataFrame([(s,) for s in cases], "s string")
    assert {r.s: r.p for r in df.select("s", netfilter.is_physical(F.col("s")).alias("p")).collect()} == cases


def test_ipv4(spark):
    cases = {"10.0.0.1/24": "10.0.0.1", "127.0.0.1/8": None, "127.9.9.9/8": None, "::1/128": None, "fe80::1/64": None,
             "::ffff:10.9.8.7/128": "10.9.8.7", "::FFFF:0a09:0807/128": "10.9.8.7", "::ffff:127.0.0.1/104": None,
             "::ffff:7f00:1/104": None, "256.1.1.1/8": None, "01.2.3.4/8": None, "1270.0.0.1/8": None}
    df = spark.createDataFrame([(s,) for s in cases], "s string")
    assert {r.s: r.p for r in df.select("s", netfilter.ipv4_of(F.col("s")).alias("p")).collect()} == cases
    listed = spark.createDataFrame([(list(cases),), (None,)], "s array<string>").select(
        netfilter.ipv4_addresses(F.col("s")).alias("a")).collect()
    assert [r.a for r in listed] == [["10.0.0.1", "10.9.8.7", "10.9.8.7"], []]


def test_registry_keys(spark):
    root = F.lit("/r/svc")
    cases = {"a": "/r/svc/a", " /r/svc/b ": "/r/svc/b", "\u3000": None, "": None, "/other": "/r/svc//other", None: None}
    df = spark.createDataFrame([(s,) for s in cases], "s string")
    assert {r.s: r.k for r in df.select("s", X.child_key(root, F.col("s")).alias("k")).collect()} == cases
    row = spark.range(1).select(
        X.registry_root(F.lit("/r"), F.lit("")).alias("a"), X.registry_root(F.lit("/r"), F.lit("svc")).alias("b"),
        X.self_key(root, F.lit("")).alias("c"), X.self_key(root, F.lit("7")).alias("d"),
        X.mutex_key(root, F.lit("m")).alias("e"), X.election_key(root, F.lit("x")).alias("f")).first()
    assert tuple(row) == ("/r", "/r/svc", "/r/svc", "/r/svc/self/7", "/r/svc/mutex/m", "/r/svc/election/leader/x")


def test_os_label(spark):
    cases = [("ubuntu", "22", "linux", "ubuntu 22"), ("ubuntu", "", "linux", "ubuntu"), ("", "22", "linux", "linux"),
             (None, None, "linux", "linux")]
    df = spark.createDataFrame(cases, "p string, v string, o string, want string")
    assert all(r.got == r.want for r in df.select(
        "want", X.os_label(F.col("p"), F.col("v"), F.col("o")).alias("got")).collect())


def test_access_lines(spark):
    cases = {
        "GET /a b/c 10.0.0.1 200 1.5ms": ("GET", "/a b/c", "10.0.0.1", 200, 1_500_000, None),
        "GET /x  404 12µs": ("GET", "/x", "", 404, 12_000, None),
        "GET /x ::1 200 soon": ("GET", "/x", "::1", 200, None, "bad_latency"),
        "nonsense": (None, None, None, None, None, "bad_line"),
        None: (None, None, None, None, None, "bad_line"),
    }
    df = spark.createDataFrame([(s,) for s in cases], "line string")
    assert {r[0]: tuple(r)[1:] for r in X.with_access_fields(df).collect()} == cases


@pytest.mark.parametrize("level,want", [
    ("silent", [None, None, None, None]), ("error", ["error", None, None, None]),
    ("warn", ["error", "slow", None, None]), ("info", ["error", "slow", "info", "info"])])
def test_statement_log_levels(spark, level, want):
    rows = [(1, 500.0, "deadlock"), (2, 200.1, "record not found"), (3, 200.0, "record not found"), (4, 1.0, None)]
    df = spark.createDataFrame(rows, "i int, ms double, err string").orderBy("i")
    assert [r.c for r in df.select(X.statement_log_class(F.col("ms"), F.col("err"), level).alias("c")).collect()] == want


def test_not_found_can_be_an_error(spark):
    df = spark.createDataFrame([(1.0, "record not found")], "ms double, err string")
    label = X.statement_log_class(F.col("ms"), F.col("err"), ignore_not_found=False)
    assert df.select(label.alias("c")).first().c == "error"


def test_long_durations_leave_the_session_alive(spark):
    from hostloom.functions.duration import duration_ns
    rows = spark.createDataFrame([("1s" * 100_000,), ("1s" * 100_000 + "x",), ("9" * 1_000_000 + "s",)], "t string")
    assert [r[0] for r in rows.select(duration_ns(rows.t)).collect()] == [100_000 * 10**9, None, None]
    assert spark.range(3).count() == 3
