"""Operators against brute force on small fixtures, with hot keys and small blocks."""

import math
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from hostloom.functions.order import place_of
from hostloom.operators import hosts, metrics, registry, reports, scan, sessions

RNG = random.Random(7)
# one key holds about a third of all rows
KEYED = [(i, "hot" if RNG.random() < 0.34 else f"k{RNG.randrange(20)}", RNG.randrange(50)) for i in
         RNG.sample(range(-500, 3000), 900)]


@pytest.fixture(scope="module")
def keyed(spark):
    return spark.createDataFrame(KEYED, "seq long, k string, v long").cache()


def by_key():
    groups = defaultdict(list)
    for seq, k, v in sorted(KEYED):
        groups[k].append((seq, v))
    return groups


@pytest.mark.parametrize("runs", [1, 2, 7, 40])
def test_scans_over_runs(keyed, runs):
    total = {(r.k, r.seq): r.t for r in scan.running_sum(keyed, ["k"], ["seq"], F.col("v"), "t", runs).collect()}
    before = {(r.k, r.seq): r.p for r in scan.neighbour(keyed, ["k"], ["seq"], {"p": "v"}, runs=runs).collect()}
    after = {(r.k, r.seq): r.p for r in scan.neighbour(keyed, ["k"], ["seq"], {"p": "v"}, True, runs).collect()}
    assert len(total) == len(before) == len(after) == len(KEYED)
    for k, rows in by_key().items():
        running = 0
        for i, (seq, v) in enumerate(rows):
            running += v
            assert total[k, seq] == running
            assert before[k, seq] == (rows[i - 1][1] if i else None)
            assert after[k, seq] == (rows[i + 1][1] if i + 1 < len(rows) else None)


def test_neighbour_keeps_null_values_and_null_keys(spark):
    df = spark.createDataFrame([(1, "a", 5), (2, "a", None), (30, "a", 7), (4, None, 1), (5, None, 2)], "seq long, k string, v long")
    for runs in (1, 4):
        rows = scan.neighbour(df, ["k"], ["seq"], {"p": "v"}, runs=runs).orderBy("k", "seq").collect()
        assert [r.p for r in rows] == [None, 1, None, 5, None]


def test_a_hot_key_is_cut_into_level_runs(spark):
    hot = spark.range(30_000).selectExpr("id * 65536 AS seq", "'hot' AS k", "1L AS v")
    rows = hot.union(spark.range(10_000).selectExpr("id", "concat('k', id % 50)", "1L"))
    sizes = [r["count"] for r in scan.cut(rows, ["k"], ["seq"], 16).groupBy(scan.RUN).count().collect()]
    assert len(sizes) == 16 and max(sizes) < 2 * 40_000 / 16
    last = scan.running_sum(rows, ["k"], ["seq"], F.col("v"), "t", 16).groupBy("k").agg(F.max("t").alias("t"))
    assert {r.t for r in last.collect()} == {30_000, 200}


def test_place_of_sorts_like_time_and_number(spark):
    stamps = ["1900-01-01 00:00:00", "1970-01-01 00:00:00", "2024-01-01 00:00:00.000001", "9999-12-31 23:59:59"]
    numbers = [-2**63, -1, 0, 7 << 16, 2**63 - 1]
    df = spark.createDataFrame([(t, n) for t in stamps for n in numbers], "t string, seq long").withColumn(
        "ts", F.col("t").cast("timestamp_ntz"))
    rows = df.withColumn("at", place_of(df, ["ts", "seq"])).collect()
    assert sorted(rows, key=lambda r: (r.ts, r.seq)) == sorted(rows, key=lambda r: r["at"])
    assert len({r["at"] for r in rows}) == len(rows)


def test_counters_last_row_wins_and_missing_is_zero(spark):
    nics = spark.createDataFrame([("h", "eth0"), ("h", "eth1"), ("g", "eth0")], "host string, if_name string")
    counters = spark.createDataFrame([("h", "eth0", 1, 10), ("h", "eth0", 2, 20), ("h", "x", 1, 5)],
                                     "host string, if_name string, pos int, rx_bytes long")
    rows = hosts.with_counters(nics, counters, ["host", "if_name"], "pos", ["rx_bytes"]).collect()
    assert sorted(map(tuple, rows)) == [("g", "eth0", 0), ("h", "eth0", 20), ("h", "eth1", 0)]


def test_usage_drops_failed_lookups(spark):
    parts = spark.createDataFrame([("/",), ("/data",)], "mountpoint string")
    usage = spark.createDataFrame([("/", 5.0)], "mountpoint string, used_percent double")
    assert [tuple(r) for r in hosts.with_usage(parts, usage, ["mountpoint"]).collect()] == [("/", 5.0)]


def test_assemble_keeps_order_and_empty_lists(spark):
    scalars = spark.createDataFrame([("a", 1.0), ("b", 2.0)], "host string, cpu double")
    disks = spark.createDataFrame([("a", 2, "/z"), ("a", 1, "/y")], "host string, pos int, mountpoint string")
    nics = spark.createDataFrame([("a", 1, "eth0")], "host string, pos int, if_name string")
    rows = {r.host: r for r in hosts.assemble(scalars, disks, nics, ["host"]).collect()}
    assert [d.mountpoint for d in rows["a"].disk] == ["/y", "/z"]
    assert rows["b"].disk == [] and rows["b"].networks == []


def test_counter_rejects_negative(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("a", -5.0), ("b", None)], "l string, delta double")
    assert [tuple(r) for r in metrics.counter(df, ["l"]).collect()] == [("a", 3.0)]
    assert metrics.counter_rejects(df).count() == 2


def test_gauge_folds_in_order(spark):
    ops = [("s", i, RNG.choice(["set", "inc", "dec", "add"]), float(RNG.randrange(9))) for i in range(200)]
    ops += [("no-set", 1, "inc", None), ("no-set", 2, "add", 2.5), ("only-set", 1, "set", 4.0)]
    want = defaultdict(float)
    for s, _, op, v in ops:
        want[s] = v if op == "set" else want[s] + {"inc": 1, "dec": -1, "add": v}[op]
    df = spark.createDataFrame(ops, "series string, seq long, op string, value double")
    assert {r.series: r.value for r in metrics.gauge(df).collect()} == dict(want)


def test_histogram_bounds_are_inclusive(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 1.5), ("a", 99.0)], "l string, v double")
    rows = metrics.histogram(df, ["l"], "v", [2.5, 1]).collect()
    assert [(r.le, r.bucket_count) for r in rows] == [("1", 1), ("2.5", 2), ("+Inf", 3)]
    assert {(r.observed_count, r.observed_sum) for r in rows} == {(3, 101.5)}


@pytest.mark.parametrize("runs", [1, 3, 20])
def test_gauge_over_runs(spark, runs):
    rng = random.Random(runs)
    rows = [(i * 1000, rng.choice("aab"), rng.choice(["set", "inc", "dec", "add", "add"]), float(rng.randrange(9))) for i in range(400)]
    want = {}
    for _, k, op, v in rows:
        want[k] = v if op == "set" else want.get(k, 0) + {"inc": 1, "dec": -1, "add": v}[op]
    df = spark.createDataFrame(rows, "seq long, series string, op string, value double")
    assert {r.series: r.value for r in metrics.gauge(df, runs=runs).collect()} == want


def test_several_metrics_in_one_pass(spark):
    rng = random.Random(8)
    rows = [(rng.choice("ab"), rng.choice(["x", "y"]), rng.choice([None, -1.0, 2.0, 5.0, 7.5, 40.0, float(rng.randrange(30))]))
            for _ in range(500)]
    df = spark.createDataFrame(rows, "k string, l string, v double")
    kinds = [metrics.Metric("n_total", ("k", "l"), "v"), metrics.Metric("size", ("k",), "v", bounds=(0, 5, 10)),
             metrics.Metric("wait", (), "v", quantiles=(0.5, 0.99))]
    for runs in (1, 6):
        got = {(r.metric, tuple(sorted(r.labels.items()))): r.value for r in metrics.collected(df, kinds, runs).collect()}
        want = {}
        for k in "ab":
            for l in "xy":
                want["n_total", (("k", k), ("l", l))] = sum(v for a, b, v in rows if (a, b) == (k, l) and v is not None and v >= 0)
            mine = [v for a, _, v in rows if a == k and v is not None]
            for b in (0, 5, 10):
                want["size_bucket", (("k", k), ("le", str(b)))] = sum(v <= b for v in mine)
            want["size_bucket", (("k", k), ("le", "+Inf"))] = want["size_count", (("k", k),)] = len(mine)
            want["size_sum", (("k", k),)] = sum(mine)
        every = sorted(v for *_, v in rows if v is not None)
        for q in (0.5, 0.99):
            want["wait", (("quantile", str(q)),)] = every[max(math.ceil(q * len(every)), 1) - 1]
        want["wait_sum", ()], want["wait_count", ()] = sum(every), len(every)
        assert got == {k: pytest.approx(v) for k, v in want.items()}
    assert metrics.collected(df.limit(0), kinds).collect() == []


@pytest.mark.parametrize("spread", [1, 30, 10**6])
def test_summary_is_exact(spark, spread):
    rows = [("hot" if RNG.random() < 0.5 else f"k{RNG.randrange(4)}", float(RNG.randrange(spread)) / 8)
            for _ in range(3000)] + [(None, 1.0), ("one", 5.0), ("one", None)]
    df = spark.createDataFrame(rows, "l string, v double")
    qs = [0.0, 0.07, 0.5, 0.9, 0.99, 1.0]
    groups = defaultdict(list)
    for l, v in rows:
        if v is not None:
            groups[l].append(v)
    want = {(l, q): sorted(vs)[max(math.ceil(round(q * len(vs), 9)), 1) - 1] for l, vs in groups.items() for q in qs}
    got = metrics.summary(df, ["l"], "v", qs).collect()
    assert {(r.l, r["quantile"]): r.value for r in got} == want and len(got) == len(want)
    assert all(r.observed_count == len(groups[r.l]) for r in got)


def test_summary_approx_is_within_tolerance(spark):
    values = RNG.sample(range(10**6), 5000)
    df = spark.createDataFrame([("a", float(v)) for v in values], "l string, v double")
    ordered = sorted(values)
    for r in metrics.summary_approx(df, ["l"], "v", {0.5: 0.05, 0.99: 0.001}).collect():
        tolerance = {0.5: 0.05, 0.99: 0.001}[r["quantile"]]
        assert abs(ordered.index(int(r.value)) / 5000 - r["quantile"]) <= tolerance + 1 / 5000


def test_zero_fill_shows_declared_and_keeps_others(spark):
    declared = spark.createDataFrame([("a",), ("b",)], "l string")
    seen = spark.createDataFrame([("a", 2.0), ("c", 3.0)], "l string, value double")
    assert sorted(map(tuple, metrics.zero_fill(declared, seen, ["l"]).collect())) == [("a", 2.0), ("b", 0.0), ("c", 3.0)]


def test_exposition_lines(spark):
    deltas = spark.createDataFrame([("GET", "/api", 1.0), ("GET", "/api", 2.0), ("POST", "/echo", 1.0)],
                                   "method string, path string, delta double")
    labels = ["path", "method"]
    total = metrics.as_samples(metrics.counter(deltas, labels), "apm_test", "http_requests_total", labels)
    odd = metrics.as_samples(spark.createDataFrame([('a"b\\c\nd', 0.5), ("inf", float("inf")), ("nan", float("nan")),
                                                    ("big", 1e300)], "l string, value double"), "", "odd", ["l"])
    lines = {r.line for r in metrics.exposition(total.unionByName(odd).unionByName(metrics.admin_info(spark))).collect()}
    assert lines == {
        'apm_test_http_requests_total{method="GET",path="/api"} 3',
        'apm_test_http_requests_total{method="POST",path="/echo"} 1',
        'odd{l="a\\"b\\\\c\\nd"} 0.5', 'odd{l="inf"} +Inf', 'odd{l="nan"} NaN', 'odd{l="big"} 1.0E300',
        'admin_info{version="v1"} 1',
    }


CHANGES = "rev long, ts timestamp_ntz, svc_key string, op string, val string, ttl_s long"


def changes(spark, rows):
    raw = spark.createDataFrame(rows, "rev long, t long, svc_key string, op string, val string, ttl_s long")
    at = F.expr("timestamp_ntz'2024-01-01 00:00:00'") + F.make_dt_interval(secs=F.col("t"))
    return raw.select("rev", at.alias("ts"), "svc_key", "op", "val", "ttl_s")


def test_registry_state_and_lookups(spark):
    log = changes(spark, [(1, 0, "/r/a", "PUT", "1", None), (2, 0, "/r/a", "PUT", "2", None), (3, 0, "/r/b", "PUT", "3", None),
                          (4, 0, "/r/b", "DELETE", "", None), (5, 0, "/r/ab", "PUT", "5", None), (6, 0, "/r/a", "UNKNOWN", "x", None)])
    assert sorted((r.svc_key, r.val) for r in registry.current(log).collect()) == [("/r/a", "2"), ("/r/ab", "5")]
    assert [r.val for r in registry.get(log, " /r/a ").collect()] == ["2"]
    assert registry.get(log, "/r/b").count() == 0
    assert sorted(r.svc_key for r in registry.get_prefix(log, " /r/a").collect()) == ["/r/a", "/r/ab"]
    asked = spark.createDataFrame([(1, " /r/a"), (2, "/r/b"), (3, "/r/a")], "request_id long, svc_key string")
    assert sorted((r.request_id, r.status, r.val) for r in registry.get_many(log, asked).collect()) == [
        (1, "ok", "2"), (2, "not_found", None), (3, "ok", "2")]
    nothing = changes(spark, [(1, 0, "/r/b", "PUT", None, None)])
    assert {r.status for r in registry.get_many(nothing, asked).collect()} == {"ok", "not_found"}
    assert [r.rev for r in registry.watch(log, "/r/a").orderBy("rev").collect()] == [1, 2]
    assert [r.rev for r in registry.watch(log, "/r/", True, since_rev=2).orderBy("rev").collect()] == [3, 4, 5]
    with pytest.raises(registry.EmptyKey):
        registry.watch(log, "  ")


def test_lease_floor_and_keepalive(spark):
    log = changes(spark, [(1, 0, "short", "PUT", "", 1), (2, 0, "long", "PUT", "", 60), (3, 0, "free", "PUT", "", None)])
    def alive(second, kept=None):
        at = F.expr("timestamp_ntz'2024-01-01 00:00:00'") + F.make_dt_interval(secs=F.lit(second))
        return {r.svc_key for r in registry.live(log, at, kept).collect()}
    assert alive(6) == {"short", "long", "free"}
    assert alive(7) == {"long", "free"}
    assert alive(61) == {"free"}
    kept = changes(spark, [(1, 5, "short", "", "", None), (2, 50, "short", "", "", None)]).select("svc_key", "ts")
    assert alive(11, kept) == {"short", "long", "free"}
    assert alive(12, kept) == {"long", "free"}


LEASES = [(1, 0, "a", "PUT", "", 60), (2, 50, "a", "PUT", "", 60), (3, 300, "a", "PUT", "", 60),
          (4, 310, "b", "PUT", "", 600), (5, 330, "b", "DELETE", "", None), (6, 400, "b", "PUT", "", 600),
          (7, 410, "b", "PUT", "", 30), (8, 500, "c", "DELETE", "", None), (9, 600, "c", "PUT", "", 1),
          (10, 700, "d", "PUT", "", 600), (11, 720, "d", "PUT", "", None), (12, 800, "free", "PUT", "", None)]


@pytest.mark.parametrize("runs", [1, 2, 5, 12])
def test_lease_spans(spark, runs):
    got = {(r.svc_key, r.started_at.strftime("%M:%S"), r.ended_at.strftime("%M:%S"), r.ended_by, r.puts)
           for r in registry.lease_spans(changes(spark, LEASES), runs).collect()}
    assert got == {("a", "00:00", "01:50", "expired", 2), ("a", "05:00", "06:00", "expired", 1),
                   ("b", "05:10", "05:30", "revoked", 1), ("b", "06:40", "07:20", "expired", 2),
                   ("c", "10:00", "10:06", "expired", 1), ("d", "11:40", "12:00", "kept", 1)}


def test_live_agrees_with_lease_spans(spark):
    log = changes(spark, LEASES)
    spans = registry.lease_spans(log).collect()
    start = F.expr("timestamp_ntz'2024-01-01 00:00:00'")
    for second in (1, 55, 111, 301, 320, 331, 415, 445, 603, 705, 900):
        alive = registry.live(log, start + F.make_dt_interval(secs=F.lit(second)))
        leased = {r.svc_key for r in alive.filter("expires_at is not null").collect()}
        at = [s for s in spans if (s.started_at.minute * 60 + s.started_at.second) <= second
              < s.ended_at.minute * 60 + s.ended_at.second]
        assert leased == {s.svc_key for s in at}, second


def test_services_leave_out_dead_instances(spark):
    log = changes(spark, [(1, 0, "/r/self/1", "PUT", "tcp://h:1", 6), (2, 0, "/r/self/2", "PUT", "tcp://h:2", 600),
                          (3, 90, "/r/self/3", "PUT", "tcp://h:3", 600)])
    at = F.expr("timestamp_ntz'2024-01-01 00:01:00'")
    assert [r.service_id for r in registry.services(log, "/r", at).collect()] == ["2"]


def test_registry_filters_reach_the_scan(spark, tmp_path):
    changes(spark, [(1, 0, "/r/a", "PUT", "1", None)]).write.parquet(str(tmp_path / "c"))
    log = spark.read.parquet(str(tmp_path / "c"))
    def plan(df):
        return df._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(svc_key,/r/a)" in plan(registry.get(log, "/r/a"))
    assert "StringStartsWith(svc_key,/r/)" in plan(registry.get_prefix(log, "/r/"))
    assert "GreaterThan(rev" in plan(registry.watch(log, "/r/a", since_rev=5))


def conn_events(spark, rows):
    raw = spark.createDataFrame(rows, "seq long, conn string, what string, client_id string")
    at = F.expr("timestamp_ntz'2024-01-01 00:00:00'") + F.make_dt_interval(secs=F.col("seq"))
    return raw.withColumn("ts", at).withColumn("listener", F.lit("l"))


def test_active_connections_refuse_and_ignore(spark):
    rows = [(1, "a", "open", ""), (2, "a", "open", ""), (3, "b", "close", ""), (4, "b", "open", ""), (5, "a", "message", ""),
            (6, "a", "close", ""), (7, "a", "close", ""), (8, "b", "close", "")]
    for runs in (1, 3, 8):
        got = sessions.active_connections(conn_events(spark, rows), "conn", "listener", runs).orderBy("seq").collect()
        assert [(r.seq, r.active) for r in got] == [(1, 1), (2, 1), (3, 1), (4, 2), (6, 1), (7, 1), (8, 0)]
    curve = sessions.active_curve(conn_events(spark, rows), "conn", "listener", "minute").collect()
    assert [r.active for r in curve] == [0]
    assert sessions.open_connections(conn_events(spark, rows[:5]), "conn").count() == 2


def test_arrival_order_of_sparse_numbers(spark):
    """Numbers as read from several Kafka partitions: offset << 16 | partition, which do not rise with time."""
    rng = random.Random(5)
    offsets, rows = [0] * 4, []
    for second in range(300):
        part = rng.randrange(4)
        offsets[part] += 1
        rows.append((second // 2, offsets[part] << 16 | part, f"c{rng.randrange(6)}", rng.choice(["open", "close", "message"]),
                     rng.choice(["", "x", "y", "z"]), rng.randrange(9)))
    at = F.expr("timestamp_ntz'2024-01-01 00:00:00'") + F.make_dt_interval(secs=F.col("s"))
    df = spark.createDataFrame(rows, "s long, seq long, conn string, what string, client_id string, v long").withColumn(
        "ts", at).withColumn("listener", F.lit("l"))
    rows.sort(key=lambda r: (r[0], r[1]))
    assert [r[1] for r in rows] != sorted(r[1] for r in rows)

    live, active = set(), []
    open_session, ended, by_client = {}, {}, {}
    falls, last = 0, None
    for s, seq, conn, what, client, v in rows:
        falls += last is not None and v < last
        last = v
        if what == "message":
            continue
        (live.add if what == "open" else live.discard)(conn)
        active.append((seq, len(live)))
        if conn in open_session:
            ended.setdefault(open_session.pop(conn), (seq, "closed" if what == "close" else "superseded"))
        if what == "open":
            client = client or f"client-{seq}"
            ended.setdefault(by_client.get(client), (seq, "superseded"))
            open_session[conn] = by_client[client] = seq
    for runs in (1, 6):
        got = sessions.active_connections(df, "conn", "listener", runs).orderBy("ts", "seq").collect()
        assert [(r.seq, r.active) for r in got] == active
        for r in sessions.sessions(df, "conn", runs).collect():
            assert r.ended_by == ended.get(r.session, (None, None))[1], r
        assert reports.out_of_order(df, "listener", ["ts", "seq"], "v", runs).first().out_of_order == falls
    assert {r.conn for r in sessions.open_connections(df, "conn").collect()} == live


def test_first_client_id_stays(spark):
    rows = [(1, "a", "message", ""), (2, "a", "message", "x"), (3, "a", "message", "y"), (4, "b", "message", ""), (5, "b", "message", None)]
    got = sessions.connection_clients(conn_events(spark, rows), "conn").collect()
    assert {r.conn: r.client_id for r in got} == {"a": "x", "b": None}


def test_sessions_end_by_their_own_connection(spark):
    rows = [(1, "1", "open", "a"), (2, "2", "open", ""), (3, "3", "open", "a"), (4, "1", "close", "a"), (5, "4", "open", None),
            (6, "5", "open", "b"), (7, "2", "close", ""), (8, "5", "close", "b"), (9, "4", "open", "x")]
    for runs in (1, 2, 8):
        got = sessions.sessions(conn_events(spark, rows), "conn", runs).orderBy("session").collect()
        # session 3 is the newest of client a: the close of connection 1 leaves it alone
        assert [(r.session, r.client_id, r.ended_by) for r in got] == [
            (1, "a", "superseded"), (2, "client-2", "closed"), (3, "a", None), (5, "client-5", "superseded"),
            (6, "b", "closed"), (9, "x", None)]
        assert [r.closed_at and r.closed_at.second for r in got] == [3, 7, None, 9, 8, None]


def test_session_activity(spark):
    events = conn_events(spark, [(2, "a", "message", ""), (1, "a", "open", ""), (9, "a", "message", "")]).withColumn(
        "headers", F.create_map(F.lit("n"), F.col("seq").cast("string")))
    row = sessions.session_activity(events, "conn").first()
    assert row.metadata == {"n": "1"} and row.last_active.second == 9


def test_ids_past_a_full_millisecond_wait(spark):
    # the millisecond offset 4094 leaves room for two ids, offset 4096 for 4096
    rows = [(i, 1, 4094) for i in range(5)] + [(10 + i, 1, 4096) for i in range(5000)] + [(9000, 2, 4094)]
    df = spark.createDataFrame(rows, "seq long, machine long, ms long")
    for runs in (1, 9):
        got = sorted(reports.assign_ids(df, "machine", "ms", ["seq"], 0, runs).collect(), key=lambda r: r.seq)
        slot, want = {}, []
        for r in got:
            slot[r.machine] = max(slot.get(r.machine, -1) + 1, r.ms * 4096 + r.ms % 4096)
            at = slot[r.machine] >> 12
            want.append((slot[r.machine] % 4096, at > r.ms, at << 22 | r.machine << 12 | slot[r.machine] % 4096))
        assert [(r.sequence, r.waited, r.id) for r in got] == want
        assert len({r.id for r in got}) == len(rows) and sum(r.waited for r in got) > 900


def test_out_of_order(spark):
    df = spark.createDataFrame([(1, "a", 5), (2, "a", 3), (3, "a", 3), (40, "a", 1), (41, "b", 1)], "seq long, k string, v long")
    for runs in (1, 2, 5):
        got = reports.out_of_order(df, "k", ["seq"], "v", runs).collect()
        assert {r.k: (r.total, r.out_of_order) for r in got} == {"a": (4, 2), "b": (1, 0)}


def test_reports(spark):
    at = F.expr("timestamp_ntz'2024-01-01 00:00:00'") + F.make_dt_interval(secs=F.col("s"))
    ops = spark.createDataFrame([(1, 0, False), (1, 10, False), (1, 4, True), (2, 3, False)], "level int, s long, failed boolean")
    got = reports.throughput(ops.withColumn("ts", at), ["level"], F.col("failed")).collect()
    assert {r.level: (r.ops, r.errors, r.ops_per_second) for r in got} == {1: (2, 1, 0.2), 2: (1, 0, None)}
    sent = spark.createDataFrame([("w1", True), ("w1", True), ("w2", True), ("w2", False)], "w string, ok boolean").withColumn("k", F.lit(1))
    row = reports.delivery(sent, ["k"], "w", F.col("ok")).first()
    assert tuple(row) == (1, 2, 1.5, 1, 2, 25.0)


def test_exposition_of_histograms_and_summaries(spark):
    rows = spark.createDataFrame([("a", 1.0), ("a", 2.5), ("a", 9.0)], "k string, v double")
    samples = metrics.histogram_samples(metrics.histogram(rows, ["k"], "v", [2, 5]), "s", "size", ["k"]).unionByName(
        metrics.summary_samples(metrics.summary(rows, ["k"], "v", [0.5]), "s", "wait", ["k"]))
    families = {"s_size": ("histogram", "A \\ and\na line."), "s_wait": ("summary", "Waiting.")}
    got = [r.line for r in metrics.exposition(samples, families).orderBy("family", "place", "line").collect()]
    assert got == [
        "# HELP s_size A \\\\ and\\na line.", "# TYPE s_size histogram", 's_size_bucket{k="a",le="+Inf"} 3',
        's_size_bucket{k="a",le="2"} 1', 's_size_bucket{k="a",le="5"} 2', 's_size_count{k="a"} 3', 's_size_sum{k="a"} 12.5',
        "# HELP s_wait Waiting.", "# TYPE s_wait summary", 's_wait_count{k="a"} 3', 's_wait_sum{k="a"} 12.5',
        's_wait{k="a",quantile="0.5"} 2.5']


def test_service_metrics_start_at_zero(spark):
    none = spark.createDataFrame([], "sink_type string, status string, rows long, bytes long")
    nobody = spark.createDataFrame([], "conn string")
    lines = [r.line for r in metrics.exposition(metrics.databus_metrics(none, nobody)).collect()]
    assert sorted(lines) == ['databus_bytes_written_total{sink_type="kafka"} 0', 'databus_connections_active{state="connected"} 0',
                             'databus_records_written_total{sink_type="kafka",status="success"} 0']
    requests = spark.createDataFrame([("GET", 200), ("GET", 200), ("PUT", 500)], "method string, status int")
    one = spark.createDataFrame([("a",)], "conn string")
    lines = [r.line for r in metrics.exposition(metrics.controller_metrics(requests, one)).collect()]
    assert sorted(lines) == ['controller_agent_connections_active{state="connected"} 1',
                             'controller_requests_total{method="GET",status="200"} 2',
                             'controller_requests_total{method="PUT",status="500"} 1']
