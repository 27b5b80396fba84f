import random
from concurrent.futures import ThreadPoolExecutor
from pathlib import Path

import pytest
from pyspark.sql import functions as F
from test_operators import changes
from test_payload import envelopes, host

from hostloom.functions.order import place_of
from hostloom.operators import ingest as I
from hostloom.operators import registry
from hostloom.plans import views as V
from hostloom.schemas import ENVELOPE, SNAPSHOT
from hostloom.sinks.base import FanOutError, Sink, fan_out
from hostloom.sinks.config import SinkConfigError, ensure_tables, plan_sinks
from hostloom.sinks.kafka import record_files_sink, to_kafka_rows
from hostloom.sinks.snapshots import SnapshotTable, Version, merge_statements, quarantine_sink, snapshot_columns, table_statements
from hostloom.sources.changes import read_changes
from hostloom.sources.envelopes import UnsupportedSource, envelopes_from_kafka, read_envelopes, read_sources
from hostloom.sources.mapping import ColumnMapping
from hostloom.streaming import jobs


def land(df, path):
    columns = [F.col(f.name).cast(f.dataType).alias(f.name) if f.name in df.columns
               else F.lit(None).cast(f.dataType).alias(f.name) for f in ENVELOPE]
    df.select(*columns).write.mode("append").parquet(path)


def rows_of(df):
    return sorted(map(str, df.collect()))


@pytest.fixture(scope="module")
def env(spark, sf):
    return V.envelopes(spark, sf).cache()


@pytest.fixture(scope="module")
def expected(env):
    return rows_of(I.latest_snapshots(env))


# --- sources ---------------------------------------------------------------


def test_sources_union_and_errors(spark, env, tmp_path):
    land(env.filter("seq < 10"), str(tmp_path / "a"))
    config = {"type": "agent", "config": {"path": str(tmp_path / "a")}}
    assert read_sources(spark, [config, config]).count() == 20
    assert read_sources(spark, []).count() == 0
    with pytest.raises(UnsupportedSource):
        read_sources(spark, [config, {"type": "file"}])
    with pytest.raises(ValueError):
        read_sources(spark, [{"type": "agent"}])


def test_kafka_records_become_envelopes(spark):
    records = spark.createDataFrame(
        [(bytearray(b"c"), bytearray(b"{}"), "t", p, o, [("h", bytearray(b"v"))]) for p in (0, 1) for o in (0, 1)],
        "key binary, value binary, topic string, partition int, offset long, headers array<struct<key string, value binary>>"
    ).withColumn("timestamp", F.expr("timestamp'2024-01-01 00:00:00'"))
    rows = envelopes_from_kafka(records).collect()
    assert len({r.seq for r in rows}) == 4
    assert {(r.client_id, r.conn_id, r.headers["h"]) for r in rows} == {("c", "t#0", "v"), ("c", "t#1", "v")}


# --- sinks -----------------------------------------------------------------


def test_kafka_rows(spark):
    rows = envelopes(spark, ["", "x", host("null")], client=None)
    assert sorted((bytes(r.key), bytes(r.value)) for r in to_kafka_rows(rows).collect()) == [
        (b"", b"x"), (b"", host("null").encode())]


def test_upsert_ignores_order_and_repeats(spark, env, expected, tmp_path):
    table = SnapshotTable(spark, str(tmp_path / "t"))
    rows = I.accepted(env).drop("doc")
    assert table.read().count() == 0
    late = rows.filter("seq % 3 = 0")
    table.upsert(rows.filter("seq % 3 = 1"), "b")
    table.upsert(rows.filter("seq % 3 = 2"), "a")
    table.upsert(late, "c")
    first = rows_of(table.read())
    assert first == expected
    table.upsert(late, "c")
    table.upsert(late.limit(0), "d")
    assert table.versions() == [1, 2, 3, 4]
    assert rows_of(table.read()) == expected == rows_of(table.read(3))
    assert table.vacuum(keep=2) > 0
    assert table.versions() == [3, 4] and rows_of(table.read()) == expected


def files_under(path):
    return sorted(str(p.relative_to(path)) for p in path.rglob("*.parquet"))


def test_readers_open_one_folder_per_bucket_after_many_batches(spark, env, expected, tmp_path):
    table = SnapshotTable(spark, str(tmp_path / "t"), buckets=4)
    rows = I.accepted(env).drop("doc").cache()
    for i in range(6):
        table.upsert(rows.filter(F.col("seq") % 6 == i), str(i))
    assert rows_of(table.read()) == expected
    opened = {f.split("?")[0].rsplit("/", 1)[0] for f in table.reduced().inputFiles()}
    assert len(opened) == 4 and len(table.reduced().inputFiles()) == 4


def test_an_upsert_writes_touched_buckets_only(spark, env, tmp_path):
    table = SnapshotTable(spark, str(tmp_path / "t"), buckets=8)
    rows = I.accepted(env).drop("doc")
    table.upsert(rows, "1")
    before = table.version()
    machine = rows.first().client_id
    table.upsert(rows.filter(F.col("client_id") == machine), "2")
    after = table.version()
    changed = [b for b in after.folders if after.folders[b] != before.folders[b]]
    assert len(changed) == 1 and len(before.folders) == 8
    assert rows_of(table.read()) == rows_of(table.read(before.number))


def test_two_writers_at_once_lose_nothing(spark, env, expected, tmp_path):
    """A writer finds its number taken: by one that changed other buckets, then by one that changed the same."""
    rows = I.accepted(env).drop("doc").cache()
    path = str(tmp_path / "t")
    mine, other = SnapshotTable(spark, path, buckets=4), SnapshotTable(spark, path, buckets=4)
    commit, rivals, merges = mine._commit, [rows.filter("seq % 3 = 1"), rows.filter("seq % 3 = 2")], []

    def late_commit(version):
        if rivals:
            other.upsert(rivals.pop(), "rival")
        return commit(version)

    merged = mine._merged
    mine._commit = late_commit
    mine._merged = lambda *a: merges.append(1) or merged(*a)
    mine.upsert(rows.filter("seq % 3 = 0"), "mine")
    assert rows_of(other.read()) == expected
    assert other.versions() == [1, 2, 3] and len(merges) == 3
    # the folders of the two attempts in vain are gone
    assert {f.split("/")[0] for f in files_under(tmp_path / "t" / "data")} == {
        f for n in other.versions() for f in other.version(n).folders.values()}


def test_writers_in_threads(spark, env, expected, tmp_path):
    rows = I.accepted(env).drop("doc").cache()
    tables = [SnapshotTable(spark, str(tmp_path / "t"), buckets=2) for _ in range(3)]
    with ThreadPoolExecutor(3) as pool:
        list(pool.map(lambda i: tables[i].upsert(rows.filter(F.col("seq") % 3 == i), str(i)), range(3)))
    assert rows_of(tables[0].read()) == expected and tables[0].versions() == [1, 2, 3]


def test_a_taken_number_is_refused(spark, tmp_path):
    table = SnapshotTable(spark, str(tmp_path / "t"))
    version = Version(1, 16, {3: "x"})
    assert table._commit(version) and not table._commit(version)
    assert table.version() == version
    assert sorted(p.name for p in (tmp_path / "t" / "versions").iterdir() if p.suffix == ".json") == ["000000000001.json"]


def test_equal_times_go_by_number(spark, tmp_path):
    table = SnapshotTable(spark, str(tmp_path / "t"), buckets=2)
    for seq in (5, 9, 7):
        one = envelopes(spark, [host('{"hostname":"h%d"}' % seq)], client="m").withColumn("seq", F.lit(seq).cast("long"))
        table.upsert(I.accepted(one).drop("doc"), str(seq))
    assert [(r.host_name, r.seq) for r in table.read().collect()] == [("h9", 9)]


@pytest.mark.parametrize("limit", [0, 1 << 26])
def test_latest_rows_are_fetched_by_list_or_by_bitmap(spark, env, expected, limit):
    rows = I.accepted(env).drop("doc")
    assert rows_of(I.as_snapshots(I.reduce_to_latest(rows, env, limit))) == expected
    twice = rows.union(rows)
    assert rows_of(I.as_snapshots(I.reduce_to_latest(twice, limit=limit))) == expected


def test_latest_carries_no_payload_through_a_sort(spark, env):
    snapshots = I.latest_snapshots(env)
    assert "SortAggregate" not in snapshots._jdf.queryExecution().toString()
    state = I.accepted(env).groupBy("client_id").agg(
        F.min("arrival_ts"), F.max_by(F.xxhash64("payload"), place_of(env, I.RECENCY)))
    plan = state._jdf.queryExecution().toString()
    assert "HashAggregate" in plan and "SortAggregate" not in plan


def broken():
    def put(rows, batch):
        raise OSError("down")
    return Sink("broken", F.lit(True), put)


def test_fan_out_goes_on_after_a_failure(spark, env, expected, tmp_path):
    table = SnapshotTable(spark, str(tmp_path / "t"))
    sinks = [broken(), record_files_sink(str(tmp_path / "k")), table.sink(), quarantine_sink(str(tmp_path / "q"))]
    got = {r.sink_type: r for r in fan_out(I.drop_greetings(env), sinks).collect()}
    assert got["broken"].status == "error" and "down" in got["broken"].error
    assert got["broken"].rows == I.drop_greetings(env).count()
    assert got["kafka"].rows == spark.read.parquet(str(tmp_path / "k")).count()
    assert got["mysql"].rows + got["quarantine"].rows == got["broken"].rows
    assert rows_of(table.read()) == expected
    quarantined = spark.read.parquet(str(tmp_path / "q"))
    assert quarantined.count() == got["quarantine"].rows and "reason" in quarantined.columns
    with pytest.raises(FanOutError):
        fan_out(env, [broken(), table.sink()], on_error="fail")


def test_single_and_no_sink(env, tmp_path, spark):
    table = SnapshotTable(spark, str(tmp_path / "t"))
    assert [r.status for r in fan_out(env, [table.sink()]).collect()] == ["success"]
    assert fan_out(env, []).count() == 0


def test_an_empty_batch(spark, env, tmp_path):
    table = SnapshotTable(spark, str(tmp_path / "t"))
    sinks = [record_files_sink(str(tmp_path / "k")), table.sink(), quarantine_sink(str(tmp_path / "q"))]
    for rows in (spark.createDataFrame([], ENVELOPE), env.filter("seq < 0"), env.filter(F.lit(False))):
        assert [(r.status, r.rows, r.bytes) for r in fan_out(rows, sinks).collect()] == [("success", 0, 0)] * 3
    assert table.read().count() == 0


def test_sink_plan(spark, tmp_path, caplog):
    kafka = {"type": "kafka", "config": {"brokers": ["b:9092"], "topic": "t"}}
    mysql = {"type": "mysql", "config": {"url": "tcp://127.0.0.1:3306", "database": "d"}}
    assert [s.type for s in plan_sinks(spark, [kafka, {**mysql, "enabled": True}, {**kafka, "enabled": None}])] == [
        "kafka", "mysql", "kafka"]
    assert plan_sinks(spark, []) == []
    assert plan_sinks(spark, [{**kafka, "enabled": False}, {"type": "nope"}]) == []
    assert "unknown sink type" in caplog.text and "dropped" in caplog.text
    bad = [
        {"type": "kafka"}, {"type": "kafka", "config": {"brokers": [], "topic": "t"}},
        {"type": "kafka", "config": {"brokers": ["b", 1], "topic": "t"}}, {"type": "kafka", "config": {"brokers": ["b"]}},
        {"type": "mysql", "config": {"database": "d"}}, {"type": "mysql", "config": {"url": "x", "database": "d"}},
        {"type": "mysql", "config": {"url": "tcp://h:1"}},
    ]
    for entry in bad:
        with pytest.raises(SinkConfigError):
            plan_sinks(spark, [kafka, entry])
    assert plan_sinks(spark, [{"type": "kafka", "enabled": False}]) == []


def test_snapshot_columns_and_merge_sql(env):
    row = snapshot_columns(I.latest_snapshots(env)).first()
    assert row.stats.startswith('{"cpu":') and row.ips.startswith("[")
    assert row.seq is not None
    insert, date, update = merge_statements("t", "s")
    assert "LEAST(t.created_at, s.created_at)" in date
    assert update.startswith("UPDATE t") and update.endswith("WHERE (s.updated_at, s.seq) > (t.updated_at, t.seq)")
    assert "WHERE t.machine_id IS NULL" in insert and "t.seq = s.seq" in update
    assert "UNIQUE KEY uk_machine_id (machine_id)" in table_statements("t")[0]


def test_ensure_tables_adds_missing_columns(spark):
    name = "hostloom_setup_test"
    spark.sql(f"DROP DATABASE IF EXISTS {name} CASCADE")
    try:
        partial = type(SNAPSHOT)(SNAPSHOT.fields[:6])
        assert ensure_tables(spark, name, schema=partial) == []
        assert ensure_tables(spark, name) == ["updated_at", "deleted_at", "seq"]
        assert ensure_tables(spark, name) == []
        assert spark.table(f"{name}.t_host_snapshots").columns == SNAPSHOT.fieldNames()
    finally:
        spark.sql(f"DROP DATABASE IF EXISTS {name} CASCADE")


# --- streams ---------------------------------------------------------------


def test_ingest_in_small_batches_equals_batch(spark, env, expected, tmp_path):
    src, checkpoint = str(tmp_path / "src"), str(tmp_path / "cp")
    for i in range(3):
        land(env.filter(F.col("seq") % 3 == i).coalesce(1), src)
    table = SnapshotTable(spark, str(tmp_path / "t"))
    sinks = [record_files_sink(str(tmp_path / "k")), broken(), table.sink(), quarantine_sink(str(tmp_path / "q"))]

    def run():
        stream = read_envelopes(spark, src, streaming=True, max_files_per_trigger=1)
        query = jobs.ingest(stream, sinks, checkpoint, str(tmp_path / "log"), available_now=True)
        query.awaitTermination()

    run()
    # a bounded trigger makes rows wait and drops none
    assert len(table.versions()) == 3
    assert rows_of(table.read()) == expected
    delivered = spark.read.parquet(str(tmp_path / "log")).groupBy("sink_type", "status").agg(F.sum("rows").alias("n"))
    totals = {(r.sink_type, r.status): r.n for r in delivered.collect()}
    kept = I.drop_greetings(env).count()
    assert totals["broken", "error"] == kept
    assert totals["mysql", "success"] + totals["quarantine", "success"] == kept
    # a restart from the same checkpoint goes on where it stopped
    more = envelopes(spark, [host('{"hostname":"new"}')], client="extra")
    land(more.withColumn("seq", F.lit(10**9).cast("long")).coalesce(1), src)
    run()
    assert table.read().filter("machine_id = 'extra'").first().host_name == "new"
    assert len(table.versions()) == 4


def test_a_trigger_is_bounded_by_bytes(spark, tmp_path):
    """Files of unequal size: batches take files up to the bound, a larger file by itself, and the log tells it."""
    src, log = tmp_path / "src", str(tmp_path / "log")
    for i, rows in enumerate([5, 5, 5, 4000, 5, 5]):
        body = host('{"os":"%s"}')
        many = envelopes(spark, [body % random.Random(f"{i}.{j}").randbytes(40).hex() for j in range(rows)], client=f"c{i}")
        land(many.coalesce(1), str(src))
    sizes = sorted(p.stat().st_size for p in src.glob("*.parquet"))
    bound = 3 * sizes[4]
    assert sizes[5] > bound
    stream = read_envelopes(spark, str(src), streaming=True, max_bytes_per_trigger=bound)
    jobs.ingest(stream, [quarantine_sink(str(tmp_path / "q"))], str(tmp_path / "cp"), log, available_now=True).awaitTermination()
    batches = spark.read.parquet(log).filter("sink_type = 'received'").orderBy("batch").collect()
    assert sum(r.rows for r in batches) == 4025 and len(batches) >= 3
    assert [r.rows for r in batches if r.rows >= 4000] and all(r.rows <= 15 for r in batches if r.rows < 4000)
    assert all(r.bytes > 80 * r.rows for r in batches)
    with pytest.raises(ValueError):
        read_envelopes(spark, str(src), True, max_files_per_trigger=1, max_bytes_per_trigger=1)


def test_files_with_other_columns_are_read_in_place(spark, tmp_path):
    spark.createDataFrame([(1, "a", "x"), (2, "b", "y")], "n int, who string, extra string").write.json(str(tmp_path / "j"))
    mapping = ColumnMapping("n int, who string", {"seq": "n * 10", "client_id": "up", "payload": "'{}'"},
                            {"up": "upper(who)"}, "n > 1")
    for streaming in (False, True):
        rows = read_envelopes(spark, str(tmp_path / "j"), streaming, "json", mapping=mapping)
        assert rows.dtypes == [(f.name, f.dataType.simpleString()) for f in ENVELOPE] and rows.isStreaming == streaming
    row = read_envelopes(spark, str(tmp_path / "j"), fmt="json", mapping=mapping).collect()
    assert [(r.seq, r.client_id, bytes(r.payload), r.headers) for r in row] == [(20, "B", b"{}", None)]


def test_mapped_columns_that_nobody_needs_are_not_read(spark, sf):
    rows = read_envelopes(spark, f"{sf}/events.parquet", mapping=V.ENVELOPES).select("seq", "conn_id")
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<event_id:bigint,user_id:bigint>" in plan


def test_a_failing_batch_is_replayed(spark, env, tmp_path):
    src, checkpoint = str(tmp_path / "src"), str(tmp_path / "cp")
    land(env, src)
    table = SnapshotTable(spark, str(tmp_path / "t"))

    def run(sinks):
        stream = read_envelopes(spark, src, streaming=True)
        jobs.ingest(stream, sinks, checkpoint, on_error="fail", available_now=True).awaitTermination()

    with pytest.raises(Exception, match="sinks failed"):
        run([table.sink(), broken()])
    first = rows_of(table.read())
    run([table.sink(), record_files_sink(str(tmp_path / "k"))])
    assert rows_of(table.read()) == first and len(table.versions()) == 2
    assert spark.read.parquet(str(tmp_path / "k")).count() > 0


def test_a_new_checkpoint_does_not_replace_old_rows(spark, tmp_path):
    table = SnapshotTable(spark, str(tmp_path / "t"))
    for name in ("one", "two"):
        src = str(tmp_path / name)
        land(envelopes(spark, [host("{}")], client=name), src)
        stream = read_envelopes(spark, src, streaming=True)
        jobs.ingest(stream, [table.sink()], f"{src}-cp", available_now=True).awaitTermination()
    assert sorted(r.machine_id for r in table.read().collect()) == ["one", "two"]


def test_latest_state_equals_batch(spark, env, expected, tmp_path):
    src = str(tmp_path / "src")
    for i in (1, 0):
        land(env.filter(F.col("seq") % 2 == i).coalesce(1), src)
    table = SnapshotTable(spark, str(tmp_path / "t"))
    stream = read_envelopes(spark, src, streaming=True, max_files_per_trigger=1)
    jobs.latest(stream, table, str(tmp_path / "cp"), available_now=True).awaitTermination()
    assert rows_of(table.read()) == expected


def lease_log(spark):
    return changes(spark, [
        (1, 0, "a", "PUT", "", 60), (2, 50, "a", "PUT", "", 60), (3, 300, "a", "PUT", "", 60),
        (4, 0, "b", "PUT", "", 600), (5, 20, "b", "DELETE", "", 600),
        (6, 0, "c", "PUT", "", 1), (7, 0, "free", "PUT", "", None), (8, 5000, "z", "PUT", "", 6)])


def test_folders_without_a_manifest_are_not_read(spark, env, tmp_path):
    table = SnapshotTable(spark, str(tmp_path / "t"), buckets=2)
    table.upsert(I.accepted(env).drop("doc"), "1")
    first = rows_of(table.read())
    land(env.limit(5), str(tmp_path / "t" / "data" / "lost" / "bucket=0"))
    (tmp_path / "t" / "versions" / ".draft-lost").write_text("{")
    assert rows_of(table.read()) == first and table.versions() == [1]
    assert table.vacuum() == 0 and (tmp_path / "t" / "data" / "lost").exists()


def test_a_failing_sink_costs_no_second_pass(spark, env, tmp_path):
    """The source is read for judging once, however many sinks there are and whether they fail."""
    src = str(tmp_path / "src")
    land(env, src)
    reads = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            reads.add(batch.num_rows)
            yield batch

    rows = read_envelopes(spark, src)
    counted = rows.mapInArrow(count, rows.schema)
    sinks = [broken(), record_files_sink(str(tmp_path / "k")), broken(), quarantine_sink(str(tmp_path / "q"))]
    outcomes = fan_out(counted, sinks).collect()
    assert reads.value == rows.count()
    assert [r.rows for r in outcomes][0] == rows.count() == [r.rows for r in outcomes][2]


def test_scratch_folders_go(spark, env, tmp_path):
    root = Path(spark.conf.get("spark.checkpoint.dir"))
    before = set(root.iterdir())
    table = SnapshotTable(spark, str(tmp_path / "t"), buckets=2)
    fan_out(env, [table.sink(), broken()])
    assert set(root.iterdir()) == before


def test_watch_stream(spark, tmp_path):
    src, out = str(tmp_path / "src"), str(tmp_path / "out")
    lease_log(spark).write.parquet(src)
    jobs.watch_events(read_changes(spark, src, streaming=True), "b", out, str(tmp_path / "cp"),
                      available_now=True).awaitTermination()
    assert [r.event for r in spark.read.parquet(out).orderBy("rev").collect()] == ["PUT", "DELETE"]


def spans_of(df):
    return sorted((r.svc_key, r.started_at, r.ended_at, r.ended_by, r.puts) for r in df.collect())


def test_lease_stream_equals_batch_over_restarts(spark, tmp_path):
    """Changes come in several files and runs; state and timers go on from the checkpoint."""
    rng = random.Random(11)
    log, second = [], 0
    for rev in range(120):
        second += rng.randrange(40)
        op = rng.choice(["PUT", "PUT", "PUT", "DELETE", "OTHER"])
        ttl = rng.choice([None, 1, 30, 60, 120]) if op == "PUT" else None
        log.append((rev, second, f"k{rng.randrange(5)}", op, "", ttl))
    # a put at the very end of a lease still renews it
    log += [(200, 9000, "edge", "PUT", "", 60), (201, 9060, "edge", "PUT", "", 60)]
    whole = changes(spark, log)
    src, out, checkpoint = (str(tmp_path / n) for n in ("src", "out", "cp"))

    def run(rows):
        if rows is not None:
            changes(spark, rows).coalesce(1).write.mode("append").parquet(src)
        jobs.lease_spans(read_changes(spark, src, streaming=True), out, checkpoint, available_now=True).awaitTermination()
        return spans_of(spark.read.parquet(out))

    run(log[:50])
    early = run(log[50:90])
    assert run(None) == early  # a restart without news changes nothing
    assert early and set(early) < set(spans_of(registry.lease_spans(whole)))
    run(log[90:])
    # time goes on: leases run out though no change of their keys comes
    assert run([(999, 50_000, "other", "DELETE", "", None)]) == spans_of(registry.lease_spans(whole))


def test_lease_stream_runs_in_a_session_with_the_default_state_store(spark, tmp_path):
    """The stream brings the store its timers need; the session keeps its own setting."""
    plain, setting = spark.newSession(), "spark.sql.streaming.stateStore.providerClass"
    default = "org.apache.spark.sql.execution.streaming.state.HDFSBackedStateStoreProvider"
    plain.conf.set(setting, default)
    src, out = str(tmp_path / "src"), str(tmp_path / "out")
    lease_log(spark).coalesce(1).write.parquet(src)
    for _ in range(2):  # the second run starts from the checkpoint
        jobs.lease_spans(read_changes(plain, src, streaming=True), out, str(tmp_path / "cp"),
                         available_now=True).awaitTermination()
        # the lease of the newest change has not run out
        whole = [s for s in spans_of(registry.lease_spans(lease_log(spark))) if s[0] != "z"]
        assert whole and spans_of(plain.read.parquet(out)) == whole
    assert plain.conf.get(setting) == default


def test_lease_stream_takes_changes_without_time(spark, tmp_path):
    """They come beside a key's open span, which goes on, and are not late in a later batch."""
    def undated(*log):
        rows = changes(spark, [(rev, 0, *rest) for rev, *rest in log])
        return rows.withColumns({"rev": F.lit(None).cast("bigint"), "ts": F.lit(None).cast("timestamp_ntz")})

    src, out, checkpoint = (str(tmp_path / n) for n in ("src", "out", "cp"))

    def run(*batches):
        for rows in batches:
            rows.coalesce(1).write.mode("append").parquet(src)
        jobs.lease_spans(read_changes(spark, src, streaming=True), out, checkpoint, available_now=True).awaitTermination()
        return [(s.svc_key, s.started_at and s.started_at.second, s.ended_at and s.ended_at.second, s.ended_by, s.puts)
                for s in spark.read.parquet(out).orderBy("started_at", "puts").collect()]

    lost = ("a", None, None, "expired")
    first = run(changes(spark, [(1, 0, "a", "PUT", "", 20)]),
                undated((2, "a", "PUT", "", 20), (3, "a", "PUT", "", 20), (4, "a", "DELETE", "", None), (5, "a", "PUT", "", None)))
    assert first == [(*lost, 2)]
    dated = changes(spark, [(6, 15, "a", "PUT", "", 20), (7, 9000, "other", "DELETE", "", None)])
    assert run(dated, undated((8, "a", "PUT", "", 20))) == [(*lost, 1), (*lost, 2), ("a", 0, 35, "expired", 2)]
    assert run(undated((9, "a", "PUT", "", 20)))[:2] == [(*lost, 1), (*lost, 1)]
