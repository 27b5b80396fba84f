import random
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from hostloom.llm.sharding import RESULT, Shuffle, place, row_at, sharded, write_shards


def placed_rows(df):
    return sorted((r.doc_id is not None, r.doc_id or 0, r.text_crc32, r["size"], r.shard, r.slot) for r in df.collect())


@pytest.mark.parametrize("n", [1, 2, 3, 5, 24, 97, 400, 2003])
def test_places_are_a_bijection_with_an_inverse(spark, n):
    how = Shuffle(shards=7, seed=n)
    rows = spark.range(n).select("id", place(F.col("id"), n, how).alias("p")).select("id", "p.*")
    back = rows.select("id", "shard", "slot", row_at(F.col("shard"), F.col("slot"), n, how).alias("back")).collect()
    assert all(r.id == r.back for r in back)
    assert sorted(r.slot * 7 + r.shard for r in back) == list(range(n))


def test_no_row_at_places_beyond_the_end(spark):
    at = spark.createDataFrame([(0, 2), (3, 0), (-1, 0), (0, -1), (2, 1)], "shard int, slot long")
    found = at.select(row_at(F.col("shard"), F.col("slot"), 5, Shuffle(shards=3)).alias("r")).collect()
    assert [r.r for r in found] == [None] * 5
    assert at.select(row_at(F.col("shard"), F.col("slot"), 0).alias("r")).first().r is None


def test_seeds_give_different_orders_that_look_random(spark):
    def order(seed):
        rows = spark.range(3000).select("id", place(F.col("id"), 3000, Shuffle(shards=1, seed=seed)).alias("p"))
        return [r.slot for r in rows.select("id", "p.slot").orderBy("id").collect()]
    a, b = order(1), order(2)
    assert sum(x == y for x, y in zip(a, b)) < 20
    assert sum(x == i for i, x in enumerate(a)) < 20
    rising = sum(x < y for x, y in zip(a, a[1:]))
    assert 1400 < rising < 1600


def test_shards_are_level_and_slots_gapless(spark, hard):
    rows = sharded(hard, Shuffle(shards=24)).collect()
    assert len(rows) == hard.count()
    counts = Counter(r.shard for r in rows)
    assert set(counts) <= set(range(24)) and max(counts.values()) - min(counts.values()) <= 1
    for shard, n in counts.items():
        assert sorted(r.slot for r in rows if r.shard == shard) == list(range(n))
    assert sorted(r.row for r in rows) == list(range(len(rows)))
    for r in rows:
        data = (r.text or "").encode()
        assert (r["size"], r.text_crc32) == (len(data) + 8, zlib.crc32(data))


def test_layout_of_the_table_changes_nothing(spark, hard):
    one = placed_rows(sharded(hard.coalesce(1), columns=["doc_id"]))
    many = placed_rows(sharded(hard.orderBy(F.rand(3)).repartition(13), columns=["doc_id"]))
    assert one == many


def test_rows_follow_ids_and_ties_follow_the_text(spark):
    rows = [(2, "b"), (1, "z"), (2, "a"), (None, "y"), (1, "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    ids = [r.doc_id for r in sharded(df).orderBy("row").collect()]
    assert ids == [None, 1, 1, 2, 2]


def test_a_hot_row_is_spread_over_the_sort(spark):
    hot = spark.range(20_000).select(F.lit(None).cast("long").alias("doc_id"), F.lit("same").alias("text"))
    rest = spark.range(40_000).select(F.col("id").alias("doc_id"), F.col("id").cast("string").alias("text"))
    rows = sharded(hot.union(rest), Shuffle(shards=5))
    counts = [r["count"] for r in rows.groupBy("shard").count().collect()]
    assert counts == [12_000] * 5


def test_empty_table(nothing):
    assert sharded(nothing).collect() == []


def test_columns_of_docs_that_are_named_like_results(spark):
    df = spark.createDataFrame([(1, "x", "mine", "s", 3)], "doc_id long, text string, shard string, doc string, at int")
    row = sharded(df).first()
    assert row.asDict() == {"doc_id": 1, "text": "x", "doc": "s", "at": 3, "size": 9, "text_crc32": zlib.crc32(b"x"),
                            "row": 0, "shard": row.shard, "slot": 0}
    assert set(RESULT) < set(row.asDict())


def test_written_shards_hold_whole_rows_in_slot_order(spark, hard, tmp_path):
    placed = sharded(hard, Shuffle(shards=3))
    write_shards(placed, str(tmp_path / "out"), rows_per_file=5)
    read = spark.read.parquet(str(tmp_path / "out"))
    assert read.count() == hard.count()
    assert sorted(map(str, (r.text for r in read.collect()))) == sorted(map(str, (r.text for r in hard.collect())))
    for shard in range(3):
        for part in range(2):
            files = list((tmp_path / "out" / f"shard={shard}" / f"part={part}").glob("*.parquet"))
            assert len(files) == 1
            slots = [r.slot for r in spark.read.parquet(str(files[0])).collect()]
            assert slots == list(range(part * 5, part * 5 + 5))


def test_plan_is_native(spark, hard):
    plan = sharded(hard)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "InArrow" not in plan and "InPandas" not in plan


def test_bad_options():
    for options in ({"shards": 0}, {"rounds": 3}, {"rounds": 0}):
        with pytest.raises(ValueError):
            Shuffle(**options)


def test_long_walks_end(spark):
    """With few rows almost every value is outside at times; all walks still end inside."""
    rng = random.Random(1)
    for n in rng.sample(range(2, 60), 8):
        rows = spark.range(n).select(place(F.col("id"), n, Shuffle(shards=1, seed=5, rounds=2)).alias("p"))
        assert sorted(r.p.slot for r in rows.collect()) == list(range(n))
