import random

import numpy as np
import pytest
from conftest import prose, texts_of
from pyspark.sql import functions as F

from hostloom.llm import near_dups
from hostloom.llm.common import settle
from hostloom.llm.components import connected
from hostloom.llm.near_dups import Banding, _texts_of, near_duplicates, signatures


def shingle_set(text, size):
    w = (text or "").encode().lower().split()
    return set(zip(*[w[i:] for i in range(size)])) if len(w) >= size else {tuple(w)} if w else set()


def brute(rows, how):
    sets = [shingle_set(t, how.size) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= how.percent * (len(sets[i]) + len(sets[j]) - both):
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    out = []
    for i, (d, _) in enumerate(rows):
        component = least.get(find(i)) if sets[i] else d
        kept = component is None or d == component
        out.append((d, len(sets[i]), component, kept))
    return sorted(out, key=repr)


def edited(rng, text, changes):
    words = text.split()
    for _ in range(changes):
        words[rng.randrange(len(words))] = "q" + str(rng.randrange(10**6))
    return " ".join(words)


@pytest.mark.parametrize("how", [Banding(size=3, percent=85, rows=4), Banding()])
def test_equals_brute_force(spark, how):
    rng = random.Random(8)
    rows, passage = [], prose(rng, 60)
    for g in range(12):
        base = prose(rng, rng.randint(30, 200))
        rows += [(len(rows) + k, edited(rng, base, rng.choice([0, 0, 1, 2, 4, 8, 16]))) for k in range(12)]
    rows += [(len(rows) + k, prose(rng, 20) + " " + passage + " " + prose(rng, 20)) for k in range(20)]
    rows += [(900, None), (901, ""), (902, "one"), (903, "ONE "), (904, "a b"), (None, rows[0][1]), (None, "null id only"),
             (None, "null id only"), rows[3], rows[3], (3, "another text under a used id")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = near_dups.near_duplicates(df, how).collect()
    assert sorted(map(tuple, got), key=repr) == brute(rows, how)


def test_hard_documents_and_empty_tables(hard, nothing):
    got = near_dups.near_duplicates(hard).collect()
    assert sorted(map(tuple, got), key=repr) == brute(texts_of(hard), Banding())
    assert near_dups.near_duplicates(nothing).count() == 0
    assert near_dups.deduplicated(nothing).count() == 0


def test_deduplicated_keeps_one_of_each_group(hard):
    got = near_dups.deduplicated(hard)
    assert got.columns == hard.columns
    ids = [r.doc_id for r in got.select("doc_id").collect()]
    kept = {d for d, _, _, k in brute(texts_of(hard), Banding()) if k and d is not None}
    assert {i for i in ids if i is not None} == kept
    # one row without id is a copy of another's text and goes; the texts of id 7 are different
    assert ids.count(5) == 1 and ids.count(None) == 1 and ids.count(7) == 2


def test_a_large_group_of_edited_copies(spark):
    rng = random.Random(3)
    base = prose(rng, 150)
    rows = [(i, edited(rng, base, rng.randint(0, 25))) for i in range(150)]
    how = Banding(size=3, percent=85, rows=4)
    got = near_dups.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), how).collect()
    assert sorted(map(tuple, got), key=repr) == brute(rows, how)


def test_bitmaps_differ_in_no_more_bits_than_sets_in_shingles():
    rng = random.Random(9)
    texts = ["", None, "one"] + [prose(rng, n) for n in (3, 50, 400, 5000)]
    texts += [edited(rng, t, k) for t in texts[3:] for k in (1, 20, 300)]
    sets, bounds = near_dups.shingles(texts, 3)
    marks = near_dups.parity(sets, bounds)
    own = [set(sets[a:b].tolist()) for a, b in zip(bounds, bounds[1:])]
    for i, x in enumerate(own):
        for j, y in enumerate(own):
            apart = int(np.bitwise_count(marks[i] ^ marks[j]).sum())
            assert apart <= len(x ^ y) and apart % 2 == len(x ^ y) % 2


def test_components(spark):
    chain = [(i, i + 1) for i in range(30)] + [(100, 200), (200, 100), (7, 7), (300, 100)]
    got = dict(connected(spark.createDataFrame(chain, "a long, b long")).collect())
    assert got == {**{i: 0 for i in range(31)}, 100: 100, 200: 100, 300: 100}
    assert connected(spark.createDataFrame([], "a long, b long")).count() == 0


def test_rows_without_id_stay_linear(spark):
    """2,000 different rows without id, and 2,000 under one id: no pair of rows and nodes is formed."""
    rng = random.Random(3)
    common = prose(rng, 60)
    rows = [(None if i % 2 else 7, f"{common} {prose(rng, 2)}") for i in range(4000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    how = Banding()
    found = settle(signatures(df, how), "signatures")
    nodes = found.groupBy("node").agg(F.min("doc_id").alias("rep"))
    texts = _texts_of(df, settle(nodes, "nodes"), how, "doc_id", "text")
    texts.collect()
    plan = texts._jdf.queryExecution().executedPlan()
    made, todo = [], [plan]
    while todo:
        node = todo.pop()
        if "Join" in node.nodeName():
            made.append(node.metrics().apply("numOutputRows").value())
        inner = node.executedPlan() if "AdaptiveSparkPlan" in node.nodeName() else node.plan() if "QueryStage" in node.nodeName() else None
        todo += [inner] if inner is not None else [node.children().apply(i) for i in range(node.children().size())]
    assert made and max(made) <= 4000
    marks = near_duplicates(df).collect()
    assert len(marks) == 4000 and len({r.component_id for r in marks}) == 1
