import math
from collections import Counter, defaultdict

import pytest
from conftest import texts_of
from pyspark.sql import functions as F

from hostloom.llm import mixing


def sources(spark, sizes):
    return spark.createDataFrame(list(sizes.items()), "source string, tokens long")


def entropy(sizes, a):
    w = [n ** a for n in sizes]
    return -sum(x / sum(w) * math.log(x / sum(w)) for x in w)


@pytest.mark.parametrize("share", [0.05, 0.2, 0.6, 0.8, 0.95])
def test_exponent_meets_the_entropy(spark, share):
    sizes = {"a": 10_000, "b": 1_000, "c": 100, "d": 10}
    a = mixing.exponent(sources(spark, sizes), mixing.Mix(entropy=share, repeats=1e9))
    assert abs(entropy(sizes.values(), a) - share * math.log(4)) < 1e-6


@pytest.mark.parametrize("sizes", [[1000 + i for i in range(20)], [10**9 + i for i in range(5)], [100, 100, 99]])
def test_nearly_equal_sources_are_sharpened_to_the_target(spark, sizes):
    table = sources(spark, {f"s{i}": n for i, n in enumerate(sizes)})
    rows = mixing.weights(table, mixing.Mix(budget=sum(sizes), entropy=0.9)).collect()
    assert rows[0].exponent > 1 and all(abs(r.entropy - 0.9) < 1e-6 for r in rows)
    top = max(sizes)
    powers = {r.source: math.exp(rows[0].exponent * math.log(r.tokens / top)) for r in rows}
    for r in rows:
        want = powers[r.source] / sum(powers.values())
        assert abs(r.weight - want) < 1e-6 and abs(r.passes - r.weight * sum(sizes) / r.tokens) < 1e-6


def test_target_out_of_reach_leaves_sources_as_they_come(spark):
    # two sources tie at the top: their entropy alone is 0.63 of the maximum
    rows = mixing.weights(sources(spark, {"a": 10, "b": 10, "c": 9}), mixing.Mix(entropy=0.5)).collect()
    assert {r.exponent for r in rows} == {1.0} and all(r.entropy > 0.99 for r in rows)


def test_exponent_meets_the_repetition_limit(spark):
    sizes = {"a": 10_000, "b": 500}
    how = mixing.Mix(repeats=3.0)
    got = {r.source: r for r in mixing.weights(sources(spark, sizes), how).collect()}
    assert abs(got["b"].passes / got["a"].passes - 3) < 1e-6 and abs(got["a"].passes - 1) < 1e-9
    assert abs(sum(r.weight for r in got.values()) - 1) < 1e-9


def test_single_equal_and_empty_sources(spark):
    assert mixing.exponent(sources(spark, {"a": 5}), mixing.Mix()) == 1.0
    got = {r.source: r.passes for r in mixing.weights(sources(spark, {"a": 5, "b": 5, "z": 0}), mixing.Mix()).collect()}
    assert got == {"a": 1.0, "b": 1.0, "z": 1.0}


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, " ".join(["w"] * (1 + i % 7)), "big" if i % 10 else "small") for i in range(4000)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string")


@pytest.mark.parametrize("budget", [3_000, 16_000, 50_000])
def test_budget_is_met_by_whole_and_part_epochs(docs, budget):
    how = mixing.Mix(budget=budget, entropy=1.0, repeats=2.0, block=1000)
    rows = mixing.stream(docs, how).collect()
    tokens, words = Counter(), {d: len(t.split()) for d, t in texts_of(docs)}
    for r in rows:
        assert r.n_tokens == words[r.doc_id]
        tokens[r.source] += r.n_tokens
    weight = {r.source: r.weight for r in rows}
    for s, n in tokens.items():
        assert 0 <= n - weight[s] * budget < 8  # up to the row that fills the share
    epochs = defaultdict(set)
    for r in rows:
        assert r.doc_id not in epochs[r.source, r.epoch]
        epochs[r.source, r.epoch].add(r.doc_id)
    size = Counter("big" if d % 10 else "small" for d in words)
    for (s, e), ids in epochs.items():
        assert len(ids) == size[s] or e == max(k for t, k in epochs if t == s)
    blocks = Counter()
    for r in rows:
        blocks[r.block, r.source] += r.n_tokens
    for b in range(max(r.block for r in rows)):
        assert abs(blocks[b, "big"] / (blocks[b, "big"] + blocks[b, "small"]) - weight["big"]) < 0.15


def plain_front(rows, passes, how):
    """Uses per row: whole epochs, and the front of one more, sorted by the same places."""
    whole = math.floor(passes)
    need, uses = (passes - whole) * sum(n for _, n, _ in rows), Counter()
    for _, n, (doc, _) in sorted(rows):
        uses[doc] = whole + (need > 1e-6)
        need -= n
    return uses


@pytest.mark.parametrize("how", [mixing.Mix(budget=20_000, entropy=0.3), mixing.Mix(budget=9_000, repeats=3.0)])
def test_uses_equal_sorted_permutations(docs, how):
    rows = mixing.mixed(docs, how)
    at = mixing._order(rows.whole, rows.key, how)
    rows = rows.select("doc", "source", "tokens", "passes", "copies", at.alias("at")).collect()
    for source in ("big", "small"):
        own = [r for r in rows if r.source == source]
        want = plain_front([(r["at"], r.tokens, (r.doc.doc_id, 0)) for r in own], own[0].passes, how)
        assert {r.doc.doc_id: r.copies for r in own} == want


def test_columns_of_any_name_stay(docs):
    names = ["_key", "_tokens", "_s", "_cut", "_weight", "_passes", "_whole", "_copies", "_epoch", "doc", "key",
             "copies", "whole", "tokens", "weight", "passes", "exponent", "entropy", "a.b"]
    odd = docs.limit(50)
    for name in names:
        odd = odd.withColumn(name, F.concat(F.lit(f"{name} of "), F.col("doc_id").cast("string")))
    got = mixing.repeated(odd).collect()
    assert len({r.doc_id for r in got}) == 50
    assert all(r[name] == f"{name} of {r.doc_id}" for r in got for name in names)
    assert mixing.stream(odd).columns[:2] == ["doc_id", "source"]


def test_repeated_keeps_every_document(docs):
    got = mixing.repeated(docs, mixing.Mix(repeats=2.0))
    uses = Counter(r.doc_id for r in got.collect())
    assert got.columns == docs.columns and len(uses) == 4000
    assert {uses[d] for d in uses if d % 10} == {1} and {uses[d] for d in uses if d % 10 == 0} <= {1, 2}
    assert sum(uses[d] for d in uses if d % 10 == 0) > 700


def test_hard_documents_and_empty_tables(hard, nothing):
    got = mixing.repeated(hard, mixing.Mix(repeats=2.0))
    want = Counter(texts_of(hard))
    have = Counter(texts_of(got))
    assert set(have) == set(want) and all(have[k] >= want[k] for k in want) and got.columns == hard.columns
    rows = mixing.stream(hard, mixing.Mix(budget=2000))
    assert rows.filter("source is null").count() >= 1
    assert mixing.stream(nothing).count() == 0 and mixing.repeated(nothing).count() == 0
