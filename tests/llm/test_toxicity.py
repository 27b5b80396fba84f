import random

import numpy as np
import pytest
from conftest import prose

from hostloom.llm import toxicity

BAD = ["vileword", "nastyword", "slurword", "meanword"]


def test_ordinal_fit_recovers_weights_and_order():
    rng = np.random.default_rng(4)
    x = rng.standard_normal((6000, 3))
    w, t = np.array([1.5, -1.0, 0.0]), np.array([-0.5, 1.0, 2.5])
    noise = np.log(1 / rng.random(6000) - 1)
    y = ((x @ w + noise)[:, None] > t).sum(1)
    got_w, got_t = toxicity.fit_ordinal(x, y, 4, ridge=1e-6)
    assert np.abs(got_w - w).max() < 0.12 and np.abs(got_t - t).max() < 0.15
    p = toxicity.worse(got_w, got_t, x)
    assert (np.diff(p, axis=1) <= 0).all() and (np.diff(got_t) > 0).all()


def test_sparse_rows_equal_dense_ones():
    rng = np.random.default_rng(6)
    full = rng.poisson(0.15, (400, 30))
    rows, places = np.nonzero(full)
    sizes = rng.integers(0, 300, 400)
    x = toxicity.design(rows, places, full[rows, places], sizes, 30)
    hits = full.sum(1)
    dense = np.hstack([np.log1p(full), np.log1p(hits)[:, None], np.log1p(1000 * hits / np.maximum(sizes, 1))[:, None]])
    w, v = rng.standard_normal(32), rng.standard_normal(400)
    assert x.shape == dense.shape
    assert np.allclose(x @ w, dense @ w) and np.allclose(x.across(v), dense.T @ v)
    y = np.minimum(hits, 3)
    for a, b in zip(toxicity.fit_ordinal(x, y, steps=200), toxicity.fit_ordinal(dense, y, steps=200)):
        assert np.allclose(a, b, atol=1e-6)


def test_counts_equal_plain_counting():
    rng = random.Random(2)
    texts = [None, "", "Bad, bad!"] + [" ".join(rng.choice(["bad", "worse", "fine", "x"]) for _ in range(n)) for n in (1, 7, 90)]
    hashes = [toxicity.word_hashes([w], toxicity.PUNCTUATION)[0][0] for w in ("bad", "worse")]
    model = toxicity.Model(np.array(hashes), np.zeros(0), np.zeros(0))
    rows, places, counts, sizes = model.counts(texts)
    names = {int(h): w for h, w in zip(hashes, ("bad", "worse"))}
    got = {(int(r), names[int(model.words[p])]): int(c) for r, p, c in zip(rows, places, counts)}
    split = [[w.strip(",!") for w in (t or "").lower().split()] for t in texts]
    assert got == {(i, w): s.count(w) for i, s in enumerate(split) for w in names.values() if w in s}
    assert sizes.tolist() == [len(s) for s in split]
    assert [len(x) for x in toxicity.Model(np.zeros(0), np.zeros(0), np.zeros(0)).counts(texts)[:3]] == [0, 0, 0]


@pytest.fixture(scope="module")
def tables(spark):
    rng = random.Random(14)
    docs, labels = [], []
    for i in range(800):
        words = prose(rng, rng.randint(20, 200)).split()
        toxic = i % 4 == 0
        for _ in range(rng.choice([1, 2, 4, 8]) if toxic else 0):
            words.insert(rng.randrange(len(words)), rng.choice(BAD) + rng.choice(["", ",", "!"]))
        docs.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    return (spark.createDataFrame(docs, "doc_id long, text string"),
            spark.createDataFrame(labels, "doc_id long, toxic int"))


def test_held_out_texts(tables):
    docs, labels = tables
    got = toxicity.severity(docs, labels.filter("doc_id % 3 <> 0")).join(
        labels.withColumnRenamed("toxic", "label"), "doc_id").filter("doc_id % 3 = 0").collect()
    assert sum(r.toxic == bool(r.label) for r in got) / len(got) > 0.98
    by_hits = {n: np.mean([r.severity for r in got if r.n_hits == n]) for n in (0, 1, 8)}
    assert by_hits[0] < 0.2 < by_hits[1] < by_hits[8]
    for r in got:
        assert 1 >= r.p_1 >= r.p_2 >= r.p_3 >= 0 and abs(r.severity - r.p_1 - r.p_2 - r.p_3) < 1e-9


def test_copies_of_one_text_teach_no_words(spark, tables):
    docs, labels = tables
    copies = spark.createDataFrame([(5000 + i, "a harmless unusual sentence copied often " + str(i)) for i in range(60)], docs.schema)
    marked = spark.createDataFrame([(5000 + i, 1) for i in range(60)], labels.schema)
    probe = spark.createDataFrame([(9000, "harmless unusual sentence")], docs.schema)
    got = toxicity.severity(docs.union(copies).union(probe), labels.union(marked)).filter("doc_id = 9000").first()
    assert got.n_hits == 0 and not got.toxic


def test_hard_documents_and_labels(spark, hard, nothing, tables):
    docs, labels = tables
    odd = spark.createDataFrame([(1, 1), (1, 0), (2, None), (None, 1), (101, 1)], labels.schema)
    both = hard.select("doc_id", "text", "lang", "y", "n").unionByName(docs, allowMissingColumns=True)
    got = toxicity.severity(both, labels.filter("doc_id > 50").union(odd))
    assert got.count() == both.count() and got.filter("severity is null or toxic is null").count() == 0
    for some in (labels.limit(0), labels.filter("toxic = 1"), labels.filter("toxic = 0")):
        assert toxicity.severity(hard, some).filter("toxic").count() == 0
    assert toxicity.severity(nothing, labels).count() == 0
