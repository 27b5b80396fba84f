import math
import random
from collections import defaultdict

import numpy as np
import pytest
from conftest import prose
from pyspark.sql import functions as F

from hostloom.llm import quality
from hostloom.llm.common import least_by_hash


def junk(rng, words):
    return " | ".join(prose(rng, words).split()) if rng.random() < 0.5 else (prose(rng, 3) + " ") * (words // 3)


@pytest.fixture(scope="module")
def tables(spark):
    rng = random.Random(9)
    rows = []
    for i in range(900):
        bad_site = i % 3 == 0
        bad = rng.random() < (0.8 if bad_site else 0.05)
        text = junk(rng, rng.randint(30, 200)) if bad else prose(rng, rng.randint(30, 200))
        rows.append((i, text, "bad.example" if bad_site else f"site{i % 7}.example", f"/p{i % 4}", int(not bad)))
    df = spark.createDataFrame(rows, "doc_id long, text string, host string, path string, quality int")
    return df.drop("quality"), df.select("doc_id", "quality")


def test_held_out_accuracy(tables):
    docs, labels = tables
    got = quality.scored(docs, labels.filter("doc_id % 2 = 0"), F.col("host"), F.col("path"))
    held = got.join(labels, "doc_id").filter("doc_id % 2 = 1")
    right = held.filter("keep = (quality = 1)").count() / held.count()
    assert right > 0.97
    assert held.filter("quality = 1 and not keep").count() <= 2


def test_sparse_sites_stay_near_their_prior(spark, tables):
    docs, labels = tables
    lone = spark.createDataFrame([(5000, "a b", "lone.example", "/")], docs.schema)
    got = quality.scored(docs.union(lone), labels, F.col("host"), F.col("path")).groupBy("host").agg(
        F.avg("host_share").alias("s"), F.avg("doc_score").alias("p")).collect()
    share = {r.host: r.s for r in got}
    mean = np.average([r.p for r in got])
    assert share["bad.example"] < 0.35 < 0.8 < share["site1.example"]
    # one document says nothing about itself: its site has the global share
    total = quality.scored(docs, labels, F.col("host"), F.col("path")).agg(F.avg("doc_score")).first()[0]
    assert abs(share["lone.example"] - total) < 0.02 and 0 < mean < 1


def test_strength_of_a_prior():
    rng = np.random.default_rng(1)
    def sums(a, b, groups=400, n=50):
        theta = rng.beta(a, b, groups)
        x = rng.random((groups, n)) < theta[:, None]
        s = x.sum(1)
        mean = x.mean()
        return {"rows": groups * n, "groups": groups, "tops": 1, "squares": float(x.sum()), "between": float((s * s / n).sum()),
                "base": mean * mean * groups * n, "sizes": n}, mean
    assert 6 < quality._strength(*sums(7, 3)) < 16
    assert quality._strength(*sums(7000, 3000)) > 300


def test_hard_documents_and_labels(spark, hard, nothing):
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, None), (101, 0), (None, 1), (9999, 1)], "doc_id long, quality int")
    got = quality.scored(hard, labels, F.col("source"), F.col("lang"))
    assert got.count() == hard.count() and got.filter("posterior is null or keep is null").count() == 0
    for some in (labels.limit(0), labels.filter("quality = 1")):
        assert quality.scored(hard, some, F.col("source"), F.col("lang")).filter("not keep").count() == 0
    assert quality.scored(nothing, labels, F.col("source"), F.col("lang")).count() == 0
    kept = quality.kept(hard, labels, F.col("source"), F.col("lang"))
    # rows without id are judged like all others
    assert kept.columns == hard.columns and kept.count() == got.filter("keep").count()
    assert kept.filter("doc_id is null").count() == got.filter("doc_id is null and keep").count()


def brute_posteriors(rows, host_prior, path_prior):
    """Posteriors by dictionaries, from each row's host, path and score."""
    def logit(p):
        p = min(max(p, 1e-6), 1 - 1e-6)
        return math.log(p / (1 - p))

    hosts, paths = defaultdict(list), defaultdict(list)
    for h, p, s in rows:
        hosts[h].append(s)
        paths[h, p].append(s)
    mean = sum(s for _, _, s in rows) / len(rows)
    out = []
    for h, p, s in rows:
        at_host = (sum(hosts[h]) - s + host_prior * mean) / (len(hosts[h]) - 1 + host_prior)
        at_path = (sum(paths[h, p]) - s + path_prior * at_host) / (len(paths[h, p]) - 1 + path_prior)
        out.append((at_host, at_path, 1 / (1 + math.exp(-(logit(s) + logit(at_path) - logit(mean))))))
    return out


def test_posteriors_equal_brute_force(spark, tables, monkeypatch):
    strengths = []
    whole = quality._strength
    monkeypatch.setattr(quality, "_strength", lambda *a: strengths.append(whole(*a)) or strengths[-1])
    docs, labels = tables
    odd = spark.createDataFrame([(6000, "a b", None, None), (None, "c d", None, "x"), (6001, None, "h", None)], docs.schema)
    got = quality.scored(docs.union(odd), labels, F.col("host"), F.col("path")).collect()
    want = brute_posteriors([(r.host, r.path, r.doc_score) for r in got], *strengths)
    assert np.allclose([(r.host_share, r.path_share, r.posterior) for r in got], want, atol=1e-9)
    assert all(r.keep == (r.posterior >= 0.3) for r in got)


@pytest.mark.parametrize("limit", [1, 50, 990, 5000])
def test_least_by_hash_equals_a_full_sort(spark, limit):
    rows = spark.createDataFrame([(i // 2 if i % 3 else None, i) for i in range(1000)] + [(7, 5)] * 300, "k long, v long")
    want = rows.orderBy(F.xxhash64("k"), "k", "v").limit(limit).collect()
    assert least_by_hash(rows, limit, "k", "v").collect() == want


def test_features_of_odd_texts():
    x = quality.features([None, "", " ", "|", "A" * 1000, "\n".join("ab" * 3)])
    assert x.shape == (6, len(quality.FEATURES)) and np.isfinite(x).all() and not x[:2].any()
