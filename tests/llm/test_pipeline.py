import random

import numpy as np
import pytest
from conftest import prose
from pyspark.sql import functions as F

import corpus_pipeline
from hostloom.llm import decontam, near_dups, packing, quality, queries
from hostloom.llm.common import table


@pytest.fixture(scope="module")
def stages(spark, sf):
    docs = table(spark, sf, "documents")
    out = {"documents": docs}
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.settle(stage(spark, docs, sf), name)
        out[name] = docs
    return out


def ids(df):
    return [r.doc_id for r in df.select("doc_id").collect()]


def test_columns_and_effect(spark, sf, stages):
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality", "near_dedup", "decontamination", "mixing", "token_ids"]
    for name in names[:-1]:
        assert stages[name].columns == stages["documents"].columns
    counts = [len(ids(stages[n])) for n in ("documents", *names[:3])]
    assert counts[0] > counts[1] > counts[2] >= counts[3] > 0
    bad = table(spark, sf, "labels").filter("quality = 0")
    assert len(set(ids(bad)) & set(ids(stages["quality"]))) <= 0.1 * bad.count()
    good = table(spark, sf, "labels").filter("quality = 1")
    assert len(set(ids(good)) - set(ids(stages["quality"]))) <= 0.02 * good.count()


def test_each_stage_on_its_own_input(spark, sf, stages):
    groups = near_dups.near_duplicates(stages["quality"]).filter("kept")
    assert sorted(ids(stages["near_dedup"])) == sorted(ids(groups))
    items = table(spark, sf, "benchmark")
    leaks = set(ids(decontam.contaminated(stages["near_dedup"], items)))
    assert set(ids(stages["decontamination"])) == set(ids(stages["near_dedup"])) - leaks
    exact = [t.text for t in items.collect()]
    assert not any(e in r.text for r in stages["decontamination"].collect() for e in exact)
    assert set(ids(stages["mixing"])) == set(ids(stages["decontamination"]))


def test_ids_say_the_texts(stages):
    want = sorted((r.doc_id, r.text) for r in stages["mixing"].collect())
    uses = stages["token_ids"].selectExpr("inline(arrays_zip(doc_ids, starts))").filter("starts = 0")
    assert sorted(r.doc_ids for r in uses.collect()) == [d for d, _ in want]
    encoding = packing.encoder(packing.Packing().vocabulary)
    text = dict(want)
    for row in stages["token_ids"].limit(20).collect():
        stream = np.frombuffer(row.ids, np.uint16)
        for doc, start, a, b in zip(row.doc_ids, row.starts, row.cu_seqlens, row.cu_seqlens[1:]):
            whole = [*encoding.encode_ordinary(text[doc]), 50256]
            assert stream[a:b].tolist() == whole[start: start + b - a]


def test_decisions_fall_by_row(spark):
    """Rows without id, and rows under one id, are each rejected or kept for themselves."""
    rng = random.Random(9)
    good = [prose(rng, 80) for _ in range(120)]
    bad = ["|" * 30 + f" {i} ## %% @@ {{}} " * 12 for i in range(120)]
    rows = [(i, g, "en", "s") for i, g in enumerate(good)] + [(200 + i, b, "en", "s") for i, b in enumerate(bad)]
    fresh, copied = prose(rng, 90), prose(rng, 90)
    junk = "|" * 30 + " 500 ## %% @@ {} " * 12
    rows += [(None, fresh, "en", "s"), (None, copied, "en", "s"), (None, copied + " end", "en", "s"), (None, copied, "en", "s"),
             (None, junk, "en", "s"), (5, junk, "en", "s")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    labels = spark.createDataFrame([(i, 1) for i in range(120)] + [(200 + i, 0) for i in range(120)], "doc_id long, quality int")
    kept = quality.kept(docs, labels, F.col("source"), F.col("lang"), quality.Quality(threshold=0.5))
    texts = [(r.doc_id, r.text) for r in kept.collect()]
    assert all(t != junk for _, t in texts) and sum(d == 5 for d, _ in texts) == 1
    assert sorted(t for d, t in texts if d is None) == sorted([fresh, copied, copied, copied + " end"])
    got = [(r.doc_id, r.text) for r in near_dups.deduplicated(kept).collect()]
    assert sum(t.startswith(copied) for _, t in got) == 1 and sum(t == fresh for _, t in got) == 1
    assert sorted(d for d, _ in got if d is not None) == list(range(120))


def test_one_query_for_each_operator():
    numbers = sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES)
    assert numbers == list(range(1, 14))
