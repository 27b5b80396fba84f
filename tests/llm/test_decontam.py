import random

import numpy as np
import pytest
from conftest import prose, texts_of

from hostloom.llm import decontam
from hostloom.llm.words import PUNCTUATION, word_hashes


def test_common_length_equals_dynamic_programming():
    rng = np.random.default_rng(2)
    for _ in range(60):
        a, b = rng.integers(0, 8, rng.integers(1, 40)).astype(np.uint64), rng.integers(0, 8, rng.integers(0, 70)).astype(np.uint64)
        best = np.zeros((len(a) + 1, len(b) + 1), dtype=int)
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                best[i + 1, j + 1] = best[i, j] + 1 if x == y else max(best[i, j + 1], best[i + 1, j])
        assert decontam.common_length(a, b) == best[-1, -1]


@pytest.fixture(scope="module")
def planted(spark):
    rng = random.Random(21)
    items = [(i, prose(rng, rng.randint(12, 60))) for i in range(30)]
    docs, leaks = [(i, prose(rng, rng.randint(50, 600))) for i in range(300)], set()
    for k in range(90):
        item, text = items[k % 30]
        words = text.split()
        if k >= 60:  # a paraphrase: a tenth of the words changed, one of eight dropped
            words = [prose(rng, 1) if rng.random() < 0.1 else w for w in words if rng.random() > 0.125]
        elif k >= 30:
            words = [w.upper().strip(".") for w in words]
        docs.append((1000 + k, f"{prose(rng, rng.randint(0, 300))} {' '.join(words)} {prose(rng, rng.randint(0, 300))}"))
        leaks.add((1000 + k, item))
    return (spark.createDataFrame(docs, "doc_id long, text string"),
            spark.createDataFrame(items, "item_id long, text string"), leaks)


def test_planted_items_are_found_and_clean_documents_left_alone(planted):
    docs, items, leaks = planted
    got = {(r.doc_id, r.item_id) for r in decontam.contaminated(docs, items).collect()}
    assert {d for d, _ in got} <= {d for d, _ in leaks}
    exact = {x for x in leaks if x[0] < 1060}
    assert exact <= got and len(got & (leaks - exact)) >= 27
    clean = decontam.decontaminated(docs, items)
    assert {d for d, _ in texts_of(clean)} == {d for d, _ in texts_of(docs)} - {d for d, _ in got}
    assert clean.columns == docs.columns


def test_blocks_of_items_give_the_same(planted):
    docs, items, leaks = planted
    got = {(r.doc_id, r.item_id) for r in decontam.contaminated(docs, items, decontam.Retrieval(block=7)).collect()}
    assert {x for x in leaks if x[0] < 1060} <= got and {d for d, _ in got} <= {d for d, _ in leaks}


def test_latent_space_holds_the_passages(spark, planted):
    docs, items, _ = planted
    searcher = next(decontam.searchers(docs, items, decontam.Retrieval(rank=30)))
    space = searcher.vectors / np.maximum(searcher.weights[:, None], 1e-12)
    assert np.allclose(space.T @ space, np.eye(30), atol=1e-4)
    rows = np.zeros((30, len(searcher.terms.hashes)))
    for i, item in enumerate(searcher.items):
        np.add.at(rows[i], searcher.terms.find(item), searcher.weights[searcher.terms.find(item)])
    rows /= np.linalg.norm(rows, axis=1, keepdims=True)
    # 30 passages span 30 directions: nothing is lost
    assert np.allclose(np.linalg.norm(rows @ space, axis=1), 1, atol=1e-3)


def test_hard_documents_and_empty_tables(spark, hard, nothing, planted):
    items = spark.createDataFrame([(1, None), (2, ""), (3, "..."), (None, dict(texts_of(hard))[3]), (4, dict(texts_of(hard))[2]),
                                   (4, dict(texts_of(hard))[2])], "item_id long, text string")
    got = [(r.doc_id, r.item_id) for r in decontam.contaminated(hard, items).collect()]
    assert {(3, None), (105, None), (2, 4)} <= set(got) and got.count((2, 4)) == 2
    kept = decontam.decontaminated(hard, items)
    assert not {2, 3, 105} & {d for d, _ in texts_of(kept)} and kept.columns == hard.columns
    for docs, some in ((nothing, items), (hard, items.limit(0)), (nothing, items.limit(0))):
        assert decontam.contaminated(docs, some).count() == 0
        assert decontam.decontaminated(docs, some).count() == docs.count()


def test_items_are_not_found_by_common_words():
    hashes, bounds = word_hashes(["the of and to", "of the and to"], PUNCTUATION)
    assert decontam.common_length(hashes[:4], hashes[4:]) == 3 and list(bounds) == [0, 4, 8]


def test_frequent_passages_are_found(spark):
    """One item copied into a third of the documents, one of words that most documents have, one with rare words."""
    rng = random.Random(5)
    common = [f"common{i}" for i in range(40)]
    items = [(1, prose(rng, 30)), (2, " ".join(rng.choice(common) for _ in range(25))), (3, "zyx " + prose(rng, 20)),
             (4, "common1 common2")]
    docs, leaks = [], set()
    for i in range(300):
        words = [w for w in prose(rng, 200).split()]
        for w in common:
            words.insert(rng.randrange(len(words)), w)
        text = " ".join(words)
        for item, every in ((1, 3), (2, 50), (3, 100)):
            if i % every == 0:
                text = f"{text[:500]} {items[item - 1][1].upper()} {text[500:]}"
                leaks.add((i, item))
        if " common1 common2 " in f" {text} ":
            leaks.add((i, 4))
        docs.append((i, text))
    docs = spark.createDataFrame(docs, "doc_id long, text string")
    items = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontam.contaminated(docs, items).collect()}
    assert leaks <= got and {x for x in got if x[1] != 4} == {x for x in leaks if x[1] != 4}
    kept = {d for d, _ in texts_of(decontam.decontaminated(docs, items))}
    assert kept == set(range(300)) - {d for d, _ in got}


def test_long_passages_are_found(spark):
    """Items of 100, 300 and 2,000 words, word for word and reworded."""
    rng = random.Random(6)
    items = [(n, prose(rng, n)) for n in (100, 300, 2000)]
    docs = [(i, prose(rng, 400)) for i in range(30)]
    for n, text in items:
        reworded = " ".join(prose(rng, 1) if k % 4 == 3 else w for k, w in enumerate(text.split()))
        sparse = " ".join(prose(rng, 1) if k % 3 == 2 and k < 0.85 * n else w for k, w in enumerate(text.split()))
        docs += [(10 * n + k, f"{prose(rng, 77)} {t} {prose(rng, 133)}") for k, t in enumerate((text, reworded, sparse))]
    docs = spark.createDataFrame(docs, "doc_id long, text string")
    items = spark.createDataFrame(items, "item_id long, text string")
    how = decontam.Retrieval()
    got = {(r.doc_id, r.item_id) for r in decontam.contaminated(docs, items, how).collect()}
    assert got == {(10 * n + k, n) for n in (100, 300, 2000) for k in range(3)}
    # the windows find them without the runs
    searcher = next(decontam.searchers(docs, items, how))
    for d, text in texts_of(docs.filter("doc_id >= 1000")):
        hashes, bounds = word_hashes([text], PUNCTUATION)
        assert d // 10 in {searcher.ids[c[1]] for c in searcher.candidates(searcher.terms.find(hashes), bounds)}
