import random

import numpy as np
from conftest import prose, texts_of
from hypothesis import given, settings
from hypothesis import strategies as st

from hostloom.llm import packing
from hostloom.llm.words import PUNCTUATION, bare_words, word_hashes


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet="aAbBzZ é\n\t.,0"), st.text()), max_size=6))
def test_word_hashes_follow_split(texts):
    hashes, bounds = word_hashes(texts)
    words = [(t or "").encode("utf-8", "surrogatepass").lower().split() for t in texts]
    assert list(np.diff(bounds)) == [len(w) for w in words]
    flat = [w for ws in words for w in ws]
    assert len(set(zip(flat, hashes.tolist()))) == len(set(flat)) == len(set(hashes.tolist()))


def test_bare_words_agree_with_their_hashes():
    texts = ["Don't stop, Été! (a_b) x-9", None, "", "..."]
    _, bounds = word_hashes(texts, PUNCTUATION)
    assert list(np.diff(bounds)) == [len(bare_words(t)) for t in texts]


def brute_best_fit(lengths, length):
    free, rows = [], []
    for p in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        fits = [r for r in range(len(rows)) if free[r] >= lengths[p]]
        if fits:
            r = min(fits, key=lambda k: free[k])
        else:
            r = len(rows)
            rows.append([])
            free.append(length)
        rows[r].append(p)
        free[r] -= lengths[p]
    return sorted(free), rows


def test_best_fit_decreasing_equals_brute_force():
    rng = random.Random(1)
    for length in (1, 7, 64, 100):
        lengths = np.array([rng.randint(1, length) for _ in range(300)])
        rows = packing.best_fit(lengths, length)
        assert sorted(p for r in rows for p in r) == list(range(300))
        free, want = brute_best_fit(lengths.tolist(), length)
        assert sorted(length - int(lengths[r].sum()) for r in rows) == free and len(rows) == len(want)


def check_rows(packs, length):
    for row in packs.collect():
        ids, places = np.frombuffer(row.ids, np.uint16), np.frombuffer(row.position_ids, np.uint16)
        edges = row.cu_seqlens
        assert len(ids) == len(places) == length and edges[0] == 0 and edges[-1] <= length
        assert len(row.doc_ids) == len(row.starts) == len(edges) - 1
        for a, b in zip(edges, edges[1:]):
            assert b > a and list(places[a:b]) == list(range(b - a))
        assert (ids[edges[-1]:] == 50256).all()


def test_round_trip_of_hard_documents(spark, hard):
    how = packing.Packing(length=64, buffer=5000)
    ids = hard.filter("doc_id is not null").dropDuplicates(["doc_id"])
    packs = packing.packed(ids, how).cache()
    check_rows(packs, 64)
    assert packs.select("pack_id").distinct().count() == packs.count()
    assert {r.doc_id: r.text for r in packing.unpacked(packs, how).collect()} == {d: t or "" for d, t in texts_of(ids)}


def test_runs_of_blanks_of_any_length(spark):
    rng = random.Random(8)
    encoding = packing.encoder(packing.Packing().vocabulary)
    for _ in range(300):
        text = "".join(rng.choice(["a", " b", "\n", "\t", "\u3000", "\x1c", "1", ".", " " * 8192, "\n " * 5000, "\r" * 9000])
                       for _ in range(rng.randint(0, 9)))
        assert packing.token_ids(text, packing.Packing().vocabulary).tolist() == encoding.encode_ordinary(text)
    texts = [" " * 1_000_000, "\n" * 1_000_000 + "x", "a" + " \t" * 1_000_000 + " b", "." * 1_000_000]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    packs = packing.packed(docs).cache()
    assert {r.doc_id: r.text for r in packing.unpacked(packs).collect()} == dict(enumerate(texts))


def test_repeated_rows_null_ids_and_empty_tables(spark, hard, nothing):
    how = packing.Packing(length=128)
    starts = packing.packed(hard, how).selectExpr("inline(arrays_zip(doc_ids, starts))").filter("starts = 0")
    assert starts.count() == hard.count()
    assert packing.packed(nothing, how).count() == 0


def test_rows_are_filled(spark):
    rng = random.Random(2)
    docs = spark.createDataFrame([(i, prose(rng, rng.randint(5, 400))) for i in range(400)], "doc_id long, text string")
    packs = packing.packed(docs.coalesce(1), packing.Packing(length=512)).collect()
    assert sum(r.cu_seqlens[-1] for r in packs) / (512 * len(packs)) > 0.97
