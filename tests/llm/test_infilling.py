import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from hostloom.llm.infilling import (LINE, PLAIN, SENTENCE, WORD, Boundaries, Infilling, WaveletMatrix, char_classes, draws,
                                    infilled, rebuilt)

SPLIT = {"line": r"[^\n]*\n|[^\n]+", "word": r"\s*\S+|\s+$"}
FLAGS = {"line": LINE, "word": WORD, "sentence": SENTENCE}


def brute(doc_id, text, how=Infilling()):
    text = text or ""
    units = re.findall(SPLIT[how.unit], text)
    h = hashlib.sha256(f"{how.seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[i:i + 8], 16) for i in (0, 8, 16, 24))
    a, b = sorted((h1 % (len(units) + 1), h2 % (len(units) + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h3 % 100 >= how.rate:
        return len(units), "plain", None, None, text
    if h4 % 100 < how.spm:
        return len(units), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return len(units), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def test_ranks_equal_counts():
    rng = np.random.default_rng(2)
    for size in (0, 1, 7, 8, 9, 64, 1000):
        symbols = rng.integers(0, 8, size).astype(np.uint8)
        matrix = WaveletMatrix(symbols)
        at = np.arange(size + 1)
        for c in range(8):
            assert matrix.rank(c, at).tolist() == np.concatenate(([0], np.cumsum(symbols == c))).tolist()


def test_classes_name_what_ends():
    codes = np.frombuffer("Hi you.\nNo".encode("utf-32-le"), "<u4")
    assert char_classes(codes, np.array([0])).tolist() == [0, 2, 0, 0, 0, 0, 6, 1, 0, 2]


@pytest.mark.parametrize("unit", ["line", "word"])
def test_cuts_equal_those_of_split_texts(unit):
    rng = random.Random(9)
    texts = ["", "\n", "\n\n", "a", "a\n", " a", "a ", "é\nß", "".join(rng.choice("ab \n.") for _ in range(500))]
    texts += ["".join(rng.choice("ab \n") for _ in range(rng.randint(0, 30))) for _ in range(200)] + [""]
    codes = np.frombuffer("".join(texts).encode("utf-32-le"), "<u4")
    found = Boundaries(codes, np.array([len(t) for t in texts]), FLAGS[unit])
    units = [re.findall(SPLIT[unit], t) for t in texts]
    assert found.units.tolist() == [len(u) for u in units]
    for share in (0, 0.3, 0.5, 1):
        k = np.array([int(len(u) * share) for u in units])
        assert found.cut(k).tolist() == [len("".join(u[:n])) for u, n in zip(units, k)]


def test_sentences():
    text = "One. Two! 3.5 is one\nword? Open end"
    found = Boundaries(np.frombuffer(text.encode("utf-32-le"), "<u4"), np.array([len(text)]), SENTENCE)
    assert found.units.tolist() == [4]
    assert [text[:found.cut(np.array([k]))[0]] for k in range(5)] == [
        "", "One.", "One. Two!", "One. Two! 3.5 is one\nword?", text]


@pytest.mark.parametrize("how", [Infilling(), Infilling(unit="word", seed=3, rate=60, spm=20)])
def test_documents_equal_brute_force_and_come_back(spark, hard, how):
    lines = spark.createDataFrame(
        [(i, "\n".join(f"line {j} é𝄞" for j in range(i))) for i in range(200, 240)] +
        [(300, "has <P> in it"), (301, "almost <P"), (302, "<\n<S\n<M"), (303, "\n" * 50), (304, "a\r\nb\r\n"), (None, "a\nb\nc")],
        "doc_id long, text string")
    docs = hard.select("doc_id", "text").union(lines)
    got = infilled(docs, how).withColumn("back", rebuilt(F.col("output"), F.col("form"), how)).collect()
    assert len(got) == docs.count()
    for r in got:
        assert (r.n, r.form, r.prefix_chars, r.middle_chars, r.output) == brute(r.doc_id, r.text, how)
        assert r.back == (r.text or "")
    assert {r.form for r in got} == {"plain", "spm", "psm"}


def test_extra_columns_stay_and_clashing_ones_give_way(spark, hard):
    df = hard.withColumn("form", F.lit(1)).withColumn("output", F.lit(2))
    got = infilled(df)
    assert set(got.columns) == set(df.columns) | {"n", "prefix_chars", "middle_chars"}
    assert dict(got.dtypes)["form"] == "string" and got.filter(F.col("lang").isNotNull()).count() > 0


def test_empty_table_and_empty_texts(spark, nothing):
    assert infilled(nothing).collect() == []
    rows = infilled(spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string")).collect()
    assert [(r.n, r.form, r.output, r.prefix_chars) for r in rows] == [(0, PLAIN, "", None)] * 2


def test_a_very_long_text(spark):
    text = "word and more\n" * 200_000
    row = infilled(spark.createDataFrame([(5, text)], "doc_id long, text string")).first()
    assert (row.n, row.form, row.prefix_chars, row.middle_chars, row.output) == brute(5, text)


def test_draws_depend_on_id_and_seed():
    assert draws(7, 5) != draws(7, 6) != draws(8, 6)


def test_bad_options():
    for options in ({"unit": "page"}, {"prefix": ""}, {"prefix": "<S>"}, {"prefix": "aba"}, {"prefix": "x<S>y"},
                    {"prefix": "ab", "suffix": "bc"}):
        with pytest.raises(ValueError):
            Infilling(**options)
