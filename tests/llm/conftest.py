import random

import pytest

SYLLABLES = "ba be bi bo da de di do ka ke ki ko la le li lo ma me mi mo na ne ni no ra re ri ro sa se si so".split()


def prose(rng, words):
    """Sentences of invented words."""
    out = []
    for i in range(words):
        w = "".join(rng.choice(SYLLABLES) for _ in range(rng.randint(1, 4)))
        out.append((w.capitalize() if i % 9 == 0 else w) + ("." if i % 9 == 8 else ""))
    return " ".join(out)


@pytest.fixture(scope="session")
def hard(spark):
    """Documents with null and repeated ids, null, empty and long texts, ties, and columns of unlucky names."""
    rng = random.Random(4)
    rows = [(i, prose(rng, rng.randint(1, 120)), "en", f"s{i % 3}") for i in range(40)]
    rows += [(100, None, "en", "s0"), (101, "", None, None), (102, " \n\t ", "en", None), (None, rows[0][1], "en", "s1"),
             (None, None, None, None), rows[5], rows[5], (7, prose(rng, 30), "fr", "s0"), (103, "x" * 300_000, "en", "s2"),
             (104, prose(rng, 20_000), "en", "s0"), (105, rows[3][1], "en", "s2"), (106, "É ſ K ß", "de", "s1")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    for name in ("node", "key", "n", "label", "host", "path", "tokens", "y", "p", "component", "learns", "_copies_", "f"):
        df = df.selectExpr("*", f"lang AS {name}")
    return df.cache()


@pytest.fixture(scope="session")
def nothing(hard):
    return hard.limit(0)


def texts_of(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]
