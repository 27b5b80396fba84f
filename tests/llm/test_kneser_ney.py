import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from conftest import texts_of

from hostloom.llm import kneser_ney as kn


def tokens(text):
    return (text or "").encode().lower().split() + [b"</s>"]


def held(doc_id):
    return zlib.crc32(str("" if doc_id is None else doc_id).encode()) % 10 == 0


class Brute:
    """The same model from dictionaries."""

    def __init__(self, rows):
        train = [tokens(t) for d, t in rows if not held(d)]
        self.words = Counter(w for t in train for w in t)
        self.n, self.v = sum(self.words.values()), len(self.words)
        self.pairs = Counter(p for t in train for p in zip(["<s>"] + t[:-1], t))
        self.history = Counter(p for t in train for p in ["<s>"] + t[:-1])
        self.followers, self.before = {}, Counter()
        for (a, b), c in self.pairs.items():
            self.followers.setdefault(a, [0, 0, 0])[min(c, 3) - 1] += 1
            self.before[b] += 1
        of = lambda counts: kn.Discounts.of(np.array([sum(c == k for c in counts) for k in (1, 2, 3, 4)]))
        self.d2, self.d1 = of(list(self.pairs.values())), of(list(self.before.values()))
        self.mass = sum(self.take(self.d1, c) for c in self.before.values())

    @staticmethod
    def take(d, c):
        return (0, d.one, d.two, d.more)[min(c, 3)]

    def lowest(self, w):
        return (self.before[w] - self.take(self.d1, self.before[w]) + self.mass / (self.v + 1)) / len(self.pairs)

    def p(self, a, b):
        if a not in self.history:
            return self.lowest(b)
        c, f = self.pairs[a, b], self.followers[a]
        back = self.d2.one * f[0] + self.d2.two * f[1] + self.d2.more * f[2]
        return (c - self.take(self.d2, c) + back * self.lowest(b)) / self.history[a]


class BruteThree(Brute):
    """Order three: pairs count the words before them, triples their occurrences."""

    def __init__(self, rows):
        super().__init__(rows)
        train = [tokens(t) for d, t in rows if not held(d)]
        self.triples = Counter(p for t in train for p in zip(["<s>", "<s>"] + t[:-2], ["<s>"] + t[:-1], t))
        self.pairs = Counter((b, c) for _, b, c in self.triples)
        self.history, self.followers, self.contexts, self.after = Counter(), {}, Counter(), {}
        for (a, _), c in self.pairs.items():
            self.history[a] += c
            self.followers.setdefault(a, [0, 0, 0])[min(c, 3) - 1] += 1
        for (a, b, _), c in self.triples.items():
            self.contexts[a, b] += c
            self.after.setdefault((a, b), [0, 0, 0])[min(c, 3) - 1] += 1
        of = lambda counts: kn.Discounts.of(np.array([sum(c == k for c in counts) for k in (1, 2, 3, 4)]))
        self.d3, self.d2 = of(list(self.triples.values())), of(list(self.pairs.values()))

    def p3(self, a, b, c):
        if (a, b) not in self.contexts:
            return self.p(b, c)
        n, f = self.triples[a, b, c], self.after[a, b]
        back = self.d3.one * f[0] + self.d3.two * f[1] + self.d3.more * f[2]
        return (n - self.take(self.d3, n) + back * self.p(b, c)) / self.contexts[a, b]


def check(rows, got, order=2):
    model = Brute(rows) if order == 2 else BruteThree(rows)
    given = (lambda a, b, c: model.p(b, c)) if order == 2 else model.p3
    for context in [("<s>", b"the"), ("<s>", "<s>"), (b"the", b"the")]:
        assert abs(sum(given(*context, w) for w in model.words) + given(*context, b"unseen") - 1) < 1e-9
    want = []
    for d, t in rows:
        k = tokens(t)
        base = sum(math.log10((model.words[w] + 0.1) / (model.n + 0.1 * (model.v + 1))) for w in k)
        score = sum(math.log10(given(*w)) for w in zip((["<s>", "<s>"] + k)[:len(k)], ["<s>"] + k[:-1], k))
        want.append((d, held(d), len(k), sum(model.words[w] > 0 for w in k), model.n, round(base, 6), round(score, 6)))
    have = [(r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6), round(r.score, 6))
            for r in got]
    assert sorted(have, key=repr) == sorted(want, key=repr)


@pytest.mark.parametrize("order", [2, 3])
def test_equals_brute_force(spark, order):
    rng = random.Random(5)
    words = "the cat sat on Mat dog ran a big red".split()
    rows = [(i, " ".join(rng.choice(words) for _ in range(rng.randrange(12)))) for i in range(300)]
    rows += [(400, None), (401, ""), (None, "the cat"), (402, "zebra the unknown"), rows[1], rows[1]]
    how = kn.Counting(order=order)
    check(rows, kn.scores(spark.createDataFrame(rows, "doc_id long, text string"), how).collect(), order)


@pytest.mark.parametrize("order", [2, 3])
def test_hard_documents(hard, order):
    check(texts_of(hard), kn.scores(hard, kn.Counting(order=order)).collect(), order)


@pytest.mark.parametrize("order", [2, 3])
def test_many_shards_and_hot_words(spark, order):
    rng = random.Random(6)
    rows = [(i, " ".join(rng.choice(["the", f"w{rng.randrange(300)}"]) for _ in range(60))) for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    how = kn.Counting(order, shard=1500, hot=500)
    assert kn.train(df.selectExpr("text", "true AS learns"), how).bits >= 3
    check(rows, kn.scores(df, how).collect(), order)


def test_no_training_texts(spark, nothing):
    assert kn.scores(nothing).count() == kn.scores(nothing, kn.Counting(order=3)).count() == 0
    only = next(i for i in range(1000) if held(i))
    row = kn.scores(spark.createDataFrame([(only, "a b")], "doc_id long, text string")).first()
    assert (row.score, row.base_score, row.n_known, row.train_tokens) == (0.0, 0.0, 0, 0)


def test_held_out_texts_are_predicted_better_than_by_the_base(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    two, three = (kn.scores(docs, kn.Counting(order)).filter("held_out").selectExpr(
        "sum(score) AS s", "sum(base_score) AS b").first() for order in (2, 3))
    assert two.s > two.b and three.s > three.b


def test_orders_beyond_three_are_refused(spark):
    with pytest.raises(ValueError, match="order"):
        kn.train(spark.createDataFrame([("a", True)], "text string, learns boolean"), kn.Counting(order=4))


def test_a_folder_that_is_not_mounted_is_refused(spark, monkeypatch):
    monkeypatch.setattr(kn, "shared_dir", lambda *a: "hdfs://store/x")
    with pytest.raises(ValueError, match="mounted"):
        kn.train(spark.createDataFrame([("a", True)], "text string, learns boolean"))
