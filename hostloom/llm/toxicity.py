"""Severity of toxic language by cumulative-link ordinal regression on sparse text features.

The model has one weight vector and ordered thresholds t_1 < t_2 < ...:
P(grade >= k) = sigmoid(w . x - t_k). All grades share the weights. The output
is the expected grade and the probability of each grade or worse.

Features are words that labelled toxic texts hold far more often than others
(a test on their log-odds), as logarithms of counts, with the sum and the rate
of all of them. Only they are looked up when scoring, so the model is small. Rows are kept sparse,
so memory grows with the words found and not with texts times words.

Labels say toxic or not. Grades come from them and from how dense the found
words are: 0 not toxic, then thirds of the toxic texts by hits per word. A
toxic text without any hit has grade 1.

At most ``sample`` labelled rows are used for fitting, chosen by a hash of
their id; every row of the table is scored, over its whole text. Null and empty
texts have no features. Rows are scored one by one, so repeated rows, null ids
and extra columns do no harm. Without labels of both kinds the severity is the
smoothed share of toxic labels and nothing is called toxic. An empty table
gives an empty one.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hostloom.llm.common import least_by_hash, map_batches, settle, slices
from hostloom.llm.words import PUNCTUATION, mix, word_hashes

GRADES = 4


@dataclass(frozen=True)
class Toxicity:
    """``sample``: bound of labelled rows for the fit; ``evidence``: least z-score of a word's log-odds."""

    sample: int = 30_000
    evidence: float = 4.0
    least_texts: int = 5
    threshold: float = 0.5
    ridge: float = 1e-3


@dataclass(frozen=True)
class Sparse:
    """A matrix of ``rows``, ``places`` and ``values``, followed by the columns of ``dense``."""

    rows: np.ndarray
    places: np.ndarray
    values: np.ndarray
    dense: np.ndarray
    words: int

    @property
    def shape(self) -> tuple[int, int]:
        return len(self.dense), self.words + self.dense.shape[1]

    def __matmul__(self, w: np.ndarray) -> np.ndarray:
        own = np.bincount(self.rows, self.values * w[self.places], len(self.dense))
        return own + self.dense @ w[self.words:]

    def across(self, v: np.ndarray) -> np.ndarray:
        """The transposed matrix times ``v``."""
        return np.concatenate([np.bincount(self.places, self.values * v[self.rows], self.words), self.dense.T @ v])


@dataclass
class Model:
    words: np.ndarray
    weights: np.ndarray
    thresholds: np.ndarray
    lookup: np.ndarray = field(init=False)

    def __post_init__(self):
        self.words = np.sort(self.words.astype(np.uint64))
        self.lookup = np.zeros(1 << 16, dtype=bool)
        self.lookup[(self.words >> np.uint64(48)).astype(np.int64)] = True

    def counts(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Text, place and count of each of the model's words in ``texts``, and the number of all words of each text."""
        hashes, bounds = word_hashes(texts, PUNCTUATION)
        maybe = np.flatnonzero(self.lookup[(hashes >> np.uint64(48)).astype(np.int64)])
        if not len(self.words):
            maybe = maybe[:0]
        at = np.minimum(np.searchsorted(self.words, hashes[maybe]), max(len(self.words) - 1, 0))
        hit = self.words[at] == hashes[maybe] if len(maybe) else np.zeros(0, dtype=bool)
        text = np.searchsorted(bounds, maybe[hit], side="right") - 1
        cells, counts = np.unique(text * max(len(self.words), 1) + at[hit], return_counts=True)
        return *np.divmod(cells, max(len(self.words), 1)), counts, np.diff(bounds)


def hits_of(rows: np.ndarray, counts: np.ndarray, texts: int) -> np.ndarray:
    return np.bincount(rows, counts, texts)


def design(rows: np.ndarray, places: np.ndarray, counts: np.ndarray, sizes: np.ndarray, words: int) -> Sparse:
    hits = hits_of(rows, counts, len(sizes))
    dense = np.stack([np.log1p(hits), np.log1p(1000 * hits / np.maximum(sizes, 1))], 1)
    return Sparse(rows, places, np.log1p(counts), dense, words)


def worse(weights: np.ndarray, thresholds: np.ndarray, x: np.ndarray | Sparse) -> np.ndarray:
    """(rows, grades - 1) probabilities of grade 1, 2, ... or worse."""
    return 1 / (1 + np.exp(-np.clip((x @ weights)[:, None] - thresholds[None, :], -40, 40)))


def fit_ordinal(x: np.ndarray | Sparse, y: np.ndarray, grades: int = GRADES, ridge: float = 1e-3,
                steps: int = 1500) -> tuple[np.ndarray, np.ndarray]:
    """Weights and ordered thresholds of the cumulative-link model, by full-batch gradient steps.

    Thresholds are kept in order as a first one and positive gaps.
    """
    share = np.clip(np.array([(y >= k).mean() for k in range(1, grades)]), 1e-3, 1 - 1e-3)
    start = np.log(1 / share - 1)
    gaps = np.log(np.maximum(np.diff(start), 1e-2))
    state = np.concatenate([np.zeros(x.shape[1]), start[:1], gaps])
    first, second = np.zeros_like(state), np.zeros_like(state)
    n, d = len(y), x.shape[1]
    across = x.across if isinstance(x, Sparse) else x.T.dot
    for step in range(1, steps + 1):
        w, jumps = state[:d], np.exp(state[d + 1:])
        t = state[d] + np.concatenate([[0], np.cumsum(jumps)])
        edges = np.concatenate([[-40.0], t, [40.0]])
        eta = x @ w
        high = 1 / (1 + np.exp(-np.clip(edges[y + 1] - eta, -40, 40)))
        low = 1 / (1 + np.exp(-np.clip(edges[y] - eta, -40, 40)))
        p = np.maximum(high - low, 1e-12)
        dh, dl = high * (1 - high), low * (1 - low)
        grad_w = across((dh - dl) / p) / n + ridge * w
        by_edge = np.bincount(y + 1, -dh / p, grades + 1) + np.bincount(y, dl / p, grades + 1)
        by_t = by_edge[1:-1] / n
        tail = np.cumsum(by_t[::-1])[::-1]
        grad = np.concatenate([grad_w, tail[:1], tail[1:] * jumps])
        first = 0.9 * first + 0.1 * grad
        second = 0.999 * second + 0.001 * grad * grad
        rate = 0.05 * min(1.0, 3 * (1 - step / (steps + 1)))
        state = state - rate * (first / (1 - 0.9 ** step)) / (np.sqrt(second / (1 - 0.999 ** step)) + 1e-9)
    return state[:d], state[d] + np.concatenate([[0], np.cumsum(np.exp(state[d + 1:]))])


def _word_lists(rows: DataFrame) -> DataFrame:
    """(y, n, mark, words, counts) of each labelled text: its distinct bare words, and a minhash of its triples."""

    def count(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = batch.column(1).to_pylist()
        sizes, words, counts, marks = [], [], [], []
        for a, b in slices(texts):
            hashes, bounds = word_hashes(texts[a:b], PUNCTUATION)
            triples = mix(mix(hashes[:-2]) + mix(hashes[1:-1] ^ np.uint64(1)) + hashes[2:])
            for i in range(b - a):
                own = triples[bounds[i]:max(bounds[i + 1] - 2, bounds[i])]
                marks.append(int((own if len(own) else hashes[bounds[i]:bounds[i + 1]]).min(initial=2**64 - 1) >> np.uint64(1)))
                w, c = np.unique(hashes[bounds[i]:bounds[i + 1]], return_counts=True)
                sizes.append(bounds[i + 1] - bounds[i])
                words.append(w.view(np.int64))
                counts.append(c)
        return pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(sizes, pa.int64()), pa.array(marks, pa.int64()), pa.array(words, pa.list_(pa.int64())),
             pa.array(counts, pa.list_(pa.int64()))], names=["y", "n", "mark", "words", "counts"])

    return map_batches(rows, count, "y int, n bigint, mark bigint, words array<bigint>, counts array<bigint>")


def train(docs: DataFrame, labels: DataFrame, how: Toxicity, id_col: str, text_col: str) -> Model | float:
    """The model, or the smoothed share of toxic labels where they are all of one kind."""
    known = labels.filter("toxic is not null").select(F.col("doc_id").alias("_id"), F.col("toxic").cast("int").alias("y"))
    chosen = least_by_hash(known, how.sample, "_id", "y")
    # at most how.sample rows of two numbers; of an id's texts the least one, so repeated ids stay within the bound
    texts = docs.select(F.col(id_col).cast("bigint").alias("_id"), F.col(text_col).alias("text")).join(
        F.broadcast(chosen), "_id").groupBy("_id", "y").agg(F.min("text").alias("text")).select("y", "text")
    lists = settle(_word_lists(texts), "toxic-words")
    totals = {r["y"]: r["c"] for r in lists.groupBy("y").agg(F.count(F.lit(1)).alias("c")).collect()}
    bad, good = totals.get(1, 0), totals.get(0, 0)
    if not bad or not good:
        return (bad + 0.5) / (bad + good + 1)
    # copies of one text count once: texts are told apart by a minhash of their word triples
    held = lists.select("y", "mark", F.explode("words").alias("w")).groupBy(
        "w", "y", "mark").agg(F.lit(1).alias("one")).groupBy("w").agg(
        F.sum("y").alias("a"), F.count(F.lit(1)).alias("c")).filter(F.col("a") >= how.least_texts)
    marks = lists.groupBy("y").agg(F.count_distinct("mark").alias("c")).collect()
    bad, good = (next((r["c"] for r in marks if r["y"] == k), 0) for k in (1, 0))
    a, b = F.col("a") + 0.5, F.col("c") - F.col("a") + 0.5
    odds = F.log(a / (bad + 1 - F.least(a, F.lit(bad + 0.5)))) - F.log(b / (good + 1 - F.least(b, F.lit(good + 0.5))))
    telling = held.filter(odds / F.sqrt(1 / a + 1 / b) >= how.evidence).select("w")
    # words of a bounded sample
    model = Model(telling.toPandas()["w"].to_numpy(dtype=np.int64).view(np.uint64), np.zeros(0), np.zeros(0))

    def pick(batch: pa.RecordBatch) -> pa.RecordBatch:
        places, counts = [], []
        for words, n in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
            w = np.array(words, dtype=np.int64).view(np.uint64)
            at = np.minimum(np.searchsorted(model.words, w), max(len(model.words) - 1, 0))
            hit = np.flatnonzero(model.words[at] == w) if len(model.words) else np.zeros(0, dtype=np.int64)
            places.append(at[hit].tolist())
            counts.append(np.array(n)[hit].tolist())
        return pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(places, pa.list_(pa.int64())),
             pa.array(counts, pa.list_(pa.int64()))], names=["y", "n", "places", "counts"])

    rows = map_batches(lists.select("y", "n", "words", "counts"), pick,
                       "y int, n bigint, places array<bigint>, counts array<bigint>").toPandas()
    found = np.repeat(np.arange(len(rows)), rows["places"].map(len).to_numpy(dtype=np.int64))
    places, counts = (np.concatenate([np.asarray(v, dtype=np.int64) for v in rows[c]] or [found]) for c in ("places", "counts"))
    sizes, y = rows["n"].to_numpy(), rows["y"].to_numpy()
    rate = hits_of(found, counts, len(rows)) / np.maximum(sizes, 1)
    dense = rate[(y == 1) & (rate > 0)]
    cuts = np.quantile(dense, [1 / 3, 2 / 3]) if len(dense) else np.array([1.0, 1.0])
    grade = np.where(y == 1, 1 + np.searchsorted(cuts, rate, side="left"), 0)
    model.weights, model.thresholds = fit_ordinal(
        design(found, places, counts, sizes, len(model.words)), grade, GRADES, how.ridge)
    return model


def severity(docs: DataFrame, labels: DataFrame, how: Toxicity = Toxicity(), id_col: str = "doc_id",
             text_col: str = "text") -> DataFrame:
    """(doc_id, n_hits, p_1, p_2, p_3, severity, grade, toxic) for each row of ``docs``.

    ``p_k`` is the probability of grade k or worse, ``severity`` the expected
    grade, ``grade`` the likeliest one, ``toxic`` whether p_1 reaches the threshold.
    """
    model = train(docs, labels, how, id_col, text_col)
    names = [f"p_{k}" for k in range(1, GRADES)]

    def score(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = batch.column(1).to_pylist()
        hits, probs = [], []
        for a, b in slices(texts):
            if isinstance(model, float):
                hits.append(np.zeros(b - a, dtype=np.int64))
                probs.append(np.tile([model, 0.0, 0.0], (b - a, 1)))
                continue
            found, places, counts, sizes = model.counts(texts[a:b])
            hits.append(hits_of(found, counts, b - a).astype(np.int64))
            probs.append(worse(model.weights, model.thresholds, design(found, places, counts, sizes, len(model.words))))
        p = np.concatenate(probs)
        exact = np.hstack([1 - p[:, :1], p[:, :-1] - p[:, 1:], p[:, -1:]])
        flag = np.zeros(len(p), dtype=bool) if isinstance(model, float) else p[:, 0] >= how.threshold
        return pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(np.concatenate(hits)), *[pa.array(np.ascontiguousarray(p[:, k])) for k in range(GRADES - 1)],
             pa.array(p.sum(1)), pa.array(exact.argmax(1).astype(np.int32)), pa.array(flag)],
            names=["doc_id", "n_hits", *names, "severity", "grade", "toxic"])

    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    return map_batches(rows, score, "doc_id bigint, n_hits bigint, " + ", ".join(f"{n} double" for n in names)
                       + ", severity double, grade int, toxic boolean")
