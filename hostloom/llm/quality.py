"""Document quality from text and site, by hierarchical empirical Bayes.

A logistic regression over a few dense features of the text gives each document
a probability of being good. Hosts and paths have shares of good documents of
their own. Their posteriors come from grouped sums of those probabilities: the
global share is the prior of hosts, a host's posterior is the prior of its
paths, and how strongly a prior holds is estimated from how much groups differ
beyond the noise within them. Sparse sites so end near their prior. A document's
odds are then moved by the odds of its path, worked out without the document
itself.

Labels: at most ``sample`` labelled rows are used to fit the regression, chosen
by a hash of their id; everything else covers all rows. Without labels of both
kinds nothing is known to be bad, and every document is kept with a score equal
to the smoothed share.

Null and empty texts have all features zero; texts of any length are read whole. A
null host or path is a group of its own. Rows without id are scored and rejected
like others; repeated rows count as often as they come, and rows under one id are
judged each by itself. Other columns bear any name. An empty table gives an empty one.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hostloom.llm.common import least_by_hash, list_array, map_batches, row_key, settle, slices
from hostloom.llm.words import PUNCTUATION, SPACES, mix, word_hashes


@dataclass(frozen=True)
class Quality:
    """``threshold``: least posterior kept; ``sample``: bound of labelled rows for the fit."""

    threshold: float = 0.3
    sample: int = 20_000
    ridge: float = 1.0


FEATURES = ("words", "word_length", "upper", "digits", "symbols", "marks", "high", "distinct", "distinct_pairs",
            "longest", "lone_symbols")

_UPPER = np.zeros(256, dtype=bool)
_UPPER[65:91] = True
_DIGIT = np.zeros(256, dtype=bool)
_DIGIT[48:58] = True
_MARKS = np.zeros(256, dtype=bool)
_MARKS[[ord(c) for c in ".,;:!?'\"()-"]] = True
_SYMBOLS = PUNCTUATION & ~_MARKS & ~SPACES
_HIGH = np.arange(256) >= 0x80


def features(texts: list[str | None]) -> np.ndarray:
    """(texts, features) values between about 0 and 1, or logarithms of counts."""
    raw = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    sizes = np.array([len(r) for r in raw])
    buffer = np.frombuffer(b"\n".join(raw) + b"\n", dtype=np.uint8)
    edges = np.concatenate([[0], np.cumsum(sizes + 1)])
    chars = np.maximum(sizes, 1)

    def share(kind: np.ndarray) -> np.ndarray:
        return np.add.reduceat(kind[buffer].astype(np.int64), edges[:-1]) / chars

    inside = ~SPACES[buffer]
    turns = np.diff(inside.view(np.int8), prepend=0)
    starts, stops = np.flatnonzero(turns == 1), np.flatnonzero(turns == -1)
    lone = np.zeros(len(buffer), dtype=bool)
    lone[starts[stops - starts == 1]] = True
    lone &= _SYMBOLS[buffer]
    hashes, bounds = word_hashes(texts)
    words = np.diff(bounds)
    count = np.maximum(words, 1)
    lengths = stops - starts
    out = np.zeros((len(texts), len(FEATURES)))
    out[:, 0] = np.log1p(words)
    out[:, 1] = (sizes - np.add.reduceat((~inside).astype(np.int64), edges[:-1]) + 1) / count / 10
    for column, kind in ((2, _UPPER), (3, _DIGIT), (4, _SYMBOLS), (5, _MARKS), (6, _HIGH)):
        out[:, column] = share(kind)
    pairs = mix(hashes[:-1]) + hashes[1:] if len(hashes) else hashes
    for i in range(len(texts)):
        a, b = bounds[i], bounds[i + 1]
        if b > a:
            out[i, 7] = len(np.unique(hashes[a:b])) / (b - a)
            out[i, 8] = len(np.unique(pairs[a:b - 1])) / (b - a - 1) if b - a > 1 else 1.0
            out[i, 9] = np.log1p(lengths[a:b].max())
    out[:, 10] = np.add.reduceat(lone.astype(np.int64), edges[:-1]) / count
    out[sizes == 0] = 0
    return out


def _described(docs: DataFrame, id_col: str, text_col: str, host: Column, path: Column) -> DataFrame:
    """(doc_id, host, path, k1, k2, x): one pass over the texts."""

    def describe(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = batch.column(5).to_pylist()
        x = np.concatenate([features(texts[a:b]) for a, b in slices(texts)])
        return pa.RecordBatch.from_arrays([*batch.columns[:5], list_array(x.ravel(), len(FEATURES))],
                                          names=["doc_id", "host", "path", "k1", "k2", "x"])

    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), host.cast("string").alias("host"),
                       path.cast("string").alias("path"), *row_key(F.col(id_col), host, path, F.col(text_col)),
                       F.col(text_col).alias("text"))
    return map_batches(rows, describe, "doc_id bigint, host string, path string, k1 bigint, k2 bigint, x array<double>")


def fit(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> tuple[np.ndarray, float, np.ndarray, np.ndarray]:
    """Weights, intercept, centre and scale of a ridge logistic regression, by Newton steps.

    Each feature also enters squared, after scaling, so that both ends of a
    feature's range can speak against a document.
    """
    centre, scale = x.mean(0), x.std(0) + 1e-9
    z = np.clip((x - centre) / scale, -6, 6)
    z = np.hstack([z, z * z, np.ones((len(z), 1))])
    w = np.zeros(z.shape[1])
    penalty = np.full(z.shape[1], ridge)
    penalty[-1] = 1e-6
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + np.diag(penalty),
                               z.T @ (y - p) - penalty * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w[:-1], float(w[-1]), centre, scale


def _linear(model: tuple[np.ndarray, float, np.ndarray, np.ndarray]) -> Column:
    weights, intercept, centre, scale = model
    total = F.lit(intercept)
    for i in range(len(centre)):
        z = F.greatest(F.lit(-6.0), F.least(F.lit(6.0), (F.col("x")[i] - float(centre[i])) / float(scale[i])))
        total = total + z * (float(weights[i]) + z * float(weights[len(centre) + i]))
    return total


def _logit(p: Column) -> Column:
    p = F.greatest(F.lit(1e-6), F.least(F.lit(1 - 1e-6), p))
    return F.log(p / (1 - p))


def _strength(sums: dict, mean: float) -> float:
    """Pseudo-count of a prior: mean (1 - mean) over the variance between groups, less one.

    ``sums``: rows, groups, sum of n^2 / N, sum of s^2 / n and of p^2, where n
    and s are a group's rows and its summed probabilities.
    """
    n, groups = sums["rows"] or 0, sums["groups"] or 0
    if groups < 2 or n <= groups:
        return 1e6
    within = max(sums["squares"] - sums["between"], 0) / (n - groups)
    between = sums["between"] - sums["base"]
    variance = (between - (groups - sums["tops"]) * within) / max(n - sums["sizes"], 1e-9)
    spread = max(mean * (1 - mean), 1e-9)
    return float(np.clip(spread / variance - 1, 1.0, 1e6)) if variance > 0 else 1e6


def scored(docs: DataFrame, labels: DataFrame, host: Column, path: Column, how: Quality = Quality(),
           id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, host, path, doc_score, host_share, path_share, posterior, keep) for each row of ``docs``.

    ``labels`` has (doc_id, quality): 1 good, 0 bad, null unknown; an id with
    several labels enters with each of them.
    """
    return _judged(docs, labels, host, path, how, id_col, text_col).drop("k1", "k2")


def _judged(docs: DataFrame, labels: DataFrame, host: Column, path: Column, how: Quality, id_col: str,
            text_col: str) -> DataFrame:
    """The columns of ``scored`` and the row's key."""
    rows = settle(_described(docs, id_col, text_col, host, path), "features")
    known = settle(rows.join(labels.select(F.col("doc_id"), F.col("quality").cast("double").alias("y")), "doc_id").filter(
        "y is not null").select("doc_id", "y", "x"), "labelled")
    # bounded by how.sample
    chosen = least_by_hash(known, how.sample, "doc_id", "y", "x").select("x", "y").toPandas()
    y = chosen["y"].to_numpy() if len(chosen) else np.zeros(0)
    if len(set(y)) > 1:
        score = 1 / (1 + F.exp(-_linear(fit(np.stack(chosen["x"].to_numpy()), y, how.ridge))))
    else:
        score = F.lit((float(y.sum()) + 1) / (len(y) + 1))
    rows = settle(rows.select("doc_id", "host", "path", "k1", "k2", score.alias("p")), "scores")

    paths = settle(rows.groupBy("host", "path").agg(
        F.count(F.lit(1)).alias("n"), F.sum("p").alias("s"), F.sum(F.col("p") * F.col("p")).alias("q")), "paths")
    hosts = settle(paths.groupBy("host").agg(
        F.sum("n").alias("hn"), F.sum("s").alias("hs"), F.sum("q").alias("hq"),
        F.sum(F.col("n") * F.col("n")).alias("nn")), "hosts")
    top = hosts.agg(
        F.sum("hn").alias("rows"), F.count(F.lit(1)).alias("groups"), F.sum("hq").alias("squares"),
        F.sum(F.col("hs") * F.col("hs") / F.col("hn")).alias("between"), F.sum("hs").alias("total"),
        F.sum(F.col("hn").cast("double") * F.col("hn")).alias("sizes"),
        F.sum(F.col("nn") / F.col("hn")).alias("path_sizes")).first().asDict()
    n = top["rows"] or 0
    mean = (top["total"] or 0.0) / n if n else 0.5
    below = paths.agg(F.count(F.lit(1)).alias("groups"), F.sum(F.col("s") * F.col("s") / F.col("n")).alias("between"),
                      ).first().asDict()
    host_prior = _strength(top | {"tops": 1, "base": mean * mean * n, "sizes": (top["sizes"] or 0) / max(n, 1)}, mean)
    path_prior = _strength({"rows": n, "groups": below["groups"], "tops": top["groups"], "squares": top["squares"],
                            "between": below["between"], "base": top["between"], "sizes": top["path_sizes"]}, mean)

    prior = F.lit(mean)
    own = F.col("p")
    host_share = (F.col("hs") - own + host_prior * prior) / (F.col("hn") - 1 + host_prior)
    path_share = (F.col("s") - own + path_prior * F.col("host_share")) / (F.col("n") - 1 + path_prior)
    sites = paths.join(hosts.select(F.col("host").alias("h"), "hn", "hs"),
                       F.col("host").eqNullSafe(F.col("h"))).select(
        F.col("host").alias("_host"), F.col("path").alias("_path"), "n", "s", "hn", "hs")
    out = rows.join(sites, F.col("host").eqNullSafe(F.col("_host")) & F.col("path").eqNullSafe(F.col("_path")))
    out = out.withColumn("host_share", host_share).withColumn("path_share", path_share)
    posterior = 1 / (1 + F.exp(-(_logit(own) + _logit(F.col("path_share")) - _logit(prior))))
    return out.select("doc_id", "host", "path", F.col("p").alias("doc_score"), "host_share", "path_share",
                      posterior.alias("posterior"), (posterior >= how.threshold).alias("keep"), "k1", "k2")


def kept(docs: DataFrame, labels: DataFrame, host: Column, path: Column, how: Quality = Quality(),
         id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` without those rejected, each row by its own id, host, path and text; equal rows go together."""
    bad = settle(_judged(docs, labels, host, path, how, id_col, text_col).filter("not keep").select("k1", "k2").distinct(),
                 "rejected")
    rows = docs.select(F.struct("*").alias("doc"), *row_key(F.col(id_col), host, path, F.col(text_col)))
    return rows.join(bad, ["k1", "k2"], "left_anti").select("doc.*")
