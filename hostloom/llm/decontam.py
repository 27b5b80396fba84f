"""Benchmark passages in documents, found by latent semantic retrieval and checked word by word.

1. Terms are the bare words of the benchmark, weighted by their rarity over all
   documents; words in more than one document of twenty keep only a trace of
   weight. No other word can bring a document nearer to an item.
2. A randomised SVD of the TF-IDF matrix of benchmark passages gives a latent
   space: the range of (A'A)^p G for a Gaussian G, worked out as Spark jobs
   over the rows of A, that sum one vector per term.
3. Overlapping windows of two widths over every document are projected and
   compared with the items by cosine. Windows without enough weighted terms for
   any item are passed by. Items longer than the wider window take part as
   overlapping pieces of its width; a piece stands for its whole item.
   Words that are frequent over the documents cannot tell windows apart, so each
   item is also looked for by its runs of three words, however frequent: a
   stretch that may hold the item and has a seventh of its runs, or two if that
   is more, is a candidate too. Copies word for word are always candidates;
   of reworded items those made of frequent words need that many whole runs.
4. A candidate is confirmed in its place. Some stretch around the window, half as
   long again as the item, must hold enough of the item's weight and most of the
   item's words in order (longest common subsequence). For paraphrases somewhat
   fewer words do if the answer is there too: most of the weight of the last
   third of the item.

The benchmark is taken in blocks of about ``block`` items, or as many pieces of
text where items are long, each searched in all documents, so what tasks hold is bounded. The document side needs no shuffle.

Null and empty texts contain nothing; items without words are in no document.
Repeated rows and items are answered as often as they come; null ids are kept
as they are. Extra columns are ignored, empty tables give empty results.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hostloom.llm.common import map_batches, ship_code, slices
from hostloom.llm.words import PUNCTUATION, mix, segment_ids, word_hashes


@dataclass(frozen=True)
class Retrieval:
    """``near``: share of an item found in order that suffices alone; ``loose``: with its answer. ``present``: share
    of its weight that must be there in any case, ``answer``: of the weight of its last third.

    ``cosine``: least cosine of a candidate; ``energy``: least weight of a window against the lightest item.
    ``run``: words in a row that are looked up as they are; ``runs``: share of an item's runs that makes a candidate.
    """

    rank: int = 64
    extra: int = 8
    power: int = 2
    step: int = 16
    widths: tuple[int, ...] = (2, 4)
    cosine: float = 0.45
    energy: float = 0.3
    near: float = 0.7
    loose: float = 0.55
    answer: float = 0.8
    present: float = 0.4
    block: int = 10_000
    seed: int = 5
    run: int = 3
    runs: float = 1 / 7


class Terms:
    """The words of a block of items as sorted hashes, with a quick test in front."""

    def __init__(self, hashes: np.ndarray):
        self.hashes = np.unique(hashes)
        self.maybe = np.zeros(1 << 16, dtype=bool)
        self.maybe[(self.hashes >> np.uint64(48)).astype(np.int64)] = True

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """Number of each word among the terms, -1 for others."""
        out = np.full(len(hashes), -1, dtype=np.int64)
        at = np.flatnonzero(self.maybe[(hashes >> np.uint64(48)).astype(np.int64)])
        if len(at):
            place = np.minimum(np.searchsorted(self.hashes, hashes[at]), len(self.hashes) - 1)
            hit = self.hashes[place] == hashes[at]
            out[at[hit]] = place[hit]
        return out


def _document_counts(docs: DataFrame, terms: Terms, text_col: str) -> tuple[np.ndarray, int]:
    """In how many documents each term is, and the number of documents."""
    size = len(terms.hashes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size + 1, dtype=np.int64)
        for batch in batches:
            texts = batch.column(0).to_pylist()
            total[size] += len(texts)
            for a, b in slices(texts):
                hashes, bounds = word_hashes(texts[a:b], PUNCTUATION)
                found = terms.find(hashes)
                at = np.flatnonzero(found >= 0)
                doc = np.searchsorted(bounds, at, side="right") - 1
                once = np.unique(doc * size + found[at])
                total[:size] += np.bincount(once % size, minlength=size)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(size + 1)), pa.array(total)], names=["t", "n"])

    ship_code(docs.sparkSession)
    counts = docs.select(F.col(text_col)).mapInArrow(run, "t bigint, n bigint").groupBy("t").agg(
        F.sum("n").alias("n")).toPandas()
    out = np.zeros(size + 1, dtype=np.int64)
    out[counts["t"].to_numpy()] = counts["n"].to_numpy()
    return out[:size], int(out[size])


def _gram_times(passages: DataFrame, z: np.ndarray) -> np.ndarray:
    """A'A z for the sparse rows ``passages(terms, weights)`` of A."""
    width = z.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for terms, weights in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                w = np.array(weights)
                row = w @ z[terms]
                for t, x in zip(terms, w):
                    total[t] = total.get(t, 0) + x * row
        if total:
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(total)), pa.array([v.tolist() for v in total.values()], pa.list_(pa.float64()))],
                names=["t", "v"])

    ship_code(passages.sparkSession)
    summed = passages.mapInArrow(run, "t bigint, v array<double>").groupBy("t").agg(
        *[F.sum(F.col("v")[i]).alias(f"v{i}") for i in range(width)]).toPandas()
    out = np.zeros_like(z)
    if len(summed):
        out[summed["t"].to_numpy()] = summed.drop(columns="t").to_numpy()
    return out


def latent_space(passages: DataFrame, terms: int, how: Retrieval) -> np.ndarray:
    """(terms, rank) orthonormal directions that hold most of the passages' weight."""
    width = min(how.rank + how.extra, terms)
    q = np.linalg.qr(np.random.default_rng(how.seed).standard_normal((terms, width)))[0]
    for _ in range(how.power):
        q = np.linalg.qr(_gram_times(passages, q))[0]
    values, vectors = np.linalg.eigh(q.T @ _gram_times(passages, q))
    return q @ vectors[:, np.argsort(-values)[: how.rank]]


def common_length(item: np.ndarray, words: np.ndarray) -> int:
    """Length of the longest common subsequence, by bit-parallel rows."""
    masks: dict[int, int] = {}
    for i, w in enumerate(item.tolist()):
        masks[w] = masks.get(w, 0) | 1 << i
    full = (1 << len(item)) - 1
    row = full
    for w in words.tolist():
        mask = masks.get(w)
        if mask:
            hit = row & mask
            row = ((row + hit) | (row - hit)) & full
    return len(item) - row.bit_count()


def _run_hashes(hashes: np.ndarray, starts: np.ndarray, size: int) -> np.ndarray:
    """Hash of the ``size`` words from each start."""
    out = mix(hashes[starts])
    for k in range(1, size):
        out = mix(out + hashes[starts + k])
    return out


class Runs:
    """Runs of words of all items: which items hold each. Items shorter than a run are a run of their own."""

    def __init__(self, items: list[np.ndarray], how: Retrieval):
        self.lengths = np.array([len(i) for i in items])
        held: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
        for at, item in enumerate(items):
            size = min(how.run, len(item))
            runs = np.unique(_run_hashes(item, np.arange(len(item) - size + 1), size))
            held.setdefault(size, []).append((runs, np.full(len(runs), at)))
        self.tables = []
        for size, parts in sorted(held.items()):
            runs, owner = (np.concatenate(c) for c in zip(*parts))
            order = np.argsort(runs, kind="stable")
            known = Terms(runs)
            edges = np.searchsorted(runs[order], known.hashes)
            self.tables.append((size, known, np.append(edges, len(runs)), owner[order]))
        count = np.maximum(self.lengths - how.run + 1, 1)
        self.need = np.minimum(np.maximum(np.ceil(how.runs * count).astype(np.int64), 2), count)

    def candidates(self, hashes: np.ndarray, found: np.ndarray,
                   bounds: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
        """(text, item, first word, last word) around stretches with enough runs of an item."""
        text = segment_ids(bounds)
        for size, known, edges, owner in self.tables:
            starts = np.arange(max(0, len(found) - size + 1))
            whole = text[starts] == text[starts + size - 1]
            for k in range(size):
                whole &= found[starts + k] >= 0
            starts = starts[whole]
            run = known.find(_run_hashes(hashes, starts, size))
            starts, run = starts[run >= 0], run[run >= 0]
            many = edges[run + 1] - edges[run]
            at = np.repeat(starts, many)
            item = owner[np.arange(many.sum()) - np.repeat(np.cumsum(many) - many - edges[run], many)]
            own = text[at] * len(self.lengths) + item
            order = np.argsort(own, kind="stable")
            at, item, own = at[order], item[order], own[order]
            end = np.arange(len(at)) + self.need[item] - 1
            inside = end < len(at)
            end = np.minimum(end, len(at) - 1)
            length = self.lengths[item]
            enough = inside & (own[end] == own) & (at[end] - at + size <= -(-3 * length // 2))
            # one candidate for all such places in a cell as long as the item
            cells = np.unique(np.stack([own[enough], at[enough] // length[enough]]), axis=1)
            for pair, cell in cells.T.tolist():
                where, which = divmod(pair, len(self.lengths))
                long = int(self.lengths[which])
                yield where, which, cell * long - long // 2 - 1, (cell + 1) * long + long // 2 + 1


def pieces(items: list[np.ndarray], how: Retrieval) -> tuple[list[np.ndarray], np.ndarray]:
    """Items cut into overlapping pieces of at most the wider window, and the item of each piece."""
    width = how.step * max(how.widths)
    cut = [(at, item[a: a + width]) for at, item in enumerate(items)
           for a in [*range(0, max(len(item) - width, 0), width // 2), max(len(item) - width, 0)]]
    return [p for _, p in cut], np.array([at for at, _ in cut])


class Searcher:
    """Finds one block of items in texts."""

    def __init__(self, ids: list, items: list[np.ndarray], terms: Terms, weights: np.ndarray, space: np.ndarray,
                 how: Retrieval):
        self.ids, self.items, self.terms, self.how = ids, items, terms, how
        self.weights = weights
        self.vectors = (space * weights[:, None]).astype(np.float32)
        # terms with a trace of weight only cannot move a window; the last place answers for words that are no terms
        self.telling = np.append(weights >= 0.05 * weights.max(), False)
        cut, self.owner = pieces(items, how)
        sums = np.stack([self.vectors[terms.find(p)].sum(0) for p in cut])
        self.directions = (sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-12)).astype(np.float32)
        self.runs = Runs(items, how)
        self.mass = np.array([(weights[terms.find(p)] ** 2).sum() for p in cut])
        self.least = how.energy * self.mass.min()
        self.parts = []
        for item in items:
            whole, tail = np.unique(item), np.unique(item[-max(1, len(item) // 3):])
            self.parts.append([(w, weights[terms.find(w)] ** 2) for w in (whole, tail)])

    def candidates(self, found: np.ndarray, bounds: np.ndarray) -> Iterator[tuple[int, int, int, int, float]]:
        """(text, item, first word, last word, cosine) of windows near an item."""
        how = self.how
        telling = np.flatnonzero(self.telling[found])
        term = found[telling]
        mass = np.zeros(len(term) + 1)
        np.cumsum(self.weights[term] ** 2, out=mass[1:])
        counts = np.diff(bounds)
        steps = np.maximum(1, -(-counts // how.step))
        text = np.repeat(np.arange(len(counts)), steps)
        first = bounds[:-1][text] + how.step * (np.arange(len(text)) - np.repeat(np.cumsum(steps) - steps, steps))
        low = np.searchsorted(telling, first)
        for width in how.widths:
            last = np.minimum(first + width * how.step, bounds[1:][text])
            high = np.searchsorted(telling, last)
            picked = np.flatnonzero((mass[high] - mass[low] >= self.least) & (high > low))
            # the products of one round take the same room however many pieces there are
            round_ = max(1, min(4096, (4096 * 10_000) // len(self.owner)))
            for at in range(0, len(picked), round_):
                some = picked[at: at + round_]
                sizes = (high - low)[some]
                edge = np.cumsum(sizes) - sizes
                inside = np.arange(sizes.sum()) - np.repeat(edge - low[some], sizes)
                sums = np.add.reduceat(self.vectors[term[inside]], edge, axis=0)
                alike = sums @ self.directions.T
                norm = np.maximum(np.linalg.norm(sums, axis=1), 1e-12)
                window, piece = np.nonzero(alike >= (how.cosine * norm)[:, None])
                own = some[window]
                heavy = mass[high[own]] - mass[low[own]] >= how.energy * self.mass[piece]
                cosine = (alike[window, piece] / norm[window])[heavy]
                own = own[heavy]
                yield from zip(text[own].tolist(), self.owner[piece[heavy]].tolist(), first[own].tolist(), last[own].tolist(),
                               cosine.tolist())

    def confirmed(self, item: int, around: np.ndarray) -> tuple[int, float]:
        """Common words and answer share of the stretch of ``around`` that holds most of the item, or zeros."""
        how, words, best = self.how, self.items[item], (0, 0.0)

        def held(part: tuple[np.ndarray, np.ndarray], stretch: np.ndarray) -> float:
            return float(part[1][np.isin(part[0], stretch)].sum() / part[1].sum())

        whole, tail = self.parts[item]
        if held(whole, around) < how.present:
            return 0, 0.0
        size, step = -(-3 * len(words) // 2), max(1, len(words) // 2)
        for at in range(0, max(1, len(around) - len(words)), step):
            stretch = around[at: at + size]
            if held(whole, stretch) < how.present:
                continue
            common, share = common_length(words, stretch), held(tail, stretch)
            if common >= how.near * len(words) or (common >= how.loose * len(words) and share >= how.answer):
                best = max(best, (common, share))
        return best

    def cosine(self, item: int, found: np.ndarray) -> float:
        """Cosine of a stretch with the nearest piece of an item."""
        stretch = self.vectors[found[found >= 0]].sum(0)
        near = (self.directions[self.owner == item] @ stretch).max()
        return float(near / max(np.linalg.norm(stretch), 1e-12))

    def matches(self, texts: list[str | None]) -> list[tuple[int, int, float, int, float]]:
        """(text, item, cosine, common words, answer share) of confirmed items, the best place of each."""
        how, best = self.how, {}
        hashes, bounds = word_hashes(texts, PUNCTUATION)
        found = self.terms.find(hashes)
        nearest = sorted(self.candidates(found, bounds), key=lambda c: -c[4])
        for text, item, a, b, cosine in nearest:
            if (text, item) in best:
                continue
            reach = len(self.items[item])
            around = hashes[max(bounds[text], a - reach): min(bounds[text + 1], b + reach)]
            common, share = self.confirmed(item, around)
            if common:
                best[text, item] = (text, item, cosine, common, share)
        for text, item, a, b in self.runs.candidates(hashes, found, bounds):
            if (text, item) in best:
                continue
            reach = len(self.items[item])
            a, b = max(bounds[text], a - reach), min(bounds[text + 1], b + reach)
            common, share = self.confirmed(item, hashes[a:b])
            if common:
                best[text, item] = (text, item, self.cosine(item, found[a:b]), common, share)
        return list(best.values())


def searchers(docs: DataFrame, items: DataFrame, how: Retrieval = Retrieval(),
              text_col: str = "text") -> Iterator[Searcher]:
    """One searcher for each block of ``items(item_id, text)``."""
    spark = docs.sparkSession
    # about as many characters as a piece has; an item that is shorter counts as one
    sizes = F.greatest(F.lit(1), F.ceil(F.length(F.coalesce("text", F.lit(""))) / 400))
    blocks = max(1, math.ceil((items.agg(F.sum(sizes)).first()[0] or 0) / how.block))
    for block in range(blocks):
        part = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block)
        rows = part.select("item_id", "text").orderBy("item_id", "text").collect()
        hashes, bounds = word_hashes([r["text"] for r in rows], PUNCTUATION)
        pairs = [(r["item_id"], hashes[a:b]) for r, a, b in zip(rows, bounds, bounds[1:]) if b > a]
        if not pairs:
            continue
        terms = Terms(hashes)
        held, n = _document_counts(docs, terms, text_col)
        rarity = np.log(np.maximum(n, 1) / np.maximum(held, 1))
        weights = 0.1 * np.log(2) + 0.1 * rarity + np.maximum(rarity - np.log(20), 0)
        sparse = []
        for words in pieces([w for _, w in pairs], how)[0]:
            t, c = np.unique(terms.find(words), return_counts=True)
            w = c * weights[t]
            sparse.append((t.tolist(), (w / max(np.linalg.norm(w), 1e-12)).tolist()))
        passages = spark.createDataFrame(sparse, "terms array<bigint>, weights array<double>")
        space = latent_space(passages, len(terms.hashes), how)
        yield Searcher([i for i, _ in pairs], [w for _, w in pairs], terms, weights, space, how)


def contaminated(docs: DataFrame, items: DataFrame, how: Retrieval = Retrieval(), id_col: str = "doc_id",
                 text_col: str = "text") -> DataFrame:
    """(doc_id, item_id, cosine, common, coverage, answer) for each item found in a document.

    ``common``: words of the longest common subsequence, ``coverage`` its share
    of the item, ``answer``: share of the answer's weight that is there.
    """
    schema = "doc_id bigint, item_id bigint, cosine double, common bigint, coverage double, answer double"
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    out = None
    for searcher in searchers(docs, items, how, text_col):

        def search(batch: pa.RecordBatch, searcher: Searcher = searcher) -> pa.RecordBatch | None:
            texts = batch.column(1).to_pylist()
            hits = [(a + t, *rest) for a, b in slices(texts) for t, *rest in searcher.matches(texts[a:b])]
            if not hits:
                return None
            text, item, cosine, common, share = (np.array(c) for c in zip(*hits))
            sizes = np.array([len(w) for w in searcher.items])[item]
            return pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(text)), pa.array([searcher.ids[i] for i in item], pa.int64()),
                 pa.array(cosine), pa.array(common), pa.array(common / sizes), pa.array(share)],
                names=["doc_id", "item_id", "cosine", "common", "coverage", "answer"])

        found = map_batches(rows, search, schema)
        out = found if out is None else out.union(found)
    return docs.sparkSession.createDataFrame([], schema) if out is None else out


def decontaminated(docs: DataFrame, items: DataFrame, how: Retrieval = Retrieval(),
                   text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` in which no item is found, all columns as they are."""
    out = docs
    for searcher in searchers(docs, items, how, text_col):
        place = docs.columns.index(text_col)

        def clean(batch: pa.RecordBatch, searcher: Searcher = searcher) -> pa.RecordBatch:
            texts = batch.column(place).to_pylist()
            keep = np.ones(len(texts), dtype=bool)
            for a, b in slices(texts):
                keep[[a + hit[0] for hit in searcher.matches(texts[a:b])]] = False
            return batch.filter(pa.array(keep))

        out = map_batches(out, clean, docs.schema)
    return out
