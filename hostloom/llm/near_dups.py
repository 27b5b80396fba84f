"""Near-duplicate texts by minhash with tensored banding, confirmed on full shingle sets.

Tensored banding: instead of one fresh group of minhashes per table, ``bands``
small groups of ``rows`` minhashes are drawn for each of two sides, and table
(i, j) is keyed by group i of the left side together with group j of the right
one. ``bands ** 2`` tables then cost only ``2 * bands * rows`` minhashes. Two
texts meet in a table as soon as they agree in any left and any right group, so
texts of similarity s miss each other with a chance of at most
``2 * (1 - s ** rows) ** bands``: 2.1e-5 at s = 0.8 with three rows, 1.5e-5 at s = 0.85 with four.

How the work stays bounded whatever the sizes of groups:

* Texts with equal shingle sets become one node before anything is compared.
* A table key can hold two nodes only if both of its groups are shared, so only
  shared groups are combined into keys; most texts never get to that point.
* Shingles that no other candidate has bound what a candidate can share with any
  other, and drop candidates and pairs without a possible link before their texts meet.
* Within a bucket all nodes are first compared with one hub. Nodes of one
  component need no more comparing. Only those outside a bucket's largest part
  then meet the others, each pair once, in the first bucket it shares, and only if
  they agree in ``AGREED`` of all groups: with 32 groups a pair at the threshold has
  fewer in 3.2e-6 (s = 0.85) or 5.3e-6 (s = 0.8) of cases. No bucket is capped and
  none is collected.
* Every candidate carries a parity bitmap: shingle hashes flip one of ``MARKS`` bits
  each. Bits in which two bitmaps differ are at most the shingles that only one text
  has, so a pair that differs in too many has no link, and its texts need not meet.

Very long texts are read whole, one at a time. Rows are documents, also when ids repeat. A null id never names a component:
a row without id gets the least id among its near-duplicates, or null.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hostloom.llm.common import list_array, map_batches, row_key, settle, slices
from hostloom.llm.components import connected
from hostloom.llm.words import mix, sums_by_text, word_hashes


# groups, of both sides together, that two nodes share at least before their texts meet
AGREED = 5
# bits of a parity bitmap, a multiple of 64
MARKS = 1024


@dataclass(frozen=True)
class Banding:
    """``size``: words per shingle; texts link at ``percent`` of similarity or more."""

    size: int = 5
    percent: int = 80
    bands: int = 16
    rows: int = 3
    seed: int = 71


def shingles(texts: list[str | None], size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text, ascending, and their bounds.

    A text with fewer words than ``size`` has its whole sequence as one
    shingle; one without words has none.
    """
    words, bounds = word_hashes(texts)
    counts = np.diff(bounds)
    rolled = np.zeros(len(words), dtype=np.uint64)
    for step in range(size):
        ahead = np.zeros(len(words), dtype=np.uint64)
        ahead[: len(words) - step] = words[step:]
        rolled = mix(rolled + ahead)
    sets = []
    for i, n in enumerate(counts):
        at = bounds[i]
        if n >= size:
            sets.append(np.unique(rolled[at: at + n - size + 1]))
        elif n:
            short = np.full(1, n, dtype=np.uint64)
            for w in words[at: at + n]:
                short = mix(short + w)
            sets.append(short)
        else:
            sets.append(rolled[:0])
    out = np.concatenate(sets) if sets else rolled[:0]
    return out, np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int64)


def node_of(sets: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """One 64-bit name per shingle set; 0 for the empty set."""
    total = mix(sums_by_text(mix(sets ^ np.uint64(0xA5A5A5A5)), bounds) + np.diff(bounds).astype(np.uint64))
    return np.where(np.diff(bounds) > 0, total | np.uint64(1), np.uint64(0))


def _band_hashes(sets: np.ndarray, bounds: np.ndarray, how: Banding) -> np.ndarray:
    """(texts, 2 * bands) hashes of minhash groups; rows of empty sets are void."""
    groups = 2 * how.bands
    factors = np.random.default_rng(how.seed).integers(1, 2**63, groups * how.rows, dtype=np.uint64) | np.uint64(1)
    texts, full = len(bounds) - 1, np.diff(bounds) > 0
    out = np.zeros((texts, groups), dtype=np.uint64)
    starts = bounds[:-1][full]
    for g in range(groups if len(starts) else 0):
        key = np.full(len(starts), g, dtype=np.uint64)
        for r in range(how.rows):
            low = np.minimum.reduceat((sets * factors[g * how.rows + r]) >> np.uint64(32), starts)
            key = mix(key + low)
        out[full, g] = key
    return out


def parity(sets: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """(texts, MARKS / 64) words of bits; a bit says whether an odd number of shingles fall on it."""
    out = np.zeros((len(bounds) - 1, MARKS // 64), dtype=np.uint64)
    place = mix(sets ^ np.uint64(0x5BD1E995)) % np.uint64(MARKS)
    text = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    np.bitwise_xor.at(out, (text, (place >> np.uint64(6)).astype(np.int64)), np.uint64(1) << (place & np.uint64(63)))
    return out


def signatures(docs: DataFrame, how: Banding, id_col: str = "doc_id", text_col: str = "text",
               key: Sequence[Column] = ()) -> DataFrame:
    """(doc_id, n_shingles, node, bands, k1, k2) for each row of ``docs``; one pass over the texts.

    ``k1`` and ``k2`` are there only where ``key`` gives them.
    """
    extra = ["k1", "k2"][: len(key)]

    def sign(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = batch.column(1).to_pylist()
        counts, nodes, bands = [], [], []
        for a, b in slices(texts):
            sets, bounds = shingles(texts[a:b], how.size)
            counts.append(np.diff(bounds))
            nodes.append(node_of(sets, bounds))
            bands.append(_band_hashes(sets, bounds, how).ravel())
        return pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(np.concatenate(counts)), pa.array(np.concatenate(nodes).view(np.int64)),
             list_array(np.concatenate(bands).view(np.int64), 2 * how.bands), *batch.columns[2:]],
            names=["doc_id", "n_shingles", "node", "bands", *extra])

    return map_batches(docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"), *key),
                       sign, "doc_id bigint, n_shingles bigint, node bigint, bands array<bigint>"
                       + "".join(f", {k} bigint" for k in extra))


def _shared_groups(nodes: DataFrame, how: Banding) -> DataFrame:
    """(node, n, left, right) of nodes with a shared minhash group on each side: those groups."""
    groups = nodes.select("node", "n", F.posexplode("bands").alias("g", "h"))
    shared = groups.groupBy("h").agg(F.count(F.lit(1)).alias("c")).filter("c > 1").select("h")
    left = F.array_sort(F.collect_list(F.when(F.col("g") < how.bands, F.col("h"))))
    right = F.array_sort(F.collect_list(F.when(F.col("g") >= how.bands, F.col("h"))))
    sides = groups.join(shared, "h").groupBy("node", "n").agg(left.alias("left"), right.alias("right"))
    return settle(sides.filter("size(left) > 0 and size(right) > 0"), "groups")


def _support(texts: DataFrame, groups: DataFrame, how: Banding) -> DataFrame:
    """(node, n, shared) of nodes that can have a link at all.

    ``shared`` counts the shingles that some other candidate has too. A link
    needs ``percent`` of a text's shingles to be shared, so most texts that only
    have a passage in common with others end here, at the cost of one count.
    """

    def cut(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = batch.column(1).to_pylist()
        found = [shingles(texts[a:b], how.size) for a, b in slices(texts)]
        sets = np.concatenate([s for s, _ in found]).view(np.int64)
        sizes = np.concatenate([np.diff(b) for _, b in found])
        return pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(np.repeat(np.arange(len(texts)), sizes))),
                                           pa.array(sets)], names=["node", "shingle"])

    rows = map_batches(texts.select("node", "text"), cut, "node bigint, shingle bigint")
    alone = rows.groupBy("shingle").agg(F.count(F.lit(1)).alias("c"), F.min("node").alias("node")).filter(
        "c = 1").groupBy("node").agg(F.count(F.lit(1)).alias("alone"))
    out = groups.select("node", "n").join(alone, "node", "left").select(
        "node", "n", (F.col("n") - F.coalesce("alone", F.lit(0))).alias("shared"))
    return settle(out.filter(100 * F.col("shared") >= how.percent * F.col("n")), "support")


def _buckets(groups: DataFrame, support: DataFrame) -> DataFrame:
    """(key, node, n, shared) for table keys held by two nodes or more."""
    sides = groups.select("node", "left", "right").join(support, "node")
    keys = settle(
        sides.withColumn("l", F.explode("left")).withColumn("r", F.explode("right"))
        .select(F.xxhash64("l", "r").alias("key"), "node", "n", "shared"), "keys")
    held = keys.groupBy("key").agg(F.count(F.lit(1)).alias("c")).filter("c > 1").select("key")
    return settle(keys.join(held, "key"), "buckets")


def _confirm(pairs: DataFrame, texts: DataFrame, how: Banding) -> DataFrame:
    """``pairs(a, b)`` with their Jaccard distance on full shingle sets, and whether they link."""

    def measure(batch: pa.RecordBatch) -> pa.RecordBatch:
        left, right = batch.column(2).to_pylist(), batch.column(3).to_pylist()
        alike, distance = np.zeros(batch.num_rows, dtype=bool), np.zeros(batch.num_rows)
        for at, stop in slices([x + y for x, y in zip(left, right)]):
            sets, bounds = shingles(left[at:stop] + right[at:stop], how.size)
            for i in range(stop - at):
                j = i + stop - at
                one, two = sets[bounds[i]:bounds[i + 1]], sets[bounds[j]:bounds[j + 1]]
                both = len(np.intersect1d(one, two, assume_unique=True))
                every = len(one) + len(two) - both
                alike[at + i], distance[at + i] = 100 * both >= how.percent * every, 1 - both / every
        return pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(alike), pa.array(distance)],
                                          names=["a", "b", "alike", "distance"])

    first = texts.select(F.col("node").alias("a"), F.col("text").alias("left"))
    second = texts.select(F.col("node").alias("b"), F.col("text").alias("right"))
    both = pairs.join(first, "a").join(second, "b").select("a", "b", "left", "right")
    return map_batches(both, measure, "a bigint, b bigint, alike boolean, distance double")


def _texts_of(docs: DataFrame, chosen: DataFrame, how: Banding, id_col: str, text_col: str) -> DataFrame:
    """(node, text, marks): one text for each row of ``chosen(node, rep)``, and its parity bitmap."""

    def name(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = batch.column(0).to_pylist()
        nodes, marks = [], []
        for a, b in slices(texts):
            found = shingles(texts[a:b], how.size)
            nodes.append(node_of(*found))
            marks.append(parity(*found).ravel())
        return pa.RecordBatch.from_arrays(
            [pa.array(np.concatenate(nodes).view(np.int64)), batch.column(0),
             list_array(np.concatenate(marks).view(np.int64), MARKS // 64)], names=["node", "text", "marks"])

    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    # rows are named before they meet nodes, so an id (or none) on many rows does not multiply
    ids = chosen.select("rep").distinct()
    near = rows.join(ids, rows.doc_id.eqNullSafe(ids.rep), "left_semi").select("text")
    named = map_batches(near, name, "node bigint, text string, marks array<bigint>")
    return named.join(chosen.select("node"), "node", "left_semi").dropDuplicates(["node"])


def _possible(how: Banding) -> Column:
    """Whether a row and a pivot, with what each can share, may link."""
    most = F.least("shared", "ps")
    return 100 * most >= how.percent * (F.col("n") + F.col("pn") - most)


def _alike(how: Banding) -> Column:
    """Whether the bitmaps of a row and a pivot leave room for a link."""
    apart = sum((F.bit_count(F.get("marks", F.lit(i)).bitwiseXOR(F.get("pmarks", F.lit(i)))) for i in range(MARKS // 64)),
                F.lit(0))
    every = F.col("n") + F.col("pn")
    return (100 + how.percent) * (every - apart) >= 2 * how.percent * every


def _links(docs: DataFrame, nodes: DataFrame, how: Banding, id_col: str, text_col: str) -> DataFrame:
    """(node, component) of all nodes that have links to other nodes."""
    groups = _shared_groups(nodes, how)
    chosen = groups.select("node").join(nodes.select("node", "rep"), "node")
    texts = settle(_texts_of(docs, chosen, how, id_col, text_col), "texts")
    rows = _buckets(groups, _support(texts, groups, how))

    # first every node of a bucket with its hub, the node with the fewest shingles of its own
    hubs = rows.groupBy("key").agg(F.min(F.struct(F.col("n") - F.col("shared"), "node", "n", "shared")).alias("p"))
    hubs = hubs.select("key", F.col("p.node").alias("p"), F.col("p.n").alias("pn"), F.col("p.shared").alias("ps"))
    met = rows.join(hubs, "key").filter((F.col("node") != F.col("p")) & _possible(how))
    tested = settle(met.select(F.least("node", "p").alias("a"), F.greatest("node", "p").alias("b")).distinct(), "pairs")
    measured = settle(_confirm(tested, texts, how), "links")
    links = measured.filter("alike").select("a", "b")

    # nodes of one component need no more comparing
    labels = settle(connected(links), "labels")
    rows = rows.join(labels.withColumnRenamed("component", "label"), "node", "left").withColumn(
        "label", F.coalesce("label", "node"))
    parts = rows.groupBy("key", "label").agg(F.count(F.lit(1)).alias("c"))
    tops = parts.groupBy("key").agg(F.max(F.struct("c", "label")).alias("top"), F.count(F.lit(1)).alias("parts"))
    rows = rows.join(tops.filter("parts > 1").select("key", F.col("top.label").alias("top")), "key").join(
        hubs.select("key", F.col("p").alias("hub")), "key")
    # distances to a common hub bound the distance of two nodes, as Jaccard distance is a metric
    away = measured.select(F.col("a").alias("_a"), F.col("b").alias("_b"), "distance")
    rows = rows.join(away, (F.least("node", "hub") == F.col("_a")) & (F.greatest("node", "hub") == F.col("_b")), "left")
    away = F.when(F.col("node") == F.col("hub"), F.lit(0.0)).otherwise(F.col("distance"))
    rows = settle(rows.withColumn("away", away).drop("hub", "_a", "_b", "distance"), "open")

    # then those outside a bucket's largest part with all others, each pair in the first of the buckets it shares
    rows = rows.join(groups.select("node", "left", "right"), "node").join(texts.select("node", "marks"), "node")
    pivots = rows.filter("label <> top").select(
        "key", F.col("node").alias("p"), F.col("label").alias("pl"), F.col("n").alias("pn"), F.col("shared").alias("ps"),
        F.col("left").alias("pleft"), F.col("right").alias("pright"), F.col("away").alias("paway"),
        F.col("marks").alias("pmarks"))
    near = F.coalesce(F.abs(F.col("away") - F.col("paway")) <= 1 - how.percent / 100 + 1e-9, F.lit(True))
    lefts, rights = F.array_intersect("left", "pleft"), F.array_intersect("right", "pright")
    first = F.xxhash64(F.array_min(lefts), F.array_min(rights))
    agreed = F.size(lefts) + F.size(rights) >= min(AGREED, how.bands)
    once = (F.col("label") == F.col("top")) | (F.col("node") < F.col("p"))
    met = rows.join(pivots, "key").filter(
        (F.col("label") != F.col("pl")) & once & _possible(how) & near & _alike(how) & agreed & (first == F.col("key")))
    # a bucket may hold a pair that is outside in one and inside in another
    pairs = met.select(F.least("node", "p").alias("a"), F.greatest("node", "p").alias("b"))
    pairs = settle(pairs.join(tested, ["a", "b"], "left_anti"), "pairs")
    if pairs.isEmpty():
        return labels
    more = settle(_confirm(pairs, texts, how).filter("alike").select("a", "b"), "links")
    if more.isEmpty():
        return labels
    return settle(connected(more.union(labels.select(F.col("node").alias("a"), F.col("component").alias("b")))), "labels")


def near_duplicates(docs: DataFrame, how: Banding = Banding(), id_col: str = "doc_id",
                    text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for each row of ``docs``.

    ``component_id`` is the least id reachable by links, the row's own included.
    ``kept`` marks the rows that bear it; a row without words or text has only
    itself, and rows without id are kept only where no row with an id is like
    them. Other columns of ``docs`` are ignored, so their names may clash.
    """
    return _grouped(docs, how, id_col, text_col).select("doc_id", "n_shingles", "component_id", "kept")


def _grouped(docs: DataFrame, how: Banding, id_col: str, text_col: str, key: Sequence[Column] = ()) -> DataFrame:
    """The columns of ``near_duplicates``, the node that names the component, and the row's key where given."""
    rows = settle(signatures(docs, how, id_col, text_col, key), "signatures")
    nodes = settle(
        rows.filter("n_shingles > 0").groupBy("node", F.col("n_shingles").alias("n"), "bands")
        .agg(F.min("doc_id").alias("rep")), "nodes")
    labels = _links(docs, nodes, how, id_col, text_col)
    places = nodes.select("node", "rep").join(labels, "node", "left").withColumn(
        "component", F.coalesce("component", "node"))
    least = places.groupBy("component").agg(F.min("rep").alias("component_id"))
    places = places.join(least, "component").select("node", "component", "component_id")
    out = rows.drop("bands").join(places, "node", "left")
    component = F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return out.withColumn("component_id", component).withColumn(
        "kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.col("component_id").isNull()))


def deduplicated(docs: DataFrame, how: Banding = Banding(), id_col: str = "doc_id",
                 text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` without those that are near-duplicates of a kept one.

    Rows are judged one by one: of each component one row stays, of the rows with
    its least id (or without any id) the one with the least key. Rows
    without words are like no other; of repeated ones (same id and text) one stays.
    """
    key = row_key(F.col(id_col), F.col(text_col))
    marks = _grouped(docs, how, id_col, text_col, key).filter("kept")
    # rows without words are their own groups
    void = F.col("n_shingles") == 0
    groups = marks.groupBy("component", F.when(void, F.col("k1")).alias("v1"), F.when(void, F.col("k2")).alias("v2"))
    stay = settle(groups.agg(F.min(F.struct("k1", "k2")).alias("k")).select("k.k1", "k.k2"), "marks")
    rows = docs.select(F.struct("*").alias("doc"), *key).join(stay, ["k1", "k2"], "left_semi")
    return rows.dropDuplicates(["k1", "k2"]).select("doc.*")
