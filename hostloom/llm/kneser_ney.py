"""Interpolated modified Kneser-Ney language model over words.

The model is of order two or, with ``order=3``, three. Spark counts it in three
shuffles, or five, and stores it as sorted arrays in the shared folder, cut into
shards:

* ``words``: the sorted 64-bit hashes of all training words, with counts. The
  place of a word in this order is its number.
* ``pairs``: per shard of first words the sorted keys (first, second), with
  counts;
* ``followers`` and ``before``: by word number, how many different words follow
  it once, twice and more often, and how often any does; and how many different
  words precede it;
* ``triples`` and ``contexts``, for order three: per shard of the two words before,
  the sorted 64-bit hashes of triples with counts, and the same four sums for each
  two words seen twice or more; those of two words seen once follow from the pair.
  ``pairs`` then count the different words that precede a pair. A text begins with
  as many starts as a context has words.

Tasks exchange one packed block per batch and shard, never a row per token.
Pairs of a very frequent first word are spread over all shards by their key, and
only its four sums are added up afterwards, so no shard is hot. Triples whose
context is of two very frequent words are spread and added up likewise.

Scoring maps the arrays into memory. A task looks up the sorted distinct words
and pairs of some million tokens at a time, shard after shard, so it reads
forward through the files and holds one batch whatever the size of the model.

Texts are cut as in the base score: words lower-cased in A-Z, then one end,
counted as a token. Unknown words share one place in the vocabulary. Texts learn
if crc32 of their id modulo 10 is not 0; a null id reads as the empty text and so
does not learn. Null and empty texts are one end token. Repeated rows count as
often as they come. An empty table gives an empty one, and without training
texts all probabilities are 1.

The shared folder must be mounted under one path on all machines, since files
cannot be mapped into memory otherwise.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hostloom.llm.common import settle, ship_code, slices
from hostloom.llm.words import mix, word_hashes
from hostloom.session import shared_dir

END = np.uint64(0x9A3C5E7F12345679)  # stands for the end of a text among word hashes
_BATCH = 1 << 20  # tokens worked on at a time
_U32 = np.uint64(32)
_LOW = np.uint64(0xFFFFFFFF)


@dataclass(frozen=True)
class Counting:
    """``order``: 2 or 3; ``shard``: tokens a shard is meant for; a first word seen more than ``hot`` times is spread."""

    order: int = 2
    shard: int = 1 << 22
    hot: int = 1 << 20


@dataclass(frozen=True)
class Discounts:
    one: float
    two: float
    more: float

    @staticmethod
    def of(counts: np.ndarray) -> Discounts:
        """From the numbers of entries seen 1, 2, 3 and 4 times; 0.5, 1, 1.5 where they say nothing."""
        n1, n2, n3, n4 = (float(c) for c in counts[:4])
        if min(n1, n2, n3, n4) <= 0:
            return Discounts(0.5, 1.0, 1.5)
        y = n1 / (n1 + 2 * n2)
        raw = (1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3)
        return Discounts(*(min(max(d, 0.05), k - 0.05) for d, k in zip(raw, (1, 2, 3))))

    def take(self, counts: np.ndarray) -> np.ndarray:
        table = np.array([0.0, self.one, self.two, self.more])
        return table[np.minimum(counts, 3)]

    def mass(self, n1, n2, more):
        return self.one * n1 + self.two * n2 + self.more * more


@dataclass
class Store:
    """Where the shards lie, and what is known of all of them."""

    folder: str
    bits: int
    spread_above: int
    order: int = 2
    offsets: np.ndarray | None = None  # number of the first word of each shard, then the number of words
    tokens: int = 0
    texts: int = 0
    hot: np.ndarray | None = None  # sorted numbers of spread first words, the start of texts included
    hot_followers: np.ndarray | None = None
    triple_discounts: Discounts | None = None
    pair_discounts: Discounts | None = None
    word_discounts: Discounts | None = None
    pairs: int = 0
    word_mass: float = 0.0

    @property
    def words(self) -> int:
        return int(self.offsets[-1])

    def path(self, kind: str, shard: int) -> str:
        return f"{self.folder}/{kind}-{shard}.npy"

    def write(self, kind: str, shard: int, values: np.ndarray) -> None:
        """Whole or not at all, so that a repeated task does no harm."""
        os.makedirs(self.folder, exist_ok=True)
        part = f"{self.folder}/.{kind}-{shard}-{uuid.uuid4().hex}.npy"
        np.save(part, values)
        os.replace(part, self.path(kind, shard))

    def mapped(self, kind: str, shard: int) -> np.ndarray:
        return np.load(self.path(kind, shard), mmap_mode="r")

    def shard_of_words(self, hashes: np.ndarray) -> np.ndarray:
        return (hashes >> np.uint64(64 - self.bits)).astype(np.int64) if self.bits else np.zeros(len(hashes), np.int64)

    def shard_of_pairs(self, keys: np.ndarray) -> np.ndarray:
        first = (keys >> _U32).astype(np.int64)
        own = np.searchsorted(self.offsets, first, side="right") - 1
        spread = np.isin(first, self.hot)
        own[spread] = self.shard_of_words(mix(keys[spread]))
        return own

    def hot_contexts(self, contexts: np.ndarray) -> np.ndarray:
        """Contexts that may be very frequent: both of their words are."""
        words = np.stack([contexts >> _U32, contexts & _LOW]).astype(np.int64)
        return np.isin(words, self.hot).all(0)

    def shard_of_triples(self, contexts: np.ndarray, keys: np.ndarray) -> np.ndarray:
        return self.shard_of_words(np.where(self.hot_contexts(contexts), keys, mix(contexts)))

    def write_counts(self, kind: str, shard: int, keys: np.ndarray, counts: np.ndarray) -> None:
        """Sorted keys, their counts in a byte each, and the counts that need more."""
        self.write(f"{kind}s", shard, keys)
        self.write(f"{kind}_counts", shard, np.minimum(counts, 255).astype(np.uint8))
        self.write(f"{kind}_rest", shard, counts[counts >= 255])


def _runs(shards: np.ndarray) -> Iterator[tuple[int, slice]]:
    """The stretches of a sorted array of shard numbers."""
    edges = np.flatnonzero(np.diff(shards, prepend=-1))
    for a, b in zip(edges, [*edges[1:], len(shards)]):
        yield int(shards[a]), slice(a, b)


def _folded(values: np.ndarray) -> bytes:
    """Ascending numbers as steps, byte by byte, which the shuffle's compression shortens well."""
    steps = np.diff(values.astype(np.uint64), prepend=np.uint64(0))
    return steps.view(np.uint8).reshape(-1, 8).T.tobytes()


def _unfolded(block: bytes) -> np.ndarray:
    planes = np.frombuffer(block, dtype=np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view(np.uint64).ravel(), dtype=np.uint64)


def _small(values: np.ndarray) -> bytes:
    """Numbers below 2^32, byte by byte."""
    return values.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()


def _smalls(block: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(block, dtype=np.uint8).reshape(4, -1).T).view("<u4").ravel()


def _block(shards: np.ndarray, keys: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
    """One row per shard with its keys and counts; keys ascend within each shard."""
    out: tuple[list, list, list] = ([], [], [])
    for shard, part in _runs(shards):
        for column, value in zip(out, (shard, _folded(keys[part]), _small(counts[part]))):
            column.append(value)
    return pa.RecordBatch.from_arrays([pa.array(out[0], pa.int32()), pa.array(out[1], pa.binary()),
                                       pa.array(out[2], pa.binary())], names=["shard", "keys", "counts"])


def _merged(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys of all blocks of a shard, and their summed counts."""
    keys = np.concatenate([_unfolded(k) for k in table.column("keys").to_pylist()])
    counts = np.concatenate([_smalls(c) for c in table.column("counts").to_pylist()]).astype(np.int64)
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    edges = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[edges], np.add.reduceat(counts, edges)


def _tokens(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes with an end after each text, and the bounds of the texts."""
    hashes, bounds = word_hashes(texts)
    hashes = np.where(hashes == END, END + np.uint64(2), hashes)
    return np.insert(hashes, bounds[1:], END), bounds + np.arange(len(bounds))


def _batches(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[tuple[np.ndarray, np.ndarray, list]]:
    """Tokens, bounds and the Arrow slices of the other columns, some million tokens at a time."""
    tokens, sizes, rows, held = [], [], [], 0
    for batch in batches:
        texts = batch.column(column).to_pylist()
        for a, b in slices(texts):
            t, bounds = _tokens(texts[a:b])
            tokens.append(t)
            sizes.append(np.diff(bounds))
            rows.append(batch.slice(a, b - a))
            held += len(t)
            if held >= _BATCH:
                yield np.concatenate(tokens), np.concatenate([[0], np.cumsum(np.concatenate(sizes))]), rows
                tokens, sizes, rows, held = [], [], [], 0
    if tokens:
        yield np.concatenate(tokens), np.concatenate([[0], np.cumsum(np.concatenate(sizes))]), rows


def _numbers(tokens: np.ndarray, store: Store) -> tuple[np.ndarray, np.ndarray]:
    """Word number (-1 for unknown) and training count of each token."""
    distinct, back = np.unique(tokens, return_inverse=True)
    number = np.full(len(distinct), -1, dtype=np.int64)
    count = np.zeros(len(distinct), dtype=np.int64)
    for shard, part in _runs(store.shard_of_words(distinct)):
        if store.offsets[shard] == store.offsets[shard + 1]:
            continue
        known = store.mapped("words", shard)
        at = np.minimum(np.searchsorted(known, distinct[part]), len(known) - 1)
        hit = known[at] == distinct[part]
        number[part] = np.where(hit, store.offsets[shard] + at, -1)
        count[part] = np.where(hit, store.mapped("word_counts", shard)[at], 0)
    return number[back], count[back]


def _words_before(number: np.ndarray, bounds: np.ndarray, store: Store, steps: int = 1) -> np.ndarray:
    """The word some steps before each token; the start of a text has the number after the last word's."""
    before = np.full_like(number, store.words)
    before[steps:] = number[:-steps]
    for step in range(steps):
        at = bounds[:-1] + step
        before[at[at < len(number)]] = store.words
    return before


def _pair(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    return first.astype(np.uint64) << _U32 | second.astype(np.uint64)


def _triple(contexts: np.ndarray, third: np.ndarray) -> np.ndarray:
    return mix(mix(contexts) + third.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def _by_triple(contexts: np.ndarray, third: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order of triples by context and word, and where in it a new one begins."""
    order = np.lexsort((third, contexts))
    c, t = contexts[order], third[order]
    return order, np.flatnonzero(np.concatenate([[True], (c[1:] != c[:-1]) | (t[1:] != t[:-1])]))


def _count_words(training: DataFrame, store: Store) -> DataFrame:
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for tokens, _, _ in _batches(batches, 0):
            keys, counts = np.unique(tokens, return_counts=True)
            yield _block(store.shard_of_words(keys), keys, counts)

    def keep(table: pa.Table) -> pa.Table:
        shard = table.column("shard")[0].as_py()
        keys, counts = _merged(table)
        store.write("words", shard, keys)
        store.write("word_counts", shard, counts)
        often = np.flatnonzero(counts > store.spread_above)
        ends = counts[keys == END].sum()
        return pa.table({"shard": pa.array([shard], pa.int32()), "words": [len(keys)], "tokens": [int(counts.sum())],
                         "texts": [int(ends)], "often": pa.array([often.tolist()], pa.list_(pa.int64()))})

    blocks = training.select("text").mapInArrow(count, "shard int, keys binary, counts binary")
    return blocks.groupBy("shard").applyInArrow(
        keep, "shard int, words bigint, tokens bigint, texts bigint, often array<bigint>")


_BLOCKS = "shard int, keys binary, counts binary"


def _count_triples(training: DataFrame, store: Store) -> DataFrame:
    """Write all triples and their contexts.

    Returns blocks of how often a pair ends a new triple (kind 0) and of the four
    sums of contexts that are spread (kinds 1 to 4), and sums per shard.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for tokens, bounds, _ in _batches(batches, 0):
            third, _ = _numbers(tokens, store)
            contexts = _pair(_words_before(third, bounds, store, 2), _words_before(third, bounds, store))
            order, edges = _by_triple(contexts, third)
            contexts, third = contexts[order][edges], third[order][edges]
            counts = np.diff(edges, append=len(order))
            shards = store.shard_of_triples(contexts, _triple(contexts, third))
            order = np.argsort(shards, kind="stable")
            out = _block(shards[order], contexts[order], counts[order])
            words = [_small(third[order][part]) for _, part in _runs(shards[order])]
            yield pa.RecordBatch.from_arrays([*out.columns, pa.array(words, pa.binary())], names=[*out.schema.names, "words"])

    def keep(table: pa.Table) -> pa.Table:
        shard = table.column("shard")[0].as_py()
        contexts = np.concatenate([_unfolded(k) for k in table.column("keys").to_pylist()])
        third, counts = (np.concatenate([_smalls(c) for c in table.column(name).to_pylist()]).astype(np.int64)
                         for name in ("words", "counts"))
        order, edges = _by_triple(contexts, third)
        counts = np.add.reduceat(counts[order], edges)
        contexts, third = contexts[order][edges], third[order][edges]
        keys = _triple(contexts, third)
        order = np.argsort(keys)
        store.write_counts("triple", shard, keys[order], counts[order])
        heads = np.flatnonzero(np.concatenate([[True], contexts[1:] != contexts[:-1]]))
        sums = np.stack([np.add.reduceat((np.minimum(counts, 3) == k).astype(np.int64), heads) for k in (1, 2, 3)]
                        + [np.add.reduceat(counts, heads)], 1)
        spread = store.hot_contexts(contexts[heads])
        own = ~spread & (sums[:, 3] > 1)
        store.write("contexts", shard, contexts[heads][own])
        store.write("context_sums", shard, sums[own].astype(np.uint32))

        pairs, before = np.unique((contexts & _LOW) << _U32 | third.astype(np.uint64), return_counts=True)
        to = store.shard_of_pairs(pairs)
        order = np.argsort(to, kind="stable")
        blocks = [_block(to[order], pairs[order], before[order])]
        to = store.shard_of_words(mix(contexts[heads]))
        for k in range(4):
            places = np.flatnonzero(spread & (sums[:, k] > 0))
            places = places[np.argsort(to[places], kind="stable")]
            blocks.append(_block(to[places], contexts[heads][places], sums[places, k]))
        nothing = pa.array([None], pa.list_(pa.int64()))
        names = ["shard", "keys", "counts", "kind", "sums"]
        out = [pa.table([*b.columns, pa.array([k] * b.num_rows, pa.int32()),
                         pa.array([None] * b.num_rows, nothing.type)], names=names) for k, b in enumerate(blocks)]
        last = [pa.array([None], t) for t in (pa.int32(), pa.binary(), pa.binary(), pa.int32())]
        whole = [int((counts == k).sum()) for k in (1, 2, 3, 4)]
        return pa.concat_tables([*out, pa.table([*last, pa.array([whole], nothing.type)], names=names)])

    blocks = training.select("text").mapInArrow(count, _BLOCKS + ", words binary")
    return blocks.groupBy("shard").applyInArrow(keep, _BLOCKS + ", kind int, sums array<bigint>")


def _add_contexts(blocks: DataFrame, store: Store) -> DataFrame:
    """Write the sums of the contexts that are spread."""

    def keep(table: pa.Table) -> pa.Table:
        shard = table.column("shard")[0].as_py()
        kinds = np.array(table.column("kind").to_pylist())
        keys, total = _merged(table.take(pa.array(np.flatnonzero(kinds == 4))))
        sums = np.zeros((len(keys), 4), dtype=np.int64)
        sums[:, 3] = total
        for k in (1, 2, 3):
            if (kinds == k).any():
                some, counts = _merged(table.take(pa.array(np.flatnonzero(kinds == k))))
                sums[np.searchsorted(keys, some), k - 1] = counts
        store.write("hot_contexts", shard, keys)
        store.write("hot_context_sums", shard, sums)
        return pa.table({"shard": pa.array([shard], pa.int32())})

    return blocks.groupBy("shard").applyInArrow(keep, "shard int")


def _pair_blocks(training: DataFrame, store: Store) -> DataFrame:
    """Blocks of how often a pair occurs."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for tokens, bounds, _ in _batches(batches, 0):
            number, _ = _numbers(tokens, store)
            keys, counts = np.unique(_pair(_words_before(number, bounds, store), number), return_counts=True)
            shards = store.shard_of_pairs(keys)
            order = np.argsort(shards, kind="stable")
            yield _block(shards[order], keys[order], counts[order])

    return training.select("text").mapInArrow(count, _BLOCKS)


def _count_pairs(blocks: DataFrame, store: Store) -> DataFrame:
    """Write all pairs; return blocks of how often a word is a new second word, and sums per shard."""

    def keep(table: pa.Table) -> pa.Table:
        shard = table.column("shard")[0].as_py()
        keys, counts = _merged(table)
        store.write_counts("pair", shard, keys, counts)
        first = (keys >> _U32).astype(np.int64)
        kind = np.minimum(counts, 3)
        low, high = int(store.offsets[shard]), int(store.offsets[shard + 1])
        own = (first >= low) & (first < high) & ~np.isin(first, store.hot)
        followers = np.stack([np.bincount(first[own & (kind == k)] - low, minlength=high - low) for k in (1, 2, 3)]
                             + [np.bincount(first[own] - low, counts[own], high - low).astype(np.int64)], 1)
        store.write("followers", shard, followers.astype(np.uint32))
        spread = [[int(h), *(int(((first == h) & (kind == k)).sum()) for k in (1, 2, 3)), int(counts[first == h].sum())]
                  for h in np.unique(first[~own])]
        second, before = np.unique(keys & np.uint64(0xFFFFFFFF), return_counts=True)
        to = np.searchsorted(store.offsets, second.astype(np.int64), side="right") - 1
        out = _block(to, second, before)
        sums = [int((counts == k).sum()) for k in (1, 2, 3, 4)] + [len(keys)]
        rows = out.num_rows
        nothing = pa.array([None] * rows, pa.list_(pa.int64()))
        many = pa.array([None] * rows, pa.list_(pa.list_(pa.int64())))
        first_table = pa.table([*out.columns, nothing, many], names=["shard", "keys", "counts", "sums", "spread"])
        last = pa.table({"shard": pa.array([None], pa.int32()), "keys": pa.array([None], pa.binary()),
                         "counts": pa.array([None], pa.binary()), "sums": pa.array([sums], pa.list_(pa.int64())),
                         "spread": pa.array([spread], pa.list_(pa.list_(pa.int64())))})
        return pa.concat_tables([first_table, last])

    return blocks.groupBy("shard").applyInArrow(keep, _BLOCKS + ", sums array<bigint>, spread array<array<bigint>>")


def _count_before(blocks: DataFrame, store: Store) -> DataFrame:
    """Write how many different words precede each word; return sums per shard."""

    def keep(table: pa.Table) -> pa.Table:
        shard = table.column("shard")[0].as_py()
        keys, counts = _merged(table)
        low, high = int(store.offsets[shard]), int(store.offsets[shard + 1])
        before = np.zeros(high - low, dtype=np.uint32)
        before[keys.astype(np.int64) - low] = counts
        store.write("before", shard, before)
        sums = [int((counts == k).sum()) for k in (1, 2, 3, 4)] + [int((counts >= 3).sum())]
        return pa.table({"sums": pa.array([sums], pa.list_(pa.int64()))})

    return blocks.select("shard", "keys", "counts").groupBy("shard").applyInArrow(keep, "sums array<bigint>")


def _summed(rows: list, width: int) -> np.ndarray:
    return np.array([r["sums"] for r in rows], dtype=np.int64).reshape(-1, width).sum(0)


def train(docs: DataFrame, how: Counting = Counting()) -> Store:
    """Count and store the model of the texts of ``docs(text, learns)`` that learn."""
    if how.order not in (2, 3):
        raise ValueError("the order is 2 or 3")
    spark = docs.sparkSession
    place = urlparse(shared_dir(spark, "llm-kneser-ney"))
    if place.scheme not in ("", "file"):
        raise ValueError("the model is mapped into memory: spark.checkpoint.dir must name a mounted folder")
    training = docs.filter("learns")
    # going by some six bytes a token, and one end a text
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("bigint") / 6 + 1
    shards = max(1, int(training.agg(F.sum(size).alias("n")).first()["n"] or 0) // how.shard)
    store = Store(place.path, max(0, int(shards - 1).bit_length()), how.hot, how.order)
    ship_code(spark)
    # one row per shard
    rows = _count_words(training, store).collect()
    sizes = np.zeros(1 << store.bits, dtype=np.int64)
    for r in rows:
        sizes[r["shard"]] = r["words"]
    store.offsets = np.concatenate([[0], np.cumsum(sizes)])
    if store.words >= 1 << 32:
        raise ValueError("more than 2^32 different words")
    store.tokens = sum(r["tokens"] for r in rows)
    store.texts = sum(r["texts"] for r in rows)
    hot = [store.offsets[r["shard"]] + w for r in rows for w in r["often"]]
    store.hot = np.array(sorted([*hot, store.words]), dtype=np.int64)

    if how.order == 3:
        triples = settle(_count_triples(training, store), "kn-triples")
        store.triple_discounts = Discounts.of(
            _summed(triples.filter("sums is not null").select("sums").collect(), 4))
        _add_contexts(triples.filter("kind > 0"), store).collect()
        pairs = triples.filter("kind = 0").select("shard", "keys", "counts")
    else:
        pairs = _pair_blocks(training, store)
    blocks = settle(_count_pairs(pairs, store), "kn-pairs")
    rows = blocks.filter("sums is not null").select("sums", "spread").collect()
    sums = _summed(rows, 5)
    store.pair_discounts, store.pairs = Discounts.of(sums), int(sums[4])
    followers = np.zeros((len(store.hot), 4), dtype=np.int64)
    for r in rows:
        for h, *counts in r["spread"]:
            followers[np.searchsorted(store.hot, h)] += counts
    store.hot_followers = followers
    sums = _summed(_count_before(blocks.filter("sums is null"), store).collect(), 5)
    store.word_discounts = Discounts.of(sums)
    store.word_mass = float(store.word_discounts.mass(sums[0], sums[1], sums[4]))
    return store


def _by_word(kind: str, number: np.ndarray, store: Store, width: int | None = None) -> np.ndarray:
    """Values of sorted distinct word numbers from their shards."""
    out = np.zeros((len(number), width) if width else len(number), dtype=np.int64)
    for shard, part in _runs(np.searchsorted(store.offsets, number, side="right") - 1):
        if shard < len(store.offsets) - 1 and os.path.exists(store.path(kind, shard)):
            out[part] = store.mapped(kind, shard)[number[part] - store.offsets[shard]]
    return out


def _counts(kind: str, keys: np.ndarray, shards: np.ndarray, store: Store) -> np.ndarray:
    """Training counts of sorted distinct keys of pairs or triples."""
    order = np.argsort(shards, kind="stable")
    out = np.zeros(len(keys), dtype=np.int64)
    for shard, part in _runs(shards[order]):
        if not os.path.exists(store.path(f"{kind}s", shard)):
            continue
        known, places = store.mapped(f"{kind}s", shard), order[part]
        at = np.minimum(np.searchsorted(known, keys[places]), len(known) - 1)
        hit = known[at] == keys[places]
        small = store.mapped(f"{kind}_counts", shard)
        counts = np.where(hit, small[at], 0).astype(np.int64)
        large = np.flatnonzero(counts == 255)
        if len(large):
            places_of_large = np.flatnonzero(small == 255)
            counts[large] = store.mapped(f"{kind}_rest", shard)[np.searchsorted(places_of_large, at[large])]
        out[places] = counts
    return out


def _context_sums(contexts: np.ndarray, store: Store) -> np.ndarray:
    """The four sums of sorted distinct contexts."""
    out = np.zeros((len(contexts), 4), dtype=np.int64)
    shards = store.shard_of_words(mix(contexts))
    order = np.argsort(shards, kind="stable")
    for shard, part in _runs(shards[order]):
        for kind in ("context", "hot_context"):
            if not os.path.exists(store.path(f"{kind}s", shard)):
                continue
            known, places = store.mapped(f"{kind}s", shard), order[part]
            if len(known):
                at = np.minimum(np.searchsorted(known, contexts[places]), len(known) - 1)
                hit = known[at] == contexts[places]
                out[places[hit]] = store.mapped(f"{kind}_sums", shard)[at[hit]]
    return out


def _given_two(number: np.ndarray, bounds: np.ndarray, paired: np.ndarray, given_one: np.ndarray,
               store: Store) -> np.ndarray:
    """Each token's probability given the two before, from that given one; ``paired`` marks tokens seen after the one before."""
    first, second = (_words_before(number, bounds, store, k) for k in (2, 1))
    known = np.flatnonzero((first >= 0) & (second >= 0))
    contexts, back = np.unique(_pair(first[known], second[known]), return_inverse=True)
    sums = _context_sums(contexts, store)[back]
    # a context is the pair of the token before; seen and without sums of its own it was seen once
    once = np.concatenate([[False], paired[:-1]])
    once[bounds[:-1]] = False
    sums[once[known] & (sums[:, 3] == 0)] = (1, 0, 0, 1)
    known, sums, contexts = known[sums[:, 3] > 0], sums[sums[:, 3] > 0], contexts[back][sums[:, 3] > 0]
    found = np.zeros(len(known), dtype=np.int64)
    inside = np.flatnonzero(number[known] >= 0)
    keys, at, back = np.unique(_triple(contexts[inside], number[known][inside]), return_index=True, return_inverse=True)
    found[inside] = _counts("triple", keys, store.shard_of_triples(contexts[inside][at], keys), store)[back]
    d, out = store.triple_discounts, given_one.copy()
    out[known] = (found - d.take(found) + d.mass(*sums[:, :3].T) * given_one[known]) / sums[:, 3]
    return out


def log_probabilities(tokens: np.ndarray, bounds: np.ndarray, store: Store) -> tuple[np.ndarray, np.ndarray]:
    """log10 of each token's probability given those before, and each token's training count."""
    if not store.tokens:
        return np.zeros(len(tokens)), np.zeros(len(tokens), dtype=np.int64)
    number, count = _numbers(tokens, store)
    first = _words_before(number, bounds, store)
    words, word_back = np.unique(number, return_inverse=True)
    before = _by_word("before", np.maximum(words, 0), store)
    before[words < 0] = 0
    lowest = (before - store.word_discounts.take(before) + store.word_mass / (store.words + 1)) / store.pairs

    heads, head_back = np.unique(first, return_inverse=True)
    followers = _by_word("followers", np.maximum(heads, 0), store, 4)
    at = np.minimum(np.searchsorted(store.hot, heads), len(store.hot) - 1)
    spread = store.hot[at] == heads
    followers[spread] = store.hot_followers[at[spread]]
    followers[heads < 0] = 0
    seen = followers[:, 3]
    back_off = np.where(seen > 0, store.pair_discounts.mass(*followers[:, :3].T) / np.maximum(seen, 1), 1.0)

    both = (number >= 0) & (first >= 0)
    keys, key_back = np.unique(_pair(first[both], number[both]), return_inverse=True)
    found = _counts("pair", keys, store.shard_of_pairs(keys), store)
    pair = np.zeros(len(tokens))
    pair[both] = (found - store.pair_discounts.take(found))[key_back]
    paired = np.zeros(len(tokens), dtype=bool)
    paired[both] = (found > 0)[key_back]
    history = np.maximum(seen, 1)[head_back]
    given_one = pair / history + back_off[head_back] * lowest[word_back]
    return np.log10(given_one if store.order == 2 else _given_two(number, bounds, paired, given_one, store)), count


def scores(docs: DataFrame, how: Counting = Counting(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, perplexity) per row of ``docs``."""
    held = F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 10 == 0
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), held.alias("held_out"),
                       F.col(text_col).alias("text"))
    store = train(rows.select("text", (~F.col("held_out")).alias("learns")), how)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = 0.1 * (store.words + 1) + store.tokens
        for tokens, bounds, parts in _batches(batches, 2):
            logs, count = log_probabilities(tokens, bounds, store)
            sums: Callable[[np.ndarray], np.ndarray] = lambda v: np.add.reduceat(v, bounds[:-1])
            sizes, total = np.diff(bounds), sums(logs)
            table = pa.Table.from_batches(parts).combine_chunks()
            yield pa.RecordBatch.from_arrays(
                [table.column(0).combine_chunks(), table.column(1).combine_chunks(), pa.array(sizes),
                 pa.array(sums((count > 0).astype(np.int64))), pa.array(np.full(len(sizes), store.tokens)),
                 pa.array(sums(np.log10((count + 0.1) / base))), pa.array(total), pa.array(10 ** (-total / sizes))],
                names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score",
                       "perplexity"])

    return rows.mapInArrow(score, "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, "
                                  "train_tokens bigint, base_score double, score double, perplexity double")
