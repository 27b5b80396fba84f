"""Token ids packed into fixed-length rows by best-fit decreasing.

Each document becomes its token ids and one end id. Documents longer than a row
are cut into pieces, none lost; whole-row pieces stand alone, all others are
placed longest first into the fullest row that still has room. A segment tree
over free capacities finds that row in a few steps.

A task packs its own documents, a bounded number of tokens at a time, so no
shuffle is needed, no source or long text is hot, and a lost task is redone
alone with the same result.

Columns of a packed row, all numbers little-endian:

* ``pack_id``: unique, from the partition and the row's place in it;
* ``ids``: ``length`` ids as binary, 2 bytes each where the vocabulary allows, else 4; the free end is filled
  with the end id;
* ``position_ids``: the same shape, starting again at 0 in each segment;
* ``cu_seqlens``: cumulative segment lengths from 0 to the used length;
* ``doc_ids``, ``starts``: per segment its document and the place of its first id within that document.

Null and empty texts are one end id; texts and runs of blanks may be of any length. A document without id keeps a null in
``doc_ids``; repeated rows are packed as often as they come. An empty table
gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hostloom.llm.common import ship_code

# Fixed value: how the public 50k byte-level vocabulary splits text before merging.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

SCHEMA = ("pack_id bigint, ids binary, position_ids binary, cu_seqlens array<int>, "
          "doc_ids array<bigint>, starts array<bigint>")


# Blanks as the pattern's \\s has them. Its lookahead steps back over a run one by one, on a stack that long runs exceed.
_RUN = re.compile("[\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]{%d,}" % (1 << 13))


@dataclass(frozen=True)
class Packing:
    """``buffer``: tokens packed at a time; ``end_id`` must be free in the vocabulary."""

    vocabulary: str = "/opt/tokenizers/byte_bpe_50k.tiktoken"
    length: int = 2048
    end_id: int = 50256
    buffer: int = 1 << 22


@cache
def encoder(vocabulary: str, pattern: str = PATTERN):
    import tiktoken

    with open(vocabulary, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("packing", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def token_ids(text: str, vocabulary: str) -> np.ndarray:
    """The ids of a text of any length; runs of blanks of any length give what the pattern gives.

    A run is one piece, but for its last blank where a word follows: that one belongs to the word.
    """
    encoding = encoder(vocabulary)
    parts, start = [], 0
    for run in _RUN.finditer(text):
        end = run.end() if run.end() == len(text) else run.end() - 1
        parts.append(encoding.encode_to_numpy(text[start:run.start()], disallowed_special=()))
        parts.append(encoder(vocabulary, "(?s:.+)").encode_to_numpy(text[run.start():end], disallowed_special=()))
        start = end
    parts.append(encoding.encode_to_numpy(text[start:], disallowed_special=()))
    return np.concatenate(parts)


class FreeRows:
    """Open rows by free capacity: a segment tree over the capacities 0 to ``length``."""

    def __init__(self, length: int):
        self.size = 1 << length.bit_length()
        self.counts = [0] * (2 * self.size)
        self.rows: dict[int, list[int]] = {}

    def add(self, capacity: int, row: int) -> None:
        self.rows.setdefault(capacity, []).append(row)
        self._count(capacity, 1)

    def _count(self, capacity: int, change: int) -> None:
        node = self.size + capacity
        while node:
            self.counts[node] += change
            node >>= 1

    def take(self, need: int) -> tuple[int, int] | None:
        """Remove and return (capacity, row) of the least capacity that is at least ``need``."""
        node = self.size + need
        if not self.counts[node]:
            while node > 1 and (node & 1 or not self.counts[node + 1]):
                node >>= 1
            if node <= 1:
                return None
            node += 1
            while node < self.size:
                node = 2 * node if self.counts[2 * node] else 2 * node + 1
        capacity = node - self.size
        self._count(capacity, -1)
        return capacity, self.rows[capacity].pop()


def best_fit(lengths: np.ndarray, length: int) -> list[list[int]]:
    """Rows as lists of piece numbers, for pieces of 1 to ``length`` tokens, longest first."""
    rows: list[list[int]] = []
    free = FreeRows(length)
    for piece in np.argsort(-lengths, kind="stable").tolist():
        need = int(lengths[piece])
        found = free.take(need)
        if found is None:
            capacity, row = length, len(rows)
            rows.append([])
        else:
            capacity, row = found
        rows[row].append(piece)
        if capacity > need:
            free.add(capacity - need, row)
    return rows


def _binary(matrix: np.ndarray) -> pa.Array:
    offsets = np.arange(len(matrix) + 1, dtype=np.int32) * (matrix.shape[1] * matrix.itemsize)
    return pa.Array.from_buffers(pa.binary(), len(matrix), [None, pa.py_buffer(offsets), pa.py_buffer(matrix)])


def _lists(parts: list[np.ndarray], values: pa.Array | None = None) -> pa.Array:
    offsets = np.cumsum([0, *map(len, parts)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(parts)) if values is None else values)


def pack(ids: list[np.ndarray], names: pa.Array, how: Packing, first: int) -> Iterator[pa.RecordBatch]:
    """Pack documents given as id arrays (end id included) with their names."""
    sizes = np.array([len(x) for x in ids])
    stream = np.concatenate(ids)
    pieces = -(-sizes // how.length)
    doc = np.repeat(np.arange(len(ids)), pieces)
    nth = np.arange(len(doc)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    start = nth * how.length
    size = np.minimum(sizes[doc] - start, how.length)
    at = (np.cumsum(sizes) - sizes)[doc] + start
    rows = best_fit(size, how.length)
    narrow = np.uint16 if how.length <= 1 << 16 else np.uint32
    for low in range(0, len(rows), 512):
        chunk = rows[low: low + 512]
        matrix = np.full((len(chunk), how.length), how.end_id, dtype=stream.dtype)
        places = np.zeros((len(chunk), how.length), dtype=narrow)
        ramp = np.arange(how.length, dtype=narrow)
        bounds = []
        for r, members in enumerate(chunk):
            edge, edges = 0, [0]
            for p in members:
                n = int(size[p])
                matrix[r, edge: edge + n] = stream[at[p]: at[p] + n]
                places[r, edge: edge + n] = ramp[:n]
                edge += n
                edges.append(edge)
            bounds.append(np.array(edges, dtype=np.int32))
        members = [np.array(m) for m in chunk]
        flat = np.concatenate(members)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(first + low, first + low + len(chunk))), _binary(matrix), _binary(places),
             _lists(bounds), _lists(members, names.take(pa.array(doc[flat]))), _lists(members, pa.array(start[flat]))],
            names=["pack_id", "ids", "position_ids", "cu_seqlens", "doc_ids", "starts"])


def packed(docs: DataFrame, how: Packing = Packing(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The packed rows of ``docs``; see the module for their columns."""
    ship_code(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding = encoder(how.vocabulary)
        wide = np.uint16 if max(encoding.max_token_value, how.end_id) < 1 << 16 else np.uint32
        first = TaskContext.get().partitionId() << 33
        end = np.array([how.end_id], dtype=wide)
        ids: list[np.ndarray] = []
        names: list[pa.Array] = []
        held = 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal ids, names, held, first
            done = 0
            for out in pack(ids, pa.concat_arrays(names), how, first):
                done += out.num_rows
                yield out
            first += done
            ids, names, held = [], [], 0

        for batch in batches:
            taken = 0
            for i, text in enumerate(batch.column(1).to_pylist()):
                own = token_ids(text or "", how.vocabulary).astype(wide)
                ids.append(np.concatenate([own, end]))
                held += len(own) + 1
                if held >= how.buffer:
                    names.append(batch.column(0).slice(taken, i + 1 - taken))
                    taken = i + 1
                    yield from flush()
            if taken < batch.num_rows:
                names.append(batch.column(0).slice(taken))
        if ids:
            yield from flush()

    return docs.select(F.col(id_col).cast("bigint"), F.col(text_col)).mapInArrow(run, SCHEMA)


def unpacked(packs: DataFrame, how: Packing = Packing()) -> DataFrame:
    """(doc_id, text) of each packed document that has an id of its own: the way back, for checks and exports."""
    ship_code(packs.sparkSession)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width = np.uint16 if max(encoder(how.vocabulary).max_token_value, how.end_id) < 1 << 16 else np.uint32
        for batch in batches:
            out: tuple[list, list, list] = ([], [], [])
            for row in batch.to_pylist():
                ids = np.frombuffer(row["ids"], dtype=width)
                edges = row["cu_seqlens"]
                for doc, start, a, b in zip(row["doc_ids"], row["starts"], edges, edges[1:]):
                    for column, value in zip(out, (doc, start, ids[a:b].tobytes())):
                        column.append(value)
            yield pa.RecordBatch.from_arrays(
                [pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.binary())],
                names=["doc_id", "start", "piece"])

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding = encoder(how.vocabulary)
        width = np.uint16 if max(encoding.max_token_value, how.end_id) < 1 << 16 else np.uint32
        for batch in batches:
            texts = [encoding.decode(np.frombuffer(b"".join(p["piece"] for p in pieces), dtype=width)[:-1].tolist())
                     for pieces in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    pieces = packs.select("ids", "cu_seqlens", "doc_ids", "starts").mapInArrow(
        cut, "doc_id bigint, start bigint, piece binary")
    whole = pieces.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("start", "piece"))).alias("pieces"))
    return whole.mapInArrow(decode, "doc_id bigint, text string")
