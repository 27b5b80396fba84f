"""Fill-in-the-middle by cuts found with rank queries on a wavelet matrix.

Each code point belongs to a class that says what ends with it: a line, a word, a
sentence, or several of these. A wavelet matrix over the classes of many texts at
once answers how many code points of a class stand before a position; ranks of the
classes that end a unit add up to the number of units, and bisection on that sum
finds the cut behind the k-th unit. Which units are cut follows from a hash of the
document's id, so it depends on nothing else.

A null text counts as empty. Empty texts and texts that hold a marker stay plain. A
null id is hashed as an empty one; rows with one id get the same draws. Texts are
worked on in groups of about ``SLICE`` code points, a longer text by itself; memory
is some 12 bytes for each of these. A column of ``docs`` with the name of a result
column gives way to the result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hostloom.llm.common import ship_code, slices

SLICE = 1 << 20

PLAIN, PSM, SPM = "plain", "psm", "spm"
LINE, WORD, SENTENCE = 1, 2, 4
UNITS = {"line": LINE, "word": WORD, "sentence": SENTENCE}

RESULT = T.StructType([
    T.StructField("n", T.LongType()), T.StructField("form", T.StringType()),
    T.StructField("prefix_chars", T.LongType()), T.StructField("middle_chars", T.LongType()),
    T.StructField("output", T.StringType()),
])


@dataclass(frozen=True)
class Infilling:
    """What to cut and how to write it.

    ``unit`` is ``line``, ``word`` or ``sentence``; ``rate`` percent of the documents are
    transformed, ``spm`` percent of these with the suffix first. The markers must be
    three different texts that cannot overlap each other.
    """

    unit: str = "line"
    seed: int = 7
    rate: int = 100
    spm: int = 50
    prefix: str = "<P>"
    suffix: str = "<S>"
    middle: str = "<M>"

    def __post_init__(self):
        if self.unit not in UNITS:
            raise ValueError(f"unit is one of {', '.join(UNITS)}")
        marks = (self.prefix, self.suffix, self.middle)
        for a in marks:
            for b in marks:
                if not a or any(a[-k:] == b[:k] for k in range(1, min(len(a), len(b)))):
                    raise ValueError("markers must not be empty or overlap")
        if len(set(marks)) < 3 or any(a != b and a in b for a in marks for b in marks):
            raise ValueError("markers must not hold each other")


# --- classes and ranks -------------------------------------------------------

_BLANK = np.zeros(0x3001, bool)
_BLANK[[0x20, 0x85, 0xA0, 0x1680, 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]] = True
_BLANK[0x09:0x0E] = True
_BLANK[0x2000:0x200B] = True
_STOPS = np.array([ord(c) for c in ".!?。！？"], np.uint32)


def char_classes(codes: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """What ends with each code point, as a sum of LINE, WORD and SENTENCE; ``starts`` are the texts' first places."""
    blank = (codes < len(_BLANK)) & _BLANK[np.minimum(codes, len(_BLANK) - 1)]
    word_end = ~blank
    last = np.zeros(len(codes) + 1, bool)
    last[starts] = True
    last[-1] = True
    word_end[:-1] &= blank[1:] | last[1:-1]
    sentence_end = word_end & np.isin(codes, _STOPS)
    return ((codes == 10) * LINE + word_end * WORD + sentence_end * SENTENCE).astype(np.uint8)


_ONES = np.array([bin(i).count("1") for i in range(256)], np.uint8)
_UPTO = np.array([(0xFF00 >> k) & 0xFF for k in range(8)], np.uint8)


class WaveletMatrix:
    """Rank queries over small symbols: one bit vector with counts per byte for each bit of the symbols."""

    def __init__(self, symbols: np.ndarray, bits: int = 3):
        self.bits = bits
        self.present = np.flatnonzero(np.bincount(symbols, minlength=1 << bits)).tolist()
        self.levels = []
        for level in reversed(range(bits)):
            bit = (symbols >> level) & 1
            packed = np.append(np.packbits(bit), np.uint8(0))
            counts = np.zeros(len(packed), np.int64)
            np.cumsum(_ONES[packed[:-1]], dtype=np.int64, out=counts[1:])
            ones = bit.astype(bool)
            zeros = symbols[~ones]
            self.levels.append((packed, counts, len(zeros)))
            symbols = np.concatenate((zeros, symbols[ones]))
        # where the run of each symbol begins in the last order
        self.begin = {c: self._down(c, np.zeros(1, np.int64))[0] for c in self.present}

    def _down(self, symbol: int, at: np.ndarray) -> np.ndarray:
        for level, (packed, counts, zeros) in enumerate(self.levels):
            byte = at >> 3
            ones = counts[byte] + _ONES[packed[byte] & _UPTO[at & 7]]
            at = zeros + ones if (symbol >> (self.bits - 1 - level)) & 1 else at - ones
        return at

    def rank(self, symbol: int, at: np.ndarray) -> np.ndarray:
        """How often ``symbol`` stands before each place."""
        return self._down(symbol, at) - self.begin[symbol] if symbol in self.begin else np.zeros(len(at), np.int64)


class Boundaries:
    """Units of many texts set one behind the other."""

    def __init__(self, codes: np.ndarray, lengths: np.ndarray, flag: int):
        self.ends = np.cumsum(lengths)
        self.starts = self.ends - lengths
        classes = char_classes(codes, self.starts)
        self.matrix = WaveletMatrix(classes)
        self.ending = [c for c in self.matrix.present if c & flag]
        self.before = self.ended(self.starts)
        self.closed = self.ended(self.ends) - self.before
        # a text that does not end with a unit's end has one unit more
        shown = lengths > 0
        open_end = np.zeros(len(lengths), bool)
        open_end[shown] = (classes[self.ends[shown] - 1] & flag) == 0
        self.units = self.closed + open_end

    def ended(self, at: np.ndarray) -> np.ndarray:
        """Units ended before each place, over all texts."""
        return sum((self.matrix.rank(c, at) for c in self.ending), np.zeros(len(at), np.int64))

    def cut(self, units: np.ndarray) -> np.ndarray:
        """Code points of each text in its first ``units`` units."""
        low, high = self.starts.copy(), self.ends.copy()
        wanted = self.before + units
        while (open_ := low < high).any():
            mid = (low + high) >> 1
            reached = self.ended(mid) >= wanted
            high = np.where(open_ & reached, mid, high)
            low = np.where(open_ & ~reached, mid + 1, low)
        return low - self.starts


# --- the operator ------------------------------------------------------------


def draws(seed: int, doc_id: int | None) -> list[int]:
    """Four numbers of 32 bits from the seed and a document's id."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return [int(digest[i:i + 8], 16) for i in range(0, 32, 8)]


def _transformed(ids: list, texts: list[str], how: Infilling) -> Iterator[tuple]:
    lengths = np.array([len(t) for t in texts], np.int64)
    codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), "<u4")
    found = Boundaries(codes, lengths, UNITS[how.unit])
    drawn = np.array([draws(how.seed, i) for i in ids], np.int64).reshape(-1, 4)
    ends = drawn[:, :2] % (found.units + 1)[:, None]
    first, second = found.cut(ends.min(axis=1)), found.cut(ends.max(axis=1))
    for text, n, a, b, (_, _, h3, h4) in zip(texts, found.units.tolist(), first.tolist(), second.tolist(),
                                             drawn.tolist()):
        marked = how.prefix in text or how.suffix in text or how.middle in text
        if not text or marked or h3 % 100 >= how.rate:
            yield n, PLAIN, None, None, text
        elif h4 % 100 < how.spm:
            yield n, SPM, a, b - a, f"{how.suffix}{text[b:]}{how.prefix}{text[:a]}{how.middle}{text[a:b]}"
        else:
            yield n, PSM, a, b - a, f"{how.prefix}{text[:a]}{how.suffix}{text[b:]}{how.middle}{text[a:b]}"


def infilled(docs: DataFrame, how: Infilling = Infilling()) -> DataFrame:
    """Documents with ``n`` units, ``form``, ``prefix_chars``, ``middle_chars`` and the ``output`` text.

    Prefix and middle are counted in code points and null in the form ``plain``, whose
    output is the text.
    """
    ship_code(docs.sparkSession)
    kept = [f for f in docs.schema if f.name not in RESULT.names]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            ids = batch.column("doc_id").to_pylist()
            for start, end in slices(texts, SLICE):
                rows = list(zip(*_transformed(ids[start:end], texts[start:end], how)))
                new = [pa.array(v, t) for v, t in zip(rows, (pa.int64(), pa.string(), pa.int64(), pa.int64(),
                                                             pa.string()))]
                part = batch.slice(start, end - start)
                yield pa.RecordBatch.from_arrays([part.column(f.name) for f in kept] + new,
                                                 [f.name for f in kept] + RESULT.names)

    return docs.mapInArrow(run, T.StructType([*kept, *RESULT.fields]))


def rebuilt(output: Column, form: Column, how: Infilling = Infilling()) -> Column:
    """The text again, from output and form alone; each marker stands once in it."""
    def between(left: str, right: str) -> Column:
        return F.substring_index(F.substring_index(output, right, 1), left, -1)

    middle = F.substring_index(output, how.middle, -1)
    psm = F.concat(between(how.prefix, how.suffix), middle, between(how.suffix, how.middle))
    spm = F.concat(between(how.prefix, how.middle), middle, between(how.suffix, how.prefix))
    return F.when(form == PSM, psm).when(form == SPM, spm).otherwise(output)
