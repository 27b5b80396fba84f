"""Words of texts as 64-bit hashes, computed over whole buffers with numpy.

A word is a run of bytes that are no separators, in the UTF-8 form of the text
with ``A-Z`` lower-cased. Its hash is a polynomial in an odd base modulo 2^64,
read off one running sum over the buffer, then mixed. Two different words get
the same hash with a chance of about 2^-64.
"""

from __future__ import annotations

import numpy as np

_U64 = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_SYMBOLS = np.random.default_rng(20240229).integers(1, 2**63, 256, dtype=np.uint64) * _U64(2) + _U64(1)

# separators of words: space, tab, line feed, vertical tab, form feed, carriage return
SPACES = np.zeros(256, dtype=bool)
SPACES[[0x20, *range(0x09, 0x0E)]] = True
# separators of bare words: all ASCII bytes but letters and digits
PUNCTUATION = np.array([b < 0x80 and not chr(b).isalnum() for b in range(256)])

_powers = {"up": np.ones(1, dtype=np.uint64), "down": np.ones(1, dtype=np.uint64)}


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers["up"]) < n:
        size = 1 << max(20, int(n - 1).bit_length())
        for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 2**64))):
            steps = np.full(size, base, dtype=np.uint64)
            steps[0] = 1
            _powers[name] = np.multiply.accumulate(steps)
    return _powers["up"], _powers["down"]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers whose every output bit depends on every input bit."""
    x = x ^ (x >> _U64(30))
    x = x * _U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U64(27))
    x = x * _U64(0x94D049BB133111EB)
    return x ^ (x >> _U64(31))


def word_hashes(texts: list[str | None], separators: np.ndarray = SPACES) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of ``texts`` in order, and the bounds of each text among them.

    Text ``i`` has the words ``hashes[bounds[i]:bounds[i + 1]]``; a null has none.
    """
    raw = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    ends = np.cumsum([len(r) + 1 for r in raw])
    buffer = np.frombuffer((b"\n".join(raw) + b"\n").lower(), dtype=np.uint8)
    inside = ~separators[buffer]
    edges = np.diff(inside.view(np.int8), prepend=0)
    starts, stops = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
    up, down = _power_tables(len(buffer) + 1)
    running = np.zeros(len(buffer) + 1, dtype=np.uint64)
    np.cumsum(_SYMBOLS[buffer] * up[: len(buffer)], out=running[1:])
    hashes = (running[stops] - running[starts]) * down[starts]
    bounds = np.concatenate([[0], np.searchsorted(starts, ends)])
    return mix(hashes + (stops - starts).astype(np.uint64)), bounds


def segment_ids(bounds: np.ndarray) -> np.ndarray:
    """For each word the index of its text."""
    return np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))


def sums_by_text(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sum of ``values`` within each text."""
    running = np.zeros(len(values) + 1, dtype=values.dtype)
    np.cumsum(values, out=running[1:])
    return running[bounds[1:]] - running[bounds[:-1]]


def bare_words(text: str | None) -> list[str]:
    """The words that ``word_hashes`` sees with ``PUNCTUATION``, as texts; for reports and models."""
    raw = (text or "").encode("utf-8", "surrogatepass").lower()
    table = bytes(0x20 if PUNCTUATION[b] else b for b in range(256))
    return [w.decode("utf-8", "replace") for w in raw.translate(table).split(b" ") if w]
