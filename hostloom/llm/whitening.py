"""Whitening of embeddings on leading eigenvectors found by spectrum slicing.

Two passes over the vectors give their sums and the covariance of the centred
vectors. Its eigenvalues are isolated without computing the others: by Sylvester's
law the negative pivots of an LDL^T factorisation of ``V - s I`` count the
eigenvalues below ``s``, and bisection on ``s`` parts the i-th eigenvalue from its
neighbours. Rayleigh quotient iteration converges to it cubically, and counts just
above and below certify that it is the i-th. Eigenvalues closer to each other than
rounding are one group; their vectors are made orthogonal.

Entries become integers ``floor(1024 c) + 100000`` first, so sums and deviations
are exact. Null vectors and those with null or non-finite entries are left out;
vectors shorter than the longest one continue with zeros. Entries beyond 2^42 count
as that. Equal vectors and repeated ids stay rows of their own. Without vectors, or
with a single one, there is no component and no row. Directions whose variance is
below 10^-11 of the whole are no components, since nothing can be scaled to one there.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hostloom.llm.common import settle, ship_code

SCALE, SHIFT = 1024, 100_000
_LARGEST = 2.0 ** 42
# variances below this share of the trace are rounding
_NOISE = 1e-11


# --- eigenvalues by counting -------------------------------------------------


def eigenvalues_below(matrix: np.ndarray, shift: float) -> int:
    """Number of eigenvalues below ``shift``: negative pivots of L D L^T = matrix - shift I.

    Symmetric pivoting by Bunch and Kaufman with blocks of one or two rows, which is
    stable for any shift. A block of two always has one eigenvalue on each side.
    """
    a = matrix - shift * np.eye(len(matrix))
    alpha, size, k, below = (1 + 17 ** 0.5) / 8, len(a), 0, 0

    def swap(i: int, j: int) -> None:
        if i != j:
            a[[i, j]] = a[[j, i]]
            a[:, [i, j]] = a[:, [j, i]]

    while k < size:
        column = np.abs(a[k + 1:, k])
        top = column.max(initial=0.0)
        block = 1
        if abs(a[k, k]) < alpha * top:
            r = k + 1 + int(column.argmax())
            row = np.abs(a[r, k:])
            row[r - k] = 0
            wide = row.max()
            if abs(a[k, k]) * wide < alpha * top * top:
                if abs(a[r, r]) >= alpha * wide:
                    swap(k, r)
                else:
                    swap(k + 1, r)
                    block = 2
        rest = a[k + block:, k:k + block]
        pivot = a[k:k + block, k:k + block]
        if block == 2:
            below += 1
            a[k + 2:, k + 2:] -= rest @ np.linalg.solve(pivot, rest.T)
        elif pivot[0, 0]:
            below += pivot[0, 0] < 0
            a[k + 1:, k + 1:] -= rest * (rest.T / pivot[0, 0])
        k += block
    return int(below)


@dataclass
class Component:
    """An eigenvalue, its unit vector and whether counts above and below certify its number."""

    value: float
    vector: np.ndarray
    certified: bool


def _refined(matrix: np.ndarray, start: float, found: list[np.ndarray], rng, norm: float) -> tuple[float, np.ndarray]:
    """Inverse iteration from a shift, then Rayleigh quotient iteration; orthogonal to ``found``."""
    size = len(matrix)
    basis = np.array(found).reshape(-1, size)
    eye, shift = np.eye(size), start
    vector = rng.standard_normal(size)
    best = (np.inf, 0.0, vector)
    for turn in range(40):
        try:
            vector = np.linalg.solve(matrix - shift * eye, vector)
        except np.linalg.LinAlgError:  # the shift is an eigenvalue to the last bit
            vector = np.linalg.solve(matrix - (shift + 4 * np.finfo(float).eps * norm) * eye, vector)
        for _ in range(2):
            vector = vector - basis.T @ (basis @ vector)
            vector = vector / np.linalg.norm(vector)
        value = float(vector @ matrix @ vector)
        residual = float(np.linalg.norm(matrix @ vector - value * vector))
        if residual < best[0]:
            best = (residual, value, vector)
        elif turn > 4:
            break
        if turn > 1:  # two steps with the fixed shift choose the eigenvalue, the rest converges
            shift = value
    return best[1], best[2]


def leading_components(matrix: np.ndarray, wanted: int, seed: int = 0) -> list[Component]:
    """The ``wanted`` largest eigenvalues above noise with their vectors, in falling order."""
    size = len(matrix)
    trace = float(np.trace(matrix))
    if not size or trace <= 0:
        return []
    matrix = (matrix + matrix.T) / 2
    norm = float(np.abs(matrix).sum(axis=1).max())
    rounding = 8 * size * np.finfo(float).eps * norm
    rng = np.random.default_rng(seed)
    counts = {0.0: size, norm * (1 + 1e-9) + rounding: 0}  # shift -> eigenvalues at or above it

    def above(shift: float) -> int:
        if shift not in counts:
            counts[shift] = size - eigenvalues_below(matrix, shift)
        return counts[shift]

    floor = max(_NOISE * trace, 2 * rounding)
    possible = min(wanted, above(floor))
    out: list[Component] = []
    while len(out) < possible:
        i = len(out) + 1  # the number of the next eigenvalue, from the top
        low = max(s for s, n in counts.items() if n >= i)
        high = min(s for s, n in counts.items() if n < i)
        # part it from its lower neighbours, then narrow until the iteration has one answer
        while True:
            alone = above(low) == i and above(high) == i - 1
            if alone:
                value, vector = _refined(matrix, (low + high) / 2, [c.vector for c in out], rng, norm)
                slack = rounding + 4 * float(np.linalg.norm(matrix @ vector - value * vector))
                if low - slack <= value <= high + slack and slack < 1e-9 * norm:
                    sure = above(value - slack) == i and above(value + slack) == i - 1
                    out.append(Component(value, vector, sure))
                    break
            if high - low <= 2 * rounding:  # a group of eigenvalues, equal up to rounding
                for _ in range(min(above(low), possible) - (i - 1)):
                    value, vector = _refined(matrix, (low + high) / 2 + rounding, [c.vector for c in out], rng, norm)
                    out.append(Component(value, vector, above(low - rounding) >= len(out) + 1
                                         and above(high + rounding) <= len(out)))
                break
            middle = (low + high) / 2
            if above(middle) >= i:
                low = middle
            else:
                high = middle
    out.sort(key=lambda c: -c.value)
    return out


# --- passes over the vectors ---------------------------------------------------


def usable(vectors: DataFrame, column: str = "embedding") -> DataFrame:
    """Rows whose vector is there and holds finite numbers only."""
    bad = F.exists(column, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    return vectors.filter(F.col(column).isNotNull() & ~bad)


def _integers(column: pa.ListArray, width: int) -> np.ndarray:
    """Vectors of a batch as rows of integers."""
    lengths = np.diff(column.offsets.to_numpy())
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    entries = np.zeros((len(lengths), width))
    entries[np.arange(width) < lengths[:, None]] = np.clip(values, -_LARGEST, _LARGEST)
    return np.floor(entries * SCALE).astype(np.int64) + SHIFT


def _batches(column: pa.ListArray, width: int, limit: int = 1 << 20) -> Iterator[tuple[int, np.ndarray]]:
    step = max(limit // max(width, 1), 1)
    for start in range(0, len(column), step):
        yield start, _integers(column.slice(start, step), width)


@dataclass
class Fit:
    """What the vectors' covariance says: count, sums, components and the trace."""

    count: int
    sums: np.ndarray
    components: list[Component]
    trace: float

    def centred(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Vectors less their mean, and the exact sums of squares of ``n x - S`` (-1 beyond 64 bits)."""
        base = self.sums // self.count
        scaled = (x - base) * self.count - (self.sums - base * self.count)
        near = (x - base).astype(np.float64) - (self.sums - base * self.count) / self.count
        fits = (near * near).sum(axis=1) * float(self.count) ** 2 < 9.2e18
        squares = np.where(fits[:, None], scaled, 0) ** 2
        return near, np.where(fits, squares.sum(axis=1), -1)

    def basis(self) -> np.ndarray:
        """Columns that take a centred vector to its whitened coordinates."""
        size = len(self.sums)
        return np.array([c.vector / np.sqrt(c.value) for c in self.components]).reshape(len(self.components), size).T


def _summed(parts: DataFrame) -> np.ndarray:
    """Add lists of numbers place by place; as many rows reach the driver as a list has places."""
    rows = parts.select(F.posexplode("v").alias("i", "x")).groupBy("i").agg(F.sum("x").alias("x")).collect()
    out = np.zeros(len(rows), np.int64 if parts.schema["v"].dataType.elementType.typeName() == "long" else np.float64)
    for row in rows:
        out[row.i] = row.x
    return out


def fitted(vectors: DataFrame, components: int = 8, column: str = "embedding") -> Fit:
    """Fit on all usable vectors. The driver holds one covariance, dimension squared numbers."""
    ship_code(vectors.sparkSession)
    rows = usable(vectors, column).select(F.col(column).alias("v"))
    shape = rows.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("v")).alias("width")).first()
    width = shape.width or 0
    if not shape.n or not width:
        return Fit(shape.n, np.zeros(width, np.int64), [], 0.0)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(width, np.int64)
        for batch in batches:
            for _, x in _batches(batch.column("v"), width):
                total += x.sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array([total.tolist()], pa.list_(pa.int64()))], ["v"])

    out = Fit(shape.n, _summed(rows.mapInArrow(sums, "v array<bigint>")), [], 0.0)
    upper = np.triu_indices(width)

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width, width))
        for batch in batches:
            for _, x in _batches(batch.column("v"), width):
                near, _ = out.centred(x)
                total += near.T @ near
        yield pa.RecordBatch.from_arrays([pa.array([total[upper]], pa.list_(pa.float64()))], ["v"])

    covariance = np.zeros((width, width))
    covariance[upper] = _summed(rows.mapInArrow(products, "v array<double>")) / out.count
    covariance = np.triu(covariance) + np.triu(covariance, 1).T
    return Fit(out.count, out.sums, leading_components(covariance, components), float(np.trace(covariance)))


def whitened(vectors: DataFrame, fit: Fit, id_column: str = "vec_id", column: str = "embedding") -> DataFrame:
    """One row per usable vector: its id, ``deviation`` (null beyond 64 bits) and ``whitened``, an array."""
    ship_code(vectors.sparkSession)
    rows = usable(vectors, column).select(id_column, F.col(column).alias("v"))
    width, basis, kind = len(fit.sums), fit.basis(), vectors.schema[id_column].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, x in _batches(batch.column("v"), width):
                near, deviation = fit.centred(x)
                lists = pa.array(list(near @ basis), pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(id_column).slice(start, len(x)), pa.array(deviation, mask=deviation < 0), lists],
                    [id_column, "deviation", "whitened"])

    return rows.mapInArrow(run, f"`{id_column}` {kind}, deviation bigint, whitened array<double>")


def identity_error(rows: DataFrame, size: int, column: str = "whitened") -> float | None:
    """Largest entry of the whitened rows' covariance less the identity."""
    if not size:
        return None
    mean = rows.agg(*[F.avg(F.col(column)[i]).alias(f"m{i}") for i in range(size)]).first()
    if mean[0] is None:
        return None

    def near(i: int) -> Column:
        return F.col(column)[i] - mean[i]

    pairs = [(i, j) for i in range(size) for j in range(i, size)]
    found = rows.agg(*[F.avg(near(i) * near(j)) for i, j in pairs]).first()
    return max(abs(c - (i == j)) for c, (i, j) in zip(found, pairs))


def components_of(vectors: DataFrame, components: int = 8, id_column: str = "vec_id",
                  column: str = "embedding") -> DataFrame:
    """One row per usable vector and component, numbered from 1.

    ``n`` counts the vectors of the fit, ``explained`` is the component's share of the
    variance and ``identity_error`` how far the covariance of the result is from the identity.
    """
    fit = fitted(vectors, components, column)
    rows = settle(whitened(vectors, fit, id_column, column), "whitened")
    error = identity_error(rows, len(fit.components))
    share = F.array(*[F.lit(c.value / fit.trace) for c in fit.components]).cast("array<double>")
    out = rows.select(id_column, "deviation", F.posexplode("whitened").alias("at", "whitened"))
    return out.select(
        id_column, (F.col("at") + 1).cast("int").alias("component"), F.lit(fit.count).cast("bigint").alias("n"),
        "deviation", "whitened", share[F.col("at")].alias("explained"),
        F.lit(error).cast("double").alias("identity_error"))
