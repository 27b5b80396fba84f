import numpy as np
import pytest
from pyspark.sql import functions as F

from hostloom.llm import queries
from hostloom.llm.whitening import components_of, eigenvalues_below, fitted, leading_components, usable

SCHEMA = "vec_id long, embedding array<float>, label int"


def symmetric(rng, values):
    q, _ = np.linalg.qr(rng.standard_normal((len(values), len(values))))
    return (q * np.asarray(values)) @ q.T


def integers(vectors):
    return [[int(np.floor(1024 * float(np.float32(c)))) + 100000 for c in v] for v in vectors]


def brute(rows):
    """Rows (vec_id, vector) -> numpy's answer: n, deviations, eigenvalues, vectors, centred vectors."""
    x = np.array(integers([v for _, v in rows]), dtype=object)
    n, sums = len(x), x.sum(axis=0)
    deviations = [int(sum((n * c - s) ** 2 for c, s in zip(v, sums))) for v in x]
    near = np.array([[float(n * c - s) / n for c, s in zip(v, sums)] for v in x])
    values, vectors = np.linalg.eigh(near.T @ near / n)
    return n, deviations, values[::-1], vectors[:, ::-1], near


@pytest.mark.parametrize("size", [1, 2, 5, 40])
def test_inertia_counts(size):
    rng = np.random.default_rng(size)
    a = rng.standard_normal((size, size))
    a = a + a.T
    np.fill_diagonal(a, 0)  # pivots of two rows are needed
    true = np.linalg.eigvalsh(a)
    for shift in [-100, 100, 0.123, *((true[1:] + true[:-1]) / 2)]:
        assert eigenvalues_below(a, shift) == (true < shift).sum()


@pytest.mark.parametrize("values", [
    np.linspace(1, 9, 30), [5.0] * 3 + [2.0] * 4 + [1e-3] * 10, [1.0] * 12, [1, 1 - 1e-9, 1 - 1e-13, 0.5, 0, 0, 0],
    [3.0], [1e12, 1e6, 1.0, 1e-3], np.random.default_rng(3).random(64) ** 5])
def test_leading_components_are_eigenvectors_in_order(values):
    values = np.asarray(values, float)
    matrix = symmetric(np.random.default_rng(4), values)
    found = leading_components(matrix, 8)
    want = np.sort(values)[::-1][:8]
    want = want[want > 1.1e-11 * values.sum()]
    assert len(found) == len(want)
    vectors = np.array([c.vector for c in found])
    assert np.allclose([c.value for c in found], want, rtol=1e-12, atol=1e-14 * want[0])
    assert np.abs(vectors @ vectors.T - np.eye(len(found))).max() < 1e-12
    assert np.abs(vectors @ matrix @ vectors.T - np.diag([c.value for c in found])).max() < 1e-13 * want[0]
    assert all(c.certified for c in found)


def test_no_components_without_variance():
    assert leading_components(np.zeros((3, 3)), 8) == []
    assert leading_components(np.zeros((0, 0)), 8) == []


def check(df, rows, size):
    n, deviations, values, vectors, near = brute(rows)
    got = df.collect()
    assert len(got) == len(rows) * size
    for i in range(1, size + 1):
        mine = sorted((r.vec_id, r.deviation, r.whitened) for r in got if r.component == i)
        axis = near @ vectors[:, i - 1] / np.sqrt(values[i - 1])
        want = sorted(zip([k for k, _ in rows], deviations, axis))
        sign = 1 if sum(a[2] * b[2] for a, b in zip(mine, want)) > 0 else -1
        for a, b in zip(mine, want):
            assert a[:2] == b[:2] and a[2] == pytest.approx(sign * b[2], abs=1e-8)
        share = pytest.approx(values[i - 1] / values.sum(), rel=1e-9)
        assert all(r.explained == share for r in got if r.component == i)
    assert {r.n for r in got} == {n}
    assert len({r.identity_error for r in got}) == 1 and got[0].identity_error < 1e-9


def test_rows_equal_numpy(spark):
    rng = np.random.default_rng(7)
    base = rng.standard_normal((300, 12)) * np.linspace(0.1, 2, 12)
    rows = [(i, [float(np.float32(c)) for c in v]) for i, v in enumerate(base)]
    bad = [(900, None, 1), (901, [float("nan")] * 12, 1), (902, [float("inf")] + [0.0] * 11, 1), (903, [None] + [0.0] * 11, 1)]
    df = spark.createDataFrame([(i, v, 0) for i, v in rows] + bad, SCHEMA).repartition(5)
    check(components_of(df), rows, 8)


def test_the_query_equals_numpy(spark, sf):
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding").collect()
    rows = [(r.vec_id, r.embedding) for r in rows if r.embedding is not None
            and all(c is not None and np.isfinite(c) for c in r.embedding)]
    check(queries.QUERIES["op13_embedding_whitening"](spark, sf), rows, 8)


def test_repeated_ids_null_ids_and_equal_vectors_stay(spark):
    rng = np.random.default_rng(1)
    rows = [(i % 5 or None, [float(c) for c in rng.random(3)], 0) for i in range(20)] + [(3, [0.5, 0.5, 0.5], 0)] * 4
    got = components_of(spark.createDataFrame(rows, SCHEMA))
    assert got.count() == 24 * 3
    assert got.filter(F.col("vec_id").isNull()).count() == 4 * 3


def test_fewer_directions_than_components(spark):
    rows = [(i, [float(i), 2.0 * i, 0.0, 7.0], 0) for i in range(10)]
    got = components_of(spark.createDataFrame(rows, SCHEMA)).collect()
    assert {r.component for r in got} == {1} and got[0].explained == pytest.approx(1)


@pytest.mark.parametrize("rows", [[], [(1, None, 0)], [(1, [], 0), (2, [], 0)], [(1, [0.5, 0.2], 0)], [(1, [0.5], 0)] * 3])
def test_tables_without_variance_have_no_rows(spark, rows):
    assert components_of(spark.createDataFrame(rows, SCHEMA)).collect() == []


def test_short_vectors_go_on_with_zeros(spark):
    rows = [(1, [1.0, 2.0], 0), (2, [3.0], 0), (3, [0.0, 1.0], 0)]
    full = [(1, [1.0, 2.0], 0), (2, [3.0, 0.0], 0), (3, [0.0, 1.0], 0)]
    a, b = (components_of(spark.createDataFrame(r, SCHEMA)).orderBy("vec_id", "component").collect() for r in (rows, full))
    assert [(r.vec_id, r.component, r.deviation, abs(r.whitened)) for r in a] == [
        (r.vec_id, r.component, r.deviation, pytest.approx(abs(r.whitened), abs=1e-9)) for r in b]


def test_huge_entries(spark):
    rows = [(1, [1e30, 1.0], 0), (2, [-1e30, 2.0], 0), (3, [0.0, 5.0], 0)]
    got = components_of(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()
    assert {r.deviation for r in got if r.vec_id != 3} == {None}
    assert all(np.isfinite(r.whitened) for r in got)


def test_unlucky_column_names(spark, sf):
    df = spark.read.parquet(f"{sf}/embeddings.parquet")
    for name in ("v", "i", "x", "whitened", "component", "deviation", "n", "at"):
        df = df.withColumn(name, F.lit("mine"))
    got = components_of(df, components=2)
    assert got.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    assert got.count() == 2 * usable(df).count()


def test_fit_is_certified(spark, sf):
    fit = fitted(spark.read.parquet(f"{sf}/embeddings.parquet"))
    assert len(fit.components) == 8 and all(c.certified for c in fit.components)
