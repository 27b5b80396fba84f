import numpy as np
import pytest

from hostloom.llm import vectors


def brute(rows, cosine=0.93):
    good = [i for i, (_, v, label) in enumerate(rows) if v is not None and label is not None and None not in v
            and np.isfinite(v).all() and any(v)]
    root, links = list(range(len(rows))), [0] * len(rows)

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for n, i in enumerate(good):
        for j in good[:n]:
            a, b = np.array(rows[i][1]), np.array(rows[j][1])
            if rows[i][2] == rows[j][2] and len(a) == len(b) and a @ b / np.linalg.norm(a) / np.linalg.norm(b) >= cosine:
                links[i] += 1
                links[j] += 1
                root[find(i)] = find(j)
    least = {}
    for i, (d, *_) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    out = []
    for i, (d, *_) in enumerate(rows):
        c = least.get(find(i))
        out.append((d, links[i], c, c is None or c == d))
    return sorted(out, key=repr)


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(3)
    base = rng.standard_normal((20, 16))
    out = []
    for i in range(400):
        v = base[rng.integers(20)] + rng.standard_normal(16) * rng.choice([0, 0.1, 0.25, 0.35])
        out.append((i, [float(x) for x in v], int(rng.integers(3))))
    one = out[0]
    return out + [(2000, None, 1), (2001, [0.0] * 16, 1), (2002, [1.0, float("nan")] + [0.0] * 14, 1),
                  (2003, [1.0, None] + [0.0] * 14, 1), (2004, one[1], None), (2005, one[1], one[2]), (2005, one[1], one[2]),
                  (None, one[1], one[2]), (None, [1.0] * 3, 2), (2006, [float("inf")] + [1.0] * 15, 0), (2007, [1.0, 2.0], 0),
                  (2008, [2.0, 4.0], 0), (2009, [], 0)]


@pytest.mark.parametrize("how", [vectors.Cells(), vectors.Cells(block=32, per_root=1.0)])
def test_equals_brute_force(spark, rows, how):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").selectExpr(
        "*", "label AS node", "label AS cell", "label AS v", "label AS copies")
    assert sorted(map(tuple, vectors.near_vectors(df, how).collect()), key=repr) == brute(rows)


def test_lengths_beyond_the_range_of_squares(spark):
    """Cosines of vectors whose squared components are zero or infinite as doubles."""
    rows = [(1, [1e-200, 1e-200], 1), (2, [1.0, 0.1], 1), (3, [1e200, 1e200], 1), (4, [2e200, 2.1e200], 1), (5, [3.0, 3.1], 1),
            (6, [5e-324, 0.0], 2), (7, [1e308, 1e300], 2), (8, [0.0, -1e308], 2)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = {r.vec_id: (r.n_links, r.component_id) for r in vectors.near_vectors(df).collect()}
    assert got == {1: (3, 1), 2: (0, 2), 3: (3, 1), 4: (3, 1), 5: (3, 1), 6: (1, 6), 7: (1, 6), 8: (0, 8)}


def test_empty_table(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert vectors.near_vectors(df).count() == 0
