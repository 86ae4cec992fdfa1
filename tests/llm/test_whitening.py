from fractions import Fraction

import numpy as np
import pytest

from buildtrail.llm import whitening as wh

SCHEMA = "vec_id long, embedding array<float>, n int, whitened string, v int"


def frame(spark, vectors):
    return spark.createDataFrame([(i, v, 1, "x", 2) for i, v in vectors], SCHEMA).repartition(3)


def sample(seed=1, n=300, dim=6):
    r = np.random.default_rng(seed)
    x = (r.normal(size=(n, dim)) * np.array([3, 1, 1, 0.5, 0.2, 0.05])[:dim]) @ r.normal(size=(dim, dim))
    return [(i, [float(np.float32(c)) for c in row]) for i, row in enumerate(x)]


def by_fractions(vectors):
    """n, S and the scatter n^2 V by definition."""
    x = [[int(np.floor(64 * c)) + 1000000 for c in v] for v in vectors]
    n, d = len(x), len(x[0])
    s = [sum(r[j] for r in x) for j in range(d)]
    v = [[sum((Fraction(r[i]) - Fraction(s[i], n)) * (Fraction(r[j]) - Fraction(s[j], n)) for r in x) / n for j in range(d)] for i in range(d)]
    return n, s, x, np.array(v, object)


def check(spark, vectors, most=32):
    usable = [(i, v) for i, v in vectors if v is not None and all(c is not None and np.isfinite(c) for c in v)]
    n, s, x, v = by_fractions([u[1] for u in usable])
    model = wh.fit(frame(spark, vectors), most=most)
    assert model.n == n
    e, u = np.linalg.eigh(v.astype(float))
    e, u = e[::-1], u[:, ::-1]
    k = len(model.roots)
    np.testing.assert_allclose(model.roots / n**2, e[:k], rtol=1e-9)
    np.testing.assert_allclose(model.explained, e[:k] / float(sum(v.diagonal())), rtol=1e-9)
    # a null space by definition: V u = e u, unit and orthogonal
    assert np.abs(v.astype(float) @ model.basis - model.basis * (model.roots / n**2)).max() < 1e-11 * e[0]
    assert np.abs(model.basis.T @ model.basis - np.eye(k)).max() < 1e-13
    assert model.identity_error < 1e-9
    got = wh.whiten(frame(spark, vectors), model, ["vec_id"]).collect()
    assert len(got) == len(usable)
    want = {}
    for (i, _), row in zip(usable, x, strict=True):
        want.setdefault(i, []).append((sum((n * a - b) ** 2 for a, b in zip(row, s, strict=True)), (np.array(row) - np.array(s, float) / n) @ model.basis / np.sqrt(e[:k])))
    for r in got:
        assert any(r["deviation"] == d and np.allclose(r["whitened"], w, atol=1e-6) for d, w in want[r["vec_id"]])
    return model


def test_against_fractions(spark):
    vectors = sample() + [(400, None), (401, [1.0] * 5 + [None]), (402, [float("nan")] * 6), (403, [float("inf")] + [0.0] * 5), (3, [9.0] * 6), (None, [0.0] * 6), (3, [9.0] * 6)]
    assert len(check(spark, vectors).roots) == 6
    assert len(check(spark, vectors, most=2).roots) == 2


def test_equal_roots_and_a_null_space(spark):
    cross = [[a if j == k else 0.0 for j in range(5)] for k in range(3) for a in (1.0, -1.0)]  # three equal roots, two of zero
    model = check(spark, list(enumerate(cross * 4)))
    assert len(model.roots) == 3 and len(set(model.roots)) == 1


def test_large_entries(spark):
    vectors = [(i, [float(c) * 2.0**30 for c in v]) for i, v in sample(2, 40, 4)]
    n, s, x, _ = by_fractions([v for _, v in vectors])
    model = wh.fit(frame(spark, vectors))
    assert model.identity_error < 1e-6
    off = [sum((n * a - b) ** 2 for a, b in zip(row, s, strict=True)) for row in x]
    got = {r["vec_id"]: r["deviation"] for r in wh.whiten(frame(spark, vectors), model, ["vec_id"]).collect()}
    assert all(got[i] == (d if d < 1 << 63 else None) for i, d in enumerate(off)) and any(d >= 1 << 63 for d in off)


def test_polynomial_is_exact(spark):
    r = np.random.default_rng(3)
    half = r.integers(-50, 50, (7, 5))
    m = np.array((half @ half.T).tolist(), object)  # rank 5 of 7
    c = wh.characteristic(spark, m)
    assert c[:2] == [0, 0] and c[7] == 1 and c[2] != 0
    for x in (-3, 0, 2, 11):
        a = [[Fraction((x if i == j else 0) - int(m[i, j])) for j in range(7)] for i in range(7)]
        det = Fraction(1)
        for k in range(7):
            p = next((i for i in range(k, 7) if a[i][k]), None)
            if p is None:
                det = Fraction(0)
                break
            if p != k:
                a[k], a[p], det = a[p], a[k], -det
            det *= a[k][k]
            for i in range(k + 1, 7):
                t = a[i][k] / a[k][k]
                a[i] = [y - t * z for y, z in zip(a[i], a[k], strict=True)]
        assert wh.value_at(c, x) == det


def test_roots_close_together():
    a, b = 10**12, 10**12 + 1
    c = [-a * b * 5, a * b + 5 * (a + b), -(a + b + 5), 1]  # (x - 5)(x - a)(x - b)
    f, cells = wh.isolate(c, 3)
    assert [wh.refine(c, f, low, high) for low, high, n in cells] == [b << f, a << f, 5 << f] and [x[2] for x in cells] == [1, 1, 1]


def test_products_of_parts():
    r = np.random.default_rng(4)
    for top in (5, 1 << 30, 1 << 56):
        y = r.integers(-top, top, (50, 3))
        assert (wh.products(y) == y.astype(object).T @ y.astype(object)).all()


@pytest.mark.parametrize("vectors", [[], [(1, None)], [(1, [])], [(1, [1.0, 2.0])], [(1, [1.0, 2.0]), (2, [1.0, 2.0])]])
def test_without_spread(spark, vectors):
    df = spark.createDataFrame([(i, v, 1, "x", 2) for i, v in vectors], SCHEMA)
    model = wh.fit(df)
    if model is not None:
        assert not len(model.roots) and all(r["whitened"] == [] and r["deviation"] == 0 for r in wh.whiten(df, model, ["vec_id"]).collect())


def test_query(spark):
    rows = wh.query(spark, "/root/testdata/sf0.001")
    assert rows.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    assert rows.count() == 32 * spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").count()
