import math
from fractions import Fraction

import numpy as np
import pytest
from conftest import SF_DIR

from almanac.llm import whitening as w
from almanac.llm.queries import queries


def grid_of(rows):
    """Rows that remain, ``(id, x)``."""
    fine = [
        (i, v) for i, v in rows
        if v is not None and all(c is not None and math.isfinite(c) and abs(c * 256) < 2**62 for c in v)
    ]
    width = max((len(v) for _, v in rows if v is not None), default=0)
    return [(i, [math.floor(256 * c) for c in v] + [0] * (width - len(v))) for i, v in fine]


def brute_force(rows, k=4):
    """By exact fractions and one plain eigenvalue routine in double precision."""
    remain = grid_of(rows)
    fit = sorted({tuple(x) for _, x in remain})
    n = len(fit)
    if not n or not fit[0]:
        return []
    sums = [sum(c) for c in zip(*fit, strict=True)]
    centred = [[Fraction(n * a - s, n) for a, s in zip(x, sums, strict=True)] for x in fit]
    d = len(sums)
    v = np.array([[float(sum(r[i] * r[j] for r in centred) / n) for j in range(d)] for i in range(d)])
    values, vectors = np.linalg.eigh(v)
    values, vectors = values[::-1], vectors[:, ::-1]
    out = []
    for i, x in remain:
        own = np.array([float(Fraction(n * a - s, n)) for a, s in zip(x, sums, strict=True)])
        deviation = sum((n * a - s) ** 2 for a, s in zip(x, sums, strict=True))
        for c in range(min(k, d)):
            if values[c] > np.trace(v) * d * 2.0**-52:
                out.append((i, c + 1, n, deviation if deviation < 2**63 else None,
                            own @ vectors[:, c] / math.sqrt(values[c]), values[c] / np.trace(v)))
    return out


def check(df, rows, tolerance=1e-9):
    got, expected = df.collect(), brute_force(rows)
    key = lambda r: (r[0] is None, r[0] or 0, r[1], abs(r[4]))
    got, expected = sorted(map(tuple, got), key=key), sorted(expected, key=key)
    assert [r[:4] for r in got] == [r[:4] for r in expected]
    for c in {r[1] for r in expected}:
        a = np.array([r[4] for r in got if r[1] == c])
        b = np.array([r[4] for r in expected if r[1] == c])
        assert min(np.abs(a - b).max(), np.abs(a + b).max()) < tolerance
    assert all(abs(a[5] - b[5]) <= 1e-9 * b[5] for a, b in zip(got, expected, strict=True))
    assert all(r[6] < 1e-9 for r in got)
    return got


def frame(spark, rows):
    return spark.createDataFrame(
        [(i, v, 1, "x", "x", "x") for i, v in rows],
        "vec_id long, embedding array<double>, label int, x string, v string, n string",
    )


def test_vectors_of_all_kinds(spark):
    draw = np.random.default_rng(2)
    rows = [(i, (draw.normal(size=5) * [3, 2, 1, 0.5, 0.2]).tolist()) for i in range(60)]
    rows += [(5, rows[5][1]), (None, rows[6][1]), (100, rows[7][1]), (101, None), (102, []), (103, [1.0]),
             (104, [1.0, None, 2.0, 3.0, 4.0]), (105, [float("nan")] * 5), (106, [float("inf")] * 5),
             (107, [1e300] * 5), (108, [0.0] * 5), (109, [-0.0, -1e-9, 1e-9, 0.0, 0.0])]
    df = frame(spark, rows)
    check(w.whiten(df, w.fit(df)), rows)


def test_too_few_to_whiten(spark):
    for rows in ([], [(1, None)], [(1, [])], [(1, [2.0, 3.0]), (2, [2.0, 3.0])]):
        df = frame(spark, rows)
        out = w.whiten(df, w.fit(df))
        assert out.count() == 0 and out.columns == [
            "vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    rows = [(1, [2.0, 3.0]), (2, [2.5, 3.0]), (3, [9.0, 3.0])]  # one dimension does not vary
    df = frame(spark, rows)
    assert {r[1] for r in check(w.whiten(df, w.fit(df)), rows)} == {1}


def test_exact_where_longs_overflow(spark):
    draw = np.random.default_rng(4)
    rows = [(i, (draw.normal(size=3) * 1e4).tolist()) for i in range(30)]
    rows += [(98, [1e9, 0.0, 0.0]), (99, [-1e9, 0.0, 0.0])]
    df = frame(spark, rows)
    got = check(w.whiten(df, w.fit(df)), rows)
    assert any(r[3] is None for r in got) and any(r[3] is not None for r in got)


def test_exact_sums():
    draw = np.random.default_rng(1)
    for most in (100, 1 << 25, 1 << 40, 1 << 55):
        a = draw.integers(-most, most, (50, 3))
        rows = [[int(x) for x in r] for r in a]
        assert w.exact_sums(a).tolist() == [sum(c) for c in zip(*rows, strict=True)]
        products = [[sum(r[i] * r[j] for r in rows) for j in range(3)] for i in range(3)]
        assert w.exact_products(a, a).tolist() == products


def _with_values(values, seed):
    """A symmetric matrix in extended precision with nearly these eigenvalues."""
    d = len(values)
    q = np.linalg.qr(np.random.default_rng(seed).normal(size=(d, d)))[0].astype(np.longdouble)
    for _ in range(4):  # orthogonal to extended precision
        q = q @ (3 * np.eye(d, dtype=np.longdouble) - q.T @ q) / 2
    a = (q * np.array(values, np.longdouble)) @ q.T
    return (a + a.T) / 2, q


@pytest.mark.parametrize(
    "values",
    [
        np.arange(1, 41.0), 10.0 ** np.arange(-8, 12), [5, 5 + 1e-7, 5 - 1e-7, 3, 2, 1],
        [1, 1 + 1e-9, 1 + 2e-9, 1 - 1e-9, 7, 7 + 1e-8, 0.5], [2] * 6 + [1] * 6, [3, 1 + 1e-12, 1, 1 - 1e-12, 0],
    ],
)
def test_eigenvectors_in_extended_precision(values):
    a, q = _with_values(values, len(values))
    found, x = w.eigen(a)
    size = np.abs(a).max()
    assert np.abs(a @ x - x * found).max() < 1e-16 * size * len(values)
    assert np.abs(x.T @ x - np.eye(len(values))).max() < 1e-16
    order = np.argsort(-np.array(values), kind="stable")
    assert np.abs(found - np.array(values, np.longdouble)[order]).max() < 1e-16 * size * len(values)
    for k, j in enumerate(order):  # simple eigenvalues: the vector itself
        gap = min((abs(values[j] - values[i]) for i in range(len(values)) if i != j), default=1)
        if gap > 1e-9 * size:
            away = np.minimum(np.abs(x[:, k] - q[:, j]).max(), np.abs(x[:, k] + q[:, j]).max())
            assert away < 1e-18 * len(values) * float(size / gap)


def test_float32_alone_would_not_do():
    """The correction is what gives the digits."""
    values = [5, 5 + 1e-5, 3, 2, 1]
    a, q = _with_values(values, 1)
    rough = np.linalg.eigh(a.astype(np.float32))[1][:, ::-1]
    fine = w.eigen(a)[1]
    away = lambda x: min(np.abs(x[:, 0] - q[:, 1]).max(), np.abs(x[:, 0] + q[:, 1]).max())
    assert away(rough) > 1e-4 and away(fine) < 1e-12


def test_query_equals_brute_force(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF_DIR}/embeddings.parquet").select("vec_id", "embedding").collect()]
    check(queries()["op13_whitening"](spark, SF_DIR), rows)
