"""Whitening against numpy on integers."""

import random
from decimal import Decimal

import numpy as np
import pytest

from foliant.llm import common, whitening

SF = "/root/testdata/sf0.01"


def plain(x, k=16):
    """Exact deviations and a decomposition of the covariance of the distinct rows of x, integers."""
    fit = np.unique(x, axis=0)
    n, sums = len(fit), [int(s) for s in fit.sum(0, dtype=object)]
    centred = np.array([[float(n * int(a) - s) / n for a, s in zip(row, sums)] for row in fit])
    e, v = np.linalg.eigh(centred.T @ centred / n)
    order = np.argsort(-e)
    e, v = e[order], v[:, order]
    k = min(k, int((e > e[0] * len(e) * np.finfo(float).eps).sum()))
    rows = np.array([[float(n * int(a) - s) / n for a, s in zip(row, sums)] for row in x])
    deviation = [sum((n * int(a) - s) ** 2 for a, s in zip(row, sums)) for row in x]
    return n, deviation, rows @ v[:, :k] / np.sqrt(e[:k]), e[:k] / e.sum()


def held(df):
    return {r.vec_id: (int(r.deviation), np.array(r.whitened)) for r in df.collect()}


def close(got, want):
    """Equal up to the sign of each component."""
    sign = np.sign((got * want).sum(0))
    return np.allclose(got * sign, want, rtol=1e-8, atol=1e-8)


def test_query_equals_numpy(spark):
    rows = common.table(spark, SF, "embeddings").orderBy("vec_id").collect()
    x = np.array([[int(np.floor(64 * float(c))) + 1_000_000 for c in r.embedding] for r in rows])
    n, deviation, w, explained = plain(x)
    got = whitening.query(spark, SF).toPandas().sort_values(["vec_id", "component"])
    assert list(got.columns) == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    assert len(got) == 16 * len(rows) and set(got.n) == {n} and got.component.tolist() == list(range(1, 17)) * len(rows)
    assert got.deviation.tolist() == [d for d in deviation for _ in range(16)]
    assert close(got.whitened.to_numpy().reshape(-1, 16), w)
    assert np.allclose(got.explained.to_numpy().reshape(-1, 16), explained, rtol=1e-9) and got.identity_error.nunique() == 1 and got.identity_error[0] < 1e-9


def test_odd_rows(spark):
    random.seed(13)
    good = [(i, [random.gauss(0, 1), random.gauss(3, 2), random.gauss(-1, 0.3), 7.0]) for i in range(60)]
    rows = good + [(100, good[0][1]), (100, good[1][1]), (None, good[2][1])]
    bad = [(200, None), (201, [1.0, None, 1.0, 1.0]), (202, [float("nan"), 1.0, 1.0, 1.0]), (203, [float("inf"), 1.0, 1.0, 1.0]), (204, []), (205, [1.0]), (206, [1e300, 0.0, 0.0, 0.0])]
    vectors = spark.createDataFrame([(*r, "x", 1) for r in rows + bad], "vec_id long, embedding array<double>, x string, deviation int").repartition(5)
    found, made = whitening.whiten(vectors, k=16)
    got = found.collect()
    assert len(got) == len(rows) and sum(r.vec_id == 100 for r in got) == 2 and sum(r.vec_id is None for r in got) == 1
    x = np.array([[int(np.floor(64 * c)) + 1_000_000 for c in v] for _, v in rows])
    n, deviation, w, explained = plain(x)
    assert made.n == n == 60 and len(made.eigenvalues) == 3  # the constant dimension has no component
    assert sorted(int(r.deviation) for r in got) == sorted(deviation)
    by = {(r.vec_id, int(r.deviation)): r.whitened for r in got}
    assert close(np.array([by[i, d] for (i, _), d in zip(rows, deviation)]), w)
    assert np.allclose(made.eigenvalues / made.total, explained, rtol=1e-9) and made.identity_error < 1e-9


@pytest.mark.parametrize("rows", [[], [(1, None)], [(1, [2.0, 3.0]), (2, [2.0, 3.0])], [(1, [])]])
def test_nothing_to_whiten(spark, rows):
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    found, made = whitening.whiten(vectors)
    assert made is None and found.count() == 0


def test_large_entries_stay_exact(spark):
    rows = [(i, [float(2**40 + i * i), float(-i), float(i % 3)]) for i in range(50)]
    found, made = whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), k=2)
    x = np.array([[int(np.floor(64 * c)) + 1_000_000 for c in v] for _, v in rows])
    n, deviation, w, _ = plain(x, 2)
    got = held(found)
    assert [got[i][0] for i, _ in rows] == deviation and close(np.array([got[i][1] for i, _ in rows]), w)
    assert whitening._deviations(np.array([[2**52, 1]]), 10**6, [5, 10**6])[0].tolist() == [10**6 * 2**52 - 5, 0]
    assert isinstance(found.head().deviation, Decimal)
