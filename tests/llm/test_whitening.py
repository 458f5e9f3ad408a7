"""Embedding whitening by spectrum slicing."""

import math
from fractions import Fraction

import numpy as np
import pytest

from viewlens.llm import whitening as wh

VECS = "vec_id long, embedding array<float>, label int"


def matrix(rng, values):
    q, _ = np.linalg.qr(rng.standard_normal((len(values), len(values))))
    return q @ np.diag(values) @ q.T


def test_inertia_counts_signs():
    rng = np.random.default_rng(1)
    for n in (1, 2, 3, 8, 40):
        for _ in range(10):
            values = rng.standard_normal(n)
            assert wh.inertia(matrix(rng, values)) == (int((values > 0).sum()), 0, int((values < 0).sum()))
    assert wh.inertia(np.array([[0.0, 1.0], [1.0, 0.0]])) == (1, 0, 1)  # no pivot on the diagonal
    assert wh.inertia(np.zeros((3, 3))) == (0, 3, 0) and wh.inertia(np.zeros((0, 0))) == (0, 0, 0)


@pytest.mark.parametrize("values", [
    [5, 4, 3, 2, 1], [1e6, 1e3, 1, 1e-3, 1e-6], [3, 3, 3, 1, 1], [2, 2, 2, 2, 2], [7, 7 - 1e-9, 7 - 2e-9, 1, 0.5], [1, 0, 0, 0, 0], [4]])
def test_pairs_equal_a_dense_solver(values):
    rng = np.random.default_rng(len(values))
    v = matrix(rng, np.array(values, float))
    found = wh.Slicer(v).pairs(len(values))
    e, q = np.array([x for x, _ in found]), np.array([x for _, x in found])
    scale = max(values)
    assert np.allclose(e, sorted(np.linalg.eigvalsh(v), reverse=True), rtol=0, atol=1e-12 * scale)
    assert np.allclose(q @ q.T, np.eye(len(values)), atol=1e-10)
    assert np.abs(v @ q.T - q.T * e).max() <= 1e-11 * scale


def test_counts_certify_and_iteration_is_short():
    """A spectrum as covariances have: few counts and solves for each pair,
    and no matrix of eigenvectors of the whole."""
    rng = np.random.default_rng(4)
    v = matrix(rng, np.geomspace(10, 0.1, 64))
    slicer, solves = wh.Slicer(v), []
    plain = slicer._solve
    slicer._solve = lambda s, x: solves.append(s) or plain(s, x)
    found = slicer.pairs(16)
    assert np.allclose([e for e, _ in found], np.geomspace(10, 0.1, 64)[:16], rtol=1e-12)
    assert len(solves) <= 16 * 12 and len(slicer.counted) <= 16 * 16
    for k, (e, _) in enumerate(found, 1):
        assert slicer.certified(k, e, 0.0) and not slicer.certified(k + 1, e, 0.0)


def brute(rows, components=16):
    """Rows that remain, fit list, and numpy's own eigenvectors."""
    left = [(i, v) for i, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    xs = [tuple(math.floor(64 * float(np.float32(c))) + 1000000 for c in v) for _, v in left]
    fit = sorted(set(xs))
    n, sums = len(fit), [sum(c) for c in zip(*fit)]
    a = np.array([[float(Fraction(n * c - s, n)) for c, s in zip(x, sums)] for x in fit])
    e, q = np.linalg.eigh(a.T @ a / n)
    e, q = e[::-1], q[:, ::-1]
    out = []
    for (i, _), x in zip(left, xs):
        dev = sum((n * c - s) ** 2 for c, s in zip(x, sums))
        own = np.array([float(Fraction(n * c - s, n)) for c, s in zip(x, sums)])
        for k in range(min(components, len(e))):
            if e[k] > 1e-9 * e[0]:
                out.append((i, k + 1, n, dev, own @ q[:, k] / math.sqrt(e[k]), e[k] / e.sum()))
    return out


def compare(spark, rows, parts=3):
    docs = spark.createDataFrame([(i, v, None) for i, v in rows], VECS).repartition(parts).selectExpr("*", "vec_id as n", "label as x")
    got = [tuple(r) for r in wh.whiten(docs).collect()]
    want = brute(rows)
    order = lambda r: (r[1], r[0] is None, r[0] or 0, r[3], abs(r[4]))
    got.sort(key=order)
    want.sort(key=order)
    assert [r[:4] for r in got] == [r[:4] for r in want]
    sign = {}
    for g, w in zip(got, want):
        if abs(w[4]) > 1e-6:
            sign.setdefault(g[1], math.copysign(1, g[4] * w[4]))
        assert math.isclose(g[4], sign.get(g[1], 1) * w[4], rel_tol=1e-7, abs_tol=1e-7)
        assert math.isclose(g[5], w[5], rel_tol=1e-9)
    assert len({r[6] for r in got}) <= 1 and all(r[6] < 1e-9 for r in got)
    return got


def test_whitening_equals_brute_force(spark):
    rng = np.random.default_rng(9)
    mix = rng.standard_normal((20, 20)) * np.geomspace(2, 0.05, 20)
    rows = [(int(i), [float(np.float32(x)) for x in mix @ rng.standard_normal(20)]) for i in range(300)]
    rows += [(1000, rows[3][1]), (1000, rows[3][1]), (None, rows[4][1])] + [(2000 + i, rows[5][1]) for i in range(200)]
    rows += [(3000, None), (3001, [None] + [1.0] * 19), (3002, [float("nan")] * 20), (3003, [float("inf")] + [0.0] * 19)]
    got = compare(spark, rows)
    assert len(got) == 16 * 503


def test_few_vectors(spark):
    assert compare(spark, [(1, [0.5, 1.0, -2.0]), (2, [3.0, 1.0, 0.25])])  # one component has variance
    one = spark.createDataFrame([(1, [1.0, 2.0], 0), (2, [1.0, 2.0], 0)], VECS)
    assert wh.whiten(one).collect() == []
    assert wh.whiten(one.limit(0)).collect() == [] and wh.whiten(one.limit(0)).columns == wh.RESULT.replace(",", "").split()[::2]
    odd = spark.createDataFrame([(1, [1.0, 2.0], 0), (2, [2.0, 5.0], 0), (3, [1.0], 0), (4, [], 0)], VECS)
    assert {r.vec_id for r in wh.whiten(odd).collect()} == {1, 2}


def test_large_entries_stay_exact(spark):
    big = spark.createDataFrame([(1, [3e38, 1.0], 0), (2, [-3e38, 2.0], 0), (3, [1.0, 5.0], 0)], VECS)
    got = wh.whiten(big).collect()
    assert len(got) >= 3 and all(r.deviation is None and math.isfinite(r.whitened) for r in got if r.vec_id < 3)
    a = np.array([[2**40, -3], [5, 7], [-(2**40), 1]])
    assert (wh.exact_products(a) == a.astype(object).T @ a.astype(object)).all()
