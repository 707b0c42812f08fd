"""Whitening against exact whole numbers and numpy's own covariance."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from graphloom.llm import whitening

SCHEMA = "vec_id long, embedding array<float>"


def brute(rows, components=4):
    """(vec_id, component) -> n, deviation, |whitened|, explained."""
    kept = [(i, [math.floor(256 * float(np.float32(c))) + 0 for c in v]) for i, v in rows]
    fit = sorted({tuple(x) for _, x in kept})
    n, dim = len(fit), len(fit[0])
    sums = [sum(x[d] for x in fit) for d in range(dim)]
    m = np.array([[(n * x[d] - sums[d]) / n for d in range(dim)] for x in fit])
    e, u = np.linalg.eigh(m.T @ m / n)
    e, u = e[::-1], u[:, ::-1]
    out = []
    for i, x in kept:
        c = np.array([(n * x[d] - sums[d]) / n for d in range(dim)])
        dev = sum((n * x[d] - sums[d]) ** 2 for d in range(dim))
        out += [(i, k + 1, n, dev, abs(float(c @ u[:, k]) / math.sqrt(e[k])), e[k] / e.sum()) for k in range(min(components, dim))]
    return out


def test_equals_brute_force(spark):
    rng = random.Random(1)
    rows = [(k, [rng.gauss(0.3 * d, 1 + d) for d in range(6)]) for k in range(300)]
    rows += [(1000 + k, rows[0][1]) for k in range(150)] + [(7, rows[7][1]), (None, rows[8][1]), (2000, [-0.0] * 6), (2001, [0.0] * 6)]
    bad = [(1, None), (2, []), (3, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (4, [float("nan")] * 6), (5, [float("inf")] + [0.0] * 5), (6, [1.0] * 5), (9, [1e30] * 6)]
    df = spark.createDataFrame(rows + bad, SCHEMA).withColumns({c: F.lit("own") for c in ("x", "v", "n", "component", "whitened")})
    got = whitening.whiten(df).collect()
    key = lambda r: (str(r[0]), r[1], round(r[4], 6))
    have = sorted(((r.vec_id, r.component, r.n, r.deviation, abs(r.whitened), r.explained) for r in got), key=key)
    want = sorted(brute(rows), key=key)
    assert [h[:4] for h in have] == [w[:4] for w in want]
    assert all(h[4] == pytest.approx(w[4], abs=1e-9) and h[5] == pytest.approx(w[5], rel=1e-9) for h, w in zip(have, want, strict=True))
    assert len({r.identity_error for r in got}) == 1 and got[0].identity_error < 1e-9


def test_signs_agree_over_rows(spark):
    rows = [(k, [float(k), 0.0, 1.0]) for k in range(10)]
    got = {r.vec_id: r.whitened for r in whitening.whiten(spark.createDataFrame(rows, SCHEMA)).where("component = 1").collect()}
    assert [got[k] < got[k + 1] for k in range(9)] in ([True] * 9, [False] * 9)


def test_without_variance(spark):
    one = whitening.whiten(spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0])], SCHEMA)).collect()
    assert [(r.vec_id, r.component, r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in sorted(one)] == [(i, c, 1, 0, 0.0, 0.0, 0.0) for i in (1, 2) for c in (1, 2)]
    line = whitening.whiten(spark.createDataFrame([(k, [float(k), float(k), 5.0]) for k in range(9)], SCHEMA)).collect()
    assert all(r.whitened == 0 and r.explained == 0 for r in line if r.component > 1) and line[0].identity_error < 1e-9
    assert whitening.whiten(spark.createDataFrame([], SCHEMA)).count() == 0
    assert whitening.whiten(spark.createDataFrame([(1, None), (2, [])], SCHEMA)).count() == 0


def test_deviations_beyond_a_long():
    p = whitening.Projection(1 << 31, (0, 0), np.eye(2), np.ones(2), 2.0)
    assert p.deviations(np.array([[1, 0], [3, 0]])) == [1 << 62, None]
    assert whitening.Projection(3, (5, 7), np.eye(2), np.ones(2), 2.0).deviations(np.array([[2, -4]])) == [1 + 19 * 19]


def test_sums_are_exact(spark):
    big = (1 << 31) - 257
    x = spark.createDataFrame([([big, -big, 1],)] * 1000, "x array<long>")
    assert whitening.exact_sums(x) == (1000, [1000 * big, -1000 * big, 1000])
