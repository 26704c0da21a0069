"""Whitening against Python's whole numbers and fractions."""

from __future__ import annotations

import random
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from linkweave.llm import queries, whitening

VECTORS = "vec_id long, embedding array<double>"


def plain(rows, scale=256, most=4):
    """(vec_id, x, deviation) of each row, and the fit's n, mean, values, vectors and shares, for vectors of one length."""
    kept = [(i, [int(Fraction(c) * scale // 1) for c in v]) for i, v in rows if v and all(c is not None and np.isfinite(c) for c in v)]
    fit = sorted({tuple(x) for _, x in kept})
    n, width = len(fit), len(fit[0])
    s = [sum(x[d] for x in fit) for d in range(width)]
    v = np.array([[float(Fraction(sum(n * x[a] * x[b] for x in fit) - s[a] * s[b], n * n)) for b in range(width)] for a in range(width)])
    values, vectors = np.linalg.eigh(v)
    values, vectors = values[::-1][:most], vectors.T[::-1][:most]
    return [(i, x, sum((n * c - t) ** 2 for c, t in zip(x, s, strict=True))) for i, x in kept], n, [Fraction(t, n) for t in s], values, vectors, values / np.trace(v)


def held(got, rows, scale=256):
    told, n, mean, values, vectors, shares = plain(rows, scale)
    done = {}
    for r in got.collect():
        done.setdefault((r.vec_id, r.component), []).append(r)
    assert sum(len(x) for x in done.values()) == len(told) * len(values)
    signs = {}
    for i, x, deviation in told:
        centred = np.array([float(c - m) for c, m in zip(x, mean, strict=True)])
        for k, (e, u) in enumerate(zip(values, vectors, strict=True), 1):
            want = float(centred @ u) / e**0.5
            found = min(done[i, k], key=lambda r: abs(int(r.deviation) - deviation))
            assert (found.n, int(found.deviation)) == (n, deviation)
            if abs(want) > 1e-6:
                assert signs.setdefault(k, np.sign(found.whitened) == np.sign(want)) == (np.sign(found.whitened) == np.sign(want))
            assert abs(found.whitened) == pytest.approx(abs(want), rel=1e-9, abs=1e-9)
            assert found.explained == pytest.approx(shares[k - 1], rel=1e-9)
            assert found.identity_error < 1e-9


def made(seed=2, n=90, width=7):
    rnd = random.Random(seed)
    rows = [(k, [rnd.gauss(0.3 * d, 0.1 + d) for d in range(width)]) for k in range(n)]
    return rows + [(500 + k, rows[3][1]) for k in range(40)] + [rows[5], (None, rows[7][1]), (rows[8][0], rows[9][1])]


def test_whitened(spark):
    rows = made()
    odd = [(900, None), (901, []), (902, [None] + [1.0] * 6), (903, [float("nan")] * 7), (904, [float("inf")] + [0.0] * 6), (905, [1e300] * 7)]
    held(whitening.whiten(spark.createDataFrame(rows + odd, VECTORS).repartition(6)), rows)


def test_huge_numbers_stay_exact(spark):
    rnd = random.Random(5)
    rows = [(k, [rnd.uniform(-1, 1) * 2.0**44 + 2.0**52, float(k % 7) - 3, rnd.uniform(-2, 2) * 2.0**30]) for k in range(60)]
    told, n, mean, *_ = plain(rows)
    got = {r.vec_id: r for r in whitening.whiten(spark.createDataFrame(rows, VECTORS)).where("component = 1").collect()}
    for i, _, deviation in told:
        assert int(got[i].deviation) == deviation


def test_scatter_is_exact():
    rnd = random.Random(1)
    y = np.array([[rnd.randint(-(1 << 70), 1 << 70), rnd.randint(-5, 5), rnd.randint(-(1 << 40), 1 << 40)] for _ in range(50)], object)
    s = whitening.Scatter(3)
    s.add(y[:20])
    s.add(y[20:])
    assert s.n == 50 and s.sums.tolist() == y.sum(0).tolist() and s.products.tolist() == (y.T @ y).tolist()
    totals = {}
    for i, j, k, part in zip(*(c.tolist() for c in s.rows()), strict=True):
        totals[i, j] = totals.get((i, j), 0) + (part << 32 * k)
    assert totals[-1, -1] == 50 and all(totals[i, j] == s.products[i, j] for i in range(3) for j in range(i, 3))


def test_lengths_are_apart_and_columns_ignored(spark):
    rows = made(seed=4, n=40, width=3)
    other = [(i + 2000 if i is not None else None, v) for i, v in made(seed=6, n=30, width=5)]
    table = spark.createDataFrame(rows + other, VECTORS).withColumns({c: F.lit("own") for c in ("x", "width", "n", "v", "__x", "component")})
    got = whitening.whiten(table)
    held(got.where("vec_id < 2000"), [r for r in rows if r[0] is not None])
    assert got.where("vec_id >= 2000").count() == 4 * sum(r[0] is not None for r in other)


def test_fewer_components_than_asked_for(spark):
    rows = [(k, [float(k), 2.0 * k, 0.0, 1.0, 5.0]) for k in range(9)]  # one direction alone
    assert whitening.whiten(spark.createDataFrame(rows, VECTORS)).select("component").distinct().collect() == [(1,)]
    assert whitening.whiten(spark.createDataFrame([(1, [1.0, 2.0])] * 3, VECTORS)).count() == 0
    assert whitening.whiten(spark.createDataFrame([], VECTORS)).count() == 0
    with pytest.raises(ValueError, match="lengths"):
        whitening.whiten(spark.createDataFrame([(k, [1.0] * k) for k in range(1, 70)], VECTORS))


def test_query(spark):
    folder = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{folder}/embeddings.parquet").select("vec_id", "embedding").collect()]
    got = queries.op12_whitening(spark, folder)
    assert dict(got.dtypes)["deviation"] == "bigint"
    held(got, rows)
