from __future__ import annotations

import numpy as np
import pytest

from linkweave.llm import embedding_dedup as E
from linkweave.llm.common import labelled
from tests.llm.conftest import table

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(ids, x):
    s = x @ x.T >= 0.9
    np.fill_diagonal(s, False)
    order = np.argsort(ids)
    place = np.argsort(order)
    a, b = np.nonzero(s)
    return s.sum(1), ids[order][labelled(len(ids), place[a], place[b])][place], s


def vectors(n=1500, d=32, seed=3):
    """Random directions, pairs that lie about the threshold, and a large group of near copies."""
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, d))
    for k in range(0, n // 2, 2):
        a = x[k] / np.linalg.norm(x[k])
        z = rng.normal(size=d)
        z -= z @ a * a
        c = rng.uniform(0.88, 0.97)
        x[k + 1] = c * a + np.sqrt(1 - c * c) * z / np.linalg.norm(z)
    x[n - 300 :] = x[0] + 0.05 * rng.normal(size=(300, d))
    return x.astype(np.float32)


def test_against_brute_force(spark):
    x = vectors()
    ids = np.random.default_rng(1).permutation(len(x)).astype(np.int64)
    df = spark.createDataFrame([(int(i), v.tolist(), 0) for i, v in zip(ids, x, strict=True)], SCHEMA).repartition(3)
    u = x.astype(float)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    links, component, pairs = brute(ids, u)
    for tile in (4096, 100):  # in one piece, and with lists cut in tiles
        got = E.near_duplicates(df, tile=tile).toPandas().set_index("vec_id").loc[ids]
        assert (got.n_links.values <= links).all()
        assert got.n_links.sum() / links.sum() >= 0.98
        lone = np.flatnonzero(links < 100)
        assert got.n_links.values[lone].sum() / links[lone].sum() >= 0.9
        assert (got.component_id.values == component).mean() >= 0.97
        assert (got.kept.values == (got.index.values == got.component_id.values)).all()


def unit(x):
    return x / np.linalg.norm(x, axis=1, keepdims=True)


@pytest.mark.parametrize("d", [32, 64, 128])
@pytest.mark.parametrize("n", [2048, 8192, 32768, 65536])
def test_recall_does_not_fall_with_the_pivots(n, d):
    """Pairs just above the threshold, in tables of up to a thousand million vectors by the number of their pivots."""
    rng = np.random.default_rng(n + d)
    a, z = unit(rng.normal(size=(400, d))), rng.normal(size=(400, d))
    z, c = unit(z - (z * a).sum(1, keepdims=True) * a), rng.uniform(0.9, 0.92, size=(400, 1))
    pivots = unit(rng.normal(size=(n, d))).astype(np.float32)
    near = [E.nearest_pivots(x.astype(np.float32), pivots, E.prefix_for(n)) for x in (a, c * a + np.sqrt(1 - c * c) * z)]
    met = [len(np.intersect1d(x, y)) >= E.SHARED for x, y in zip(*near, strict=True)]
    assert np.mean(met) >= 0.97


def test_many_pivots_are_chosen_without_a_step_each():
    x = unit(np.random.default_rng(4).normal(size=(9000, 24)))
    pivots = E.choose_pivots(x, 4096)
    assert len(pivots) == len(np.unique(pivots, axis=0)) == 4096
    close = pivots @ pivots[: E.FARTHEST].T
    close[np.arange(E.FARTHEST), np.arange(E.FARTHEST)] = 0
    assert close.max() < 0.8
    assert len(E.choose_pivots(np.repeat(x[:1], 3000, 0), 2048)) == E.PREFIX


def test_rows_that_link_with_nothing(spark):
    rows = [(1, [1.0, 0.0], 0), (2, [2.0, 0.0], 1), (3, None, 0), (4, [0.0, 0.0], 0), (5, [float("nan"), 1.0], 0), (6, [float("inf"), 1.0], 0), (7, [1.0, None], 0), (8, [1.0, 0.0, 0.0], 0), (9, [], 0), (None, [1.0, 0.0], 0), (1, [1.0, 0.0], 0), (10, [1e-30, 0.0], 0)]
    df = spark.createDataFrame(rows, SCHEMA)
    want = [(1, 2, 1, True), (1, 2, 1, True), (10, 2, 1, False), (2, 2, 1, False), *[(k, 0, k, True) for k in range(3, 10)], (None, 0, None, True)]
    assert table(E.near_duplicates(df)) == sorted(want, key=lambda r: [(x is None, str(x)) for x in r])


def test_empty_and_all_unusable(spark):
    assert table(E.near_duplicates(spark.createDataFrame([], SCHEMA))) == []
    assert table(E.near_duplicates(spark.createDataFrame([(1, None, 0)], SCHEMA))) == [(1, 0, 1, True)]


def test_extra_columns(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0], 5, 9, 9), (2, [1.0, 0.1], 6, 9, 9)], SCHEMA + ", n_links int, component_id int")
    assert table(E.near_duplicates(df)) == [(1, 1, 1, True), (2, 1, 1, False)]


def test_each_length_links_by_itself(spark):
    """Random directions of three lengths, each with an exact copy."""
    rng = np.random.default_rng(9)
    rows = []
    for start, n, d in ((0, 200, 32), (1000, 60, 48), (2000, 1, 24)):
        x = rng.normal(size=(n, d)).astype(np.float32).tolist()
        rows += [(start + 2 * k + c, v, 0) for k, v in enumerate(x) for c in (0, 1)]
    got = table(E.near_duplicates(spark.createDataFrame(rows, SCHEMA).repartition(3)))
    assert sorted(got) == [(i, 1, i - i % 2, i % 2 == 0) for i in sorted(r[0] for r in rows)]


def test_equal_vectors_are_one_class(spark):
    """20,000 ids of one vector, a near one, and ids that have several vectors."""
    rows = [(k, [1.0, 0.5, 0.0], 0) for k in range(20_000)] + [(30_000, [1.0, 0.55, 0.0], 0), (30_001, [0.0, 0.0, 1.0], 0), (40_000, [1.0, 0.5, 0.0], 0), (40_000, [0.0, 0.1, 1.0], 0), (40_000, [0.0, 0.0, 0.0], 0)]
    rows += [(50_000 + k, [0.0, 0.0, 0.0], 0) for k in range(300)]
    got = table(E.near_duplicates(spark.createDataFrame(rows, SCHEMA).repartition(3)))
    want = [(k, 20_001, 0, k == 0) for k in range(20_000)] + [(30_000, 20_001, 0, False), (30_001, 1, 0, False)]
    want += [(40_000, 20_002, 0, False)] * 3 + [(50_000 + k, 0, 50_000 + k, True) for k in range(300)]
    assert got == sorted(want, key=lambda r: [(x is None, str(x)) for x in r])


def test_pivots_are_found_in_pieces():
    rng = np.random.default_rng(2)
    x, pivots = rng.normal(size=(3000, 8)), rng.normal(size=(5000, 8))
    near = E.nearest_pivots(x, pivots, 14)
    assert (near == np.argsort(-(x @ pivots.T), axis=1, kind="stable")[:, :14]).all()
