"""Voronoi kNN join against check SQL and brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from kinweave.llm import knn
from kinweave.llm.queries import ORACLES, QUERIES
from tests.compare import DATA, differences


@pytest.mark.parametrize("sf", ["0.001", "0.01"])
def test_against_check_sql(spark, sf):
    assert differences(QUERIES["op2_voronoi_knn"](spark, DATA.format(sf)), ORACLES["op2_voronoi_knn"], sf) is None


def by_hand(rows, k, step):
    held = {}
    for i, v in rows:
        if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v):
            w = [int(np.floor(64 * float(x))) for x in v]
            held[i] = max(held.get(i, []), w)
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    out = []
    for q in sorted(held):
        if q % step == 0:
            best = sorted((-dot(held[q], v), i) for i, v in held.items() if i != q)[:k]
            out += [(q, r, i, -s) for r, (s, i) in enumerate(best, 1)]
    return out


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 1, "x") for i, v in rows], "vec_id long, embedding array<float>, rank int, score string")


def answer(df, k, step, **sizes):
    return sorted(map(tuple, knn.top_k(df, k, F.col("vec_id") % step == 0, **sizes).collect()))


def test_clusters_with_a_hot_vector(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(8, 6)) * 3
    rows = [(i, [float(x) for x in (centres[0] if i % 3 == 0 else centres[i % 8] + rng.normal(size=6) * 0.2)]) for i in range(900)]
    df = frame(spark, rows)
    assert answer(df, 5, 20, n_pivots=12, chunk_rows=40) == by_hand(rows, 5, 20)


def test_bounds_leave_cells_out():
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(16, 4)) * 20
    x = np.floor(64 * (np.repeat(centres, 50, 0) + rng.normal(size=(800, 4)) * 0.1)).astype(np.int64)
    cells = knn.Cells(x[::50], float((x.astype(float) ** 2).sum(1).max()))
    d = cells.distances(x)
    home = d.argmin(1)
    counts = np.bincount(home, minlength=16)
    radius = np.array([d[home == j, j].max() for j in range(16)])
    near = [np.sort(d[home == j, j])[:6] for j in range(16)]
    wanted = knn.needed(cells, counts, radius, near, x, 5)
    best = np.argsort(-knn.scores(x, x), axis=1)[:, :5]
    assert all(wanted[i, home[j]] for i in range(800) for j in best[i])
    assert wanted.mean() < 0.6


def test_odd_rows(spark):
    inf, nan = float("inf"), float("nan")
    rows = [(0, [1.0, 0.0]), (20, [-1.0, 2.0]), (20, [-1.0, 2.0]), (40, None), (60, [1.0, None]), (80, [nan, 1.0]), (100, [inf, 0.0]),
            (1, [1.0]), (2, [0.5, 0.5, 0.5]), (3, [1.0, 0.0]), (None, [9.0, 9.0]), (5, []), (7, [0.01, -0.01]), (7, [0.0, -0.01])]
    df = frame(spark, rows)
    assert answer(df, 20, 20) == by_hand(rows, 20, 20)
    assert answer(df, 2, 20, n_pivots=2, chunk_rows=1) == by_hand(rows, 2, 20)
    assert answer(df.limit(0), 20, 20) == []
    assert answer(frame(spark, [(0, None)]), 20, 20) == []


def test_very_large_components(spark):
    rows = [(i, [(i - 3) * 1e7, 1.0, float(i)]) for i in range(7)]
    assert answer(frame(spark, rows), 4, 2, n_pivots=2) == by_hand(rows, 4, 2)
