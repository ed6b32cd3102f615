"""The pivot index: the same neighbours, links and clusters as all pairs give, with most cells passed over on clustered vectors."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.operators import pivots, vectors

SCHEMA = "id long, class_ string, v array<double>"


def clustered(rng, n, groups, spread, d=16):
    centres = rng.normal(size=(groups, d))
    return centres[rng.integers(0, groups, n)] + spread * rng.normal(size=(n, d))


@pytest.fixture
def small(monkeypatch):
    monkeypatch.setattr(pivots, "WORTH", 20)
    monkeypatch.setattr(vectors, "BLOCK", 64)


def table(spark, x, first=0, name="a"):
    return spark.createDataFrame([(first + i, name, v.tolist()) for i, v in enumerate(x)], SCHEMA)


@pytest.mark.parametrize("spread", [0.05, 0.5, 3.0])
@pytest.mark.parametrize("same", [True, False])
def test_neighbours_are_those_of_all_pairs(spark, small, spread, same):
    rng = np.random.default_rng(int(spread * 100))
    x, few = clustered(rng, 600, 12, spread), clustered(rng, 30, 3, spread)
    x[5] = x[4]
    y = x if same else clustered(rng, 500, 12, spread)
    left = table(spark, x).unionByName(table(spark, few, 5000, "b"))
    right = left if same else table(spark, y, 10_000).unionByName(table(spark, few, 15_000, "b"))
    got = {r.id: r for r in vectors.nearest(left, right, 5, 0.9, same).collect()}
    unit = lambda z: z / (np.linalg.norm(z, axis=1, keepdims=True) + 1e-8)
    for q, r, first in ((x, y, 0), (few, few, 5000)):
        s = unit(q) @ unit(r).T
        if same:
            np.fill_diagonal(s, -np.inf)
        for i, row in enumerate(s):
            assert got[first + i].top == pytest.approx(sorted(row, reverse=True)[:5], abs=1e-12)
            assert got[first + i].n_duplicates == (row >= 0.9).sum() and got[first + i].n_peers == len(r) - same
    assert len(got) == 630


def test_clustered_queries_pass_most_cells_over(spark, small):
    rng = np.random.default_rng(2)
    x = clustered(rng, 1280, 10, 0.02)
    rows = table(spark, x)
    known, laid = pivots.index(rows)
    n = len(known.pivots['{"class_":"a"}'])
    assert 10 <= n <= 64 and laid.count() == 1280
    first = pivots.visits(rows, known, lambda i, name, q, _: i.first(name, q, 6)).count()
    near = pivots.visits(rows, known, lambda i, name, q, _: i.bounds(name, q)[1] <= pivots.reach(0.95)).count()
    assert first <= 3 * 1280 and near <= 0.25 * 1280 * n  # cells passed over: three quarters at least


def test_clusters_are_those_of_all_pairs(spark, small):
    rng = np.random.default_rng(4)
    x = clustered(rng, 500, 30, 0.15)
    rows = table(spark, x).select("id", F.col("class_").alias("c"), "v")
    got = {r.node: r.cluster for r in vectors.clusters(vectors.duplicate_edges(rows, "id", "c", "v", 0.95)).collect()}
    u = x / (np.linalg.norm(x, axis=1, keepdims=True) + 1e-8)
    hit, label = u @ u.T >= 0.95, np.arange(len(x))
    while ((new := np.where(hit, label, len(x)).min(axis=1)) != label).any():
        label = new
    want = {i: int(k) for i, k in enumerate(label) if (label == k).sum() > 1}
    assert got == want and len(set(want.values())) > 5


def test_a_hot_class_is_cut(spark, small):
    """One class with nearly all rows: no group of a join holds more than a block of either side."""
    rng = np.random.default_rng(9)
    rows = table(spark, clustered(rng, 900, 1, 0.01)).unionByName(table(spark, clustered(rng, 50, 2, 0.1), 9000, "b"))
    sizes = []
    seen = vectors.blocks(rows, rows, lambda a, x, b, y: __import__("pandas").DataFrame({"n": [max(len(a), len(b))]}), "n long")
    sizes = [r.n for r in seen.collect()]
    assert max(sizes) < 3 * 64 and sum(s > 0 for s in sizes) >= (900 // 64) ** 2
