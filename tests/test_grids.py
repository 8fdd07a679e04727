from itertools import product

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from tessera.operators import grids as G
from tessera.operators import models as M
from tessera.plans import learning


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(0)
    rows = []
    for k in range(600):
        a, b, c = rng.normal(), float(rng.integers(0, 90)), float(rng.integers(0, 4))
        y = int((a > 0.2) + (b > 40 + 10 * c)) if rng.random() < 0.9 else int(rng.integers(0, 3))
        rows.append((k, k % 3, y, [float(c == 0), float(c == 1), a, b, 7.0]))
    return spark.createDataFrame(rows, "h bigint, fold int, y int, x array<double>").repartition(5).persist()


def _fold(data, estimator, k):
    of = data.select("fold", F.col("y").cast("double").alias("label"), array_to_vector("x").alias("features"))
    return estimator.fit(of.where(f"fold != {k}")).transform(of.where(f"fold = {k}"))


def test_trees_of_a_grid_are_those_of_spark(data):
    grid = {"maxDepth": [0, 3, 9], "impurity": ["entropy", "gini"], "maxBins": [6, 40]}
    got = G.grid_scores(data, grid)
    assert [tuple(p.values()) for p, _ in got] == list(product(*grid.values()))
    for p, score in got:
        if (p["maxDepth"], p["maxBins"]) in ((9, 6), (3, 40)):
            assert score == pytest.approx(np.mean([M.EVALUATORS["accuracy"]("label").evaluate(_fold(data, M.tree(1, **p), k)) for k in range(3)]), abs=1e-9), p


def test_each_tree_has_the_nodes_of_spark(data):
    d = data.orderBy("h").toPandas()
    x = np.array(d["x"].tolist())
    cuts = [G.thresholds(*np.unique(c, return_counts=True), 20) for c in x.T]
    bins = np.array([np.searchsorted(t, c) for t, c in zip(cuts, x.T)])
    for impurity, depth in product(("gini", "entropy"), (4, 12)):
        spark_tree = M.tree(1, maxDepth=depth, impurity=impurity, maxBins=20)
        told = _fold(data.withColumn("fold", F.lit(1)).unionByName(data.withColumn("fold", F.lit(0))), spark_tree, 0)
        raw = sorted(map(tuple, (r["probability"].toArray().round(9).tolist() for r in told.collect())))
        mine = G.Tree(bins, [len(t) + 1 for t in cuts], d["y"].to_numpy(), np.ones(600, int), 3, [2, depth], impurity, bins).shares(depth)
        assert raw == sorted(map(tuple, mine.round(9).tolist()))


def test_forests_of_a_grid(data, monkeypatch):
    two = data.withColumn("y", (F.col("y") > 0).cast("int"))
    grid = {"maxDepth": [2, 6], "impurity": ["gini"], "maxBins": [20], "numTrees": [5, 10]}
    got = G.grid_scores(two, grid, 1)
    assert got == G.grid_scores(two.repartition(2), grid, 1) != G.grid_scores(two, grid, 2)
    alone = G.grid_scores(two, grid | {"maxDepth": [2], "numTrees": [5]}, 1)  # the other points decide nothing
    assert alone == [got[0]]
    for p, score in got:
        theirs = np.mean([M.EVALUATORS["auc"]("label").evaluate(_fold(two, M.forest(1, **p), k)) for k in range(3)])
        assert abs(score - theirs) < 0.04, p
    monkeypatch.setattr(G, "CODES", 100)
    assert G.grid_scores(two, grid, 1) is None


def test_thresholds_and_area():
    v = np.array([1.0, 2.0, 4.0, 9.0])
    assert G.thresholds(v, np.array([1, 0, 2, 3]), 32).tolist() == [2.5, 6.5] and G.thresholds(v, np.array([9, 0, 0, 0]), 32).size == 0
    assert G.thresholds(v, np.array([10, 1, 1, 10]), 2).tolist() == [3.0]
    assert G.area(np.array([0.9, 0.5, 0.5, 0.1]), np.array([True, False, True, False])) == 0.875
    assert G.area(np.array([0.9, 0.5]), np.array([True, True])) == 0.0


def _no_fit_for_each_point(*args, **kwargs):
    raise AssertionError("a model for each point and fold")


def test_forest_cv_reads_its_points_off_the_same_trees(spark, monkeypatch):
    monkeypatch.setattr(M, "cross_validated", _no_fit_for_each_point)
    got = learning.forest_cv(spark, "/root/testdata/sf0.001").collect()
    assert len({r["params"] for r in got}) == 54 and all(0 <= r["metric"] <= 1 for r in got)
    assert got[0]["params"] == "impurity=entropy, maxBins=20, maxDepth=5, numTrees=5"


def test_tree_cv_reads_its_points_off_the_same_trees(spark, monkeypatch):
    monkeypatch.setattr(M, "cross_validated", _no_fit_for_each_point)
    got = learning.tree_cv(spark, "/root/testdata/sf0.001").collect()
    assert len({r["params"] for r in got}) == 18 and all(0 <= r["metric"] <= 1 for r in got)
    assert got[0]["params"] == "impurity=entropy, maxBins=20, maxDepth=5"
