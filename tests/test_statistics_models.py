import numpy as np
from pyspark.sql import functions as F

from tessera.operators import models as M
from tessera.operators import semantic as L
from tessera.operators import statistics as S
from tessera.operators import text_counts as C


def test_spearman_with_ties(spark):
    rng = np.random.default_rng(0)
    rows = [(k, float(rng.integers(0, 5)), float(rng.integers(0, 5)), float(-k)) for k in range(50)]
    df = spark.createDataFrame([*rows, (99, None, 1.0, 1.0)], "id int, y double, a double, b double")

    def ranks(x):
        return np.array([(np.sum(x < v) + (np.sum(x == v) + 1) / 2) for v in x])

    got = {r["feature"]: r["rho"] for r in S.spearman(df, "id", "y", ["a", "b"]).collect()}
    y, a, b = (np.array([r[k] for r in rows]) for k in (1, 2, 3))
    assert abs(got["a"] - np.corrcoef(ranks(y), ranks(a))[0, 1]) < 1e-12
    assert abs(got["b"] - np.corrcoef(ranks(y), ranks(b))[0, 1]) < 1e-12
    table = spark.createDataFrame([("p", 0.2), ("n", -0.9)], "feature string, rho double")
    assert S.best_feature(table).first()["feature"] == "p" and S.best_feature(table, "abs").first()["feature"] == "n"
    assert S.best_feature(table.where("rho < 0")).count() == 0


def test_curves_and_auc(spark):
    df = spark.createDataFrame([("g", 0.9, 1), ("g", 0.5, 0), ("g", 0.5, 1), ("g", 0.1, 0), ("h", 0.4, 1)], "g string, s double, y int")
    c = {r["threshold"]: (r["tp"], r["fp"]) for r in S.score_curve(df.where("g = 'g'"), "s", "y").collect()}
    assert c == {0.9: (1, 0), 0.5: (2, 1), 0.1: (2, 2)}
    assert {r["g"]: r["auc"] for r in S.grouped_auc(df, "g", "s", "y").collect()} == {"g": 0.875}
    r = S.confusion(df, "s", "y", 0.5).first()
    assert (r["tp"], r["fp"], r["tn"], r["fn"]) == (2, 1, 1, 1)


def test_contingency_and_chi_square(spark):
    df = spark.createDataFrame([(3, 3)] * 10 + [(13, 3)] * 20 + [(3, 13)] * 30 + [(500, 500)] * 5 + [(None, 1)], "a int, b int")
    t = S.contingency(df, "a", "b")
    assert t.count() == 100 and t.agg(F.sum("n")).first()[0] == 65
    r = S.chi_square(t).first()
    obs = np.array([[10, 30, 0], [20, 0, 0], [0, 0, 5]], dtype=float)
    exp = obs.sum(1)[:, None] * obs.sum(0) / obs.sum()
    assert abs(r["statistic"] - ((obs - exp) ** 2 / exp).sum()) < 1e-9 and r["degrees"] == 4


def test_elbow_and_tournament_scores(spark):
    costs = spark.createDataFrame([(2, 100.0), (3, 50.0), (4, 40.0), (5, 39.0), (6, 10.0)], "k int, c double")
    assert S.elbow(costs, "k", "c", 1.2).first()["k"] == 4 and S.elbow(costs, "k", "c", 5.0).first()["k"] == 2
    runs = spark.createDataFrame([(k, "x", float(k)) for k in range(12)], "run int, init string, cost double")
    got = {r["run"]: r["score"] for r in S.ranked_scores(runs, ["run", "init"], {"cost": 1.0}).collect()}
    assert got[0] == 30 and got[10] == 0 and got[11] == -3


def test_trees_and_forest(spark):
    rows = [(k, "red" if k % 2 else "blue", float(k % 10), "yes" if k % 10 > 4 else "no") for k in range(120)]
    df = spark.createDataFrame(rows, "id int, colour string, x double, y string")
    model, scores = M.cross_validated(df, M.feature_stages(["colour"], ["x"], "y"), M.tree(1), {"maxDepth": [1, 2]}, "accuracy", folds=2, seed=1)
    assert max(m for _, m in scores) == 1.0 and len(scores) == 2
    assert M.wrong_predictions(model, df, "id", model.stages[0].labels).count() == 0
    reg, s = M.cross_validated(df, M.feature_stages([], ["x"]), M.forest_regression("x", 1, trees=3), {"maxDepth": [4]}, "rmse", label="x", folds=2, seed=1)
    assert s[0][1] < 1.0


def test_k_means_and_outliers(spark):
    rng = np.random.default_rng(0)
    pts = np.concatenate([rng.normal(0, 0.1, (40, 3)), rng.normal(5, 0.1, (40, 3)), [[2.0, 2.0, 2.0]]])
    df = M.as_vector(spark.createDataFrame([(k, [float(x) for x in p]) for k, p in enumerate(pts)], "id int, v array<double>"), "v")
    model = M.k_means(df, 2, 1)
    told = M.with_distance(model.transform(df).withColumnRenamed("prediction", "cluster"), M.centres(spark, model), "cluster", "v")
    assert abs(M.cost_figures(told).first()["cost"] - model.summary.trainingCost) < 1e-6
    assert [r["id"] for r in M.outliers(told, factor=4.0).collect()] == [80] and M.outliers(told.limit(0)).count() == 0
    assert [r["cluster"] for r in M.nearest(df.where("id = 0"), [(0, [9, 9, 9]), (1, [0, 0, 0])], "v").collect()] == [1]


def test_recommendations(spark):
    rows = [(u, i, float(1 + (u + i) % 3)) for u in range(12) for i in range(10) if (u + i) % 2 == 0]
    r = spark.createDataFrame(rows, "user int, item int, rating float")
    model = M.implicit_als(r, rank=2, iterations=2, seed=1)
    rec = M.recommended(model, r.select("user").distinct().where("user < 3"), 4)
    assert rec.count() == 12 and rec.agg(F.max("rank")).first()[0] == 4
    a = M.held_out_auc(rec, r).first()
    assert a["users"] <= 3
    pop = M.popular_for(r.select("user").distinct(), r.withColumn("rating", F.col("rating").cast("long")), 2)
    assert pop.count() == 24 and M.popular(r, 2).count() == 2
    assert M.cold_start(r, 999, [(0, 5.0), (2, 5.0)], 3, seed=1, rank=2, iterations=2).count() == 3


def test_concepts_match_a_dense_decomposition(spark):
    rng = np.random.default_rng(0)
    words = [f"w{k}" for k in range(12)]
    texts = [(k, " ".join(rng.choice(words[(k % 3) * 4 : (k % 3) * 4 + 5 if k % 3 < 2 else 12], 20))) for k in range(30)]
    docs = spark.createDataFrame(texts, "id long, t string").select("id", F.split("t", " ").alias("terms"))
    tf = C.term_frequency(docs, "id", "terms")
    vocab = C.inverse_frequency(C.vocabulary(tf, 50), 30)
    w = C.weights(tf, "id", vocab)
    a = np.zeros((30, vocab.count()))
    for r in w.collect():
        a[r["id"], r["term_id"]] = r["weight"]
    c = L.decomposed(w, "id", vocab, 3, passes=20)
    u, s, vt = np.linalg.svd(a, full_matrices=False)
    assert np.allclose(c.values, s[:3], rtol=1e-5)
    mine = np.array([r["us"] for r in L.scaled_documents(c, "id").orderBy("id").collect()])
    assert np.allclose(np.abs(mine[:, :2]), np.abs((u * s)[:, :2]), atol=1e-4)
    assert L.top_terms(c, 2).count() == 6 and L.top_documents(c, "id", 2).count() == 6
    assert L.query(c, "id", ["w0", "nothing"], 5).count() == 5


def test_totals_before_over_ranges(spark):
    rng = np.random.default_rng(2)
    x = rng.permutation(3000).astype(float) / 7
    n = rng.integers(1, 9, 3000)
    df = spark.createDataFrame([(float(a), int(b)) for a, b in zip(x, n)], "x double, n long")
    up = {r["x"]: r["t"] for r in S.with_total_before(df, "x", "n", "t").collect()}
    down = {r["x"]: r["t"] for r in S.with_total_before(df, "x", "n", "t", descending=True).collect()}
    order = np.argsort(x)
    total = np.cumsum(n[order]) - n[order]
    assert up == dict(zip(x[order].tolist(), total.tolist()))
    assert all(down[v] == n.sum() - up[v] - c for v, c in zip(x.tolist(), n.tolist()))
    assert S.with_total_before(df.limit(0), "x", "n", "t").count() == 0


def test_ranks_of_many_values_are_those_of_few(spark):
    rng = np.random.default_rng(3)
    rows = [(k, float(rng.integers(0, 6)) if k % 9 else None, float(rng.normal())) for k in range(400)]
    df = spark.createDataFrame(rows, "id int, a double, b double")
    few, many = ({r["id"]: (r["a"], r["b"]) for r in S.mean_ranks(df, ["a", "b"], "id", n).collect()} for n in (10_000, 0))
    assert few == many and len(few) == 400 and few[9] == (None, few[9][1])
    assert S.mean_ranks(df.limit(0), ["a", "b"], "id").count() == 0


def test_a_sweep_fits_few_rows_in_one_task(spark, monkeypatch):
    rows = [(k, float(k % 10), float(k % 3), float(k % 10 > 4)) for k in range(120)]
    df = spark.createDataFrame(rows, "id int, x double, z double, label double").repartition(6)
    seen = []

    class Tree(M.DecisionTreeClassifier):
        def _fit(self, dataset):
            seen.append(dataset.rdd.getNumPartitions())
            return super()._fit(dataset)

    monkeypatch.setattr(M, "DecisionTreeClassifier", Tree)
    stages = [M.VectorAssembler(inputCols=["x", "z"], outputCol="raw_features")]
    out = M.swept(df, df, stages, lambda p: M.indexed_tree(16, 1, **p), [{"maxDepth": 0}, {"maxDepth": 4}], "accuracy")
    assert seen == [1, 1] and out == [({"maxDepth": 4}, 1.0), ({"maxDepth": 0}, 0.5)]
    monkeypatch.setattr(M, "TOGETHER", 100)
    assert M.together(df).rdd.getNumPartitions() == 6
