import numpy as np
import pytest
from pyspark.ml import Pipeline
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import functions as F

from wavelane.ml import classifiers as C
from wavelane.ml.estimators import GeneticShapelets, ShapeletModel, ShapeletTransformer
from wavelane.operators import evolve as V, fitness as Fit
from wavelane.sources import generators as G


@pytest.fixture(scope="module")
def blobs(spark):
    return V.write_through(G.gen_random_walk_blobs(spark, per_class=10, size=32, seed=3))


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(0)
    y = np.arange(90) % 3
    x = rng.normal(size=(90, 4)) * 0.4 + np.eye(3)[y] @ rng.normal(size=(3, 4)) * 2
    return V.write_through(spark.createDataFrame([(i, int(l), [float(v) for v in r]) for i, (l, r) in enumerate(zip(y, x))],
                                                 "series_id long, label long, features array<double>"))


def vectors(table):
    return table.select("series_id", F.col("label").cast("double").alias("label"), array_to_vector("features").alias("features"))


def hit(predictions, table):
    return predictions.select("series_id", F.col("prediction").cast("long").alias("p")).join(table, "series_id").agg(
        F.avg((F.col("p") == F.col("label")).cast("int"))).first()[0]


def test_fit_save_load_score(spark, blobs, tmp_path):
    lr = LogisticRegression(regParam=0.01)
    genetic = GeneticShapelets(populationSize=6, iterations=2, seed=1)
    model = Pipeline(stages=[genetic, lr]).fit(blobs)
    scored = model.transform(blobs)
    assert scored.agg(F.avg((F.col("prediction") == F.col("label")).cast("int"))).first()[0] == 1.0
    shapelets = model.stages[0]
    shapelets.save(str(tmp_path / "m"))
    back = ShapeletModel.load(str(tmp_path / "m"))
    key = lambda m: sorted((r.series_id, tuple(r.f)) for r in m.transform(blobs).select("series_id", vector_to_array("features").alias("f")).collect())
    assert key(back) == key(shapelets) and back.uid == shapelets.uid
    with pytest.raises(ValueError):
        ShapeletModel().transform(blobs)


def test_settings_are_saved(spark, blobs, tmp_path):
    genetic = GeneticShapelets(populationSize=4, iterations=1, wait=7, crossoverProb=0.3, mutationProb=0.2, maxLen=9, maxShaps=3, seed=5, normed=True)
    genetic.save(str(tmp_path / "g"))
    again = GeneticShapelets.load(str(tmp_path / "g"))
    settings = lambda x: {p.name: v for p, v in x.extractParamMap().items()}
    assert settings(again) == settings(genetic)
    model = again.fit(blobs)
    model.save(str(tmp_path / "m"))
    back = ShapeletModel.load(str(tmp_path / "m"))
    assert settings(back) == settings(model)
    assert {k: settings(back)[k] for k in settings(genetic)} == settings(genetic)
    windows = ShapeletTransformer(method="fast", minLen=5, maxLen=8, nShapelets=2, options={"lengths": [6]})
    windows.save(str(tmp_path / "w"))
    loaded = ShapeletTransformer.load(str(tmp_path / "w"))
    assert settings(loaded) == settings(windows) and loaded.fit(blobs).shapelets.count() == 2


def test_voting_ensemble(spark, table):
    split = table.withColumn("held", F.col("series_id") % 4 == 0)
    model = C.VotingEnsemble().fit(split.where("NOT held"))
    weights = {r["member"]: r["weight"] for r in model.weights.collect()}
    assert set(weights) == {"knn", "bayes", "centroid"} and all(w > 0.8 for w in weights.values())
    held = split.where("held")
    for predicted in (model.predict_soft(held), model.predict_hard(held)):
        assert predicted.count() == held.count() and hit(predicted, table) > 0.85


def test_custom_fitness(spark, blobs):
    model = GeneticShapelets(populationSize=4, iterations=1, seed=1, fitness=Fit.f1_fitness, single=True).fit(blobs)
    assert model.shapelets.count() == 1 and model.history.count() == 1


@pytest.mark.parametrize("method,options", [("fast", {"lengths": [8]}), ("swarm", {"particles": 4, "iterations": 1})])
def test_shapelet_transformer(spark, blobs, method, options):
    model = ShapeletTransformer(method=method, minLen=4, maxLen=10, nShapelets=2, options=options).fit(blobs)
    size = model.transform(blobs).select(F.size(vector_to_array("features"))).first()[0]
    assert size == (1 if method == "swarm" else 2)


def test_grids(spark, table):
    rows = vectors(table).persist()
    assert hit(C.logreg_grid(rows, cs=(1.0, 100.0), folds=2)[0].transform(rows), table) > 0.9
    assert hit(C.linear_svm_grid(rows, cs=(1.0,), folds=2, max_iter=10)[0].transform(rows), table) > 0.8
    assert hit(C.random_forest_grid(rows, trees=(5,), depths=(3,), folds=2)[0].transform(rows), table) > 0.9
    assert hit(C.decision_tree_grid(rows, leaf_sizes=(1, 5), folds=2)[0].transform(rows), table) > 0.9
    assert hit(C.naive_bayes(rows).transform(rows), table) > 0.8
    assert C.folds_for(rows) == 3 and C.smallest_class(rows) == 30
    w = C.balanced_weights(rows).agg(F.sum("weight")).first()[0]
    assert w == pytest.approx(90)


def test_knn_matches_loops(spark, table):
    data = [(r.series_id, r.label, np.array(r.features)) for r in table.collect()]
    for limit in (None, 0):
        near = C.knn_join(table, table, 4, broadcast_points=limit)
        got = {(r.series_id, r.rank): (r.train_id, r.dist) for r in near.collect()}
        assert len(got) == 360
        for sid, _, x in data:
            want = sorted((round(float(np.sqrt(((x - y) ** 2).sum())), 9), tid) for tid, _, y in data)[:4]
            assert [got[(sid, i + 1)] for i in range(4)] == [(t, pytest.approx(d, abs=1e-9)) for d, t in want]
    assert hit(C.knn_predict(near), table) == 1.0  # every row is its own neighbour at distance 0
    grid = C.knn_grid(table, ks=(1, 5)).collect()
    assert {r.k for r in grid} == {1, 5} and grid[0].accuracy >= grid[1].accuracy > 0.8


def test_rotation(spark, table):
    one, two = (C.rotation_matrices(table, 4, 2, seed=5) for _ in range(2))
    for a, b in zip(one, two):
        assert np.allclose(a, b) and np.allclose(a @ a.T, np.eye(4), atol=1e-9)
    assert not np.allclose(one[0], one[1])
    forest = C.RotationForest(3, max_depth=4).fit(table)
    proba = forest.predict_proba(table).groupBy("series_id").agg(F.sum("p").alias("s")).collect()
    assert all(r.s == pytest.approx(1.0) for r in proba)
    assert hit(forest.predict(table), table) > 0.9


def test_votes(spark):
    rows = spark.createDataFrame([(1, "a", 0, .9), (1, "a", 1, .1), (1, "b", 0, .2), (1, "b", 1, .8)],
                                 "series_id int, member string, class int, p double")
    weights = spark.createDataFrame([("a", 1.0), ("b", 3.0)], "member string, weight double")
    r = C.voting_soft(rows, weights).first()
    assert r.prediction == 1 and r.p == pytest.approx((0.1 + 3 * 0.8) / 4)
    votes = spark.createDataFrame([(1, "a", 2), (1, "b", 0), (2, "a", 1)], "series_id int, member string, prediction int")
    even = spark.createDataFrame([("a", 1.0), ("b", 1.0)], "member string, weight double")
    got = {r.series_id: r.prediction for r in C.voting_hard(votes, even).collect()}
    assert got == {1: 0, 2: 1}


def test_discovery_grid(spark, blobs):
    quick = {"populationSize": 4, "iterations": 1, "fitness": Fit.class_scatter_fitness}
    model, max_len, shaps = C.discovery_grid(blobs, lengths=[8], shapelet_counts=[3], folds=2, search=quick, final=quick)
    assert max_len == 8 and shaps == 3 and model.shapelets.count() >= 1


def test_knn_searches_equal_features_once(spark, monkeypatch):
    """Copies on both sides: one query and the k smallest ids of each are searched, and every row gets its neighbours."""
    rows = [(i, i % 2, [float(i % 7), 0.0]) for i in range(700)]
    df = spark.createDataFrame(rows, "series_id long, label long, features array<double>")
    real, seen = C._knn, []
    monkeypatch.setattr(C, "_knn", lambda test, train, *a: seen.append((test.count(), train.count())) or real(test, train, *a))
    for limit in (None, 0):
        got = {(r.series_id, r["rank"]): (r.train_id, r.label, r.dist) for r in C.knn_join(df, df, 3, broadcast_points=limit).collect()}
        assert got == {(i, k + 1): (i % 7 + 7 * k, (i % 7 + 7 * k) % 2, 0.0) for i in range(700) for k in range(3)}
    assert seen == [(7, 21)] * 2


def test_knn_beyond_a_small_table_goes_by_blocks(spark, monkeypatch):
    """What a task holds of the training rows does not grow with them."""
    rng = np.random.default_rng(6)
    rows = [(i, i % 2, list(map(float, rng.normal(size=2)))) for i in range(60)]
    df = spark.createDataFrame(rows, "series_id long, label long, features array<double>")
    want = sorted(map(tuple, C.knn_join(df, df, 2).collect()))
    real, calls = C._knn_by_blocks, []
    monkeypatch.setattr(C, "_knn_by_blocks", lambda *a: calls.append(1) or real(*a))
    monkeypatch.setattr(C, "KNN_POINTS", 119)
    assert C.KNN_POINTS < 120 and sorted(map(tuple, C.knn_join(df, df, 2).collect())) == want and calls == [1]
