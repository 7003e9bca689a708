"""One-vs-one machines against their definitions."""

import numpy as np
import pytest

from wavelane.ml import classifiers as C, machines as S


@pytest.fixture(scope="module")
def blobs(spark):
    rng = np.random.default_rng(2)
    centres = np.array([[0, 0, 1], [3, 0, 0], [0, 3, 0]], float)
    rows = [(i, i % 3, (centres[i % 3] + rng.normal(size=3)).tolist()) for i in range(150)]
    return rows, spark.createDataFrame(rows, "series_id long, label int, features array<double>").repartition(3).persist()


def test_coupling_is_the_smallest_sum():
    rng = np.random.default_rng(1)
    for k in (2, 3, 5):
        r = np.full((4, k, k), 0.5)
        for i in range(k):
            for j in range(i):
                r[:, i, j] = rng.uniform(0.05, 0.95, 4)
                r[:, j, i] = 1 - r[:, i, j]
        p = S.couple(r)

        def loss(p, r):
            return sum((r[j, i] * p[i] - r[i, j] * p[j]) ** 2 for i in range(k) for j in range(k) if i != j)
        assert np.allclose(p.sum(axis=1), 1) and (p >= 0).all()
        for row, pair in zip(p, r):
            for _ in range(200):
                q = np.maximum(row + rng.normal(size=k) * 0.02, 0)
                assert loss(row, pair) <= loss(q / q.sum(), pair) + 1e-12
        if k == 2:
            assert np.allclose(p[:, 0], r[:, 0, 1])


def test_machines_are_optimal_and_calibrated(spark, blobs):
    rows, train = blobs
    model = S.fit_machines(train, cs=(0.01, 1.0), folds=3)
    assert model.converged and model.accuracy > 0.9 and model.c in (0.01, 1.0)
    x, label = np.array([f for _, _, f in rows]), np.array([y for _, y, _ in rows])
    z = S.expanded(x, model.low, model.high, 1)
    for p, (i, j) in enumerate(model.pairs):
        mine = (label == i) | (label == j)
        y = np.where(label[mine] == i, 1.0, -1.0)
        w = model.weights[p]
        slack = np.maximum(0, 1 - y * (z[mine] @ w))
        gradient = np.append(w[:-1], 1e-8 * w[-1]) - 2 * model.c * (slack * y) @ z[mine]
        assert np.abs(gradient).max() < 1e-5
        assert model.sigmoids[p][0] < 0  # a larger margin means a larger chance
    got = {}
    for r in model.predict(train).collect():
        got.setdefault(r["series_id"], {})[r["class"]] = r["p"]
    assert all(sum(v.values()) == pytest.approx(1) for v in got.values()) and len(got) == 150
    hit = np.mean([max(got[i], key=got[i].get) == y for i, y, _ in rows])
    told = np.mean([got[i][y] for i, y, _ in rows])
    assert hit > 0.9 and 0.75 < told <= hit + 0.05  # probabilities are neither flat nor far too sure


def test_degree_two_separates_a_ring(spark):
    rng = np.random.default_rng(5)
    angle, radius = rng.uniform(0, 2 * np.pi, 200), np.where(np.arange(200) % 2, 1.0, 3.0) + rng.normal(size=200) * 0.2
    rows = [(i, i % 2, [float(r * np.cos(a)), float(r * np.sin(a))]) for i, (a, r) in enumerate(zip(angle, radius))]
    train = spark.createDataFrame(rows, "series_id long, label int, features array<double>")
    assert S.fit_machines(train, cs=(10.0,), degree=2).accuracy > 0.95 > S.fit_machines(train, cs=(10.0,)).accuracy


def test_member_of_a_vote(spark, blobs):
    rows, train = blobs
    model = C.VotingEnsemble({"machines": S.machine_member(), "bayes": C.bayes_member()}, folds=2).fit(train)
    got = {r.series_id: r.prediction for r in model.predict_soft(train).collect()}
    assert np.mean([got[i] == y for i, y, _ in rows]) > 0.9
