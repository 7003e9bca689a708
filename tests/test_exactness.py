"""Results that must not depend on neighbours, blocks, offsets, amplitudes or ties."""

import numpy as np
import pytest

from wavelane.functions import breeding as B, kernels
from wavelane.ml import classifiers as C
from wavelane.operators import evolve as V


def nearest(x, y, ids, k, digits=9):
    out = []
    for row in x:
        with np.errstate(invalid="ignore"):
            gaps = [np.round(np.sqrt((np.where(row == v, 0.0, row - v) ** 2).sum()), digits) for v in y]
        out.append([(ids[j], gaps[j]) for j in np.lexsort((ids, gaps))[:k]])
    return out


@pytest.mark.parametrize("case", ["ties", "offset", "plain", "infinite", "one"])
@pytest.mark.parametrize("limit", [None, 0])
def test_knn_is_exact(spark, case, limit):
    rng = np.random.default_rng(3)
    y = {"ties": np.zeros((150, 2)), "offset": 1e8 + rng.normal(size=(300, 3)), "plain": rng.normal(size=(200, 4)),
         "infinite": np.where(rng.random((60, 3)) < 0.3, np.inf, rng.normal(size=(60, 3))), "one": rng.normal(size=(1, 2))}[case]
    x = y[:7] + (1.0 if case == "ties" else 0.0)
    ids = rng.permutation(len(y)) * 2 + 1
    train = spark.createDataFrame([(int(i), 0, v.tolist()) for i, v in zip(ids, y)], "series_id long, label int, features array<double>").repartition(3)
    test = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "series_id long, features array<double>")
    got = {}
    for r in C.knn_join(test, train, 4, broadcast_points=limit).collect():
        got.setdefault(r["series_id"], []).append((r["rank"], r["train_id"], r["dist"]))
    want = nearest(x, y, ids, 4)
    for i, rows in enumerate(want):
        found = sorted(got[i])
        assert [t for _, t, _ in found] == [int(t) for t, _ in rows]
        assert [d for _, _, d in found] == pytest.approx([d for _, d in rows])


def test_location_does_not_depend_on_neighbours():
    rng = np.random.default_rng(1)
    s = rng.normal(size=(1, 6))
    x = rng.normal(size=(1, 30))
    x[0, 8:14] = s[0]
    x[0, 3:9] = s[0] + 1e-3 / np.sqrt(6)  # overlaps the exact match, which is put back
    x[0, 8:14] = s[0]
    alone = kernels.best_match(x, s, "raw", True)
    loud = kernels.best_match(np.vstack([x, np.full((1, 30), 1e9)]), s, "raw", True)
    assert alone[1][0, 0] == loud[1][0, 0] == 8 and alone[0][0, 0] == loud[0][0, 0] == 0.0


@pytest.mark.parametrize("metric", ["raw", "znorm", "corr"])
@pytest.mark.parametrize("pos", [True, False])
def test_matches_do_not_depend_on_the_cell_limit(monkeypatch, metric, pos):
    rng = np.random.default_rng(2)
    x, s = rng.integers(0, 4, (9, 50)).astype(float), rng.integers(0, 4, (7, 5)).astype(float)
    x[2], s[1] = 1.0, 2.0
    whole = kernels.best_match(x, s, metric, pos)
    monkeypatch.setattr(kernels, "BLOCK_CELLS", 64)
    parts = kernels.best_match(x, s, metric, pos)
    assert np.allclose(whole[0], parts[0], atol=1e-9)
    assert (whole[1] is None and parts[1] is None) if not pos else (whole[1] == parts[1]).all()


def test_long_series_in_bounded_memory(monkeypatch):
    seen = []
    plain = kernels._match_offsets

    def watched(*args):
        d2, win = plain(*args)
        seen.append(max(d2.size, win.size))
        return d2, win
    monkeypatch.setattr(kernels, "_match_offsets", watched)
    monkeypatch.setattr(kernels, "BLOCK_CELLS", 1 << 16)
    x = np.random.default_rng(0).normal(size=(1, 200_000))
    s = x[:, 150_000:150_100].copy()
    dist, at = kernels.best_match(x, s, "raw", True)
    assert at[0, 0] == 150_000 and dist[0, 0] == 0.0
    assert max(seen) <= 2 * (1 << 16)


@pytest.mark.parametrize("scale", [1e-7, 1.0, 1e9])
def test_window_correlation_ignores_amplitude(scale):
    rng = np.random.default_rng(5)
    x, y = rng.normal(size=20), rng.normal(size=25)
    y[10:16] = 0.5                   # constant windows
    x[3:9] = 1.0 + 1e-6 * x[3:9]     # hardly any variation against the series
    got = kernels.window_correlations(x * scale + 3 * scale, y * scale, 6)
    for u in range(15):
        for v in range(20):
            a, b = x[u:u + 6], y[v:v + 6]
            want = 0.0 if a.min() == a.max() or b.min() == b.max() else np.corrcoef(a, b)[0, 1]
            assert got[u, v] == pytest.approx(want, abs=1e-5)


def test_random_windows_come_from_any_series(spark):
    series = spark.range(300).selectExpr("id as series_id", "array_repeat(cast(id as double), 8) as values")
    draws = spark.range(2_000).selectExpr("id as ind_id", "0 as pos")
    rows = V.random_windows(series, draws, 3, 8, 8).collect()
    assert len(rows) == 2_000 and all(4 <= len(r["values"]) < 8 for r in rows)
    assert len({r["values"][0] for r in rows}) > 285  # 300 (1 - e^-6.7) expected
    few = V.random_windows(series, draws.limit(3), 4, 8, 8).collect()
    assert len(few) == 3


def test_crossovers_keep_points():
    rng = np.random.default_rng(4)
    first = [np.arange(10.0) + 100 * i for i in range(4)]
    second = [np.arange(7.0) + 1000 * (i + 1) for i in range(3)]
    flat = lambda *sets: sorted(x for s in sets for v in s for x in v)
    changed = 0
    for _ in range(60):
        a, b = B.cross_points(first, second, rng)
        assert sorted(map(tuple, [*a, *b])) == sorted(map(tuple, [*first, *second]))
        changed += [tuple(v) for v in a] != [tuple(v) for v in first]
        c, d = B.cross_shapelet_points(first, second, rng, p=1.0)
        assert flat(c, d) == flat(first, second)
    assert changed == 60  # an exchange always exchanges something


def test_random_merge_takes_the_mean_of_the_originals():
    rng = np.random.default_rng(6)
    for _ in range(40):
        a, b = rng.normal(size=9), rng.normal(size=6)
        (x,), (y,) = B.cross_random_merge([a], [b], rng, p=1.0)
        assert len(x) == 9 and len(y) == 6
        at, to = np.flatnonzero(x != a), np.flatnonzero(y != b)
        assert len(at) == len(to) > 0
        assert np.allclose(x[at], (a[at] + b[to]) / 2) and np.allclose(y[to], x[at])


def test_bandwidth_uses_all_points():
    members = [np.arange(200.0), np.arange(150.0)]
    points = np.concatenate([m[:150] for m in members])
    gaps = np.abs(points[:, None] - points[None, :])[np.triu_indices(300, 1)]
    assert B.gak_bandwidth(members) == pytest.approx(np.median(gaps) * np.sqrt(150))


def test_words_of_large_alphabets(spark, series_of):
    from pyspark.sql import functions as F

    from wavelane.functions import arrays as A
    from wavelane.operators import windows as W
    rng = np.random.default_rng(7)
    series = series_of([(i, 0, rng.normal(size=12)) for i in range(5)])
    words = W.sax_words_of_windows(series, [12], 6, 300).select("series_id", "word").collect()
    plain = dict(series.select("series_id", W.word_string(A.sax_word(A.z_norm(F.col("values")), 6, 300)).alias("w")).collect())
    assert {r["series_id"]: r["word"] for r in words} == plain
    assert max(ord(c) for r in words for c in r["word"]) > 255 and all(len(r["word"]) == 6 for r in words)


def test_knn_by_blocks_visits_few_pairs(spark, monkeypatch):
    """Clusters, a third of all rows equal, infinite features, queries without a block: exact, and most block pairs are never met."""
    from wavelane.ml import neighbours as N

    rng = np.random.default_rng(17)
    centres = rng.normal(size=(20, 6)) * 50
    rows = [(i, i % 4, (centres[i % 20] + rng.normal(size=6)).tolist()) for i in range(600)]
    for i in range(0, 600, 3):
        rows[i] = (i, i % 4, rows[0][2])
    rows[5] = (5, 1, [float("inf")] + [0.0] * 5)
    rows[6] = (6, 1, [float("inf")] + [0.0] * 5)
    train = spark.createDataFrame(rows, "series_id long, label int, features array<double>")
    asked = rows[::11] + [(1000, 0, [1e6] * 6), rows[5]]
    test = spark.createDataFrame([(i + 5000, f) for i, _, f in asked], "series_id long, features array<double>")
    monkeypatch.setattr(C, "KNN_BLOCK", 20)
    met = []
    monkeypatch.setattr(N, "deal", lambda visits, held, key, deal=N.deal: (met.append(visits.count()), deal(visits, held, key))[1])
    got = {}
    for r in C.knn_join(test.dropDuplicates(["series_id"]), train, 4, broadcast_points=0).collect():
        got.setdefault(r.series_id - 5000, []).append((r["rank"], r.train_id, r.dist))
    for i, _, f in asked:
        both = [(np.array(f), np.array(g), j) for j, _, g in rows]
        dist = sorted((round(float(np.sqrt(sum(0.0 if a == b else (a - b) ** 2 for a, b in zip(x, y)))), 9), j) for x, y, j in both)
        want = [(k + 1, j, d) for k, (d, j) in enumerate(dist[:4])]
        assert [(k, j) for k, j, _ in sorted(got[i])] == [(k, j) for k, j, _ in want]
    blocks = -(-600 // 20)
    assert sum(met) < 0.35 * len(asked) * blocks
