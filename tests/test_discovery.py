import numpy as np
import pytest
from pyspark.sql import functions as F

from wavelane.functions import breeding as B, kernels, logistic
from wavelane.operators import discover as E, evolve as V, fitness as Fit, prep as P, symbolic as S, tree as T, windows as W
from wavelane.sources import generators as G
from tests import brute


@pytest.fixture(scope="module")
def blobs(spark):
    return V.write_through(G.gen_random_walk_blobs(spark, per_class=10, size=32, seed=3))


@pytest.fixture(scope="module")
def patterns(spark):
    return V.write_through(G.gen_imbalanced3(spark, seed=1))


def small(series_of, n=8, m=9):
    rng = np.random.default_rng(5)
    rows = [(i, i % 2, rng.normal(size=m) + (np.arange(m) % 3 if i % 2 else 0)) for i in range(n)]
    return rows, series_of(rows)


def loop_search(rows, lengths, metric):
    out = []
    for i, _, x in rows:
        for l in lengths:
            for k in range(len(x) - l + 1):
                pairs = [(round(brute.sliding(y, x[k:k + l], metric, "swap")[0], 9), lab) for _, lab, y in rows]
                gain, gap, _ = brute.best_split(pairs)
                out.append((round(gain, 7), round(gap, 7), i, k, l))
    return sorted(out, reverse=True)


@pytest.mark.parametrize("method,metric", [("exhaustive", "znorm"), ("fast", "corr")])
def test_search_matches_loops_in_both_forms(spark, series_of, method, metric):
    rows, series = small(series_of)
    want = loop_search(rows, [4, 5], metric)[:6]
    for limit in (None, 0):
        got = E.METHODS[method](series, lengths=[4, 5], n=6, broadcast_points=limit).collect()
        assert [(round(r.gain, 7), r.series_id, r.start, r.length) for r in got] == [(g, i, k, l) for g, _, i, k, l in want]
        assert [r.gap for r in got] == pytest.approx([w[1] for w in want], abs=1e-6)
        assert got[0]["values"] == pytest.approx(rows[want[0][2]][2][want[0][3]:want[0][3] + want[0][4]].tolist())


def test_ragged_search(spark, series_of):
    rng = np.random.default_rng(6)
    rows = [(i, i % 2, rng.normal(size=int(rng.integers(4, 9)))) for i in range(8)]
    got = E.discover_exhaustive(series_of(rows), lengths=[4, 6], n=4).collect()
    want = loop_search([(i, l, x) for i, l, x in rows], [4, 6], "znorm")[:4]
    assert [(r.series_id, r.start, r.length) for r in got] == [w[2:] for w in want]


def test_collisions_match_loops(spark, series_of):
    rng = np.random.default_rng(8)
    rows = [(i, i % 2, rng.integers(0, 4, 12).astype(float)) for i in range(7)]
    series = P.encode_labels(series_of(rows))
    masks = [[0, 1], [1, 2]]
    words = W.sax_words_of_windows(series, [6], 3, 3, keep=("label_index",))
    masked = W.random_mask(words, masks)
    flat = [(r.series_id, r.start, r.iter, r.masked) for r in masked.collect()]
    got = {(r.series_id, r.start): r.scores for r in S.window_class_score(masked, 2).collect()}
    for sid, start in {(f[0], f[1]) for f in flat}:
        want = [0, 0]
        for it in range(2):
            key = next(f[3] for f in flat if f[:3] == (sid, start, it))
            for other in {f[0] for f in flat if f[2] == it and f[3] == key}:
                want[other % 2] += 1
        assert list(got[(sid, start)]) == want


def test_sax_search_separates(spark, patterns):
    train = patterns.where("split = 'train'").drop("split")
    best = E.discover_sax(train, lengths=[6, 8], word=4, candidates=20, mask_size=1, n=1).first()
    assert best.gain > 0.3


@pytest.mark.parametrize("method,options", [("exhaustive", {"lengths": [5]}), ("sax", {"lengths": [6], "word": 4, "mask_size": 1, "candidates": 20})])
def test_tree_learns_patterns(spark, patterns, method, options):
    train, test = (patterns.where(f"split = '{s}'").drop("split") for s in ("train", "test"))
    tree = T.fit_tree(train, method=method, max_depth=3, **options)
    rows = {r.node_id: r for r in tree.collect()}
    assert all(r.is_leaf or {2 * i, 2 * i + 1} <= rows.keys() for i, r in rows.items())
    hit = T.tree_predict(test, tree).join(test, "series_id").agg(
        F.avg((F.col("prediction") == F.col("label")).cast("int"))).first()[0]
    assert hit > 0.8
    order = [r.path for r in T.tree_shapelets(tree).collect()]
    assert order == sorted(order) and len(order) == sum(not r.is_leaf for r in rows.values())
    probs = T.tree_predict_proba(test, tree).first().probs
    assert sum(probs.values()) == pytest.approx(1.0)


def test_tree_rules(spark, series_of):
    flat = series_of([(i, i % 2, [0, 1, 0, 1, 0, 1]) for i in range(6)])
    assert T.fit_tree(flat, lengths=[4]).count() == 1  # nothing separates: one leaf
    rows, series = small(series_of)
    assert T.fit_tree(series, max_depth=0, lengths=[4]).count() == 1
    calls = []

    def method(own):
        calls.append(1)
        return E.discover_exhaustive(own, lengths=[4], n=1)
    assert T.fit_tree(series, method=method, max_depth=1).count() == 3 and calls


def test_tree_query_searches_real_lengths(spark, tmp_path):
    """The registered tree on a few users, against loops over all windows of 8, 24 and 48 points at every node."""
    from wavelane.plans.model_queries import tree_fit_levels

    rng = np.random.default_rng(3)
    users = {i: (f"t{i % 3}", rng.normal(size=50 + i % 2).round(3).tolist()) for i in range(9)}
    events = [(i * 100 + k, i, k, kind, x) for i, (kind, values) in users.items() for k, x in enumerate(values)]
    spark.createDataFrame(events, "event_id long, user_id long, ts long, event_type string, value double").coalesce(1).write.parquet(
        f"{tmp_path}/events.parquet")

    def windows(values, length):
        w = np.lib.stride_tricks.sliding_window_view(np.array(values), length)
        return (w - w.mean(axis=1, keepdims=True)) / w.std(axis=1, keepdims=True)

    cut = {(i, n): windows(values, n) for i, (_, values) in users.items() for n in (8, 24, 48)}
    want, open_ = {}, [(1, 0, sorted(users))]
    while open_:
        node, depth, ids = open_.pop()
        if depth == 3 or len({users[i][0] for i in ids}) == 1:
            want[node] = (depth, None)
            continue
        best = None
        for n in (8, 24, 48):
            dist = {j: [np.sqrt(((a[:, None, :] - cut[j, n][None]) ** 2).sum(axis=2)).min(axis=1).round(9) for a in (cut[i, n] for i in ids)] for j in ids}
            for at, i in enumerate(ids):
                for start in range(len(cut[i, n])):
                    gain, gap, threshold = brute.best_split([(dist[j][at][start], users[j][0]) for j in ids])
                    found = (round(gain, 9), round(gap, 9), i, start, n, threshold)
                    if best is None or found > best:
                        best, sides = found, {j: dist[j][at][start] <= threshold for j in ids}
        want[node] = (depth, best[-1])
        open_ += [(2 * node, depth + 1, [j for j in ids if sides[j]]), (2 * node + 1, depth + 1, [j for j in ids if not sides[j]])]
    got = {r["node_id"]: (r["depth"], r["threshold"]) for r in tree_fit_levels(spark, str(tmp_path)).collect()}
    assert got.keys() == want.keys() and max(d for d, _ in got.values()) >= 2
    for node, (depth, threshold) in want.items():
        assert got[node] == (depth, threshold if threshold is None else pytest.approx(threshold, abs=1e-6))


def test_estimate_lengths(spark, blobs):
    lo, hi = T.estimate_lengths(blobs, iterations=2, lengths=[5, 8, 12])
    assert 5 <= lo < hi <= 13


def test_genetic_separates_and_never_falls(spark, blobs):
    found = V.discover_genetic(blobs, population_size=6, iterations=3, seed=1)
    best = [r["max"] for r in found.history.collect()]
    assert best == sorted(best) and found.score == best[-1] and found.score > -0.05
    assert found.shapelets.count() >= 1
    again = V.discover_genetic(blobs, population_size=6, iterations=3, seed=1)
    key = lambda r: [tuple(x["values"]) for x in r.shapelets.orderBy("shapelet_id").collect()]
    assert key(found) == key(again)


def test_single_and_odd_population(spark, blobs):
    found = V.discover_genetic_single(blobs, population_size=5, iterations=2, seed=2, fitness=Fit.f1_fitness)
    assert found.shapelets.count() == 1 and found.score > 0.9


def test_fitness_contract(spark, blobs):
    with pytest.raises(ValueError):
        V.discover_genetic(blobs, fitness=lambda a, b: None)


def test_swarm(spark, blobs):
    found = V.discover_swarm(blobs, particles=4, iterations=2, seed=1)
    assert found.score > 0.5 and found.shapelets.count() == 1


def test_motif(spark, blobs):
    row = V.init_motif(blobs, 8, draws=5, seed=1).first()
    assert len(row["values"]) == 8 and row.profile > 0


def test_initialisers(spark, blobs):
    sets = spark.createDataFrame([(0, 1), (1, 3), (2, 4)], "ind_id long, k int")
    for op in V.INITIALISERS:
        rows = op(blobs, sets, 5, 32, 16).collect()
        sizes = {}
        for r in rows:
            sizes.setdefault(r.ind_id, []).append(len(r["values"]))
        assert {i: len(v) for i, v in sizes.items()} == {0: 1, 1: 3, 2: 4}
        assert all(4 <= n < 16 for v in sizes.values() for n in v)


# ------------------------------------------------------------------- model fitting


def test_both_fits_reach_the_same_optimum(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(200, 4)) + [0, 3, 0, 0]
    y = (x[:, 0] > 0).astype(int) + (x[:, 2] > 0.5)
    df = spark.createDataFrame([(int(b), [float(v) for v in a]) for a, b in zip(x, y)],
                               "label_index int, features array<double>").repartition(3)
    members = spark.createDataFrame([(0, [0, 1]), (1, [0, 1, 2, 3])], "ind_id long, slots array<int>")
    shared = {r.ind_id: r for r in Fit.fit_sets(df, members, 3).collect()}
    spread = {r.ind_id: r for r in Fit.fit_sets(df, members, 3, shared_cells=0).collect()}
    for i in shared:
        assert shared[i].loss == pytest.approx(spread[i].loss, rel=1e-5) and shared[i].rows == 200
        slots = [0, 1] if i == 0 else [0, 1, 2, 3]
        w = np.array(shared[i].weights).reshape(3, -1)
        loss, grad, hits = logistic.softmax_sums(x[:, slots], y, w)
        _, g = logistic.penalised(loss, grad, w)
        assert np.abs(g).max() < 2e-2 and loss == pytest.approx(shared[i].loss)


# --------------------------------------------------------------------- breeding


def sets():
    rng = np.random.default_rng(1)
    return [rng.normal(size=n) for n in (6, 8, 5)], [rng.normal(size=n) for n in (7, 9)]


def test_mutations():
    a, _ = sets()
    rng = np.random.default_rng(2)
    assert len(B.mutate_add(a, rng, lambda: np.ones(4))) == 4
    assert len(B.mutate_remove(a, rng, None)) == 2 and len(B.mutate_remove(a[:1], rng, None)) == 1
    for _ in range(20):
        masked = B.mutate_mask(a, rng, None)
        changed = [(m, o) for m, o in zip(masked, a) if len(m) != len(o)]
        assert len(changed) <= 1 and all(len(m) >= 4 for m, _ in changed)
    noisy = B.mutate_noise(a, rng, None)
    assert [len(x) for x in noisy] == [6, 8, 5]


def test_crossovers():
    a, b = sets()
    rng = np.random.default_rng(3)
    x, y = B.cross_points(a, b, rng)
    assert sorted(map(len, x + y)) == sorted(map(len, a + b))
    x, y = B.cross_shapelet_points(a, b, np.random.default_rng(4), p=1.0)
    assert sum(map(len, x + y)) == sum(map(len, a + b)) and len(x) == 3 and len(y) == 2
    x, y = B.cross_random_merge(a, b, np.random.default_rng(5), p=1.0)
    assert sorted(map(len, x)) == sorted(map(len, a))
    x, y = B.cross_merge(a, b, rng)
    assert len(x) == 3 and len(y) == 2 and len(x[0]) in (6,)


def test_gak():
    a, b = sets()
    sim = B.gak_similarity(a, b)
    assert sim.shape == (3, 2) and (sim >= 0).all() and (sim <= 1 + 1e-9).all()
    assert B.gak_similarity([a[0]], [a[0]])[0, 0] == pytest.approx(1.0)
    near = B.gak_similarity([a[0]], [a[0] + 0.01, a[0] + 2.0], sigma=1.0)[0]
    assert near[0] > near[1]
    # direct recursion on one short pair
    s = 0.9
    def raw(p, q):
        k = np.zeros((len(p) + 1, len(q) + 1)); k[0, 0] = 1
        for i in range(len(p)):
            for j in range(len(q)):
                e = np.exp(-(p[i] - q[j]) ** 2 / (2 * s * s)); e = e / (2 - e)
                k[i + 1, j + 1] = e * (k[i, j] + k[i, j + 1] + k[i + 1, j])
        return k[-1, -1]
    want = raw(a[0], b[0]) / np.sqrt(raw(a[0], a[0]) * raw(b[0], b[0]))
    assert B.gak_similarity([a[0]], [b[0]], sigma=s)[0, 0] == pytest.approx(want)


@pytest.mark.parametrize("metric,on_short", [("znorm", "swap"), ("corr", "inf")])
def test_closest_windows_equal_ragged_match(metric, on_short, monkeypatch):
    rng = np.random.default_rng(12)
    lists = [rng.normal(size=int(rng.integers(3, 40))) * 10.0 ** rng.integers(-6, 6) + 10.0 ** rng.integers(-3, 4) for _ in range(40)]
    lists += [np.full(12, 3.0), np.concatenate([np.zeros(9), rng.normal(size=9)]), np.arange(20.0), lists[0], 2 * lists[1] + 1, np.zeros(0)]
    pool = kernels.Ragged.from_lists(lists)
    monkeypatch.setattr(kernels, "SEARCH_CELLS", 4096)
    for limit in (8192, 15):  # with the second, longer series are matched one by one
        monkeypatch.setattr(kernels, "LONG_SERIES", limit)
        for length in (4, 9):
            cand = np.concatenate([np.lib.stride_tricks.sliding_window_view(x, length) for x in lists if len(x) >= length])
            got = E._distances(cand, kernels.Windows(pool, length, 64), metric, on_short)
            want = kernels.ragged_match(pool, kernels.Ragged(cand.reshape(-1), np.full(len(cand), length)), metric, on_short)[0].T
            assert (np.isinf(got) == np.isinf(want)).all()
            assert np.allclose(got[np.isfinite(got)], want[np.isfinite(want)], rtol=1e-9, atol=1e-7)
            assert (got[want == 0] < 1e-9).all()


def test_gain_bounds_enclose_the_best_gain():
    rng = np.random.default_rng(3)
    for classes, n in ((2, 30), (4, 200), (10, 1000), (3, 2)):
        label = rng.integers(0, classes, n)
        dist = np.abs(rng.normal(size=(50, n))) + 0.3 * label * rng.random((50, 1))
        dist[:5] = np.round(dist[:5])
        dist[5, : n // 2] = np.inf
        dist[6] = 1.0
        counts = kernels.distance_histograms(dist, label, classes, 4.0, 9)
        assert (counts.sum(axis=(1, 2)) == n).all()
        low, up = kernels.gain_bounds(counts)
        gain = kernels.split_scores(dist, label, classes)[0]
        assert (low <= gain + 1e-9).all() and (gain <= up + 1e-9).all()


def odd_series(rng):
    lists = [rng.normal(size=int(rng.integers(3, 40))) * 10.0 ** rng.integers(-6, 6) + 10.0 ** rng.integers(-3, 4) for _ in range(40)]
    return lists + [np.full(12, 3.0), np.concatenate([np.zeros(9), rng.normal(size=9)]), np.arange(20.0), lists[0], 2 * lists[1] + 1, np.zeros(0)]


@pytest.mark.parametrize("metric,on_short", [("znorm", "swap"), ("corr", "inf")])
def test_single_precision_is_off_by_its_error_at_most(metric, on_short, monkeypatch):
    rng = np.random.default_rng(13)
    lists = odd_series(rng)
    pool = kernels.Ragged.from_lists(lists)
    for rows, cells, kept in ((4096, 128 * 1024, 1 << 24), (7, 512, 0)):  # with the second, a long series comes in pieces
        for name, value in (("UNIT_ROWS", rows), ("UNIT_CELLS", cells), ("KEPT_CELLS", kept)):
            monkeypatch.setattr(kernels, name, value)
        for length in (4, 9):
            cand = np.concatenate([np.lib.stride_tricks.sliding_window_view(x, length) for x in lists if len(x) >= length])
            got = E._correlations(cand, kernels.UnitWindows(pool, length), metric, on_short)
            dist = E._distances(cand, kernels.Windows(pool, length, 64), metric, on_short)
            assert ((got == -2) == np.isinf(dist)).all()
            want = np.where(np.isinf(dist), -2.0, 1 - dist ** 2 / (2 if metric == "corr" else 2 * length))
            assert np.abs(got - want).max() <= kernels.correlation_error(length)
    missing = kernels.Ragged.from_lists([lists[0], np.append(np.nan, np.arange(30.0))])
    got = E._correlations(cand[:3], kernels.UnitWindows(missing, 9), metric, on_short)
    assert (np.isnan(got) == [False, True]).all()


def test_gain_limits_are_above_every_gain_and_near():
    rng = np.random.default_rng(4)
    for classes, n in ((2, 140), (5, 3000), (10, 1000), (300, 700), (3, 2), (1, 150)):
        label = rng.integers(0, classes, n)
        corr = np.clip(0.5 + 0.1 * rng.normal(size=(40, n)) + 0.05 * rng.random((40, 1)) * (label % 2), -0.9, 0.99)
        corr[:4] = np.round(corr[:4], 1)                # ties
        corr[4], corr[5, :n // 3] = 0.5, -2.0            # one value; infinitely far
        corr[6, :n // 2] = 0.5 + 1e-7 * rng.random(n // 2)  # closer than the error
        weight = rng.integers(1, 400, n)
        for given in (None, weight):
            for error in (1e-6, 1e-3):
                dist = np.where(corr > -2, np.sqrt(2 * (1 - corr)), np.inf)
                gain = kernels.split_scores(dist, label, classes, 9, given)[0]
                wrong = np.where(corr > -2, corr + error * rng.uniform(-0.99, 0.99, corr.shape), -2.0).astype(np.float32)
                up = kernels.gain_limits(wrong.T.copy().T, label, classes, error + 2.0 ** -23, given)
                assert (up >= gain - 1e-9).all()
                if error == 1e-6 and given is None and n > 500 and classes < 100:
                    assert np.median((up - gain)[7:]) * n < 6 and (up - gain)[7:].max() * n < 30
    wrong[0], wrong[1, :5] = np.nan, np.nan
    found = kernels.gain_limits(wrong, label, classes, 1e-3)
    assert found[0] == -np.inf and np.isfinite(found[1:]).all()


def test_series_without_signal_are_bounded(spark, series_of):
    """Where labels tell nothing, few windows are scored in double precision; the n best are those of the whole search."""
    rng = np.random.default_rng(14)
    rows = [(i, int(rng.integers(0, 4)), rng.exponential(size=int(rng.integers(7, 22)))) for i in range(600)]
    series = series_of(rows).withColumn("run", F.col("series_id") % 3)
    for fast in (False, True):
        for by in (None, "run"):
            order = ([by] if by else []) + ["gain", "gap", "series_id", "start", "length"]
            want = E.score_windows_shared(series, [8, 16], fast, 6, by).toPandas()
            got = E.score_windows_shared(series, [8, 16], fast, 6, by, 3).toPandas()
            best = [t.sort_values(order, ascending=False) for t in (want, got)]
            one, two = ((t.groupby(by).head(3) if by else t.head(3))[order].to_numpy() for t in best)
            np.testing.assert_array_equal(one, two)
            assert len(got) < len(want) / 5


def test_block_search_keeps_what_can_win(spark, series_of, monkeypatch):
    """Several blocks of series: the counts add up, few windows go on, and the n best of every group are among them."""
    rng = np.random.default_rng(21)
    rows = [(i, i % 3, np.cumsum(rng.normal(size=int(rng.integers(5, 24))))) for i in range(60)]
    series = series_of(rows).withColumn("run", F.col("series_id") % 2)
    for fast in (False, True):
        for by in (None, "run"):
            full = E.score_windows_shared(series, [5, 8], fast, 9, by)
            keys = ([by] if by else []) + ["series_id", "start", "length"]
            ranked = full.where(F.col("gain") > -1).toPandas().sort_values("gain", ascending=False)
            want = ranked.groupby(by).head(7) if by else ranked.head(7)
            likely = E.likely_windows(series, [5, 8], fast, 7, 9, by, block=16).toPandas()
            assert set(map(tuple, want[keys].to_numpy().tolist())) <= set(map(tuple, likely[keys].to_numpy().tolist()))
            assert len(likely) < full.count()


def test_copies_are_searched_once(spark, series_of, monkeypatch):
    """Copies count as often as they occur, all of them are found, and the search sees one of each."""
    rng = np.random.default_rng(5)
    lists = [(i % 2, np.cumsum(rng.normal(size=14))) for i in range(12)]
    rows = [(i, *lists[i % 12]) for i in range(50)]  # four or five of each
    series = series_of(rows).withColumn("run", (F.col("series_id") > 23).cast("int"))
    real, seen = E.score_windows_shared, []
    for fast in (False, True):
        for by in (None, "run"):
            order = ([by] if by else []) + ["gain", "gap", "series_id", "start", "length"]
            want = real(series, [5, 8], fast, 6, by).toPandas().sort_values(order, ascending=False)
            want = want.groupby(by).head(7) if by else want.head(7)
            search = E.discover_fast if fast else E.discover_exhaustive
            for limit in (None, 0):
                monkeypatch.setattr(E, "score_windows_shared", lambda s, *a: seen.append(s.count()) or real(s, *a))
                got = search(series, n=7, lengths=[5, 8], digits=6, by=by, broadcast_points=limit).toPandas()
                keys = [c for c in order if c not in ("gain", "gap")]
                one, two = (t.sort_values(keys)[order].to_numpy() for t in (got, want))
                np.testing.assert_allclose(one, two, atol=2e-6)  # means may lie on half a digit
    assert seen == [12, 24, 12, 24]


def test_weights_count_as_copies():
    rng = np.random.default_rng(8)
    label, weight = rng.integers(0, 3, 40), rng.integers(1, 5, 40)
    dist = np.abs(rng.normal(size=(20, 40)))
    dist[0], dist[1, :20], dist[2] = 1.0, np.inf, np.round(dist[2])
    long, labels = np.repeat(dist, weight, axis=1), np.repeat(label, weight)
    for got, want in zip(kernels.split_scores(dist, label, 3, 6, weight), kernels.split_scores(long, labels, 3, 6)):
        np.testing.assert_allclose(got, want, atol=2e-6)
    one = kernels.split_scores(dist[:1, :1], label[:1], 3, 6, np.array([4]))
    assert one[0][0] == -np.inf and np.isnan(one[2][0])
    assert (kernels.distance_histograms(dist, label, 3, 4.0, 9, weight) == kernels.distance_histograms(long, labels, 3, 4.0, 9)).all()


def test_tree_estimator_in_a_pipeline(spark, patterns, tmp_path):
    from pyspark.ml import Pipeline, PipelineModel

    from wavelane.ml.estimators import ShapeletTreeClassifier

    train, test = (patterns.where(f"split = '{s}'").drop("split") for s in ("train", "test"))
    named = train.select("series_id", F.concat(F.lit("class "), "label").alias("label"), "values")
    model = Pipeline(stages=[ShapeletTreeClassifier(maxDepth=3, options={"lengths": [5]})]).fit(named)
    model.save(str(tmp_path / "tree"))
    loaded = PipelineModel.load(str(tmp_path / "tree"))
    assert loaded.stages[0].getOrDefault("maxDepth") == 3
    rows = test.select("series_id", "values", F.lit(7).alias("prediction"), F.concat(F.lit("class "), "label").alias("label"))
    got, again = (sorted(map(tuple, m.transform(rows).drop("values").collect())) for m in (model, loaded))
    assert got == again and len(got) == rows.count()
    assert loaded.transform(rows).columns == ["series_id", "values", "label", "prediction", "probability"]
    assert sum(r[1] == r[2] for r in got) / len(got) > 0.8
    tree = loaded.stages[0].tree
    want = {r.series_id: r.probs for r in T.tree_predict_proba(test, tree).collect()}
    assert {r.series_id: r.probs for r in T.tree_predict_proba(test, tree, broadcast_points=0).collect()} == want  # level by level
    assert {r[0]: r[3] for r in got} == {i: [p.get(c, 0.0) for c in range(3)] for i, p in want.items()}


def test_trees_deeper_than_numbers(spark, series_of):
    """A chain of 70 splits: paths go on where node numbers end."""
    depth, rows = 70, []
    for d in range(depth + 1):
        leaf = d == depth
        rows.append((None, None, None, d, None if leaf else [0.0, float(d % 3), 1.0, 0.0], None if leaf else -1.0, {0: 1.0}, leaf, "1" * d))
        if d:
            rows.append((None, None, None, d, None, None, {1: 1.0}, True, "1" * (d - 1) + "0"))
    tree = spark.createDataFrame(rows, T.TREE)
    series = series_of([(i, 0, np.sin(np.arange(6) * (i + 1))) for i in range(5)])
    for limit in (None, 0):
        assert {r.prediction for r in T.tree_predict(series, tree, broadcast_points=limit).collect()} == {0}
    numbers = spark.range(1).select(*[T._number(F.lit(p)).alias(n) for n, p in (("a", ""), ("b", "01"), ("c", "1" * 62), ("d", "1" * 63))]).first()
    assert tuple(numbers) == (1, 5, 2 ** 63 - 1, None)
