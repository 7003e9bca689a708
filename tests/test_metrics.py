import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from wavelane.operators import metrics as M, prep as P, ranking as R, reports as Z
from tests import brute


def dist_table(spark, rows):
    """rows: (shapelet_id, label, dist)"""
    return spark.createDataFrame([(int(s), str(l), float(d)) for s, l, d in rows], "shapelet_id long, label string, dist double")


def scores(df, *cols):
    return {r.shapelet_id: tuple(r[c] for c in cols) for r in df.collect()}


def test_ig_goldens(spark):
    rows = [(0, "a", 0), (0, "b", 1), (1, "a", 0), (1, "a", 0), (1, "b", 2), (1, "b", 2), (2, "a", 3), (2, "b", 3), (3, "a", 1)]
    for spread in (0, M.SPREAD):
        got = scores(M.ig_score(dist_table(spark, rows), spread=spread), "gain", "gap", "threshold")
        assert got[0] == (pytest.approx(math.log(2), abs=1e-8), 1.0, 0.5)
        assert got[1] == (pytest.approx(math.log(2), abs=1e-8), 2.0, 1.0)
        assert got[2][:2] == (-math.inf, -math.inf)
        assert got[3][:2] == (None, None)
    tau = scores(M.ig_threshold(dist_table(spark, rows)), "threshold")
    assert tau[0] == (0.5,) and tau[2] == (3.0,) and tau[3] == (None,)


@pytest.mark.parametrize("spread", [0, 2, M.SPREAD])
def test_ig_matches_loops(spark, spread):
    rng = np.random.default_rng(0)
    rows = [(s, rng.choice(list("abc")), round(float(rng.gamma(2.0)), 1 if s % 2 else 4)) for s in range(6) for _ in range(40)]
    rows += [(6, l, d) for l, d in zip("aabbcc", [0, 0, 0.5, math.inf, 0, 2])]
    got = scores(M.ig_score(dist_table(spark, rows), spread=spread), "gain", "gap", "threshold")
    for s in range(6):
        gain, gap, tau = brute.best_split([(d, l) for i, l, d in rows if i == s])
        assert got[s] == (pytest.approx(gain, abs=1e-8), pytest.approx(gap, abs=1e-7), pytest.approx(tau))


def test_hot_distance_value(spark):
    """A third of all rows share one distance; the counts collapse before ordering."""
    rows = [(0, "a" if i % 2 else "b", 1.0) for i in range(300)] + [(0, "a", 0.5 + i / 1000) for i in range(100)] + \
           [(0, "b", 2 + i / 1000) for i in range(200)]
    got = scores(M.ig_score(dist_table(spark, rows), spread=M.SPREAD), "gain", "threshold")[0]
    gain, _, tau = brute.best_split([(d, l) for _, l, d in rows])
    assert got == (pytest.approx(gain, abs=1e-8), pytest.approx(tau))


def test_other_scores_golden(spark):
    two = dist_table(spark, [(0, "x", 0), (0, "x", 2), (0, "y", 4), (0, "y", 6)])
    assert scores(M.f_score(two), "score")[0][0] == pytest.approx(8.0)
    assert scores(M.kruskal_score(two), "score")[0][0] == pytest.approx(2.4)
    # 2x2 table [[0,2],[2,0]], corrected: 4 * (1 - 0.5)^2 / 1
    assert scores(M.mood_median(two), "score")[0][0] == pytest.approx(1.0)
    assert M.class_scatter(two).first()["score"] == pytest.approx(0.8)
    cells = dist_table(spark, [(0, "x", 0), (0, "x", 0), (0, "y", 1), (0, "y", 1)]).withColumn(
        "series_id", F.monotonically_increasing_id())
    assert M.bhattacharyya(cells).first()["score"] == 0.0
    flat = dist_table(spark, [(0, "x", 1), (0, "y", 1)]).withColumn("series_id", F.monotonically_increasing_id())
    assert M.bhattacharyya(flat).first()["score"] == 1.0
    assert scores(M.f_score(flat), "score")[0][0] == -math.inf
    assert scores(M.kruskal_score(flat), "score")[0][0] == -math.inf
    assert scores(M.mood_median(flat), "score")[0][0] == -math.inf


def test_gain_not_above_prior(spark):
    rng = np.random.default_rng(3)
    rows = [(s, rng.choice(list("ab")), float(rng.random())) for s in range(5) for _ in range(30)]
    df = dist_table(spark, rows)
    prior = {r.shapelet_id: r.entropy for r in M.entropy(df, ["shapelet_id"]).collect()}
    for s, (gain,) in scores(M.ig_score(df), "gain").items():
        assert 0 <= gain <= prior[s] + 1e-9


def test_wilcoxon_worked(spark):
    # differences 1..6 with signs -,+,+,+,+,+ : W- = 1, W+ = 20
    d = [-1, 2, 3, 4, 5, 6, 0]
    pairs = spark.createDataFrame([("d", float(x), 0.0) for x in d], "dataset string, x double, y double")
    r = Z.wilcoxon(pairs, ["dataset"]).first()
    se = math.sqrt(6 * 7 * 13 / 24)
    assert (r.n, r.statistic) == (6, 1.0)
    assert r.z == pytest.approx((1 - 10.5) / se)
    assert r.p_value == pytest.approx(math.erfc(abs(r.z) / math.sqrt(2)))


def test_compare_table_ties_differences_that_differ_by_rounding(spark):
    x, y = [0.1 + 0.2, 0.3, 0.9, 2e-9], [0.0, 0.6, 0.0, 1e-9]  # 0.30000000000000004, -0.3, 0.9 and 1e-9
    rows = [("d", m, i, v) for m, values in (("m", x), ("n", y)) for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, "dataset string, method string, run int, accuracy double")
    r = Z.compare_table(df, "m", "n", digits=6).first()
    # ranks 1 (a zero, of neither side), 2.5, 2.5, 4
    se = math.sqrt((4 * 5 * 9 - 0.5 * 6) / 24)
    assert r.statistic == 2.5 and r.z == pytest.approx((2.5 - 5) / se)


def test_mann_whitney_worked(spark):
    rows = [("d", "m", float(v)) for v in (5, 6, 7, 8, 9)] + [("d", "n", float(v)) for v in (1, 2, 3, 4, 5)]
    df = spark.createDataFrame(rows, "dataset string, method string, value double")
    r = Z.mann_whitney(df, ["dataset"], "method", "m", "n").first()
    assert r.u == 0.5 and r.flag == "+"
    sd = math.sqrt((1 - 6 / 990) * 25 * 11 / 12)
    assert r.z == pytest.approx((24.5 - 13) / sd)
    assert r.p_value == pytest.approx(0.5 * math.erfc(r.z / math.sqrt(2)))
    same = Z.mann_whitney(df, ["dataset"], "method", "n", "m").first()
    assert same.flag == "-" and same.u == 0.5


def test_compare_table_std_only_when_paired(spark):
    rows = [("a", "m", 0, .5), ("a", "m", 1, .7), ("a", "n", 0, .4), ("a", "n", 1, .8), ("b", "m", 0, .1), ("b", "n", 0, .2), ("c", "m", 0, .3)]
    df = spark.createDataFrame(rows, "dataset string, method string, run int, accuracy double")
    got = {r.dataset: r for r in Z.compare_table(df, "m", "n").collect()}
    assert set(got) == {"a", "b"}
    assert got["a"].std1 == pytest.approx(0.1) and got["b"].std1 is None and got["b"].p_value is None


def test_class_probabilities_and_stats(spark):
    df = spark.createDataFrame([(1, 0), (1, 0), (1, 1), (2, 1)], "node_id int, label_index int")
    got = {r.node_id: r.class_probs for r in Z.class_probabilities(df, ["node_id"]).collect()}
    assert got[1] == {0: pytest.approx(2 / 3), 1: pytest.approx(1 / 3)} and got[2] == {1: 1.0}
    s = Z.generation_stats(spark.createDataFrame([(1, float(x)) for x in (1, 2, 3, 5)], "g int, score double"), ["g"]).first()
    assert (s.avg, s.max, s.min, s.q25, s.q75) == (2.75, 5.0, 1.0, 1.75, 3.5)
    assert s.std == pytest.approx(np.std([1, 2, 3, 5]))


def test_length_percentiles(spark):
    df = spark.createDataFrame([(l,) for l in (4, 4, 4, 4)], "length int")
    assert tuple(Z.length_percentiles(df).first()) == (4, 5)


def test_prep(spark, series_of):
    s = series_of([(1, "b", range(10)), (2, "a", range(6)), (3, "b", range(30)), (4, "b", range(8))])
    assert {r.label: r.label_index for r in P.label_map(s).collect()} == {"a": 0, "b": 1}
    assert P.checked_limits(s) == (6, 15, 3)
    with pytest.raises(ValueError):
        P.checked_limits(series_of([(1, "a", [1, 2, 3, 4])]))
    assert P.sample_series(s, 3, 1).count() == 3
    big = spark.range(1000).select(F.col("id").alias("series_id"), F.when(F.col("id") < 700, "hot").otherwise("cold").alias("label"))
    split = P.stratified_split(big, 0.25, seed=2)
    counts = {(r.label, r.split): r["count"] for r in split.groupBy("label", "split").count().collect()}
    assert counts == {("hot", "train"): 175, ("hot", "test"): 525, ("cold", "train"): 75, ("cold", "test"): 225}


def test_tournament_and_best(spark):
    table = spark.createDataFrame([(i, float(i), 10 - i) for i in range(8)], "ind_id long, score double, points long")
    draws = R.tournament_draws(spark, 7, 8, 3)
    a = R.tournament(table, draws).orderBy("slot").collect()
    assert len(a) == 7 and a == R.tournament(table, R.tournament_draws(spark, 7, 8, 3)).orderBy("slot").collect()
    drawn = {}
    for r in draws.collect():
        drawn.setdefault(r.slot, []).append(r.ind_id)
    assert all(r.ind_id == max(drawn[r.slot]) for r in a)
    tie = spark.createDataFrame([(0, 1.0, 9), (1, 1.0, 4)], "ind_id long, score double, points long")
    assert R.select_best(tie).first().ind_id == 1


def test_narrow_bands_and_signs_are_dealt_evenly(spark):
    """One candidate, all values in a narrow band on both sides of zero: no task orders much more than its share."""
    rows = spark.range(8_000).select(F.lit(1).alias("shapelet_id"), ((F.col("id") - 4_000) * 1e-7 - 0.00005).alias("dist"),
                                     (F.col("id") % 3).cast("int").alias("label"), F.lit(1).cast("long").alias("n"))
    parts = M.dealt(rows, ["shapelet_id"], "dist", 8).groupBy("_b").agg(F.count(F.lit(1)).alias("n"), F.min("dist").alias("low"), F.max("dist").alias("high"))
    found = parts.orderBy("_b").collect()
    assert len(found) >= 4 and max(r.n for r in found) < 3 * 8_000 / len(found)
    assert all(a.high <= b.low for a, b in zip(found, found[1:]))
    whole, split = (sorted(map(tuple, M.cumulative_class_counts(rows.drop("n"), spread=s).collect())) for s in (0, M.SPREAD))
    assert whole == split


def test_hot_words_are_salted_by_their_counts(spark):
    from wavelane.operators import symbolic as S

    rows = [(i % 40, i, 5, 0, [0] if i % 3 else [i % 7], i % 2) for i in range(600)]
    masked = spark.createDataFrame(rows, "series_id long, start int, length int, iter int, masked array<int>, label_index int")
    plain, salted = (sorted(map(tuple, S.word_collision(masked, 2, hot=h).collect())) for h in (10 ** 6, 25))
    assert plain == salted and len(plain) == 600
