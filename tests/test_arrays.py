import numpy as np
import pytest
from pyspark.sql import functions as F

from wavelane.functions import arrays as A, kernels
from wavelane.operators import windows as W
from tests import brute


def one(spark, expr, **cols):
    row = spark.createDataFrame([tuple(cols.values())], list(cols)) if cols else spark.range(1)
    return row.select(expr.alias("r")).first()["r"]


def test_z_norm_golden(spark):
    assert np.round(one(spark, A.z_norm(F.col("v")), v=[0.0, 3.0, 6.0]), 4).tolist() == [-1.2247, 0.0, 1.2247]
    assert one(spark, A.z_norm(F.col("v")), v=[5.0, 5.0, 5.0]) == [0.0, 0.0, 0.0]
    assert one(spark, A.z_norm(F.col("v")), v=[0.1, 0.1, 0.1]) == [0.0, 0.0, 0.0]


def test_paa_last_frame_takes_the_rest(spark):
    assert one(spark, A.paa(F.col("v"), 2), v=[1.0, 3.0, 5.0, 5.0, 8.0]) == [2.0, 6.0]
    assert one(spark, A.paa(F.col("v"), 9), v=[1.0, 2.0]) == [1.0, 2.0]


def test_sax_golden(spark):
    assert one(spark, A.sax_word(F.col("v"), 2, 4), v=[-2.0, -2.0, 2.0, 2.0]) == [0, 3]
    assert A.sax_distance_table(4)[0][3] == pytest.approx(1.349, abs=1e-3)
    assert A.sax_distance_table(4)[1][2] == 0.0
    dist = A.sax_distance(F.col("a"), F.col("b"), F.lit(8), 4)
    assert one(spark, dist, a=[0, 0], b=[3, 0]) == pytest.approx(2 * 1.34898, abs=1e-4)


def test_barycenter_and_merge(spark):
    assert one(spark, A.barycenter(F.col("a"), F.col("b")), a=[0.0, 2.0, 4.0], b=[2.0, 4.0]) == [1.0, 3.0]
    merged = one(spark, A.merge_aligned(F.col("a"), F.col("b"), F.lit(0.9)), a=[0.0, 2.0, 4.0, 6.0], b=[2.0, 4.0])
    assert merged["start"] == 1 and merged["centroid"] == [2.0, 4.0]


def test_subseries_skips_short(spark, series_of):
    rows = W.subseries(series_of([(1, 0, [1, 2, 3]), (2, 0, [1])]), [2]).collect()
    assert [(r.series_id, r.start, r["values"]) for r in rows] == [(1, 0, [1.0, 2.0]), (1, 1, [2.0, 3.0])]


def test_words_equal_column_expression(spark, series_of):
    rng = np.random.default_rng(0)
    series = series_of([(i, 0, rng.normal(size=9 + i)) for i in range(5)])
    got = {(r.series_id, r.start): r.word for r in W.sax_words_of_windows(series, [7], 3, 4).collect()}
    windows = W.subseries(series, [7])
    want = windows.select("series_id", "start", W.word_string(A.sax_word(A.z_norm(F.col("values")), 3, 4)).alias("w"))
    assert got == {(r.series_id, r.start): r.w for r in want.collect()}


def test_prefix_and_cross_sums(spark, series_of):
    x, y = np.array([1.0, 2, 3]), np.array([4.0, 5])
    stats = W.prefix_stats(series_of([(1, 0, x)])).first()
    assert stats["s1"] == [0, 1, 3, 6] and stats["s2"] == [0, 1, 5, 14]
    m = kernels.cross_prefix(x, y)[0]
    for u in range(1, 4):
        for v in range(1, 3):
            assert m[u, v] == sum(x[u - 1 - i] * y[v - 1 - i] for i in range(min(u, v)))


def test_window_correlation_matches_numpy():
    rng = np.random.default_rng(1)
    x, y = rng.normal(size=12), rng.normal(size=9)
    got = kernels.window_correlations(x, y, 5)
    for u in range(8):
        for v in range(5):
            assert got[u, v] == pytest.approx(np.corrcoef(x[u:u + 5], y[v:v + 5])[0, 1], abs=1e-9)
    assert kernels.window_correlations(np.ones(6), y, 5).max() == pytest.approx(0.0, abs=1e-9)


def test_bitmap_shares_sum_to_one(spark, series_of):
    rng = np.random.default_rng(2)
    series = series_of([(i, 0, rng.normal(size=20)) for i in range(4)])
    sums = W.sax_bitmap(series, series).groupBy("series_id").agg(F.sum("share").alias("s")).collect()
    assert len(sums) == 4 and all(r.s == pytest.approx(1.0) for r in sums)


def test_draw_masks():
    masks = W.draw_masks(16, 3, 5, seed=1)
    assert len(masks) == 5 and all(len(set(m)) == 13 and m == sorted(m) for m in masks)
    assert masks == W.draw_masks(16, 3, 5, seed=1)


def test_brute_agrees_with_itself():
    assert brute.sliding([0, 1, 2, 3], [1, 2]) == (0.0, 1)


def test_paired_rows_are_measured_together():
    """Many pairs at once give what each pair gives alone."""
    from wavelane.functions import breeding as B

    rng = np.random.default_rng(4)
    first = [list(rng.normal(size=int(rng.integers(1, 9)))) for _ in range(40)] + [[1.0, 1.0]]
    second = [list(rng.normal(size=int(rng.integers(3, 12)))) for _ in range(40)] + [[1.0, 1.0, 1.0]]
    alone = [B.gak_similarity([a], [b])[0, 0] for a, b in zip(first, second)]
    np.testing.assert_allclose(B.paired_gak(first, second, block=7), alone, rtol=1e-12)
    x, y = rng.normal(size=(30, 9)), rng.normal(size=(30, 14))
    x[3], y[4, :7], x[5, :6] = 2.0, 0.5, 1e-9 * x[5, :6]
    got = kernels.paired_correlations(x, y, 5)
    for i in range(30):
        np.testing.assert_allclose(got[i], kernels.window_correlations(x[i], y[i], 5), atol=1e-12)
    naive = [[np.corrcoef(x[0, u:u + 5], y[0, v:v + 5])[0, 1] for v in range(10)] for u in range(5)]
    np.testing.assert_allclose(got[0], naive, atol=1e-9)


def test_series_of_one_label_lie_in_many_tasks(spark, series_of):
    from wavelane.plans.series_queries import label_mean_pairs

    rng = np.random.default_rng(2)
    pairs = label_mean_pairs(series_of([(i, "one", rng.normal(size=4)) for i in range(400)]))
    parts = pairs.select("series_id", F.spark_partition_id().alias("part")).groupBy("part").count().collect()
    assert sum(r["count"] for r in parts) == 400 and max(r["count"] for r in parts) < 100
