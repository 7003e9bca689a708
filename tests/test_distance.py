import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from wavelane.functions import kernels
from wavelane.operators import distance as D
from wavelane.streaming.project import stream_distances
from tests import brute


def table(df, *cols):
    return {(r.series_id, r.shapelet_id): tuple(r[c] for c in cols) for r in df.collect()}


def ragged(n, lo, hi, seed, discrete=False):
    rng = np.random.default_rng(seed)
    draw = (lambda k: rng.integers(0, 3, k).astype(float)) if discrete else (lambda k: rng.normal(size=k))
    return [draw(int(rng.integers(lo, hi))) for _ in range(n)]


def test_goldens(spark, series_of, shapelets_of):
    series = series_of([(0, 0, [0, 1, 2, 3]), (1, 0, [0, 0]), (2, 0, [5, 6])])
    got = table(D.min_distance(series, shapelets_of([[1, 2], [1, 1, 1]]), location=True), "dist", "loc")
    assert got[(0, 0)] == (0.0, 0.5)
    assert got[(1, 1)][0] == float("inf")
    assert got[(2, 0)][1] == 0.0
    swap = table(D.min_distance(series_of([(0, 0, [0, 0, 0])]), shapelets_of([[1] * 5]), on_short="swap"), "dist")
    assert swap[(0, 0)][0] == pytest.approx(1.73205, abs=1e-5)
    z = table(D.min_distance(series_of([(0, 0, [10, 20, 30, 5])]), shapelets_of([[1, 2, 3]]), "znorm"), "dist")
    assert z[(0, 0)][0] == 0.0


@pytest.mark.parametrize("metric", ["raw", "znorm", "corr"])
@pytest.mark.parametrize("on_short", ["inf", "swap"])
@pytest.mark.parametrize("discrete", [False, True])
def test_joins_match_loops(spark, series_of, shapelets_of, metric, on_short, discrete):
    xs, ss = ragged(7, 4, 14, 1, discrete), ragged(6, 3, 12, 2, discrete)
    series = series_of([(i, i % 2, x) for i, x in enumerate(xs)])
    shapelets = shapelets_of(ss)
    for limit in (None, 0):
        got = table(D.min_distance(series, shapelets, metric, on_short, True, ("label",), broadcast_points=limit), "dist", "pos", "label")
        assert len(got) == 42
        for (i, j), (dist, pos, label) in got.items():
            want, at = brute.sliding(xs[i], ss[j], metric, on_short)
            assert dist == pytest.approx(want, abs=1e-7) and label == i % 2
            if np.isfinite(want):
                assert pos == at


@settings(max_examples=30, deadline=None)
@given(st.lists(st.floats(-5, 5), min_size=3, max_size=12), st.lists(st.floats(-5, 5), min_size=2, max_size=6))
def test_kernel_matches_loops(x, s):
    d, _ = kernels.ragged_match(kernels.Ragged.from_lists([x]), kernels.Ragged.from_lists([s]), "raw", "swap")
    assert d[0, 0] == pytest.approx(brute.sliding(x, s, "raw", "swap")[0], abs=1e-6)


def test_znorm_ignores_scale_and_shift():
    x, s = ragged(1, 20, 21, 3)[0], ragged(1, 6, 7, 4)[0]
    a = kernels.best_match(x[None], s[None], "znorm")[0]
    b = kernels.best_match(3 * x[None] + 7, s[None], "znorm")[0]
    assert a[0, 0] == pytest.approx(b[0, 0], abs=1e-9)


def test_expression_twin_and_partitions(spark, series_of, shapelets_of):
    xs, ss = ragged(9, 4, 14, 5), ragged(4, 3, 9, 6)
    series, shapelets = series_of([(i, 0, x) for i, x in enumerate(xs)]), shapelets_of(ss)
    arrow = table(D.min_distance(series.repartition(5), shapelets, location=True), "dist", "loc")
    again = table(D.min_distance(series.coalesce(1), shapelets, location=True), "dist", "loc")
    column = table(D.min_distance_expr(series, shapelets), "dist", "loc")
    assert arrow == again
    for key, (d, l) in arrow.items():
        assert column[key] == (pytest.approx(d, abs=1e-9), pytest.approx(l, abs=1e-9))


def test_features_and_large_form_agree(spark, series_of, shapelets_of):
    series = series_of([(i, 0, x) for i, x in enumerate(ragged(8, 10, 14, 7))])
    shapelets = shapelets_of(ragged(5, 3, 9, 8))
    one = {r.series_id: r.features for r in D.distance_features(series, shapelets, location=True).collect()}
    two = {r.series_id: r.features for r in D.distance_features(series, shapelets, location=True, broadcast_points=0).collect()}
    assert one.keys() == two.keys()
    for k in one:
        assert one[k] == pytest.approx(two[k], abs=1e-9)


def test_by_matches_only_within_groups(spark, series_of, shapelets_of):
    series = series_of([(i, i % 2, x) for i, x in enumerate(ragged(6, 8, 9, 9))])
    shapelets = shapelets_of(ragged(4, 4, 5, 10)).withColumn("label", (F.col("shapelet_id") % 2).cast("int"))
    rows = D.min_distance(series, shapelets, by="label").collect()
    assert len(rows) == 12 and all(r.series_id % 2 == r.shapelet_id % 2 for r in rows)


def test_stream_projection(spark, series_of, shapelets_of, tmp_path):
    xs = ragged(10, 8, 12, 11)
    series, shapelets = series_of([(i, 0, x) for i, x in enumerate(xs)]), shapelets_of(ragged(3, 4, 5, 12))
    series.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(series.schema).parquet(str(tmp_path / "in"))
    query = (stream_distances(stream, shapelets).writeStream.format("parquet").option("path", str(tmp_path / "out"))
             .option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start())
    query.awaitTermination(120)
    got = {r.series_id: r.features for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    want = {r.series_id: r.features for r in D.distance_features(series, shapelets).collect()}
    assert got == want


def test_a_match_holds_little_beside_its_rows():
    """Intermediates of a large batch stay far below the 100 MB that all its products take."""
    import tracemalloc

    rng = np.random.default_rng(1)
    x, s = rng.normal(size=(10_000, 64)), rng.normal(size=(40, 16))
    tracemalloc.start()
    kernels.best_match(x, s)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 40e6
