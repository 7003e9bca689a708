import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from wavelane.operators import distance as D, segments as G
from wavelane.sources import generators, readers, writers
from wavelane.operators import prep as P


def rows(df):
    return {r.series_id: (r.label, list(r["values"])) for r in df.collect()}


FLAT = [[0.0] * 8] * 4 + [[1.0] * 8] * 4


@pytest.mark.parametrize("data", [FLAT, np.array(FLAT), pd.DataFrame(FLAT)])
@pytest.mark.parametrize("labels", [[0] * 4 + [1] * 4, np.array([1.0] * 4 + [2.0] * 4), list("aaaabbbb"), np.repeat([3, 7], 4)])
def test_local_inputs(spark, data, labels):
    df = readers.series_from_local(spark, data, labels)
    assert len(rows(df)) == 8
    encoded = P.encode_labels(df).orderBy("series_id").collect()
    assert [r.label_index for r in encoded] == [0] * 4 + [1] * 4


def test_ragged_and_integer_input(spark):
    df = readers.series_from_local(spark, [[1, 2, 3], [4, 5]], ["x", "y"])
    assert rows(df) == {0: ("x", [1.0, 2.0, 3.0]), 1: ("y", [4.0, 5.0])}


def test_wide_csv(spark, tmp_path):
    pd.DataFrame({"t0": [1, 2], "t1": [3, 4.5], "target": ["u", "v"]}).to_csv(tmp_path / "wide.csv", index=False)
    got = sorted((r.label, r["values"]) for r in readers.read_wide_csv(spark, str(tmp_path / "wide.csv")).collect())
    assert got == [("u", [1.0, 3.0]), ("v", [2.0, 4.5])]


def test_long_rows_in_order(spark):
    df = spark.createDataFrame([(1, 2, 20.0), (1, 1, 10.0), (2, 5, 7.0)], "k int, t int, v double")
    got = {r.series_id: r["values"] for r in readers.series_from_long(df, "k", ["t"], "v").collect()}
    assert got == {1: [10.0, 20.0], 2: [7.0]}


def test_archive(spark, tmp_path):
    (tmp_path / "Coffee_TRAIN.tsv").write_text("1\t0.5\t1.5\n2\t3\t4\n")
    (tmp_path / "Coffee_TEST.txt").write_text("1, 9, 8\n")
    got = sorted((r.dataset, r.split, r.label, r["values"]) for r in readers.read_archive(spark, str(tmp_path / "*")).collect())
    assert got == [("Coffee", "test", "1", [9.0, 8.0]), ("Coffee", "train", "1", [0.5, 1.5]), ("Coffee", "train", "2", [3.0, 4.0])]


def test_prediction_files(spark, tmp_path):
    (tmp_path / "Beef_genetic_predictions_1530000000_lr_proba.csv").write_text(
        ",proba_0,proba_1,proba_2\n0,0.2,0.5,0.3\n1,0.6,0.2,0.2\n")
    got = readers.read_predictions(spark, str(tmp_path / "*proba.csv")).orderBy("row_id").collect()
    assert [(r.dataset, r.method, r.timestamp, r.row_id, r.prediction) for r in got] == [
        ("Beef", "genetic", "1530000000", 0, 1), ("Beef", "genetic", "1530000000", 1, 0)]


def test_shapelet_text(spark, tmp_path):
    (tmp_path / "s.txt").write_text("[0.1  -2.5e-1\n 3. ]\n[ 4 5\n6]\n")
    got = [r["values"] for r in readers.read_shapelets_text(spark, str(tmp_path / "s.txt")).orderBy("shapelet_id").collect()]
    assert got == [[0.1, -0.25, 3.0], [4.0, 5.0, 6.0]]


def test_round_trips(spark, tmp_path, shapelets_of):
    shapelets = shapelets_of([[0.1, 1 / 3], [2.0, 3.0, 4.0]])
    writers.write_shapelets(shapelets, str(tmp_path / "a"))
    assert writers.read_shapelets(spark, str(tmp_path / "a")).orderBy("shapelet_id").collect() == shapelets.orderBy("shapelet_id").collect()
    writers.write_shapelets_text(shapelets, str(tmp_path / "b"))
    back = sorted(r["values"] for r in readers.read_shapelets_text(spark, str(tmp_path / "b")).collect())
    assert back == [[0.1, 1 / 3], [2.0, 3.0, 4.0]]
    preds = spark.createDataFrame([(0, [0.25, 0.75], 1)], "row_id long, probs array<double>, prediction int")
    writers.write_predictions(preds, str(tmp_path / "p"), 2)
    r = spark.read.csv(str(tmp_path / "p_proba"), header=True).first()
    assert (r.row_id, r.proba_0, r.proba_1) == ("0", "0.25", "0.75")
    writers.write_runtime(spark, 1.5, str(tmp_path / "t"), "d")
    assert spark.read.csv(str(tmp_path / "t"), header=True, inferSchema=True).first().seconds == 1.5
    writers.write_split(spark.createDataFrame([(7, "x")], "series_id long, label string"), str(tmp_path / "g"))
    assert spark.read.csv(str(tmp_path / "g"), header=True).first().row_id == "7"


def test_generators(spark):
    s = generators.gen_sinusoids(spark).orderBy("series_id").collect()
    theta = 2 * np.pi * 5 * np.arange(0, 1601, 40) / 8000
    want = [np.sin(theta), -np.abs(np.sin(theta + np.pi)), np.sin(theta + np.pi), np.abs(np.sin(theta))]
    assert [r.label for r in s] == [0, 0, 1, 1]
    for r, w in zip(s, want):
        assert np.allclose(r["values"], w)
    p = generators.gen_imbalanced3(spark, seed=1)
    counts = {(r.split, r.label): r["count"] for r in p.groupBy("split", "label").count().collect()}
    assert counts == {(a, l): n for a in ("train", "test") for l, n in ((0, 25), (1, 5), (2, 5))}
    x = np.array([r["values"] for r in p.where("label = 1").collect()])
    assert np.abs(x.mean(0) - generators.PATTERNS[1][3]).max() < 0.1 and 0.01 < x.std(0).mean() < 0.1
    b = generators.gen_random_walk_blobs(spark, per_class=5, size=16).collect()
    assert len(b) == 10 and all(len(r["values"]) == 16 for r in b) and len({r.series_id for r in b}) == 10
    noise = spark.range(20000).select(generators._normal(1, F.col("id")).alias("x")).agg(F.avg("x"), F.stddev("x")).first()
    assert abs(noise[0]) < 0.03 and abs(noise[1] - 1) < 0.03


def test_segments_of_a_hot_key(spark, shapelets_of):
    rng = np.random.default_rng(0)
    long, short = rng.normal(size=500), rng.normal(size=5)
    points = [(1, i, float(v)) for i, v in enumerate(long)] + [(2, i, float(v)) for i, v in enumerate(short)]
    df = spark.createDataFrame([points[i] for i in rng.permutation(len(points))], "k long, t int, v double")
    parts = G.segments_from_long(df, "k", ["t"], "v", points=40, overlap=9, partitions=6)
    sizes = parts.where("series_id = 1").select(F.size("values").alias("n")).collect()
    assert len(sizes) == 13 and max(r.n for r in sizes) == 49
    shapelets = shapelets_of([long[36:44], rng.normal(size=10), rng.normal(size=6)])
    got = {(r.series_id, r.shapelet_id): (r.dist, r.pos) for r in G.min_distance_segments(parts, shapelets, 9).collect()}
    series = spark.createDataFrame([(1, [float(v) for v in long]), (2, [float(v) for v in short])], "series_id long, values array<double>")
    for r in D.min_distance(series, shapelets, location=True).collect():
        dist, pos = got[(r.series_id, r.shapelet_id)]
        assert dist == pytest.approx(r.dist, abs=1e-9)
        if np.isfinite(r.dist):
            assert pos == r.pos
    assert got[(1, 0)] == (0.0, 36)
    with pytest.raises(ValueError):
        G.min_distance_segments(parts, shapelets_of([rng.normal(size=11)]), 9)
