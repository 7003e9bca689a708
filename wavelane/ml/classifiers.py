"""Classifiers on distance features, their tuning grids, and weighted votes.

Inputs have ``features`` (vector) and ``label`` (double index); outputs are long rows
(series_id, class, p) or (series_id, prediction), so members combine by grouping.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.ml import Pipeline
from pyspark.ml.classification import (DecisionTreeClassifier, LinearSVC, LogisticRegression, NaiveBayes, OneVsRest,
                                       RandomForestClassifier)
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.feature import MinMaxScaler, PolynomialExpansion
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import DataFrame, Window, functions as F, types as T

from wavelane.functions import kernels
from wavelane.operators import prep as P
from wavelane.ml import neighbours as N
from wavelane.runtime import attach_row, fits_broadcast, spread_small_input, table_size, write_through

# The grid of C.
C_GRID = [10.0 ** i for i in range(-2, 6)] + [5.0 ** i for i in range(-2, 6)]
ACCURACY = dict(metricName="accuracy")


def smallest_class(df: DataFrame, label: str = "label") -> int:
    return df.groupBy(label).count().agg(F.min("count")).first()[0]


def folds_for(df: DataFrame, most: int = 3) -> int:
    """Folds bounded by the smallest class, at least two."""
    return max(2, min(most, smallest_class(df)))


def balanced_weights(df: DataFrame, label: str = "label") -> DataFrame:
    """Adds ``weight``: n / (classes * class size)."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("_n"))
    packed = counts.agg(F.sum("_n").alias("_t"), F.count(F.lit(1)).alias("_c"),
                        F.map_from_entries(F.collect_list(F.struct(label, "_n"))).alias("_sizes"))  # one entry per class
    return attach_row(df, packed).withColumn(
        "weight", F.col("_t") / (F.col("_c") * F.col("_sizes")[F.col(label)])).drop("_t", "_c", "_sizes")


def _search(df, estimator, grid, folds, seed, metric="accuracy", parallelism=4):
    cv = CrossValidator(estimator=estimator, estimatorParamMaps=grid, numFolds=folds, seed=seed, parallelism=parallelism,
                        evaluator=MulticlassClassificationEvaluator(metricName=metric))
    fitted = cv.fit(df)
    larger = metric != "logLoss"
    scores = fitted.avgMetrics
    return fitted.bestModel, (max if larger else min)(scores)


def logreg_grid(df: DataFrame, penalties=(1.0, 0.0), cs=tuple(C_GRID), balanced=(False, True), folds: int = 3, seed: int = 0):
    """Logistic regression over penalty (1 = L1, 0 = L2), C and class weighting.

    C maps to regParam = 1 / (C n). Returns (model, cross-validated accuracy).
    """
    n = df.count()
    best = None
    for weighted in balanced:
        rows = balanced_weights(df) if weighted else df
        lr = LogisticRegression(family="multinomial", standardization=False, maxIter=100)
        if weighted:
            lr.setWeightCol("weight")
        grid = ParamGridBuilder().addGrid(lr.elasticNetParam, list(penalties)).addGrid(
            lr.regParam, [1.0 / (c * n) for c in cs]).build()
        found = _search(rows, lr, grid, folds, seed)
        if best is None or found[1] > best[1]:
            best = found
    return best


def linear_svm_grid(df: DataFrame, cs=tuple(C_GRID), folds: int = 3, seed: int = 0, degree: int = 1, max_iter: int = 50):
    """One-vs-rest linear machines over C on min-max scaled features; degree 2 adds products."""
    n = df.count()
    classes = int(df.agg(F.max("label")).first()[0]) + 1
    stages = [MinMaxScaler(inputCol="features", outputCol="scaled")]
    column = "scaled"
    if degree > 1:
        stages.append(PolynomialExpansion(degree=degree, inputCol="scaled", outputCol="expanded"))
        column = "expanded"
    best = None
    for c in cs:
        svc = LinearSVC(regParam=1.0 / (c * n), maxIter=max_iter, featuresCol=column)
        # the machines of the classes are independent: train them side by side
        rest = OneVsRest(classifier=svc, featuresCol=column, parallelism=min(classes, 8))
        pipeline = Pipeline(stages=stages + [rest])
        found = _search(df, pipeline, [{}], folds, seed)
        if best is None or found[1] > best[1]:
            best = found
    return best


def quadratic_svm(df: DataFrame, cs=(1.0,), folds: int = 2, seed: int = 0, max_iter: int = 50):
    return linear_svm_grid(df, cs, folds, seed, degree=2, max_iter=max_iter)


def random_forest_grid(df: DataFrame, trees=(10, 25, 50, 100, 500), depths=(30, 3, 7, 15), impurities=("gini",),
                       features=("auto",), folds: int = 3, seed: int = 0):
    rf = RandomForestClassifier(seed=seed)
    grid = (ParamGridBuilder().addGrid(rf.numTrees, list(trees)).addGrid(rf.maxDepth, list(depths))
            .addGrid(rf.impurity, list(impurities)).addGrid(rf.featureSubsetStrategy, list(features)).build())
    return _search(df, rf, grid, folds, seed)


def decision_tree_grid(df: DataFrame, leaf_sizes=(1, 3, 5, 7, 13, 25), folds: int = 3, seed: int = 0, max_depth: int = 15):
    dt = DecisionTreeClassifier(seed=seed, maxDepth=max_depth)
    grid = ParamGridBuilder().addGrid(dt.minInstancesPerNode, list(leaf_sizes)).build()
    return _search(df, dt, grid, folds, seed)


def naive_bayes(df: DataFrame, kind: str = "gaussian"):
    return NaiveBayes(modelType=kind).fit(df)


def class_rows(predictions: DataFrame, member: str, classes: int) -> DataFrame:
    """(series_id, member, class, p) from ``probability``, or from softmaxed margins."""
    if "probability" in predictions.columns:
        probs = vector_to_array("probability")
    else:
        raw = vector_to_array("rawPrediction")
        top = F.array_max(raw)
        e = F.transform(raw, lambda x: F.exp(x - top))
        probs = F.transform(e, lambda x: x / F.aggregate(e, F.lit(0.0), lambda a, b: a + b))
    return predictions.select("series_id", F.lit(member).alias("member"), F.posexplode(probs).alias("class", "p")).where(
        F.col("class") < classes)


def voting_soft(rows: DataFrame, weights: DataFrame) -> DataFrame:
    """Weighted mean probability; weights (member, weight) are normalised to 1, one row per member."""
    total = weights.agg(F.sum("weight").alias("_t"))
    shares = attach_row(weights, total).select("member", (F.col("weight") / F.col("_t")).alias("_w"))
    mixed = rows.join(F.broadcast(shares), "member").groupBy("series_id", "class").agg(F.sum(F.col("_w") * F.col("p")).alias("p"))
    return mixed.groupBy("series_id").agg(
        F.max_by("class", F.struct(F.round("p", 9), -F.col("class"))).alias("prediction"),
        F.max("p").alias("p"))


def voting_hard(votes: DataFrame, weights: DataFrame) -> DataFrame:
    """Weighted majority of (series_id, member, prediction); smallest class on ties."""
    counted = votes.join(F.broadcast(weights), "member").groupBy("series_id", "prediction").agg(F.sum("weight").alias("w"))
    return counted.groupBy("series_id").agg(
        F.max_by("prediction", F.struct(F.round("w", 9), -F.col("prediction"))).alias("prediction"), F.max("w").alias("weight"))


# ------------------------------------------------------------ nearest neighbours

KNN_BLOCK = 4096
KNN_POINTS = 1024 * 1024  # training points that every task holds; beyond it blocks of rows meet
KNN_CELLS = 512 * 1024    # distances formed at once


def _gaps(x, y):
    """Euclidean distances of paired rows; equal infinities do not differ, unequal ones are infinitely far."""
    with np.errstate(invalid="ignore"):
        diff = np.where(x == y, 0.0, x - y)
        return np.sqrt((diff * diff).sum(axis=-1))


def _nearest(x, y, ids, k, digits):
    """(row of x, row of y, distance) of the k nearest rows of y for every row of x, nearest first, ties by id.

    The product form of centred values only preselects: every row within its rounding bound of the k-th value is measured
    from the differences, however many there are. Infinite features are measured directly.
    """
    k = min(k, len(y))
    out = []
    finite = np.isfinite(x).all() and np.isfinite(y).all()
    centre = y.mean(axis=0) if finite else 0.0
    yc = y - centre
    square = (yc * yc).sum(1)
    step = max(1, KNN_CELLS // max(len(y), 1))
    for a in range(0, len(x), step):
        part = x[a:a + step]
        if finite:
            pc = part - centre
            own = (pc * pc).sum(1)
            d2 = own[:, None] + square[None, :] - 2 * pc @ yc.T
            error = 8e-16 * (x.shape[1] + 8) * (own[:, None] + square[None, :])
            upper = np.partition(d2 + error, k - 1, axis=1)[:, k - 1]
            reach = (np.sqrt(np.maximum(upper, 0)) + 10.0 ** -digits) ** 2
            i, j = np.nonzero(d2 - error <= reach[:, None])
        else:
            i, j = np.divmod(np.arange(len(part) * len(y)), len(y))
        exact = np.empty(len(i))
        rows = max(1, KNN_CELLS // max(x.shape[1], 1))
        for b in range(0, len(i), rows):
            exact[b:b + rows] = _gaps(part[i[b:b + rows]], y[j[b:b + rows]])
        exact = np.round(exact, digits)
        order = np.lexsort((ids[j], exact, i))
        i, j, exact = i[order], j[order], exact[order]
        rank = np.arange(len(i)) - np.searchsorted(i, i)
        keep = rank < k
        out.append((i[keep] + a, j[keep], exact[keep]))
    return [np.concatenate(c) for c in zip(*out)] if out else [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]


def knn_join(test: DataFrame, train: DataFrame, k: int, broadcast_points: int | None = None, digits: int = 9) -> DataFrame:
    """(series_id, rank, train_id, label, dist): k nearest training rows in distance space.

    Both sides have (series_id, features array); train has label. Only the k nearest of a block leave a task, never all
    pairs. Ties after rounding to ``digits`` go to the smaller train id, however many rows tie. Equal features are searched
    once, and of training rows with equal features only the k smallest ids can be among the nearest.
    """
    copy = F.row_number().over(Window.partitionBy("_f").orderBy("train_id"))
    sized = write_through(train.select(F.col("series_id").alias("train_id"), F.col("label").cast("long").alias("label"),
                                       F.col("features").alias("_f")).withColumn("_copy", copy).where(F.col("_copy") <= k).drop("_copy"))
    rows, points = table_size(sized, "_f")
    every = write_through(test.select("series_id", "features"))
    test = write_through(every.groupBy("features").agg(F.min("series_id").alias("series_id")).select("series_id", "features"))
    near = _knn(test, sized, rows, points, k, broadcast_points, digits)
    if test.count() == every.count():
        return near
    items = F.collect_list(F.struct("rank", "train_id", "label", "dist")).alias("_near")
    packed = test.join(near.groupBy("series_id").agg(items), "series_id").select("features", "_near")
    return every.join(packed, "features").select("series_id", F.explode("_near").alias("_n")).select(
        "series_id", "_n.train_id", "_n.label", "_n.dist", "_n.rank")


def _knn(test, sized, rows, points, k, broadcast_points, digits):
    """The join of queries with different features."""
    sid = test.schema["series_id"].dataType.simpleString()
    tid = sized.schema["train_id"].dataType.simpleString()
    schema = f"series_id {sid}, train_id {tid}, label long, dist double"
    names = ["series_id", "train_id", "label", "dist"]

    def emit(left_ids, x, tids, labels, y):
        tids, labels = np.asarray(tids), np.asarray(labels)
        i, j, dist = _nearest(x, y, tids, k, digits)
        return [left_ids.take(pa.array(i)), pa.array(tids[j]), pa.array(labels[j]), pa.array(dist)]

    def matrix(column):
        own = kernels.Ragged.from_arrow(column)
        return own.flat.reshape(len(own), -1)

    if fits_broadcast(rows, points, KNN_POINTS if broadcast_points is None else broadcast_points):
        table = sized.toArrow()
        ids = table.column("train_id").to_numpy()
        labels = table.column("label").to_numpy()
        shared = test.sparkSession.sparkContext.broadcast((ids, labels, matrix(table.column("_f"))))

        def run(batches):
            ids, labels, y = shared.value
            for batch in batches:
                if batch.num_rows:
                    yield pa.RecordBatch.from_arrays(
                        emit(batch.column("series_id"), matrix(batch.column("features")), ids, labels, y), names=names)

        near = spread_small_input(test.select("series_id", "features")).mapInArrow(run, schema)
    elif not rows:
        near = test.sparkSession.createDataFrame([], schema)
    else:
        near = _knn_by_blocks(test, sized, rows, k, digits, emit, matrix, schema, names)
    rank = F.row_number().over(Window.partitionBy("series_id").orderBy("dist", "train_id"))
    return near.withColumn("rank", rank).where(F.col("rank") <= k)


def _knn_by_blocks(test, train, rows, k, digits, emit, matrix, schema, names):
    """Nearest rows of the blocks that can hold them: first the query's own block, then those within its k-th distance."""
    pivots = N.choose_pivots(train, "_f", rows)
    placed = write_through(N.place(train, "_f", pivots))
    numbered = N.ring_blocks(placed, KNN_BLOCK)
    held = numbered(placed, "train_id")
    queries = write_through(numbered(N.place(test.select("series_id", "features"), "features", pivots), "series_id"))

    def visit(visits):
        left, right = N.deal(visits, held.select("block", "train_id", "label", "_f"), "series_id")

        def join(a, b):
            if not a.num_rows or not b.num_rows:
                return pa.table({n: pa.array([], t) for n, t in zip(names, (a.schema.field("series_id").type,
                                 b.schema.field("train_id").type, pa.int64(), pa.float64()))})
            cols = emit(a.column("series_id").combine_chunks(), matrix(a.column("features")),
                        b.column("train_id").to_numpy(), b.column("label").to_numpy(), matrix(b.column("_f")))
            return pa.Table.from_arrays(cols, names=names)

        return left.select("block", "_chunk", "series_id", "features").groupBy("block", "_chunk").cogroup(
            right.groupBy("block", "_chunk")).applyInArrow(join, schema)

    first = write_through(visit(queries.where(F.col("block").isNotNull())))
    cuts = first.groupBy("series_id").agg(F.when(F.count(F.lit(1)) >= k, F.max("dist")).alias("cut"))
    others = write_through(N.open_blocks(queries.join(cuts, "series_id", "left"), N.block_ranges(held, len(pivots)), "series_id", digits))
    return first.unionByName(visit(queries.drop("block").join(others, "series_id")))


def knn_predict(neighbours: DataFrame, k: int | None = None) -> DataFrame:
    """Vote with weight 1/d; if a neighbour is at distance 0, only such neighbours vote."""
    rows = neighbours if k is None else neighbours.where(F.col("rank") <= k)
    by = Window.partitionBy("series_id")
    exact = F.max(F.when(F.col("dist") == 0, 1).otherwise(0)).over(by) == 1
    weight = F.when(exact, F.when(F.col("dist") == 0, 1.0).otherwise(0.0)).otherwise(1 / F.col("dist"))
    votes = rows.withColumn("_w", weight).groupBy("series_id", "label").agg(F.sum("_w").alias("w"))
    return votes.groupBy("series_id").agg(
        F.max_by("label", F.struct(F.round("w", 9), -F.col("label"))).alias("prediction"))


def knn_grid(train: DataFrame, ks=(1, 3, 5, 7, 13, 25), folds: int = 3, seed: int = 0, fold: str | None = None,
             digits: int = 9) -> DataFrame:
    """Cross-validated accuracy of every k from one ranked join per fold: (k, accuracy), best first.

    ``fold`` names a column that already numbers the folds.
    """
    part_of = F.col(fold) if fold else F.pmod(F.xxhash64(F.lit(seed), "series_id"), F.lit(folds))
    rows = train.withColumn("_fold", part_of)
    near = None
    for i in range(folds):
        part = knn_join(rows.where(F.col("_fold") == i), rows.where(F.col("_fold") != i), max(ks), digits=digits)
        near = part if near is None else near.unionByName(part)
    near = near.persist()
    out = None
    truth = train.select("series_id", F.col("label").alias("_truth"))
    for k in sorted(set(ks)):
        one = knn_predict(near, k).join(truth, "series_id").agg(
            F.lit(k).alias("k"), F.avg(F.when(F.col("prediction") == F.col("_truth"), 1.0).otherwise(0.0)).alias("accuracy"))
        out = one if out is None else out.unionByName(one)
    return out.orderBy(F.desc("accuracy"), "k")


# ----------------------------------------------------------------- voting ensemble
# A member is a function of a training table (series_id, label, features array) that gives a function of
# a table with series_id and features; that one gives rows (series_id, class, p).


def knn_member(k: int = 5, digits: int = 9):
    """Class shares of the k nearest rows, weighted by 1/d; k is at most a fifth of the training rows."""
    def fit(train: DataFrame):
        own = max(1, min(k, train.count() // 5))

        def predict(rows: DataFrame) -> DataFrame:
            near = knn_join(rows.select("series_id", "features"), train, own, digits=digits)
            exact = F.max((F.col("dist") == 0).cast("int")).over(Window.partitionBy("series_id")) == 1
            weight = F.when(exact, (F.col("dist") == 0).cast("double")).otherwise(1 / F.col("dist"))
            votes = near.withColumn("_w", weight).groupBy("series_id", F.col("label").alias("class")).agg(F.sum("_w").alias("_w"))
            total = votes.groupBy("series_id").agg(F.sum("_w").alias("_t"))
            return votes.join(total, "series_id").select("series_id", "class", (F.col("_w") / F.col("_t")).alias("p"))
        return predict
    return fit


def bayes_member():
    """Gaussian naive Bayes."""
    def fit(train: DataFrame):
        vectors = lambda df, *cols: df.select("series_id", *cols, array_to_vector("features").alias("features"))
        model = naive_bayes(vectors(train, F.col("label").cast("double").alias("label")))
        return lambda rows: class_rows(model.transform(vectors(rows)), "", model.numClasses).select(
            "series_id", F.col("class").cast("long").alias("class"), "p")
    return fit


def centroid_member():
    """Shares of exp(-distance to the mean of a class)."""
    def fit(train: DataFrame):
        points = train.select(F.col("label").cast("long").alias("class"), F.posexplode("features").alias("at", "x"))
        means = points.groupBy("class", "at").agg(F.avg("x").alias("x")).groupBy("class").agg(
            F.transform(F.sort_array(F.collect_list(F.struct("at", "x"))), lambda e: e["x"]).alias("mean"))
        packed = means.agg(F.collect_list(F.struct("class", "mean")).alias("means"))  # one vector per class

        def predict(rows: DataFrame) -> DataFrame:
            gap = F.zip_with("features", "m.mean", lambda a, b: (a - b) * (a - b))
            near = attach_row(rows.select("series_id", "features"), packed).select("series_id", "features", F.explode("means").alias("m")).select(
                "series_id", F.col("m.class").alias("class"), F.exp(-F.sqrt(F.aggregate(gap, F.lit(0.0), lambda a, b: a + b))).alias("e"))
            total = near.groupBy("series_id").agg(F.sum("e").alias("_t"))
            return near.join(total, "series_id").select("series_id", "class", (F.col("e") / F.col("_t")).alias("p"))
        return predict
    return fit


def hard_votes(rows: DataFrame) -> DataFrame:
    """(series_id, member, prediction): most likely class of each member, the smaller one on ties."""
    return rows.groupBy("series_id", "member").agg(
        F.max_by("class", F.struct(F.round("p", 9), -F.col("class"))).alias("prediction"))


class VotingEnsemble:
    """Members weighted by their cross-validated accuracy on the training rows, then fitted on all of them."""

    def __init__(self, members: dict | None = None, folds: int = 3, seed: int = 0):
        self.members = members or {"knn": knn_member(), "bayes": bayes_member(), "centroid": centroid_member()}
        self.folds, self.seed = folds, seed

    def _rows(self, fitted: dict, rows: DataFrame) -> DataFrame:
        out = None
        for name, predict in fitted.items():
            part = predict(rows).select("series_id", F.lit(name).alias("member"), "class", "p")
            out = part if out is None else out.unionByName(part)
        return out

    def fit(self, train: DataFrame, fold: str | None = None):
        """train: series_id, label (long), features. ``fold`` names a column that already numbers the folds.

        Folds are at most the rows of the smallest class.
        """
        folds = folds_for(train, self.folds) if fold is None else train.agg(F.max(fold)).first()[0] + 1
        part_of = F.col(fold) if fold else F.pmod(P.random_key(self.seed, "series_id"), F.lit(folds))
        rows = write_through(train.select("series_id", F.col("label").cast("long").alias("label"), "features", part_of.cast("int").alias("_fold")))
        judged = None
        for i in range(folds):
            own = rows.where(F.col("_fold") != i)
            part = hard_votes(self._rows({n: m(own) for n, m in self.members.items()}, rows.where(F.col("_fold") == i)))
            judged = part if judged is None else judged.unionByName(part)
        hits = judged.join(rows.select("series_id", "label"), "series_id").groupBy("member").agg(
            F.avg((F.col("prediction") == F.col("label")).cast("double")).alias("weight"))
        self.weights = write_through(hits)  # a row per member
        self.fitted = {n: m(rows) for n, m in self.members.items()}
        return self

    def predict_soft(self, rows: DataFrame) -> DataFrame:
        """(series_id, prediction, p) by weighted mean probability."""
        return voting_soft(self._rows(self.fitted, rows), self.weights)

    def predict_hard(self, rows: DataFrame) -> DataFrame:
        """(series_id, prediction, weight) by weighted majority."""
        return voting_hard(hard_votes(self._rows(self.fitted, rows)), self.weights)


# ----------------------------------------------------------------- rotation forest


def rotation_matrices(df: DataFrame, dims: int, trees: int, seed: int = 0) -> list[np.ndarray]:
    """Block rotations of all trees from one pass over the data.

    Each feature batch has min(floor(sqrt(d)), n) columns; its components come from the
    moments of a bootstrap sample, drawn as Poisson(1) row weights from a hash of the row.
    """
    n = df.count()
    size = max(1, min(int(math.sqrt(dims)), n))
    batches = [list(range(a, min(a + size, dims))) for a in range(0, dims, size)]

    def run(tables):
        total: dict = {}
        for table in tables:
            x = kernels.Ragged.from_arrow(table.column("features")).flat.reshape(table.num_rows, dims)
            keys = table.column("_h").to_numpy(zero_copy_only=False)
            for t in range(trees):
                for b, cols in enumerate(batches):
                    mix = (keys ^ np.int64(((seed * 1_000_003 + t) * 8191 + b) * 0x9E3779B1 & 0x7FFFFFFF)).view(np.uint64)
                    mix = (mix ^ (mix >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
                    mix = (mix ^ (mix >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
                    u = (mix >> np.uint64(11)).astype(np.float64) / float(1 << 53)
                    w = np.searchsorted(POISSON, u).astype(np.float64)
                    part = np.hstack([np.ones((len(x), 1)), x[:, cols]])
                    m = (part * w[:, None]).T @ part
                    total[(t, b)] = m if (t, b) not in total else total[(t, b)] + m
        for (t, b), m in total.items():
            v = m.reshape(-1)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(v), t, np.int32)), pa.array(np.full(len(v), b, np.int32)),
                                              pa.array(np.arange(len(v), dtype=np.int32)), pa.array(v)], names=["t", "b", "i", "v"])

    sums = df.select(F.col("features"), F.xxhash64("series_id").alias("_h")).mapInArrow(
        run, "t int, b int, i int, v double").groupBy("t", "b", "i").agg(F.sum("v").alias("v"))
    moments: dict = {}
    for r in sums.collect():  # trees x batches x size^2 numbers
        moments.setdefault((r["t"], r["b"]), {})[r["i"]] = r["v"]
    out = []
    for t in range(trees):
        full = np.zeros((dims, dims))
        for b, cols in enumerate(batches):
            m = np.array([moments[(t, b)][i] for i in range((len(cols) + 1) ** 2)]).reshape(len(cols) + 1, -1)
            mean = m[0, 1:] / m[0, 0]
            cov = m[1:, 1:] / m[0, 0] - np.outer(mean, mean)
            values, vectors = np.linalg.eigh(cov)
            full[np.ix_(cols, cols)] = vectors[:, ::-1].T  # components as rows, largest first
        out.append(full)
    return out


# Cumulative Poisson(1) probabilities of 0, 1, 2, ...
POISSON = np.cumsum([math.exp(-1) / math.factorial(i) for i in range(16)])


def rotate(df: DataFrame, matrix: np.ndarray) -> DataFrame:
    """Multiply the ``features`` array by a small shared matrix, as vector ``rotated``."""
    keep = [c for c in df.columns if c not in ("features", "rotated")]
    schema = T.StructType([df.schema[c] for c in keep] + [T.StructField("_r", T.ArrayType(T.DoubleType()))])
    dims = len(matrix)

    def run(batches):
        for batch in batches:
            x = kernels.Ragged.from_arrow(batch.column("features")).flat.reshape(batch.num_rows, dims) @ matrix
            offsets = pa.array(np.arange(len(x) + 1, dtype=np.int32) * dims)
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in keep] + [
                pa.ListArray.from_arrays(offsets, pa.array(np.ascontiguousarray(x).reshape(-1)))], names=schema.fieldNames())

    return df.select(*keep, "features").mapInArrow(run, schema).withColumn("rotated", array_to_vector("_r")).drop("_r")


class RotationForest:
    """Trees on rotated features; probabilities are averaged."""

    def __init__(self, trees: int = 50, max_depth: int = 15, seed: int = 0):
        self.trees, self.max_depth, self.seed = trees, max_depth, seed

    def fit(self, df: DataFrame):
        """df: series_id, label, features (array<double>)."""
        dims = df.select(F.size("features")).first()[0]
        self.classes = int(df.agg(F.max("label")).first()[0]) + 1
        self.members = []
        for matrix in rotation_matrices(df, dims, self.trees, self.seed):
            tree = DecisionTreeClassifier(featuresCol="rotated", maxDepth=self.max_depth, seed=self.seed)
            self.members.append((matrix, tree.fit(rotate(df.select("series_id", F.col("label").cast("double"), "features"), matrix))))
        return self

    def predict_proba(self, df: DataFrame) -> DataFrame:
        """(series_id, class, p), averaged over the trees."""
        rows = None
        for i, (matrix, model) in enumerate(self.members):
            part = class_rows(model.transform(rotate(df.select("series_id", "features"), matrix)), str(i), self.classes)
            rows = part if rows is None else rows.unionByName(part)
        return rows.groupBy("series_id", "class").agg((F.sum("p") / len(self.members)).alias("p"))

    def predict(self, df: DataFrame) -> DataFrame:
        return self.predict_proba(df).groupBy("series_id").agg(
            F.max_by("class", F.struct(F.round("p", 9), -F.col("class"))).alias("prediction"))


def rotation_tree(df: DataFrame, max_depth: int = 15, seed: int = 0) -> RotationForest:
    return RotationForest(1, max_depth, seed).fit(df)


def discovery_grid(series: DataFrame, lengths=None, shapelet_counts=None, folds: int | None = None, seed: int = 0,
                  search: dict | None = None, final: dict | None = None):
    """Tune discovery bounds by cross-validated log loss, then discover once more with the best.

    Returns (ShapeletModel, max_len, max_shaps). ``search`` and ``final`` override the
    discovery settings of the two phases.
    """
    from wavelane.ml.estimators import GeneticShapelets

    rows = P.encode_labels(series).withColumn("label", F.col("label_index").cast("double")).drop("label_index")
    size = rows.agg(F.max(F.size("values"))).first()[0]
    lengths = lengths or [size // 4, size // 2, 3 * size // 4, size]
    shapelet_counts = shapelet_counts or [int(math.sqrt(size)), 100, 1000]
    genetic = GeneticShapelets(**{"populationSize": 10, "iterations": 25, "wait": 5, "seed": seed, **(search or {})})
    lr = LogisticRegression(family="multinomial", standardization=False, regParam=1.0 / rows.count())
    grid = ParamGridBuilder().addGrid(genetic.maxLen, lengths).addGrid(genetic.maxShaps, shapelet_counts).build()
    cv = CrossValidator(estimator=Pipeline(stages=[genetic, lr]), estimatorParamMaps=grid,
                        numFolds=folds or folds_for(rows), seed=seed,
                        evaluator=MulticlassClassificationEvaluator(metricName="logLoss"))
    fitted = cv.fit(rows)
    best = grid[int(np.argmin(fitted.avgMetrics))]
    max_len, max_shaps = best[genetic.maxLen], best[genetic.maxShaps]
    last = GeneticShapelets(**{"populationSize": 100, "iterations": 100, "wait": 10, "seed": seed, **(final or {}),
                               "maxLen": max_len, "maxShaps": max_shaps})
    return last.fit(rows), max_len, max_shaps
