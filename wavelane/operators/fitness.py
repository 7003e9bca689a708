"""Fitness of shapelet sets over shared distance features.

A fitness takes (features, members, classes, max_passes, verbose) and returns a table
(ind_id, score). ``features`` has one row per series (label_index, features) over the distinct
shapelets of a generation; ``members`` lists each set's feature slots (ind_id, slots) and
is as large as the population.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from wavelane.functions import logistic

SHARED_CELLS = 4 * 1024 * 1024  # largest feature table shipped whole to each task (32 MB)


def _batch(batch, width):
    y = batch.column("label_index").to_numpy(zero_copy_only=False).astype(np.int64)
    x = batch.column("features").flatten().to_numpy(zero_copy_only=False).reshape(len(y), width)
    return x, y


def _sum_by_slot(features: DataFrame, width: int, fn) -> dict:
    """Add up the vectors ``fn(x, y)`` gives per batch: {id: vector} over the whole table."""
    def run(batches):
        total: dict = {}
        for batch in batches:
            if batch.num_rows:
                for key, vector in fn(*_batch(batch, width)).items():
                    total[key] = vector if key not in total else total[key] + vector
        for key, vector in total.items():
            yield pa.RecordBatch.from_arrays([
                pa.array(np.full(len(vector), key, np.int64)), pa.array(np.arange(len(vector), dtype=np.int64)),
                pa.array(vector)], names=["id", "slot", "v"])

    sums = features.select("label_index", "features").mapInArrow(run, "id long, slot long, v double")
    out: dict = {}
    # one number per model parameter, whatever the number of rows
    for row in sums.groupBy("id", "slot").agg(F.sum("v").alias("v")).collect():
        out.setdefault(row["id"], {})[row["slot"]] = row["v"]
    return {key: np.array([v[i] for i in range(len(v))]) for key, v in out.items()}


def fit_sets(features: DataFrame, members: DataFrame, classes: int, max_passes: int = 100,
             tol: float = 1e-4, shared_cells: int = SHARED_CELLS) -> DataFrame:
    """Fit one model per shapelet set: (ind_id, rows, loss, hits, passes, converged, weights).

    A feature table within ``shared_cells`` is shipped to the tasks, which fit whole sets in
    parallel. Otherwise every pass over the table serves all sets still open, and only summed
    gradients come back.
    """
    spark = features.sparkSession
    shape = features.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("features")).alias("d")).first()
    n, width = shape["n"], shape["d"] or 0
    schema = "ind_id long, rows long, loss double, hits double, passes int, converged boolean, weights array<double>"
    if n * width <= shared_cells:
        table = features.select("label_index", "features").toArrow().combine_chunks()
        x, y = _batch(table.to_batches()[0], width)
        shared = spark.sparkContext.broadcast((x, y))

        def fit(frames):
            x, y = shared.value
            for frame in frames:
                out = []
                for ind, slots in zip(frame["ind_id"], frame["slots"]):
                    own = x[:, np.asarray(slots, dtype=np.int64)]
                    done = logistic.fit_many({0: logistic.gram(own)}, lambda asks: {
                        0: logistic.softmax_sums(own, y, asks[0])}, classes, tol, max_passes)
                    w, loss, hits, passes, converged = done[0]
                    out.append((ind, len(y), loss, hits, passes, converged, w.reshape(-1).tolist()))
                yield pd.DataFrame(out, columns=["ind_id", "rows", "loss", "hits", "passes", "converged", "weights"])

        tasks = spark.sparkContext.defaultParallelism
        return members.select("ind_id", "slots").repartition(tasks, "ind_id").mapInPandas(fit, schema)

    slots = {r["ind_id"]: np.asarray(r["slots"], dtype=np.int64) for r in members.collect()}
    moments = _sum_by_slot(features, width, lambda x, y: {
        i: logistic.gram(x[:, s]).reshape(-1) for i, s in slots.items()})
    problems = {i: m.reshape(len(slots[i]) + 1, -1) for i, m in moments.items()}

    def evaluate(asks):
        shared = spark.sparkContext.broadcast({i: (slots[i], w) for i, w in asks.items()})

        def sums(x, y):
            out = {}
            for i, (s, w) in shared.value.items():
                loss, grad, hits = logistic.softmax_sums(x[:, s], y, w)
                out[i] = np.concatenate([[loss, hits], grad.reshape(-1)])
            return out

        got = _sum_by_slot(features, width, sums)
        shared.destroy()
        return {i: (v[0], v[2:].reshape(asks[i].shape), v[1]) for i, v in got.items()}

    done = logistic.fit_many(problems, evaluate, classes, tol, max_passes)
    return spark.createDataFrame([(int(i), int(n), float(loss), float(hits), int(passes), converged, w.reshape(-1).tolist())
                                  for i, (w, loss, hits, passes, converged) in done.items()], schema)


def logloss_fitness(features, members, classes, max_passes, verbose):
    """Negative mean training log loss of a logistic regression on the set's distances."""
    fits = fit_sets(features, members, classes, max_passes)
    return fits.select("ind_id", (-F.col("loss") / F.col("rows")).alias("score"))


def f1_fitness(features, members, classes, max_passes, verbose):
    """Micro-averaged F1 of the same model, which equals its training accuracy."""
    fits = fit_sets(features, members, classes, max_passes)
    return fits.select("ind_id", (F.col("hits") / F.col("rows")).alias("score"))


def logloss_fitness_location(features, members, classes, max_passes, verbose):
    """``logloss_fitness`` on distances and match locations."""
    half = features.select(F.size("features").alias("s")).limit(1).first()["s"] // 2
    both = members.select("ind_id", F.concat("slots", F.transform("slots", lambda s: s + half)).alias("slots"))
    return logloss_fitness(features, both, classes, max_passes, verbose)


logloss_fitness_location.needs_location = True


def class_scatter_fitness(features, members, classes, max_passes, verbose):
    """Between-class scatter share of the set: one aggregation, no model."""
    long = features.select("label_index", F.posexplode("features").alias("slot", "x"))
    per = long.groupBy("slot", "label_index").agg(
        F.count("x").alias("n"), F.avg("x").alias("m"), F.var_samp("x").alias("v"))
    one = per.groupBy("slot").agg(F.sum("n").alias("N"), F.sum(F.col("n") * F.col("m")).alias("s"),
                                  F.sum("v").alias("sw"), F.collect_list(F.struct("n", "m")).alias("c"))
    grand = F.col("s") / F.col("N")
    sb = F.aggregate("c", F.lit(0.0), lambda a, e: a + e["n"] * (e["m"] - grand) * (e["m"] - grand))
    one = one.select("slot", "sw", sb.alias("sb"))
    return members.select("ind_id", F.explode("slots").alias("slot")).join(one, "slot").groupBy("ind_id").agg(
        (F.sum("sb") / (F.sum("sw") + F.sum("sb"))).alias("score"))
