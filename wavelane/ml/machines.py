"""One-vs-one linear machines with probabilities; all pairs of classes, folds and settings are trained in the same passes.

A machine minimises |w|^2 / 2 + C * sum(max(0, 1 - y f)^2) over the rows of its two classes. From the rows inside the margin alone
the next weights follow by a linear system, so a pass over the rows returns one matrix for every machine, summed over tasks, and the
weights settle in a few passes. Margins of rows that a machine has not seen (folds) calibrate a sigmoid per pair, again a pass
per Newton step. Class probabilities p couple the pairs' r_ij by the smallest sum of (r_ji p_i - r_ij p_j)^2 with sum(p) = 1.

Features are scaled by the smallest and largest of the training rows; degree 2 adds all products. What the driver holds is the
size of the models: settings x folds x pairs x features^2.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, functions as F

from wavelane.operators import prep as P
from wavelane.runtime import write_through

CHUNK = 1 << 16          # numbers in a row of sums
LARGEST = 64 * 1024 ** 2  # numbers that a pass may return


def expanded(x: np.ndarray, low: np.ndarray, high: np.ndarray, degree: int) -> np.ndarray:
    """Scaled features, their products where the degree is 2, and a one for the offset."""
    x = (x - low) / np.where(high > low, high - low, 1.0)
    parts = [x]
    if degree > 1:
        i, j = np.triu_indices(x.shape[1])
        parts.append(x[:, i] * x[:, j])
    return np.hstack([*parts, np.ones((len(x), 1))])


def summed(rows: DataFrame, fn, size: int) -> np.ndarray:
    """Sum over all rows of ``fn(batch)``, an array of ``size`` numbers; tasks add up their batches, Spark the tasks."""
    def run(batches):
        total = np.zeros(size)
        for batch in batches:
            if len(batch):
                total += fn(batch)
        for k, at in enumerate(range(0, size, CHUNK)):
            yield pd.DataFrame({"k": [k], "part": [total[at:at + CHUNK].tobytes()]})

    def add(part: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"k": [part["k"].iloc[0]], "part": [np.sum([np.frombuffer(p) for p in part["part"]], axis=0).tobytes()]})

    schema = "k int, part binary"
    found = rows.mapInPandas(run, schema).groupBy("k").applyInPandas(add, schema).collect()
    return np.concatenate([np.frombuffer(r["part"]) for r in sorted(found, key=lambda r: r["k"])]) if found else np.zeros(size)


def couple(r: np.ndarray) -> np.ndarray:
    """Class probabilities (n, K) from pair probabilities r (n, K, K) with r_ij + r_ji = 1."""
    n, k, _ = r.shape
    q = -r.transpose(0, 2, 1) * r
    q[:, range(k), range(k)] = 0.0
    q[:, range(k), range(k)] = (r ** 2).sum(axis=1) - r[:, range(k), range(k)] ** 2
    system = np.ones((n, k + 1, k + 1))
    system[:, :k, :k], system[:, k, k] = q, 0.0
    p = np.linalg.solve(system, np.broadcast_to(np.eye(k + 1)[k][:, None], (n, k + 1, 1)))[:, :k, 0]
    p = np.maximum(p, 0.0)
    return p / p.sum(axis=1, keepdims=True)


class PairMachines:
    """Fitted machines: ``weights`` and ``sigmoids`` per pair of classes, the chosen C and its accuracy on held-out rows."""

    def __init__(self, classes, pairs, low, high, degree, weights, sigmoids, c, accuracy, converged):
        self.classes, self.pairs, self.low, self.high, self.degree = classes, pairs, low, high, degree
        self.weights, self.sigmoids, self.c, self.accuracy, self.converged = weights, sigmoids, c, accuracy, converged

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        margins = expanded(x, self.low, self.high, self.degree) @ self.weights.T
        r = np.full((len(x), self.classes, self.classes), 0.5)
        for p, (i, j) in enumerate(self.pairs):
            a, b = self.sigmoids[p]
            r[:, i, j] = np.clip(1 / (1 + np.exp(np.clip(a * margins[:, p] + b, -500, 500))), 1e-7, 1 - 1e-7)
            r[:, j, i] = 1 - r[:, i, j]
        return couple(r)

    def predict(self, rows: DataFrame) -> DataFrame:
        """(series_id, class, p) in one narrow stage."""
        shared = rows.sparkSession.sparkContext.broadcast(self)
        kind = rows.schema["series_id"].dataType.simpleString()

        def run(batches):
            for batch in batches:
                if len(batch):
                    own = shared.value
                    p = own.probabilities(np.array(batch["x"].tolist(), dtype=float))
                    yield pd.DataFrame({"series_id": np.repeat(batch["series_id"].to_numpy(), own.classes),
                                        "class": np.tile(np.arange(own.classes), len(batch)), "p": p.reshape(-1)})

        return _arrays(rows, "series_id").mapInPandas(run, f"series_id {kind}, class long, p double")


def _arrays(rows: DataFrame, *keep) -> DataFrame:
    plain = rows.schema["features"].dataType.simpleString().startswith("array")
    return rows.select(*keep, (F.col("features") if plain else vector_to_array("features")).alias("x"))


def fit_machines(train: DataFrame, cs=(1.0,), degree: int = 1, folds: int = 3, seed: int = 0, passes: int = 20) -> PairMachines:
    """train: series_id, label (0..K-1), features. The C with the best held-out accuracy wins, the first of equals."""
    rows = write_through(_arrays(train.withColumn("_fold", F.pmod(P.random_key(seed, "series_id"), F.lit(folds)).cast("int")),
                                 "series_id", F.col("label").cast("int").alias("label"), "_fold"))
    width = len(rows.first()["x"])
    facts = rows.agg(F.max("label").alias("label"), *[f(F.col("x")[i]).alias(f"{n}{i}") for i in range(width) for n, f in (("l", F.min), ("h", F.max))]).first()
    low, high = (np.array([facts[f"{n}{i}"] for i in range(width)], float) for n in "lh")
    classes = facts["label"] + 1
    pairs = list(combinations(range(classes), 2))
    cs = [float(c) for c in cs]
    size = expanded(np.zeros((1, width)), low, high, degree).shape[1]
    cost = np.repeat(cs, folds + 1)  # machines of a pair: every C without each fold, then with all rows
    held = np.tile([*range(folds), -1], len(cs))
    shape = (len(pairs), len(cost))
    weights = np.zeros((*shape, size))
    if weights.size * (size + 1) > LARGEST:
        raise ValueError("too many machines or features for one pass: fewer settings, or the margins of classifiers.linear_svm_grid")
    spark = rows.sparkSession

    def own(batch):
        return expanded(np.array(batch["x"].tolist(), dtype=float), low, high, degree), batch["label"].to_numpy(), batch["_fold"].to_numpy()

    def moments(shared):
        def fn(batch):
            x, label, fold = own(batch)
            out = np.zeros((*shape, size, size + 1))
            for p, (i, j) in enumerate(pairs):
                mine = (label == i) | (label == j)
                xs, y = x[mine], np.where(label[mine] == i, 1.0, -1.0)
                inside = (y[:, None] * (xs @ shared.value[p].T) < 1) & (fold[mine][:, None] != held)
                for m in range(len(held)):
                    part, sign = xs[inside[:, m]], y[inside[:, m]]
                    out[p, m, :, :size], out[p, m, :, size] = part.T @ part, part.T @ sign
            return out.reshape(-1)
        return fn

    penalty = np.append(np.ones(size - 1), 1e-8)
    converged = False
    for _ in range(passes):
        shared = spark.sparkContext.broadcast(weights)
        sums = summed(rows, moments(shared), weights.size * (size + 1)).reshape(*shape, size, size + 1)
        scale = 2 * cost[None, :, None]
        found = np.linalg.solve(scale[..., None] * sums[..., :size] + np.diag(penalty), (scale * sums[..., size])[..., None])[..., 0]
        change, weights = np.abs(found - weights).max(), found
        if change <= 1e-7 * max(1.0, np.abs(weights).max()):
            converged = True
            break
    shared = spark.sparkContext.broadcast(weights)

    def hits(batch):
        x, label, fold = own(batch)
        out = np.zeros(len(cs) + 1)
        for c in range(len(cs)):
            votes = np.zeros((len(x), classes))
            for p, (i, j) in enumerate(pairs):
                margin = (x * shared.value[p, c * (folds + 1) + fold]).sum(axis=1)
                votes[np.arange(len(x)), np.where(margin > 0, i, j)] += 1
            out[c] = (votes.argmax(axis=1) == label).sum()
        out[-1] = len(x)
        return out

    right = summed(rows, hits, len(cs) + 1)
    best = int(right[:-1].argmax())

    def sigmoid_sums(params):
        def fn(batch):
            x, label, fold = own(batch)
            out = np.zeros((len(pairs), 8))
            for p, (i, j) in enumerate(pairs):
                mine = (label == i) | (label == j)
                f = (x[mine] * shared.value[p, best * (folds + 1) + fold[mine]]).sum(axis=1)
                up = label[mine] == i
                out[p, :2] = up.sum(), (~up).sum()
                if params is not None:
                    a, b, high_t, low_t = params[p]
                    z = np.clip(a * f + b, -500, 500)
                    q, t = 1 / (1 + np.exp(z)), np.where(up, high_t, low_t)
                    d, w = t - q, q * (1 - q)
                    out[p, 2:] = (d * f).sum(), d.sum(), (w * f * f).sum(), (w * f).sum(), w.sum(), (t * z + np.logaddexp(0, -z)).sum()
            return out.reshape(-1)
        return fn

    n = summed(rows, sigmoid_sums(None), 8 * len(pairs)).reshape(len(pairs), 8)[:, :2]
    targets = np.stack([(n[:, 0] + 1) / (n[:, 0] + 2), 1 / (n[:, 1] + 2)], axis=1)
    at = np.stack([np.zeros(len(pairs)), np.log((n[:, 1] + 1) / (n[:, 0] + 1))], axis=1)
    step, last = np.zeros_like(at), np.full(len(pairs), np.inf)
    for _ in range(passes):
        s = summed(rows, sigmoid_sums(np.hstack([at + step, targets])), 8 * len(pairs)).reshape(len(pairs), 8)
        better = s[:, 7] <= last + 1e-12
        at, last = np.where(better[:, None], at + step, at), np.where(better, s[:, 7], last)
        hessian = np.stack([s[:, [4, 5]], s[:, [5, 6]]], axis=1) + 1e-9 * np.eye(2)
        newton = -np.linalg.solve(hessian, s[:, 2:4, None])[..., 0]
        step = np.where(better[:, None], newton, step / 2)  # a step that makes things worse is halved
        if np.abs(step).max() < 1e-6:
            break
    return PairMachines(classes, pairs, low, high, degree, weights[:, best * (folds + 1) + folds], at, cs[best], right[best] / max(right[-1], 1), converged)


def machine_member(cs=(1.0,), degree: int = 1, folds: int = 3):
    """A member of a voting ensemble: machines whose probabilities are mixed with the others'."""
    def fit(rows: DataFrame):
        return fit_machines(rows, cs, degree, folds).predict
    return fit
