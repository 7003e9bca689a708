"""Scoring of predictions and comparison of methods over data sets."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from wavelane.operators.metrics import SPREAD, average_ranks


@F.pandas_udf(T.DoubleType())
def upper_tail(z: pd.Series) -> pd.Series:
    """P(N(0,1) > z); Spark has no error function. One value per data set."""
    return z.map(lambda v: None if v is None or math.isnan(v) else 0.5 * math.erfc(v / math.sqrt(2)))


def truth_join(predictions: DataFrame, truth: DataFrame, keys=("dataset", "row_id")) -> DataFrame:
    return predictions.join(truth, list(keys))


def accuracy(rows: DataFrame, keys: list[str], prediction: str = "prediction", label: str = "label_index") -> DataFrame:
    return rows.groupBy(*keys).agg(
        F.avg(F.when(F.col(prediction) == F.col(label), 1.0).otherwise(0.0)).alias("accuracy"),
        F.count(F.lit(1)).alias("n"))


def log_loss(rows: DataFrame, keys: list[str], probs: str = "probs", label: str = "label_index") -> DataFrame:
    p = F.element_at(probs, F.col(label).cast("int") + 1)
    clipped = F.greatest(F.least(p, F.lit(1 - 1e-15)), F.lit(1e-15))
    return rows.groupBy(*keys).agg((-F.avg(F.log(clipped))).alias("log_loss"))


def class_probabilities(rows: DataFrame, keys: list[str], label: str = "label_index") -> DataFrame:
    """Per node: class counts and shares as maps; one entry per class."""
    counts = rows.groupBy(*keys, label).agg(F.count(F.lit(1)).alias("n"))
    packed = counts.groupBy(*keys).agg(F.sum("n").alias("rows"), F.sort_array(F.collect_list(F.struct(label, "n"))).alias("_c"))
    return packed.select(*keys, "rows", F.map_from_entries("_c").alias("class_counts"), F.map_from_entries(
        F.transform("_c", lambda e: F.struct(e[label], e["n"] / F.col("rows")))).alias("class_probs"))


def generation_stats(scores: DataFrame, keys: list[str], score: str = "score") -> DataFrame:
    """Spread of a population's scores per generation (a group is one population)."""
    return scores.groupBy(*keys).agg(
        F.avg(score).alias("avg"), F.stddev_pop(score).alias("std"), F.max(score).alias("max"),
        F.min(score).alias("min"), F.percentile(score, F.lit(0.25)).alias("q25"), F.percentile(score, F.lit(0.75)).alias("q75"))


def wilcoxon(pairs: DataFrame, keys: list[str], x: str = "x", y: str = "y", spread: int = SPREAD, digits: int | None = None) -> DataFrame:
    """Paired signed-rank test per key: statistic, z and two-sided normal p.

    Zero differences are dropped; ties share average ranks and shrink the variance. With ``digits``, what is left is rounded
    before it is ranked, so that means summed in another order tie as equal ones do.
    """
    d = F.col(x) - F.col(y)
    diff = pairs.where(d != 0).select(*keys, (d if digits is None else F.round(d, digits)).alias("d")).withColumn("a", F.abs("d"))
    ranks = average_ranks(diff, keys, "a", spread)
    signed = diff.groupBy(*keys, "a").agg(F.count(F.when(F.col("d") > 0, 1)).alias("up"), F.count(F.when(F.col("d") < 0, 1)).alias("down"))
    sums = ranks.join(signed, [*keys, "a"]).groupBy(*keys).agg(
        F.max("rows").alias("n"), F.sum(F.col("rank") * F.col("up")).alias("plus"),
        F.sum(F.col("rank") * F.col("down")).alias("minus"),
        F.sum(F.col("t").cast("double") * F.col("t") * F.col("t") - F.col("t")).alias("ties"))
    n = F.col("n").cast("double")
    stat = F.least("plus", "minus")
    se = F.sqrt((n * (n + 1) * (2 * n + 1) - 0.5 * F.col("ties")) / 24)
    out = sums.select(*keys, "n", stat.alias("statistic"), ((stat - n * (n + 1) / 4) / se).alias("z"))
    return out.withColumn("p_value", 2 * upper_tail(F.abs("z")))


def mann_whitney(samples: DataFrame, keys: list[str], group: str, first: str, second: str,
                 value: str = "value", alpha: float = 0.05, spread: int = SPREAD) -> DataFrame:
    """Rank test of two methods per key: u, z, one-sided p with continuity, and a flag.

    flag: ``\\`` if p > alpha, else ``+`` where the first method's mean is larger, else ``-``.
    """
    rows = samples.where(F.col(group).isin(first, second))
    ranks = average_ranks(rows, keys, value, spread)
    counts = rows.groupBy(*keys, value).agg(
        F.count(F.when(F.col(group) == first, 1)).alias("c1"), F.count(F.when(F.col(group) == second, 1)).alias("c2"))
    s = ranks.join(counts, [*keys, value]).groupBy(*keys).agg(
        F.sum("c1").alias("n1"), F.sum("c2").alias("n2"), F.sum(F.col("rank") * F.col("c1")).alias("r1"),
        F.sum(F.col("t").cast("double") * F.col("t") * F.col("t") - F.col("t")).alias("ties"),
        (F.sum(F.col(value) * F.col("c1")) / F.sum("c1")).alias("mean1"),
        (F.sum(F.col(value) * F.col("c2")) / F.sum("c2")).alias("mean2"))
    n1, n2 = F.col("n1").cast("double"), F.col("n2").cast("double")
    n = n1 + n2
    u1 = n1 * n2 + n1 * (n1 + 1) / 2 - F.col("r1")
    big = F.greatest(u1, n1 * n2 - u1)
    sd = F.sqrt((1 - F.col("ties") / (n * n * n - n)) * n1 * n2 * (n + 1) / 12)
    out = s.select(*keys, "n1", "n2", "mean1", "mean2", F.least(u1, n1 * n2 - u1).alias("u"),
                   ((big - (n1 * n2 / 2 + 0.5)) / sd).alias("z")).withColumn("p_value", upper_tail(F.abs("z")))
    return out.withColumn("flag", F.when(F.col("p_value") > alpha, "\\").when(
        F.col("mean1") > F.col("mean2"), "+").otherwise("-"))


def compare_methods(results: DataFrame, first: str, second: str, dataset: str = "dataset",
                    method: str = "method", value: str = "accuracy") -> DataFrame:
    """Mean and population deviation of both methods on the data sets they share.

    Deviations only where both have the same number of runs, more than one.
    """
    def side(name, i):
        return results.where(F.col(method) == name).groupBy(dataset).agg(
            F.avg(value).alias(f"mean{i}"), F.stddev_pop(value).alias(f"std{i}"), F.count(F.lit(1)).alias(f"runs{i}"))

    both = side(first, 1).join(side(second, 2), dataset)
    paired = (F.col("runs1") > 1) & (F.col("runs1") == F.col("runs2"))
    return both.select(dataset, "mean1", "mean2", F.when(paired, F.col("std1")).alias("std1"),
                       F.when(paired, F.col("std2")).alias("std2"), "runs1", "runs2")


def compare_table(results: DataFrame, first: str, second: str, dataset: str = "dataset", method: str = "method",
                  run: str = "run", value: str = "accuracy", spread: int = SPREAD, digits: int | None = None) -> DataFrame:
    """``compare_methods`` with the paired test (differences rounded to ``digits``) where the deviations are shown."""
    table = compare_methods(results, first, second, dataset, method, value)
    a = results.where(F.col(method) == first).select(dataset, run, F.col(value).alias("x"))
    b = results.where(F.col(method) == second).select(dataset, run, F.col(value).alias("y"))
    test = wilcoxon(a.join(b, [dataset, run]), [dataset], spread=spread, digits=digits).select(dataset, "statistic", "z", "p_value")
    shown = F.col("std1").isNotNull()
    return table.join(test, dataset, "left").select(
        *table.columns, *[F.when(shown, F.col(c)).alias(c) for c in ("statistic", "z", "p_value")])


def sort_report(table: DataFrame, difference: Column, dataset: str = "dataset") -> DataFrame:
    return table.withColumn("difference", difference).orderBy("difference", dataset)


def mixed_report(samples: DataFrame, first: str, others: list[str], facts: DataFrame | None = None, dataset: str = "dataset",
                 method: str = "method", value: str = "value", alpha: float = 0.05, spread: int = SPREAD) -> DataFrame:
    """One row per data set with all methods: one method against each of the others, with rank tests and flags.

    Columns: the data set, those of ``facts`` (one row per data set), runs and mean of the first method, and for other method i
    ``mean_i``, ``u_i``, ``z_i``, ``p_value_i``, ``flag_i`` (see ``mann_whitney``) and ``difference_i`` = mean - mean_i. Data sets
    without runs of the first method have no row; comparisons without runs of the other method are null. Ordered by the
    first difference, then the data set. All comparisons are ranked in one pass; the samples are read once.
    """
    name = F.col(method)
    against = F.explode(F.when(name == first, F.array(*map(F.lit, others))).otherwise(F.array(name)))
    rows = samples.where(name.isin(first, *others)).withColumn("_against", against)
    side = rows.withColumn("_side", F.when(name == first, "first").otherwise("other"))
    tests = mann_whitney(side, [dataset, "_against"], "_side", "first", "other", value, alpha, spread).where("n1 > 0")

    def of(i, column):
        return F.max(F.when(F.col("_against") == others[i], F.when(F.col("n2") > 0, F.col(column))))

    wide = tests.groupBy(dataset).agg(F.max("n1").alias("runs"), F.max("mean1").alias("mean"), *[
        of(i, c).alias(f"{n}_{i + 1}") for i in range(len(others)) for c, n in (
            ("mean2", "mean"), ("u", "u"), ("z", "z"), ("p_value", "p_value"), ("flag", "flag"))])
    wide = wide.select("*", *[(F.col("mean") - F.col(f"mean_{i + 1}")).alias(f"difference_{i + 1}") for i in range(len(others))])
    table = wide if facts is None else facts.join(wide, dataset)
    return table.orderBy("difference_1", dataset)


def length_percentiles(shapelets: DataFrame, low: float = 25, high: float = 75, length: str = "length") -> DataFrame:
    """(min_len, max_len) from percentiles of winning lengths; distinct lengths are few."""
    out = shapelets.agg(F.floor(F.percentile(length, F.lit(low / 100))).alias("min_len"),
                        F.floor(F.percentile(length, F.lit(high / 100))).alias("hi"))
    return out.select("min_len", F.greatest(F.col("min_len") + 1, F.col("hi")).alias("max_len"))
