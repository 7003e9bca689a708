"""Synthetic labelled series for tests and trials."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

# Fixed base patterns: label, copies, noise deviation, points.
PATTERNS = [
    (0, 25, 0.01, [0, 1, 0, -1, 0, 1, 0, -1, 0, 1, 0]),
    (1, 5, 0.05, [0, 0, -1, 0, 1, 0, -1, 0, 1, 0, 0]),
    (2, 5, 0.05, [0, 0, 1, 0, -1, 0, 1, 0, -1, 0, 0]),
]


def _normal(seed: int, *keys):
    """Standard normal draw from a hash of the seed and keys, the same on every run."""
    def unit(i):
        return (F.pmod(F.xxhash64(F.lit(seed), F.lit(i), *keys), F.lit(1 << 53)) + 0.5) / float(1 << 53)
    return F.sqrt(-2 * F.log(unit(0))) * F.cos(2 * math.pi * unit(1))


def gen_imbalanced3(spark: SparkSession, seed: int = 0, scale: int = 1) -> DataFrame:
    """Noisy copies of three patterns, 25/5/5 per unit of ``scale``, with train and test splits."""
    table = spark.createDataFrame([(l, n * scale, s, [float(v) for v in p]) for l, n, s, p in PATTERNS],
                                  "label int, copies int, sd double, base array<double>")
    rows = table.select("*", F.explode(F.array(F.lit("train"), F.lit("test"))).alias("split")).select(
        "*", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy"))
    values = F.transform("base", lambda v, i: v + F.col("sd") * _normal(seed, F.col("split"), F.col("label"), F.col("copy"), i))
    sid = F.xxhash64("split", "label", "copy")
    return rows.select(sid.alias("series_id"), "split", "label", values.alias("values"))


def gen_sinusoids(spark: SparkSession) -> DataFrame:
    """Four series of 41 points over one period: sin, -|sin shifted|, sin shifted, |sin|."""
    angle = F.transform(F.sequence(F.lit(0), F.lit(1600), F.lit(40)), lambda t: t * (2 * math.pi * 5 / 8000))
    base = spark.range(4).select(F.col("id").alias("series_id"), angle.alias("a"))
    k = F.col("series_id")
    point = lambda a: (F.when(k == 0, F.sin(a)).when(k == 1, -F.abs(F.sin(a + math.pi)))
                       .when(k == 2, F.sin(a + math.pi)).otherwise(F.abs(F.sin(a))))
    return base.select("series_id", F.floor(k / 2).cast("int").alias("label"), F.transform("a", point).alias("values"))


def gen_random_walk_blobs(spark: SparkSession, per_class: int = 20, classes: int = 2, size: int = 64,
                          noise: float = 0.1, seed: int = 0) -> DataFrame:
    """One random walk per class, plus noisy copies of it."""
    steps = spark.range(classes).select(F.col("id").alias("label"), F.explode(F.sequence(F.lit(0), F.lit(size - 1))).alias("p"))
    walk = steps.withColumn("x", F.sum(_normal(seed, F.col("label"), F.col("p"))).over(Window.partitionBy("label").orderBy("p")))
    base = walk.groupBy("label").agg(F.sort_array(F.collect_list(F.struct("p", "x"))).alias("_w"))
    copies = base.select("label", "_w", F.explode(F.sequence(F.lit(0), F.lit(per_class - 1))).alias("copy"))
    return copies.select(
        (F.col("label") * per_class + F.col("copy")).alias("series_id"), F.col("label").cast("int").alias("label"),
        F.transform("_w", lambda e: e["x"] + noise * _normal(seed + 1, F.col("label"), F.col("copy"), e["p"])).alias("values"))
