"""Shapelet pools cut from the mean series of each label."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def label_means(series: DataFrame, digits: int = 6) -> DataFrame:
    """(label, p, x): mean value per label and position."""
    points = series.select("label", F.posexplode("values").alias("p", "x"))
    return points.groupBy("label", "p").agg(F.round(F.avg("x"), digits).alias("x"))


def mean_segments(series: DataFrame, length: int, shapelet_id) -> DataFrame:
    """Cut each label's mean series into consecutive segments of ``length`` points.

    ``shapelet_id(label, segment)`` builds the id column. A segment has at most
    ``length`` points, so the collected groups are bounded.
    """
    means = label_means(series).withColumn("_seg", F.floor(F.col("p") / length).cast("int"))
    return means.groupBy("label", "_seg").agg(
        F.sort_array(F.collect_list(F.struct("p", "x"))).alias("_items")).select(
        shapelet_id(F.col("label"), F.col("_seg")).alias("shapelet_id"),
        F.transform("_items", lambda e: e["x"]).alias("values"))


def emb_pool(series: DataFrame) -> DataFrame:
    return mean_segments(series, 16, lambda label, seg: (label * 4 + seg).cast("long"))


def user_pool(series: DataFrame) -> DataFrame:
    return mean_segments(series, 12, lambda label, seg: F.concat(label, F.lit("/"), seg.cast("string")))
