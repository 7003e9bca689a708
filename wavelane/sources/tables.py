"""Labelled series derived from the star-schema and event tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from wavelane.sources.readers import series_from_long


def read(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def emb_series(spark, folder) -> DataFrame:
    """Fixed-length series: one embedding per row, integer labels."""
    return read(spark, folder, "embeddings").select(
        F.col("vec_id").alias("series_id"), F.col("label"),
        F.col("embedding").cast("array<double>").alias("values"))


def user_points(spark, folder) -> DataFrame:
    return read(spark, folder, "events").select(
        F.col("user_id").alias("series_id"), F.col("ts"), F.col("event_id"), F.col("value"))


def user_series(spark, folder) -> DataFrame:
    """Ragged series of event values per user, labelled by the most frequent event type."""
    events = read(spark, folder, "events")
    counts = events.groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n"))
    # most frequent type, first name on ties
    label = counts.groupBy(F.col("user_id").alias("series_id")).agg(
        F.min(F.struct(-F.col("n"), F.col("event_type")))["event_type"].alias("label"))
    return series_from_long(user_points(spark, folder), "series_id", ["ts", "event_id"], "value").join(
        label, "series_id").select("series_id", "label", "values")


def customer_points(spark, folder) -> DataFrame:
    return read(spark, folder, "orders").select(
        F.col("o_custkey").alias("series_id"), "o_orderdate", "o_orderkey", "o_totalprice")


def customer_series(spark, folder) -> DataFrame:
    """Order values per customer; short and ragged, string labels."""
    customer = read(spark, folder, "customer").select(
        F.col("c_custkey").alias("series_id"), F.col("c_mktsegment").alias("label"))
    return series_from_long(customer_points(spark, folder), "series_id", ["o_orderdate", "o_orderkey"],
                            "o_totalprice").join(customer, "series_id").select(
        "series_id", "label", "values")


def part_series(spark, folder) -> DataFrame:
    """Shipped quantities per part in date order, labelled by brand."""
    points = read(spark, folder, "lineitem").select(
        F.col("l_partkey").alias("series_id"), "l_shipdate", "l_orderkey", "l_linenumber", "l_quantity")
    part = read(spark, folder, "part").select(
        F.col("p_partkey").alias("series_id"), F.col("p_brand").alias("label"))
    return series_from_long(points, "series_id", ["l_shipdate", "l_orderkey", "l_linenumber"],
                            "l_quantity").join(part, "series_id").select("series_id", "label", "values")
