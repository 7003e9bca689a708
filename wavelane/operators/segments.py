"""Series too long for one row: overlapping segments, matched exactly.

A key may hold a large share of all points. Its rows are ranked by range partitions of
(key, order), so no task sees the whole series, and cut into segments of bounded size.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from wavelane.operators.distance import min_distance
from wavelane.runtime import write_through


def ranked_points(df: DataFrame, key: str, order: list[str], value: str, partitions: int | None = None) -> DataFrame:
    """(series_id, pos, value): position of every row within its key, from 0.

    Rows are range-partitioned by key and order, numbered inside a partition, and shifted by the
    rows of the same key in earlier partitions. The numbered rows are written once, because
    the range bounds are sampled and both readers must see the same ones.
    """
    spark = df.sparkSession
    parts = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = df.select(F.col(key).alias("series_id"), *order, F.col(value).cast("double").alias("_v"))
    ranged = rows.repartitionByRange(parts, "series_id", *order).withColumn("_part", F.spark_partition_id())
    by = Window.partitionBy("_part", "series_id").orderBy(*order)
    local = write_through(ranged.withColumn("_i", F.row_number().over(by) - 1).select("series_id", "_part", "_i", "_v"))
    counts = local.groupBy("series_id", "_part").agg(F.count(F.lit(1)).alias("_n"))
    run = Window.partitionBy("series_id").orderBy("_part")
    offsets = counts.select("series_id", "_part", (F.sum("_n").over(run) - F.col("_n")).alias("_before"))
    return local.join(offsets, ["series_id", "_part"]).select(
        "series_id", (F.col("_before") + F.col("_i")).alias("pos"), F.col("_v").alias("value"))


def segments_from_long(df: DataFrame, key: str, order: list[str], value: str, points: int = 65536,
                       overlap: int = 1024, partitions: int | None = None) -> DataFrame:
    """(series_id, segment, offset, values): at most points + overlap values per row.

    A segment also holds the first ``overlap`` values of the next one, so every window of up to
    overlap + 1 points lies in the segment its start belongs to.
    """
    if overlap >= points:
        raise ValueError("overlap must be smaller than a segment")
    ranked = ranked_points(df, key, order, value, partitions)
    own = F.floor(F.col("pos") / points)
    shared = (F.col("pos") % points < overlap) & (own > 0)
    both = ranked.withColumn("segment", F.explode(F.when(shared, F.array(own, own - 1)).otherwise(F.array(own))))
    packed = both.groupBy("series_id", "segment").agg(F.sort_array(F.collect_list(F.struct("pos", "value"))).alias("_p"))
    return packed.select("series_id", "segment", (F.col("segment") * points).alias("offset"),
                         F.transform("_p", lambda e: e["value"]).alias("values"))


def min_distance_segments(segments: DataFrame, shapelets: DataFrame, overlap: int, metric: str = "raw") -> DataFrame:
    """(series_id, shapelet_id, dist, pos) of whole series from their segments.

    Exact for shapelets of at most overlap + 1 points; a longer one is refused.
    """
    longest = shapelets.agg(F.max(F.size("values"))).first()[0]
    if longest > overlap + 1:
        raise ValueError("a shapelet is longer than overlap + 1")
    part = min_distance(segments, shapelets, metric, "inf", True, carry=("offset",))
    best = F.min(F.struct("dist", (F.col("offset") + F.col("pos")).alias("pos")))
    return part.groupBy("series_id", "shapelet_id").agg(best.alias("_b")).select(
        "series_id", "shapelet_id", "_b.dist", "_b.pos")
