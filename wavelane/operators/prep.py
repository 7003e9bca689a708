"""Label encoding, scaling, limits, splits and samples."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from wavelane.functions import arrays as A
from wavelane.runtime import attach_row


def label_map(df: DataFrame, label: str = "label") -> DataFrame:
    """(label, label_index): sorted distinct labels numbered from 0; one row per class."""
    return _sorted_labels(df, label).select(F.posexplode("_labels").alias("label_index", label)).select(label, "label_index")


def _sorted_labels(df: DataFrame, label: str) -> DataFrame:
    """One row: the sorted distinct labels, reduced before they meet in one task."""
    labels = df.select(label).where(F.col(label).isNotNull()).distinct()
    return labels.agg(F.sort_array(F.collect_list(label)).alias("_labels"))


def encode_labels(df: DataFrame, label: str = "label") -> DataFrame:
    """Adds ``label_index`` 0..C-1 in sorted label order; rows without a label are left out.

    The label list is attached to the rows, which stay where they are: joining on the label
    would gather a frequent class in one task.
    """
    found = attach_row(df.where(F.col(label).isNotNull()), _sorted_labels(df, label))
    return found.withColumn("label_index", (F.array_position("_labels", F.col(label)) - 1).cast("int")).drop("_labels")


def scale_series(series: DataFrame) -> DataFrame:
    return series.withColumn("values", A.z_norm(F.col("values")))


def scale_global(train: DataFrame, series: DataFrame) -> DataFrame:
    """Scale points by the mean and population deviation of all training points."""
    stats = train.select(F.explode("values").alias("x")).agg(
        F.avg("x").alias("_m"), F.stddev_pop("x").alias("_s"))  # one row
    sd = F.when(F.col("_s") == 0, F.lit(1.0)).otherwise(F.col("_s"))
    return attach_row(series, stats).withColumn(
        "values", F.transform("values", lambda x: (x - F.col("_m")) / sd)).drop("_m", "_s")


def scale_minmax(train: DataFrame, rows: DataFrame, column: str = "features") -> DataFrame:
    """Scale each feature by its training range; a constant feature becomes 0."""
    bounds = train.select(F.posexplode(column).alias("_i", "x")).groupBy("_i").agg(
        F.min("x").alias("lo"), F.max("x").alias("hi"))
    packed = bounds.agg(F.sort_array(F.collect_list(F.struct("_i", "lo", "hi"))).alias("_b"))  # one entry per feature
    return attach_row(rows, packed).withColumn(column, F.zip_with(
        column, "_b", lambda x, b: F.when(b["hi"] > b["lo"], (x - b["lo"]) / (b["hi"] - b["lo"]))
        .otherwise(x - b["lo"]))).drop("_b")


def series_limits(series: DataFrame) -> DataFrame:
    """One row: min_len, max_len (half the longest above 20 points), max_shaps, valid (min_len > 4)."""
    n = F.size("values")
    lo, hi = F.min(n), F.max(n)
    return series.agg(lo.alias("min_len"), F.when(hi > 20, F.floor(hi / 2)).otherwise(hi).cast("int").alias("max_len"),
                      (F.floor(F.sqrt(lo)) + 1).cast("int").alias("max_shaps"), (lo > 4).alias("valid"))


def checked_limits(series: DataFrame) -> tuple[int, int, int]:
    row = series_limits(series).first()
    if row["min_len"] is None or not row["valid"]:
        raise ValueError("series need more than 4 points")
    return row["min_len"], row["max_len"], row["max_shaps"]


DRAW_BITS = 52


def random_key(seed: int, *keys):
    """Repeatable random order key in [0, 2^52): the head of the MD5 hash of the seed and the row's keys, as other engines have it."""
    text = F.concat_ws("|", F.lit(str(seed)), *[(F.col(k) if isinstance(k, str) else k).cast("string") for k in keys])
    return F.conv(F.substring(F.md5(text), 1, DRAW_BITS // 4), 16, 10).cast("long")


def uniform(seed: int, *keys):
    """Repeatable draw in [0, 1) from a seed and row keys."""
    return random_key(seed, *keys) / F.lit(float(1 << DRAW_BITS))


def stratified_split(rows: DataFrame, share: float, key: str = "series_id", label: str = "label",
                     seed: int = 0) -> DataFrame:
    """Adds ``split``: exactly round(share * n) rows of every label go to train, in random order.

    A label may hold most rows, so ranks come from range buckets of the random key:
    bucket totals first, then ranks inside one bucket.
    """
    sized = rows.withColumn("_r", random_key(seed, key)).withColumn("_b", F.shiftright("_r", DRAW_BITS - 10))
    counts = sized.groupBy(label, "_b").agg(F.count(F.lit(1)).alias("_n"))
    by = Window.partitionBy(label)
    offsets = counts.select(label, "_b", F.sum("_n").over(by).alias("_all"),
                            (F.sum("_n").over(by.orderBy("_b")) - F.col("_n")).alias("_before"))
    rank = F.row_number().over(Window.partitionBy(label, "_b").orderBy("_r", key)) + F.col("_before")
    return sized.join(offsets, [label, "_b"]).withColumn(
        "split", F.when(rank <= F.round(F.col("_all") * share), "train").otherwise("test")).drop(
        "_r", "_b", "_all", "_before")


def split_by_index(rows: DataFrame, test_index: DataFrame, key: str) -> DataFrame:
    """Adds ``split``: rows whose key is in the saved index are test, the rest train."""
    marked = test_index.select(F.col(key).alias("_key")).where(F.col("_key").isNotNull()).distinct()
    return rows.join(marked, rows[key] == marked["_key"], "left").withColumn(
        "split", F.when(F.col("_key").isNotNull(), "test").otherwise("train")).drop("_key")


def sample_series(series: DataFrame, k: int, seed: int = 0) -> DataFrame:
    """k rows without replacement."""
    ids = series.select("series_id").orderBy(random_key(seed, "series_id"), "series_id").limit(k)
    return series.join(ids, "series_id")  # only ids meet in one task


def filter_class(df: DataFrame, label) -> DataFrame:
    return df.where(F.col("label") == F.lit(label))


def union_splits(train: DataFrame, test: DataFrame) -> DataFrame:
    return train.unionByName(test)


def index_difference(all_rows: DataFrame, taken: DataFrame, key: str) -> DataFrame:
    """Distinct keys of ``all_rows`` that are not in ``taken``."""
    return all_rows.select(key).subtract(taken.select(key))
