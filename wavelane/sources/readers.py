"""Readers: wide and long tables, local data, labelled archives, result files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F


def series_from_wide(df: DataFrame, target: str, id_column: str | None = None,
                     points: list[str] | None = None) -> DataFrame:
    """One numeric column per time point plus a label column."""
    points = points or [c for c in df.columns if c not in (target, id_column)]
    key = F.col(id_column) if id_column else F.monotonically_increasing_id()
    return df.select(key.alias("series_id"), F.col(target).alias("label"),
                     F.array(*[F.col(c).cast("double") for c in points]).alias("values"))


def series_from_long(df: DataFrame, key: str, order: list[str], value: str) -> DataFrame:
    """(key, order, value) rows to one array per key, in order."""
    item = F.struct(*order, F.col(value).cast("double").alias("_v"))
    rows = df.groupBy(F.col(key).alias("series_id")).agg(
        F.sort_array(F.collect_list(item)).alias("_items"))
    return rows.select("series_id", F.transform("_items", lambda e: e["_v"]).alias("values"))


def series_from_local(spark: SparkSession, data, labels=None) -> DataFrame:
    """Lists, an ndarray or a pandas frame (one row per series) to a series table."""
    rows = data.values if hasattr(data, "values") and hasattr(data, "columns") else data
    rows = [[float(v) for v in row] for row in rows]
    if labels is None:
        return spark.createDataFrame([(i, r) for i, r in enumerate(rows)],
                                     "series_id long, values array<double>")
    labels = [v.item() if hasattr(v, "item") else v for v in labels]
    kind = {str: "string", int: "long", bool: "boolean"}.get(type(labels[0]), "double")
    return spark.createDataFrame([(i, y, r) for i, (r, y) in enumerate(zip(rows, labels))],
                                 f"series_id long, label {kind}, values array<double>")


def read_wide_csv(spark: SparkSession, path: str, target: str = "target") -> DataFrame:
    return series_from_wide(spark.read.csv(path, header=True, inferSchema=True), target)


def source_name(from_folder: bool) -> Column:
    """Name of the file a row came from, or of its folder for tables written by Spark."""
    if not from_folder:
        return F.col("_metadata.file_name")
    return F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2)


def read_archive(spark: SparkSession, glob: str, separator: str = r"[,\s]+", from_folder: bool = False) -> DataFrame:
    """Archives named ``{dataset}_{TRAIN|TEST}.ext``: label then points on every line."""
    name = source_name(from_folder)
    lines = spark.read.text(glob).select(
        F.regexp_extract(name, r"^(.*)_(TRAIN|TEST)\.", 1).alias("dataset"),
        F.lower(F.regexp_extract(name, r"^(.*)_(TRAIN|TEST)\.", 2)).alias("split"),
        F.filter(F.split(F.trim("value"), separator), lambda s: s != "").alias("_f"))
    return lines.where(F.size("_f") > 1).select(
        "dataset", "split", F.monotonically_increasing_id().alias("series_id"),
        F.col("_f")[0].alias("label"),
        F.slice("_f", F.lit(2), F.size("_f") - 1).cast("array<double>").alias("values"))


def arg_max(values: Column) -> Column:
    """Zero-based index of the first maximum of an array."""
    return (F.array_position(values, F.array_max(values)) - 1).cast("int")


def read_predictions(spark: SparkSession, glob: str, from_folder: bool = False) -> DataFrame:
    """Class-probability CSVs ``{dataset}_{method}..._{timestamp}..._proba.csv``.

    First column is the row index, the rest one probability per class.
    """
    name = source_name(from_folder)
    lines = spark.read.text(glob).select(
        name.alias("file"), F.split("value", ",").alias("_f"),
        F.regexp_extract(name, r"^([^_]+)_", 1).alias("dataset"),
        F.regexp_extract(name, r"^[^_]+_([^_]+)_", 1).alias("method"),
        F.regexp_extract(name, r"_(\d+)(?:_[a-z]+)*(?:\.csv)?$", 1).alias("timestamp"))
    rows = lines.where(F.col("_f")[0].rlike(r"^\d+$"))
    probs = F.slice("_f", F.lit(2), F.size("_f") - 1).cast("array<double>")
    return rows.select("file", "dataset", "method", "timestamp",
                       F.col("_f")[0].cast("long").alias("row_id"), probs.alias("probs"),
                       arg_max(probs).alias("prediction"))


def read_shapelets_text(spark: SparkSession, path: str) -> DataFrame:
    """Bracketed, whitespace-separated arrays that may run over several lines."""
    blocks = spark.read.option("lineSep", "]").text(path).select(
        F.monotonically_increasing_id().alias("shapelet_id"),
        F.regexp_extract("value", r"\[(?s)(.*)$", 1).alias("_t"))
    numbers = F.filter(F.split(F.trim(F.regexp_replace("_t", r"[\s,]+", " ")), " "), lambda s: s != "")
    return blocks.where(F.trim("_t") != "").select("shapelet_id", numbers.cast("array<double>").alias("values"))
