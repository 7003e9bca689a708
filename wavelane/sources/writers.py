"""Writers for predictions, shapelets, splits and run times."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F


def write_predictions(predictions: DataFrame, path: str, classes: int, fmt: str = "csv") -> None:
    """Row index plus one probability column per class; the hard label goes to ``path``_hard."""
    proba = predictions.select("row_id", *[F.col("probs")[c].alias(f"proba_{c}") for c in range(classes)])
    hard = predictions.select("row_id", "prediction")
    for df, folder in ((proba, f"{path}_proba"), (hard, f"{path}_hard")):
        writer = df.write.mode("overwrite")
        writer.csv(folder, header=True) if fmt == "csv" else writer.format(fmt).save(folder)


def write_shapelets(shapelets: DataFrame, path: str) -> None:
    """One shapelet per line, as JSON."""
    shapelets.select("shapelet_id", F.col("values").cast("array<double>")).write.mode("overwrite").json(path)


def write_shapelets_text(shapelets: DataFrame, path: str) -> None:
    """One bracketed, space-separated array per line."""
    line = F.concat(F.lit("["), F.concat_ws(" ", F.col("values").cast("array<string>")), F.lit("]"))
    shapelets.select(line.alias("value")).write.mode("overwrite").text(path)


def read_shapelets(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("shapelet_id long, values array<double>").json(path)


def write_split(rows: DataFrame, path: str, key: str = "series_id", label: str = "label") -> None:
    """Ground truth with the original row index."""
    rows.select(F.col(key).alias("row_id"), F.col(label).alias("label")).write.mode("overwrite").csv(path, header=True)


def write_runtime(spark: SparkSession, seconds: float, path: str, dataset: str = "") -> None:
    spark.createDataFrame([(dataset, float(seconds))], "dataset string, seconds double").write.mode(
        "overwrite").csv(path, header=True)
