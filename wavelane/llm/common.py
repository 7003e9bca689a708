"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from wavelane.runtime import scratch_folder, ship_package


BROADCAST_KEYS = 2_000_000  # ids sent to the tasks, about 40 bytes each; more of them are joined by a shuffle
BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def prepare(spark: SparkSession, rows: int = 2_000) -> None:
    """Give the workers the package; documents are large rows, so pass few at a time to Python unless the session says otherwise."""
    ship_package(spark)
    if spark.conf.get(BATCH) in ("10000", getattr(spark, "_wavelane_batch", None)):  # Spark's default, or set here
        spark._wavelane_batch = str(rows)
        spark.conf.set(BATCH, str(rows))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(key: str, parts: int) -> Column:
    """crc32 of the key's text modulo the number of parts; a null key has no part."""
    return F.crc32(F.col(key).cast("string").cast("binary")) % F.lit(parts)


def free_name(df: DataFrame, stem: str) -> str:
    """A column name that the table does not use."""
    taken = {c.lower() for c in df.columns}
    while stem.lower() in taken:
        stem += "_"
    return stem


def thin(df: DataFrame, key: Column, rows: int, bound: int) -> DataFrame:
    """About ``bound`` of ``rows`` rows, chosen by the key's hash so that a rerun chooses the same ones."""
    if rows <= bound:
        return df
    steps = 1_000_000
    return df.where(F.pmod(F.xxhash64(key, F.lit("thin")), F.lit(steps)) < int(steps * bound / rows))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def write_packed(df: DataFrame) -> DataFrame:
    """write_through() with denser compression, for large tables of ids."""
    path = f"{scratch_folder(df.sparkSession)}/iteration-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._scratch_path = path
    return out


def with_keys(df: DataFrame, keys: DataFrame, key: str, bound: int | None = None) -> DataFrame:
    """Rows whose key is in the table of keys; without moving them while the keys are few."""
    return df.join(_sized(keys, bound), key, "left_semi").select(*df.columns)


def without_keys(df: DataFrame, keys: DataFrame, key: str, bound: int | None = None) -> DataFrame:
    """Rows whose key is null or not in the table of keys; without moving them while the keys are few."""
    return df.join(_sized(keys, bound), key, "left_anti").select(*df.columns)


def _sized(keys: DataFrame, bound: int | None) -> DataFrame:
    return F.broadcast(keys) if keys.count() <= (BROADCAST_KEYS if bound is None else bound) else keys


def byte_alphabet() -> dict[str, int]:
    """Characters that byte-level vocabularies write for bytes: printable Latin-1 as itself, the others from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(others)}
