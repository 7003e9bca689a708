"""Session helpers: size checks before broadcasts, and lineage cuts."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession, functions as F

# Largest number of float64 points a task may hold as one side of a distance
# join (32 Mi points = 256 MB). Beyond it the block join is used.
BROADCAST_POINTS = 32 * 1024 * 1024
BROADCAST_ROWS = 1_000_000


def ship_package(spark: SparkSession) -> None:
    """Give the Python workers this package, as ``--py-files`` would; once per context."""
    sc = spark.sparkContext
    if getattr(sc, "_wavelane_shipped", False):
        return
    root = os.path.dirname(os.path.abspath(__file__))
    path = os.path.join(tempfile.mkdtemp(prefix="wavelane-package-"), "wavelane.zip")
    with zipfile.ZipFile(path, "w") as archive:
        for folder, _, names in os.walk(root):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    archive.write(full, os.path.relpath(full, os.path.dirname(root)))
    sc.addPyFile(path)  # copied from the driver to every executor
    sc._wavelane_shipped = True


def scratch_folder(spark: SparkSession) -> str:
    """The shared folder named by the cluster; a temporary one only in local mode."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not sc.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a shared folder")
            folder = tempfile.mkdtemp(prefix="wavelane-")
        sc.setCheckpointDir(folder)
    return sc.getCheckpointDir()


def write_through(df: DataFrame) -> DataFrame:
    """Write an iteration table to the shared folder once and read on from there.

    Cuts the lineage of a loop, and survives the loss of executors.
    """
    path = f"{scratch_folder(df.sparkSession)}/iteration-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._scratch_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete the files of iteration tables that nothing reads any more; other tables are left alone."""
    for df in tables:
        path = getattr(df, "_scratch_path", None)
        if path is not None:
            jvm = df.sparkSession._jvm
            place = jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(place, True)


def attach_row(df: DataFrame, row: DataFrame) -> DataFrame:
    """Add the columns of a one-row table (an aggregate without keys) to every row."""
    return df.join(F.broadcast(row.limit(1)))


def spread_small_input(df: DataFrame) -> DataFrame:
    """Spread a table held in fewer files than there are cores, before costly work per row."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if 0 < len(df.inputFiles()) < cores else df


def table_size(df: DataFrame, values: str = "values") -> tuple[int, int]:
    """(rows, points) of a table with one array per row."""
    row = df.agg(F.count(F.lit(1)).alias("n"), F.sum(F.size(values)).alias("p")).first()
    return int(row["n"]), int(row["p"] or 0)


def fits_broadcast(rows: int, points: int, limit: int | None = None) -> bool:
    return rows <= BROADCAST_ROWS and points <= (BROADCAST_POINTS if limit is None else limit)
