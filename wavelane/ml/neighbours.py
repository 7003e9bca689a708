"""Blocks of rows around pivots, for exact nearest-neighbour joins that visit few pairs of blocks.

For every pivot p, rows q and c are at least |d(q, p) - d(c, p)| apart. Training rows are dealt to their nearest pivot, each such
cell is cut into rings by the distance to the pivot, and rings of too many rows (copies have one distance) are split by hash. A
block knows the range of its rows' distances to every pivot, so the distance of a query to the block has a lower bound. A query first
searches the block it would lie in; then only blocks whose bound does not exceed its k-th distance are visited. Pivots decide
how much is skipped, never the result. Rows with infinite or undefined features lie in blocks of their own that every query
visits, and such queries visit every block.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from wavelane.runtime import write_through

PIVOTS = 32
SAMPLE = 4_096     # rows the pivots are chosen from
CHUNK = 1_024      # queries that visit a block together
SLICE = 1_024      # blocks compared with a chunk of queries at once
PLACED = "cell int, near double, table array<double>"


def choose_pivots(rows: DataFrame, features: str, n: int, pivots: int = PIVOTS, sample: int = SAMPLE) -> np.ndarray:
    """Rows of a bounded sample, each the farthest from those chosen before; (0, 0) if no row is finite."""
    steps = 1_000_000
    some = rows.where(F.pmod(F.xxhash64(features, F.lit("pivots")), F.lit(steps)) < max(int(steps * sample / max(n, 1)), 1)) if n > sample else rows
    found = np.array(sorted(list(r[0]) for r in some.select(features).distinct().collect()), dtype=float)
    found = found[np.isfinite(found).all(axis=1)] if len(found) else np.zeros((0, 0))
    if not len(found):
        return np.zeros((0, 0))
    chosen = [int(((found - found.mean(axis=0)) ** 2).sum(axis=1).argmax())]
    gap = np.full(len(found), np.inf)
    while len(chosen) < pivots:
        gap = np.minimum(gap, ((found - found[chosen[-1]]) ** 2).sum(axis=1))
        if not gap.max() > 0:
            break
        chosen.append(int(gap.argmax()))
    return found[chosen]


def place(rows: DataFrame, features: str, pivots: np.ndarray) -> DataFrame:
    """Add cell (nearest pivot, -1 without finite features), near (distance to it) and table (distances to all pivots)."""
    shared = rows.sparkSession.sparkContext.broadcast(pivots)

    @F.pandas_udf(PLACED)
    def put(values: pd.Series) -> pd.DataFrame:
        own = np.array(values.tolist(), dtype=float).reshape(len(values), -1 if len(values) else 0)
        table = np.zeros((len(own), len(shared.value)))
        fine = np.isfinite(own).all(axis=1) & bool(len(shared.value))
        for k, pivot in enumerate(shared.value):
            table[fine, k] = np.sqrt(((own[fine] - pivot) ** 2).sum(axis=1))
        cell = np.where(fine, table.argmin(axis=1) if table.shape[1] else -1, -1)
        near = np.where(fine, table[np.arange(len(own)), np.maximum(cell, 0)] if table.shape[1] else 0.0, 0.0)
        return pd.DataFrame({"cell": cell.astype(np.int32), "near": near, "table": list(table)})

    return rows.withColumn("_p", put(F.col(features))).select(*rows.columns, "_p.*")


def ring_blocks(placed: DataFrame, block: int):
    """A function that adds the number of the block to placed rows; blocks hold about ``block`` rows of ``placed``."""
    parts = {r["cell"]: -(-r["count"] // block) for r in placed.groupBy("cell").count().collect()}  # PIVOTS rows
    most, cuts = max(parts.values()), {}
    if most > 1:
        for r in placed.groupBy("cell").agg(F.percentile_approx("near", [j / most for j in range(1, most)], 10_000).alias("at")).collect():
            m = parts[r["cell"]]
            cuts[r["cell"]] = np.array([r["at"][max(round(j * most / m), 1) - 1] for j in range(1, m)])
    shared = placed.sparkSession.sparkContext.broadcast(cuts)  # one number per block of rows

    @F.pandas_udf("int")
    def ring(cell: pd.Series, near: pd.Series) -> pd.Series:
        out = np.zeros(len(cell), np.int32)
        for c in cell.unique():
            mine = (cell == c).to_numpy()
            out[mine] = np.searchsorted(shared.value.get(c, np.zeros(0)), near[mine].to_numpy(), "left")
        return pd.Series(out)

    sizes = write_through(placed.withColumn("_ring", ring("cell", "near")).groupBy("cell", "_ring").agg(
        F.ceil(F.count(F.lit(1)) / block).cast("long").alias("_parts")))
    largest = sizes.agg(F.max("_parts")).first()[0]

    def numbered(rows: DataFrame, key: str) -> DataFrame:
        known = rows.withColumn("_ring", ring("cell", "near")).join(sizes, ["cell", "_ring"], "left")
        number = ((F.col("cell").cast("long") + 1) * (most + 1) + F.col("_ring")) * (largest + 1) + F.pmod(F.xxhash64(key), F.col("_parts"))
        return known.withColumn("block", number).drop("_ring", "_parts")

    return numbered


def block_ranges(rows: DataFrame, pivots: int) -> DataFrame:
    """block, wild (holds rows without finite features), low and high distances to every pivot; a row per block."""
    cells = range(pivots)
    return write_through(rows.groupBy("block").agg(F.max((F.col("cell") < 0).cast("int")).alias("wild"),
                                                   *[f(F.col("table")[i]).alias(f"{f.__name__}{i}") for i in cells for f in (F.min, F.max)]).select(
        "block", "wild", F.array(*[F.col(f"min{i}") for i in cells]).cast("array<double>").alias("low"),
        F.array(*[F.col(f"max{i}") for i in cells]).cast("array<double>").alias("high")))


def open_blocks(queries: DataFrame, ranges: DataFrame, key: str, digits: int) -> DataFrame:
    """key, block of the blocks other than a query's own that can hold a row within its ``cut`` (null: any row).

    Chunks of queries meet slices of the ranges, so no task holds all of either.
    """
    chunks, slices = max(1, -(-queries.count() // CHUNK)), max(1, -(-ranges.count() // SLICE))
    left = queries.withColumn("_c", F.pmod(F.xxhash64(key), F.lit(chunks))).withColumn("_s", F.explode(F.sequence(F.lit(0), F.lit(slices - 1))))
    right = ranges.withColumn("_s", F.pmod(F.xxhash64("block"), F.lit(slices))).withColumn("_c", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))))
    kind = queries.schema[key].dataType.simpleString()

    def compare(some: pd.DataFrame, blocks: pd.DataFrame) -> pd.DataFrame:
        if not len(some) or not len(blocks):
            return pd.DataFrame({key: some[key].iloc[:0], "block": []})
        own = np.stack(some["table"].to_numpy())
        gap = np.zeros((len(some), len(blocks)))
        for p, (low, high) in enumerate(zip(np.stack(blocks["low"].to_numpy()).T, np.stack(blocks["high"].to_numpy()).T)):
            np.maximum(gap, np.maximum(low - own[:, p, None], own[:, p, None] - high), out=gap)
        gap[(some["cell"] < 0).to_numpy()] = 0.0
        gap[:, (blocks["wild"] == 1).to_numpy()] = 0.0
        cut = some["cut"].astype(float).fillna(np.inf).to_numpy()
        home = some["block"].astype(float).to_numpy()  # NaN, no block, equals none
        # Rounded distances tie within 10^-digits, and sums of squares carry relative errors.
        reach = cut * (1 + 1e-9) + 2 * 10.0 ** -digits + 1e-9 * own.max(axis=1, initial=0.0)
        q, b = np.nonzero((gap <= reach[:, None]) & (blocks["block"].to_numpy() != home[:, None]))
        return pd.DataFrame({key: some[key].to_numpy()[q], "block": blocks["block"].to_numpy()[b]})

    columns = [key, "cell", "table", "cut", "block"]
    return left.select("_c", "_s", *columns).groupBy("_c", "_s").cogroup(right.groupBy("_c", "_s")).applyInPandas(compare, f"{key} {kind}, block long")


def deal(visits: DataFrame, rows: DataFrame, key: str):
    """(visits, rows), each with the columns block and _chunk: a block is met by at most about CHUNK queries at a time."""
    wanted = visits.groupBy("block").agg(F.ceil(F.count(F.lit(1)) / CHUNK).cast("long").alias("_chunks"))
    left = visits.join(wanted, "block").withColumn("_chunk", F.pmod(F.xxhash64(key), F.col("_chunks"))).drop("_chunks")
    right = rows.join(wanted, "block").withColumn("_chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_chunks") - 1))).drop("_chunks")
    return left, right
