"""Exact top-k by inner product of integer vectors, by elimination with a table of distances to many pivots.

The inner product is (|q|² + |c|² - d²) / 2, and for every pivot p the distance d of q and c is at least |d(q, p) - d(c, p)|. The
largest of these lower bounds over all pivots bounds the product from above. Candidates are evaluated in the order of that
bound, and a query stops when the next bound is below its k-th best product: what is left cannot change the result.

Rows are dealt to their nearest pivot, each such cell is cut by the distance to the pivot into rings of about ``block`` rows, and
rings of more rows (copies have one distance) are split by hash. A block knows the range of its rows' distances to every
pivot. A query first searches the block it would itself lie in; its k-th best product there then tells which other blocks can
hold a better row, and only those are visited. Queries and blocks meet some hundreds of queries and one block at a time, so no
task holds more, however many queries want a block. Only the pivots (chosen from a bounded sample of rows, farthest first) and
counts per cell and per ring (one per ``block`` rows) pass the driver. Pivots change how much is skipped, never the result.

Cases: rows with a null key or vector, or a null component, take no part. Vectors of different lengths count as filled up with
zeros; an empty vector has product 0 with all. A query's own row, and repeated rows of its key, are no candidates of it; rows that
repeat count as often as they stand, repeated queries are answered each. Ties go to the smaller key. Products beyond a long are
held at its limits. Fewer than k candidates: all of them. No queries or no rows: an empty table. Other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from wavelane.llm.common import thin, write_packed
from wavelane.runtime import write_through

PIVOTS = 64
SAMPLE = 4_096      # rows from which pivots are chosen
BLOCK = 8_192       # rows that a task searches at once
CHUNK = 512         # queries that visit a block together
SLICE = 1_024       # blocks whose ranges are compared with a chunk of queries at once
LONG = (1 << 63) - 1

PREPARED = "key long, vec array<long>, norm double, near double, cell int, table array<double>"


def matrix(vectors, width: int) -> np.ndarray:
    out = np.zeros((len(vectors), width), np.int64)
    for row, v in zip(out, vectors):
        row[:len(v)] = v
    return out


def products(rows: np.ndarray, query: np.ndarray, limit: float) -> np.ndarray:
    """Exact inner products; ``limit`` bounds their size. Doubles hold integers below 2^53, longs below 2^63."""
    if limit < 1 << 52:
        return (rows.astype(np.float64) @ query.astype(np.float64)).astype(np.int64)
    if limit < 1 << 62:
        return rows @ query
    return np.array([max(-LONG - 1, min(LONG, sum(map(int.__mul__, r, query.tolist())))) for r in rows.tolist()], np.int64)


def farthest_first(vectors: np.ndarray, pivots: int) -> np.ndarray:
    """Vectors chosen one after another, each the farthest from those before it."""
    left = vectors.astype(np.float64)
    gap = ((left - left.mean(axis=0)) ** 2).sum(axis=1)
    chosen = [int(gap.argmax())]
    gap = np.full(len(left), np.inf)
    while len(chosen) < pivots:
        gap = np.minimum(gap, ((left - left[chosen[-1]]) ** 2).sum(axis=1))
        if not gap.max() > 0:
            break
        chosen.append(int(gap.argmax()))
    return vectors[chosen]


def distances(vectors: np.ndarray, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(squared norms, distances to the pivots)"""
    x, p = vectors.astype(np.float64), pivots.astype(np.float64)
    norm = (x * x).sum(axis=1)
    return norm, np.sqrt(np.maximum(norm[:, None] + (p * p).sum(axis=1) - 2 * x @ p.T, 0))


def upper_bounds(norm_q, norm_c, gap, slack: float):
    """Products of vectors with these squared norms that are at least ``gap`` apart; rounding of norms and distances is covered."""
    total = norm_q + norm_c
    return (total - gap * gap) / 2 + 1e-7 * (total + slack) + 1


def search(queries: pd.DataFrame, rows: pd.DataFrame, k: int, width: int, limit: float, slack: float):
    """(query row, key, product) of the k best rows of a block for every query; evaluated in the order of the bounds."""
    held, keys, norms = matrix(rows["vec"], width), rows["key"].to_numpy(), rows["norm"].to_numpy()
    table = np.stack(rows["table"].to_numpy()).T.copy()
    for begin in range(0, len(queries), 64):
        part = queries.iloc[begin:begin + 64]
        gap = np.zeros((len(part), len(rows)))
        for own, other in zip(np.stack(part["table"].to_numpy()).T, table):
            np.maximum(gap, np.abs(own[:, None] - other), out=gap)
        bounds = upper_bounds(part["norm"].to_numpy()[:, None], norms, gap, slack)
        for bound, vec, q, number, floor in zip(bounds, matrix(part["vec"], width), part["key"], part["qrow"], part["floor"]):
            open_ = np.flatnonzero((bound >= floor) & (keys != q))
            open_ = open_[np.argsort(-bound[open_])]
            best, best_keys = np.zeros(0, np.int64), np.zeros(0, np.int64)
            at, step = 0, 64
            while at < len(open_) and bound[open_[at]] >= floor:
                now = open_[at:at + step]
                best = np.append(best, products(held[now], vec, limit))
                best_keys = np.append(best_keys, keys[now])
                order = np.lexsort((best_keys, -best.astype(object) if limit >= 1 << 62 else -best))[:k]
                best, best_keys = best[order], best_keys[order]
                if len(best) == k:
                    floor = max(floor, best[-1])
                at, step = at + step, step * 2
            yield number, best_keys, best


def _prepare(df: DataFrame, pivots: np.ndarray, width: int) -> DataFrame:
    shared = df.sparkSession.sparkContext.broadcast(pivots)  # PIVOTS vectors

    def prepare(batches):
        for batch in batches:
            norm, far = distances(matrix(batch["vec"], width), shared.value)
            cell = far.argmin(axis=1) if len(far) else np.zeros(0, int)
            yield pd.DataFrame({"key": batch["key"], "vec": batch["vec"], "norm": norm, "near": far[np.arange(len(far)), cell],
                                "cell": cell.astype(np.int32), "table": list(far)})

    return df.mapInPandas(prepare, PREPARED)


def _rings(prepared: DataFrame, block: int):
    """Function that adds ``block`` to prepared rows: cell, ring by the distance to the pivot, part of the ring by hash."""
    spark = prepared.sparkSession
    parts = {r["cell"]: -(-r["count"] // block) for r in prepared.groupBy("cell").count().collect()}  # PIVOTS rows
    most = max(parts.values())
    cuts = {}
    if most > 1:
        steps = [j / most for j in range(1, most)]
        for r in prepared.groupBy("cell").agg(F.percentile_approx("near", steps, 10_000).alias("at")).collect():
            m = parts[r["cell"]]
            cuts[r["cell"]] = np.array([r["at"][max(round(j * most / m), 1) - 1] for j in range(1, m)])
    shared = spark.sparkContext.broadcast(cuts)  # one number per block of rows

    @F.pandas_udf("int")
    def ring(cell: pd.Series, near: pd.Series) -> pd.Series:
        out = np.zeros(len(cell), np.int32)
        for c in cell.unique():
            mine = (cell == c).to_numpy()
            out[mine] = np.searchsorted(shared.value.get(c, np.zeros(0)), near[mine].to_numpy(), "left")
        return pd.Series(out)

    ringed = prepared.withColumn("ring", ring("cell", "near"))
    sizes = write_through(ringed.groupBy("cell", "ring").agg(F.ceil(F.count(F.lit(1)) / block).cast("long").alias("parts")))
    largest = sizes.agg(F.max("parts")).first()[0]

    def blocked(df: DataFrame) -> DataFrame:
        placed = df.withColumn("ring", ring("cell", "near")).join(sizes, ["cell", "ring"], "left")
        number = (F.col("cell").cast("long") * (most + 1) + F.col("ring")) * (largest + 1) + F.pmod(F.xxhash64("key"), F.col("parts"))
        return placed.withColumn("block", number).drop("cell", "ring", "near", "parts")

    return blocked


def _visit(visits: DataFrame, rows: DataFrame, k: int, width: int, limit: float, slack: float, chunk: int) -> DataFrame:
    """qrow, key, score of the best rows of the visited blocks."""
    wanted = visits.groupBy("block").agg(F.ceil(F.count(F.lit(1)) / chunk).cast("long").alias("chunks"))
    queries = visits.join(wanted, "block").withColumn("chunk", F.pmod(F.xxhash64("qrow"), F.col("chunks")))
    held = rows.join(wanted, "block").withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)))

    def meet(some: pd.DataFrame, block: pd.DataFrame) -> pd.DataFrame:
        if not len(some) or not len(block):
            return pd.DataFrame({"qrow": [], "key": [], "score": []}, dtype="int64")
        some["floor"] = some["floor"].astype("float64").fillna(-np.inf)
        found = list(search(some, block, k, width, limit, slack))
        return pd.DataFrame({"qrow": np.repeat([q for q, _, _ in found], [len(s) for _, _, s in found]),
                             "key": np.concatenate([x for _, x, _ in found]), "score": np.concatenate([s for _, _, s in found])})

    return queries.select("block", "chunk", "qrow", "key", "vec", "norm", "table", "floor").groupBy("block", "chunk").cogroup(
        held.select("block", "chunk", "key", "vec", "norm", "table").groupBy("block", "chunk")).applyInPandas(meet, "qrow long, key long, score long")


def _open_blocks(queries: DataFrame, ranges: DataFrame, n_queries: int, n_blocks: int, slack: float, chunk: int) -> DataFrame:
    """qrow, floor, block of the other blocks whose bound reaches the query's floor; chunks of queries meet slices of the ranges."""
    chunks, slices = -(-n_queries // chunk), -(-n_blocks // SLICE)
    left = queries.withColumn("chunk", F.pmod(F.xxhash64("qrow"), F.lit(chunks))).withColumn("slice", F.explode(F.sequence(F.lit(0), F.lit(slices - 1))))
    right = ranges.withColumn("slice", F.pmod(F.xxhash64("block"), F.lit(slices))).withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))))

    def compare(some: pd.DataFrame, blocks: pd.DataFrame) -> pd.DataFrame:
        if not len(some) or not len(blocks):
            return pd.DataFrame({"qrow": [], "floor": [], "block": []})
        own = np.stack(some["table"].to_numpy())
        gap = np.zeros((len(some), len(blocks)))
        for p, (low, high) in enumerate(zip(np.stack(blocks["low"].to_numpy()).T, np.stack(blocks["high"].to_numpy()).T)):
            np.maximum(gap, np.maximum(low - own[:, p, None], own[:, p, None] - high), out=gap)
        bound = upper_bounds(some["norm"].to_numpy()[:, None], blocks["norm"].to_numpy(), gap, slack)
        floor = some["floor"].astype("float64").fillna(-np.inf).to_numpy()
        home = some["block"].astype("float64").to_numpy()  # NaN, no block, equals none
        q, b = np.nonzero((bound >= floor[:, None]) & (blocks["block"].to_numpy() != home[:, None]))
        return pd.DataFrame({"qrow": some["qrow"].to_numpy()[q], "floor": some["floor"].to_numpy()[q], "block": blocks["block"].to_numpy()[b]})

    return left.select("chunk", "slice", "qrow", "norm", "table", "floor", "block").groupBy("chunk", "slice").cogroup(
        right.groupBy("chunk", "slice")).applyInPandas(compare, "qrow long, floor long, block long")


def exact_top_k(queries: DataFrame, rows: DataFrame, k: int = 5, key: str = "vec_id", vector: str = "vector", pivots: int = PIVOTS,
                block: int = BLOCK, chunk: int = CHUNK, sample: int = SAMPLE) -> DataFrame:
    """query, rank, key, score of the k rows with the greatest inner product with each query's vector of longs."""
    spark = rows.sparkSession
    queries, rows = (df.select(F.col(key).cast("long").alias("key"), F.col(vector).cast("array<long>").alias("vec")).where(
        F.col("key").isNotNull() & F.col("vec").isNotNull() & F.coalesce(~F.exists("vec", lambda x: x.isNull()), F.lit(False)))
        for df in (queries, rows))
    largest = F.max(F.coalesce(F.array_max(F.transform("vec", lambda x: F.abs(x.cast("double")))), F.lit(0.0)))
    facts = [df.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("vec")).alias("width"), largest.alias("largest")).first() for df in (queries, rows)]
    if not all(f["n"] for f in facts):
        return spark.createDataFrame([], f"query long, rank int, {key} long, score long")
    width = max(max(f["width"] for f in facts), 1)
    limit = width * facts[0]["largest"] * facts[1]["largest"]
    some = thin(rows, F.col("key"), facts[1]["n"], sample).collect() or [rows.first()]
    chosen = farthest_first(matrix([r["vec"] for r in sorted(some, key=lambda r: (r["key"], r["vec"]))], width), pivots)
    slack = float((chosen.astype(np.float64) ** 2).sum(axis=1).max())

    prepared = write_packed(_prepare(rows, chosen, width))
    blocked = _rings(prepared, block)
    held = blocked(prepared)
    asked = write_packed(blocked(_prepare(queries, chosen, width)).withColumn("qrow", F.monotonically_increasing_id()))

    home = asked.where(F.col("block").isNotNull()).withColumn("floor", F.lit(None).cast("long"))
    first = write_through(_visit(home, held, k, width, limit, slack, chunk))
    floors = first.groupBy("qrow").agg(F.when(F.count(F.lit(1)) == k, F.min("score")).alias("floor"))
    cells = range(len(chosen))
    ranges = write_through(held.groupBy("block").agg(*[f(F.col("table")[i]).alias(f"{f.__name__}{i}") for i in cells for f in (F.min, F.max)],
                                                     F.max("norm").alias("norm")).select(
        "block", "norm", F.array(*[f"min{i}" for i in cells]).alias("low"), F.array(*[f"max{i}" for i in cells]).alias("high")))
    visits = write_through(_open_blocks(asked.join(floors, "qrow", "left"), ranges, facts[0]["n"], ranges.count(), slack, chunk))
    others = _visit(asked.drop("block").join(visits, "qrow"), held, k, width, limit, slack, chunk)

    order = Window.partitionBy("qrow").orderBy(F.desc("score"), "key")
    best = first.unionByName(others).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return best.join(asked.select("qrow", F.col("key").alias("query")), "qrow").select("query", "rank", F.col("key").alias(key), "score")
