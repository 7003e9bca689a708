"""Distance joins between series and shapelets (raw, z-normalised, correlation).

Shapelets that pass a size check are shipped to every task once and the join is one
narrow stage over the series, with no shuffle. Larger shapelet tables use a
block join: both sides are hashed to blocks of bounded size and matched per block pair.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema, to_arrow_type

from wavelane.functions import kernels
from wavelane.runtime import attach_row, fits_broadcast, table_size

SERIES_BLOCK = 4096
SHAPELET_BLOCK = 2048
BLOCK_POINTS = 4 * 1024 * 1024  # of a block, in the mean
OUT_ROWS = 500_000  # pairs per emitted Arrow batch


def _out_schema(series: DataFrame, shapelets: DataFrame, carry, location) -> T.StructType:
    fields = [T.StructField("series_id", series.schema["series_id"].dataType),
              T.StructField("shapelet_id", shapelets.schema["shapelet_id"].dataType)]
    fields += [series.schema[c] for c in carry]
    fields.append(T.StructField("dist", T.DoubleType()))
    if location:
        fields += [T.StructField("pos", T.LongType()), T.StructField("loc", T.DoubleType())]
    return T.StructType(fields)


def _pair_batches(sid, carried, series, kid, shapelets, metric, on_short, location):
    """Long (series, shapelet) batches; ``carried`` are Arrow columns of the series."""
    k = len(shapelets)
    step = max(1, OUT_ROWS // max(k, 1))
    for a in range(0, len(series), step):
        n = len(series.lengths[a:a + step])
        lo = series.starts[a]
        part = kernels.Ragged(series.flat[lo:lo + series.lengths[a:a + n].sum()],
                              series.lengths[a:a + n])
        dist, pos = kernels.ragged_match(part, shapelets, metric, on_short, location)
        take = pa.array(np.repeat(np.arange(a, a + n), k))
        cols = [sid.take(take), kid.take(pa.array(np.tile(np.arange(k), n)))]
        cols += [c.take(take) for c in carried]
        cols.append(pa.array(dist.reshape(-1)))
        if location:
            span = np.abs(part.lengths[:, None] - shapelets.lengths[None, :])
            loc = np.where(np.isfinite(dist), pos / np.maximum(span, 1), 0.0)
            cols += [pa.array(pos.reshape(-1)), pa.array(loc.reshape(-1))]
        yield cols


def _flat(column):
    return column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column


def collect_shapelets(shapelets: DataFrame):
    """Ids and values of a shapelet table whose size has been checked."""
    table = shapelets.select("shapelet_id", F.col("values").cast("array<double>").alias("values")).orderBy(
        "shapelet_id").toArrow()
    return table.column("shapelet_id").to_pylist(), kernels.Ragged.from_arrow(table.column("values"))


def min_distance(series: DataFrame, shapelets: DataFrame, metric: str = "raw",
                 on_short: str = "inf", location: bool = False,
                 carry: tuple[str, ...] = (), by: str | None = None,
                 broadcast_points: int | None = None) -> DataFrame:
    """Minimum sliding distance of every series to every shapelet, in long form.

    metric: ``raw`` Euclidean, ``znorm`` (each window and the shapelet normalised) or
    ``corr`` (sqrt(2(1-correlation))). With ``location``, adds the first best offset and
    its relative position. With ``by``, only pairs with equal ``by`` values are matched.
    """
    carry = tuple(carry)
    if by:
        carry = (by, *[c for c in carry if c != by])
    schema = _out_schema(series, shapelets, carry, location)
    series = series.select("series_id", *carry, F.col("values").cast("array<double>").alias("values"))
    # aliases keep both sides apart when they come from the same table
    shapelets = shapelets.select(*([F.col(by).alias(by)] if by else []), F.col("shapelet_id").alias("shapelet_id"),
                                 F.col("values").cast("array<double>").alias("values"))
    pool = shapelets.persist()  # sized and read: compute it once
    rows, points = table_size(pool)
    if by or not fits_broadcast(rows, points, broadcast_points):
        return _block_join(series, pool, rows, schema, metric, on_short, location, carry, by)

    ids, values = collect_shapelets(pool)
    pool.unpersist()
    kid_type = to_arrow_type(schema["shapelet_id"].dataType)
    shared = series.sparkSession.sparkContext.broadcast((ids, values))
    names = schema.fieldNames()

    def join(batches):
        ids, pool = shared.value
        kid = pa.array(ids, kid_type)
        for batch in batches:
            if not batch.num_rows or not len(pool):
                continue
            own = kernels.Ragged.from_arrow(batch.column("values"))
            carried = [batch.column(c) for c in carry]
            for cols in _pair_batches(batch.column("series_id"), carried, own, kid, pool,
                                      metric, on_short, location):
                yield pa.RecordBatch.from_arrays(cols, names=names)

    return series.mapInArrow(join, schema)


def _block_join(series, shapelets, n_shapelets, schema, metric, on_short, location, carry, by=None):
    """Block nested loop: both sides hashed to blocks, one task per block pair."""
    n_series, points = table_size(series)
    sb = max(1, math.ceil(n_series / SERIES_BLOCK), math.ceil(points / BLOCK_POINTS))
    kb = max(1, math.ceil(n_shapelets / SHAPELET_BLOCK), math.ceil(table_size(shapelets)[1] / BLOCK_POINTS))
    left = series.withColumn("_sb", F.pmod(F.xxhash64("series_id"), F.lit(sb))).withColumn(
        "_kb", F.explode(F.sequence(F.lit(0), F.lit(kb - 1)).cast("array<bigint>")))
    right = shapelets.withColumn("_kb", F.pmod(F.xxhash64("shapelet_id"), F.lit(kb))).withColumn(
        "_sb", F.explode(F.sequence(F.lit(0), F.lit(sb - 1)).cast("array<bigint>")))
    names = schema.fieldNames()

    def join(left, right):
        if not left.num_rows or not right.num_rows:
            return schema_table([])
        own = kernels.Ragged.from_arrow(left.column("values"))
        pool = kernels.Ragged.from_arrow(right.column("values"))
        batches = [pa.RecordBatch.from_arrays(cols, names=names) for cols in _pair_batches(
            _flat(left.column("series_id")), [_flat(left.column(c)) for c in carry], own,
            _flat(right.column("shapelet_id")), pool, metric, on_short, location)]
        return pa.Table.from_batches(batches)

    arrow_schema = to_arrow_schema(schema)

    def schema_table(batches):
        return pa.Table.from_batches(batches, schema=arrow_schema)

    keys = [*([by] if by else []), "_sb", "_kb"]
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(join, schema)


def distance_features(series: DataFrame, shapelets: DataFrame, metric: str = "raw",
                      on_short: str = "inf", location: bool = False,
                      keep: tuple[str, ...] = ("series_id",),
                      broadcast_points: int | None = None) -> DataFrame:
    """One row per series with ``features``: distances in shapelet_id order.

    With ``location`` the relative locations follow the distances in the same array.
    """
    keep = tuple(keep)
    table = shapelets.persist()
    rows, points = table_size(table)
    if not fits_broadcast(rows, points, broadcast_points):
        long = min_distance(series, shapelets, metric, on_short, location, carry=keep[1:],
                            broadcast_points=broadcast_points)
        items = [F.struct("shapelet_id", F.col("dist").alias("x"))]
        arrays = [F.transform(F.sort_array(F.collect_list(items[0])), lambda e: e["x"])]
        if location:
            loc = F.struct("shapelet_id", F.col("loc").alias("x"))
            arrays.append(F.transform(F.sort_array(F.collect_list(loc)), lambda e: e["x"]))
        return long.groupBy(*keep).agg(F.concat(*arrays).alias("features"))

    _, pool = collect_shapelets(table)
    table.unpersist()
    shared = series.sparkSession.sparkContext.broadcast(pool)
    schema = T.StructType([series.schema[c] for c in keep]
                          + [T.StructField("features", T.ArrayType(T.DoubleType()))])
    names = schema.fieldNames()

    def project(batches):
        pool = shared.value
        rows = max(1, kernels.BLOCK_CELLS // max(len(pool), 1))
        for batch in (whole.slice(a, rows) for whole in batches for a in range(0, whole.num_rows, rows)):
            own = kernels.Ragged.from_arrow(batch.column("_values"))
            dist, pos = kernels.ragged_match(own, pool, metric, on_short, location)
            if location:
                span = np.abs(own.lengths[:, None] - pool.lengths[None, :])
                loc = np.where(np.isfinite(dist), pos / np.maximum(span, 1), 0.0)
                dist = np.hstack([dist, loc])
            width = dist.shape[1]
            offsets = pa.array(np.arange(len(own) + 1, dtype=np.int32) * width)
            lists = pa.ListArray.from_arrays(offsets, pa.array(np.ascontiguousarray(dist).reshape(-1)))
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in keep] + [lists], names=names)

    return series.select(*keep, F.col("values").cast("array<double>").alias("_values")).mapInArrow(
        project, schema)


def match_expr(values, shapelet):
    """Column twin of the raw join: struct(square, pos) of the best offset.

    Stays inside the JVM, so it also runs on a streaming table; null when the
    shapelet is longer than the series.
    """
    length = F.size(shapelet)
    offsets = F.sequence(F.lit(0), F.greatest(F.size(values) - length, F.lit(0)))
    windows = F.transform(offsets, lambda k: F.struct(
        F.aggregate(F.transform(shapelet, lambda s, i: s - F.get(values, k + i)), F.lit(0.0),
                    lambda acc, d: acc + d * d).alias("square"),
        k.alias("pos")))
    return F.when(length <= F.size(values), F.array_min(windows))


def min_distance_expr(series: DataFrame, shapelets: DataFrame) -> DataFrame:
    """``min_distance`` with location as a JVM expression over a checked broadcast side."""
    rows, points = table_size(shapelets)
    if not fits_broadcast(rows, points):
        raise ValueError("shapelet table too large to broadcast; use min_distance")
    packed = shapelets.select("shapelet_id", F.col("values").alias("_s")).groupBy().agg(
        F.sort_array(F.collect_list(F.struct("shapelet_id", "_s"))).alias("_pool"))
    joined = attach_row(series, packed).select("series_id", "values", F.explode("_pool").alias("_p"))
    best = joined.select("series_id", F.col("_p.shapelet_id").alias("shapelet_id"),
                         (F.size("values") - F.size("_p._s")).alias("_span"),
                         match_expr(F.col("values"), F.col("_p._s")).alias("_m"))
    return best.select(
        "series_id", "shapelet_id",
        F.coalesce(F.sqrt("_m.square"), F.lit(float("inf"))).alias("dist"),
        F.coalesce(F.col("_m.pos") / F.greatest(F.col("_span"), F.lit(1)), F.lit(0.0)).alias("loc"))


def paired_distance(rows: DataFrame, by: str, shapelet: str = "shapelet", metric: str = "znorm",
                    on_short: str = "swap") -> DataFrame:
    """Adds ``dist``: distance of each row's values to the shapelet in the same row.

    Rows with equal ``by`` hold the same shapelet and are matched together within a batch.
    """
    schema = T.StructType(rows.schema.fields + [T.StructField("dist", T.DoubleType())])

    def run(batches):
        for batch in batches:
            own = kernels.Ragged.from_arrow(batch.column("values"))
            other = kernels.Ragged.from_arrow(batch.column(shapelet))
            keys = np.array(batch.column(by).to_pylist())
            dist = np.full(len(own), np.inf)
            for key in np.unique(keys):
                at = np.flatnonzero(keys == key)
                lo, n = other.starts[at[0]], other.lengths[at[0]]
                pool = kernels.Ragged(other.flat[lo:lo + n], [n])
                part = kernels.Ragged.from_lists([own.flat[own.starts[i]:own.starts[i] + own.lengths[i]] for i in at])
                dist[at] = kernels.ragged_match(part, pool, metric, on_short)[0][:, 0]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(dist)], names=schema.fieldNames())

    return rows.mapInArrow(run, schema)
