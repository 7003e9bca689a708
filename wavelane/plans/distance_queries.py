"""Queries over windows, array functions and distance joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from wavelane.operators import distance as D, segments as G
from wavelane.plans.registry import CUSTOMERS, EMB_POOL, USER_POOL, query
from wavelane.runtime import spread_small_input
from wavelane.sources import pools, tables

# ---------------------------------------------------------------- joins J1-J7

RAW = """dists AS (
  SELECT series_id, label, shapelet_id, len(v) AS n, len(s) AS l,
         list_transform(range(0, len(v) - len(s) + 1), lambda k: list_distance(v[k+1:k+len(s)], s)) AS d
  FROM {src}, pool)"""

ZWIN = """zpool AS (
  SELECT shapelet_id, len(s) AS l, CASE WHEN list_min(s) = list_max(s) THEN list_transform(s, lambda x: 0.0)
    ELSE list_transform(s, lambda x: (x - list_avg(s)) / list_stddev_pop(s)) END AS s FROM pool),
lens AS (SELECT DISTINCT l FROM zpool),
starts AS (SELECT series_id, label, v, l, unnest(range(0, greatest(len(v) - l + 1, 0))) AS k FROM {src}, lens),
wins AS (SELECT series_id, label, l, k, v[k+1:k+l] AS w FROM starts),
stats AS (SELECT *, list_avg(w) AS m, list_stddev_pop(w) AS sd, list_min(w) = list_max(w) AS flat FROM wins),
zwins AS (SELECT series_id, label, l, k, flat,
  CASE WHEN flat THEN list_transform(w, lambda x: 0.0) ELSE list_transform(w, lambda x: (x - m) / sd) END AS w
  FROM stats)"""


def _emb(spark, folder):
    series = tables.emb_series(spark, folder)
    return series, pools.emb_pool(series)


def _users(spark, folder):
    series = tables.user_series(spark, folder)
    return series, pools.user_pool(series)


def finite(col):
    return F.when(F.col(col) < float("inf"), F.round(col, 6))


@query("min_distance", f"""WITH {EMB_POOL}, {RAW.format(src='emb')}
SELECT series_id, shapelet_id, round(list_min(d), 6) AS dist FROM dists""")
def min_distance(spark, folder):
    return D.min_distance(*_emb(spark, folder)).select(
        "series_id", "shapelet_id", F.round("dist", 6).alias("dist"))


@query("min_distance_ragged", f"""WITH {USER_POOL}, {RAW.format(src='users')}
SELECT series_id, shapelet_id, CASE WHEN l <= n THEN round(list_min(d), 6) END AS dist FROM dists""")
def min_distance_ragged(spark, folder):
    return D.min_distance(*_users(spark, folder)).select(
        "series_id", "shapelet_id", finite("dist").alias("dist"))


@query("min_distance_segments", f"""WITH {USER_POOL}, {RAW.format(src='users')}
SELECT series_id, shapelet_id, CASE WHEN l <= n THEN round(list_min(d), 6) END AS dist FROM dists""")
def min_distance_segments(spark, folder):
    """The ragged join over overlapping 32-point segments of each user's events."""
    pool = pools.user_pool(tables.user_series(spark, folder))
    parts = G.segments_from_long(tables.user_points(spark, folder), "series_id", ["ts", "event_id"], "value", 32, 11)
    return G.min_distance_segments(parts, pool, 11).select("series_id", "shapelet_id", finite("dist").alias("dist"))


@query("min_distance_location", f"""WITH {USER_POOL}, {RAW.format(src='users')}
SELECT series_id, shapelet_id, CASE WHEN l <= n THEN round(list_min(d), 6) END AS dist,
  round(CASE WHEN l < n THEN (list_position(list_transform(d, lambda x: round(x, 9)), round(list_min(d), 9)) - 1) / (n - l)
        ELSE 0.0 END, 6) AS loc FROM dists""")
def min_distance_location(spark, folder):
    return D.min_distance(*_users(spark, folder), location=True).select(
        "series_id", "shapelet_id", finite("dist").alias("dist"), F.round("loc", 6).alias("loc"))


@query("min_distance_location_mixed", f"""WITH {USER_POOL}, {CUSTOMERS},
mixed AS (SELECT series_id, label, v FROM users UNION ALL SELECT -1 - series_id, label, v FROM customers),
{RAW.format(src='mixed')}
SELECT series_id, shapelet_id, CASE WHEN l <= n THEN round(list_min(d), 6) END AS dist,
  round(CASE WHEN l < n THEN (list_position(list_transform(d, lambda x: round(x, 9)), round(list_min(d), 9)) - 1) / (n - l)
        ELSE 0.0 END, 6) AS loc FROM dists""")
def min_distance_location_mixed(spark, folder):
    """Series whose values differ by a factor of ten thousand in one table: neighbours do not change a location."""
    series, pool = _users(spark, folder)
    customers = tables.customer_series(spark, folder).withColumn("series_id", -1 - F.col("series_id"))
    return D.min_distance(series.unionByName(customers), pool, location=True).select(
        "series_id", "shapelet_id", finite("dist").alias("dist"), F.round("loc", 6).alias("loc"))


@query("min_distance_expr", f"""WITH {EMB_POOL}, {RAW.format(src='emb')}
SELECT series_id, shapelet_id, round(list_min(d), 6) AS dist,
  round((list_position(d, list_min(d)) - 1) / (n - l), 6) AS loc FROM dists""")
def min_distance_expr(spark, folder):
    series, pool = _emb(spark, folder)
    return D.min_distance_expr(spread_small_input(series), pool).select(
        "series_id", "shapelet_id", F.round("dist", 6).alias("dist"), F.round("loc", 6).alias("loc"))


@query("min_distance_block", f"""WITH {EMB_POOL}, {RAW.format(src='emb')}
SELECT series_id, shapelet_id, round(list_min(d), 6) AS dist FROM dists""")
def min_distance_block(spark, folder):
    """The block join, forced by a broadcast limit of zero points."""
    return D.min_distance(*_emb(spark, folder), broadcast_points=0).select(
        "series_id", "shapelet_id", F.round("dist", 6).alias("dist"))


@query("raw_min_distance", f"""WITH {USER_POOL},
pairs AS (SELECT series_id, shapelet_id, CASE WHEN len(s) > len(v) THEN s ELSE v END AS v,
                 CASE WHEN len(s) > len(v) THEN v ELSE s END AS s FROM users, pool)
SELECT series_id, shapelet_id, round(list_min(list_transform(range(0, len(v) - len(s) + 1),
  lambda k: list_distance(v[k+1:k+len(s)], s))), 6) AS dist FROM pairs""")
def raw_min_distance(spark, folder):
    return D.min_distance(*_users(spark, folder), on_short="swap").select(
        "series_id", "shapelet_id", F.round("dist", 6).alias("dist"))


@query("znorm_min_distance", f"""WITH {EMB_POOL}, {ZWIN.format(src='emb')}
SELECT series_id, shapelet_id, round(min(list_distance(w, s)), 6) AS dist
FROM zwins JOIN zpool USING (l) GROUP BY series_id, shapelet_id""")
def znorm_min_distance(spark, folder):
    return D.min_distance(*_emb(spark, folder), metric="znorm", on_short="swap").select(
        "series_id", "shapelet_id", F.round("dist", 6).alias("dist"))


@query("znorm_min_distance_pos", f"""WITH {EMB_POOL}, {ZWIN.format(src='emb')}
SELECT series_id, shapelet_id, round(min(list_distance(w, s)), 6) AS dist,
  arg_min(k, (round(list_distance(w, s), 9), k)) AS pos
FROM zwins JOIN zpool USING (l) GROUP BY series_id, shapelet_id""")
def znorm_min_distance_pos(spark, folder):
    return D.min_distance(*_emb(spark, folder), metric="znorm", on_short="swap", location=True).select(
        "series_id", "shapelet_id", F.round("dist", 6).alias("dist"), "pos")


@query("corr_min_distance", f"""WITH {EMB_POOL}, {ZWIN.format(src='emb')}
SELECT series_id, shapelet_id,
  round(sqrt(2 * (1 - least(1.0, max(list_inner_product(w, s) / l)))), 6) AS dist
FROM zwins JOIN zpool USING (l) GROUP BY series_id, shapelet_id""")
def corr_min_distance(spark, folder):
    return D.min_distance(*_emb(spark, folder), metric="corr").select(
        "series_id", "shapelet_id", F.round("dist", 6).alias("dist"))


@query("distance_matrix", f"""WITH {EMB_POOL}, {RAW.format(src='emb')},
long AS (SELECT series_id, shapelet_id, row_number() OVER (PARTITION BY series_id ORDER BY shapelet_id) - 1 AS feature,
  list_min(d) AS x FROM dists)
SELECT series_id, feature, round(x, 6) AS x FROM long""")
def distance_matrix(spark, folder):
    """Feature vectors in shapelet order, shown one feature per row."""
    wide = D.distance_features(*_emb(spark, folder), on_short="swap")
    return wide.select("series_id", F.posexplode("features").alias("feature", "x")).select(
        "series_id", F.col("feature").cast("long").alias("feature"), F.round("x", 6).alias("x"))
