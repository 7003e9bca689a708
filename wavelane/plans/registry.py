"""Named queries over the driver tables, each with its SQL twin where SQL can say it."""

from __future__ import annotations

from functools import wraps

from wavelane.runtime import ship_package

QUERIES: dict = {}
ORACLES: dict = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        @wraps(fn)
        def run(spark, folder):
            ship_package(spark)
            return fn(spark, folder)

        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return register


# Common table expressions shared by the SQL twins.
EMB = """emb AS (
  SELECT vec_id AS series_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS v
  FROM embeddings)"""

USERS = """user_label AS (
  SELECT user_id, event_type AS label FROM (
    SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY count(*) DESC, event_type) AS rn
    FROM events GROUP BY user_id, event_type) WHERE rn = 1),
users AS (
  SELECT e.user_id AS series_id, any_value(l.label) AS label, list(e.value ORDER BY e.ts, e.event_id) AS v
  FROM events e JOIN user_label l ON e.user_id = l.user_id GROUP BY e.user_id)"""

CUSTOMERS = """customers AS (
  SELECT o_custkey AS series_id, any_value(c_mktsegment) AS label,
         list(o_totalprice ORDER BY o_orderdate, o_orderkey) AS v
  FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY o_custkey)"""

PARTS = """parts AS (
  SELECT l_partkey AS series_id, any_value(p_brand) AS label,
         list(l_quantity ORDER BY l_shipdate, l_orderkey, l_linenumber) AS v
  FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY l_partkey)"""

# Mean series per label cut into four 16-point segments: one small pool per label.
EMB_POOL = EMB + """,
emb_points AS (SELECT label, unnest(v) AS x, unnest(range(0, len(v))) AS p FROM emb),
emb_mean AS (SELECT label, p, round(avg(x), 6) AS x FROM emb_points GROUP BY label, p),
pool AS (SELECT label * 4 + (p // 16) AS shapelet_id, list(x ORDER BY p) AS s
         FROM emb_mean GROUP BY label, p // 16)"""

USER_POOL = USERS + """,
user_points AS (SELECT label, unnest(v) AS x, unnest(range(0, len(v))) AS p FROM users),
user_mean AS (SELECT label, p, round(avg(x), 6) AS x FROM user_points GROUP BY label, p),
pool AS (SELECT label || '/' || (p // 12) AS shapelet_id, list(x ORDER BY p) AS s
         FROM user_mean GROUP BY label, p // 12)"""


def draw_key_sql(seed: int, *keys: str) -> str:
    """The SQL twin of ``prep.random_key``."""
    return f"('0x' || substr(md5(concat_ws('|', '{seed}', {', '.join(keys)})), 1, 13))::BIGINT"


def uniform_sql(seed: int, *keys: str) -> str:
    return f"({draw_key_sql(seed, *keys)} / 4503599627370496.0::DOUBLE)"
