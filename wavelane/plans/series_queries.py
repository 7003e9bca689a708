"""Queries over sources, preparation and array functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from wavelane.functions import arrays as A
from wavelane.operators import prep as P, windows as W
from wavelane.plans.registry import CUSTOMERS, EMB, PARTS, USERS, draw_key_sql, query
from wavelane.runtime import fits_broadcast, table_size, write_through
from wavelane.sources import pools, readers, tables

BP4 = A.sax_breakpoints(4)
CUTS4 = "[" + ", ".join(repr(b) for b in BP4) + "]"
MASKS = [[0, 1, 2, 5, 7], [1, 3, 4, 6, 7], [0, 2, 3, 4, 6]]


def points(df, values="values", name="x", keep=("series_id",), digits=6):
    """One row per array element with a rounded value."""
    return df.select(*keep, F.posexplode(values).alias("p", name)).select(
        *keep, F.col("p").cast("long").alias("pos"), F.round(name, digits).alias(name))


def label_mean_pairs(series):
    """Each series next to the mean series of its label, as arrays x and y."""
    means = write_through(pools.label_means(series).groupBy("label").agg(
        F.sort_array(F.collect_list(F.struct("p", "x"))).alias("_m")).select(
        "label", F.transform("_m", lambda e: e["x"]).alias("y")))
    # Joining on the label alone would gather each label in one task.
    spread = 4 * series.sparkSession.sparkContext.defaultParallelism
    if fits_broadcast(*table_size(means, "y")):
        joined = series.repartition(spread, "series_id").join(F.broadcast(means), "label")
    else:
        copies = means.withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(spread - 1))))
        joined = series.withColumn("_part", F.pmod(F.xxhash64("series_id"), F.lit(spread)).cast("int")).join(copies, ["label", "_part"])
    return joined.select("series_id", "label", F.col("values").alias("x"), "y")


CUST_PAIRS = CUSTOMERS + """,
cpoints AS (SELECT label, unnest(v) AS x, unnest(range(0, len(v))) AS p FROM customers),
cmean AS (SELECT label, list(x ORDER BY p) AS y FROM (
  SELECT label, p, round(avg(x), 6) AS x FROM cpoints GROUP BY label, p) GROUP BY label),
pairs AS (SELECT series_id, c.label, v AS x, y FROM customers c JOIN cmean m ON c.label = m.label)"""

# ------------------------------------------------------------------- sources


@query("series_from_wide", """
SELECT p_partkey AS series_id, p_brand AS label, unnest([0::BIGINT, 1::BIGINT]) AS pos,
       unnest([round(p_size::DOUBLE, 6), round(p_retailprice, 6)]) AS x FROM part""")
def series_from_wide(spark, folder):
    wide = tables.read(spark, folder, "part").select("p_partkey", "p_brand", "p_size", "p_retailprice")
    return points(readers.series_from_wide(wide, "p_brand", "p_partkey"), keep=("series_id", "label"))


@query("series_from_long", f"""WITH {USERS}
SELECT series_id, unnest(range(0, len(v))) AS pos, unnest(list_transform(v, lambda x: round(x, 6))) AS x FROM users""")
def series_from_long(spark, folder):
    return points(readers.series_from_long(tables.user_points(spark, folder), "series_id", ["ts", "event_id"], "value"))


# --------------------------------------------------------------- preparation


@query("encode_labels", """
SELECT p_brand AS label, dense_rank() OVER (ORDER BY p_brand) - 1 AS label_index, count(*) AS n
FROM part GROUP BY p_brand""")
def encode_labels(spark, folder):
    rows = tables.read(spark, folder, "part").select(F.col("p_brand").alias("label"))
    return P.encode_labels(rows).groupBy("label", F.col("label_index").cast("long").alias("label_index")).agg(
        F.count(F.lit(1)).alias("n"))


Z = """CASE WHEN list_min({v}) = list_max({v}) THEN list_transform({v}, lambda x: 0.0)
  ELSE list_transform({v}, lambda x: round((x - list_avg({v})) / list_stddev_pop({v}), 6)) END"""


@query("z_norm", f"""WITH {CUSTOMERS}
SELECT series_id, unnest(range(0, len(v))) AS pos, unnest({Z.format(v='v')}) AS x FROM customers""")
def z_norm(spark, folder):
    series = tables.customer_series(spark, folder)
    return points(series.select("series_id", A.z_norm(F.col("values")).alias("values")))


@query("scale_series", f"""WITH {EMB}
SELECT series_id, unnest(range(0, len(v))) AS pos, unnest({Z.format(v='v')}) AS x FROM emb""")
def scale_series(spark, folder):
    return points(P.scale_series(tables.emb_series(spark, folder)))


GLOBAL = USERS + """,
g AS (SELECT avg(x) AS m, stddev_pop(x) AS s FROM (SELECT unnest(v) AS x FROM users)),
scaled AS (SELECT series_id, label, list_transform(v, lambda x: (x - m) / s) AS v FROM users, g)"""


@query("scale_global", f"""WITH {GLOBAL}
SELECT series_id, unnest(range(0, len(v))) AS pos, unnest(list_transform(v, lambda x: round(x, 6))) AS x FROM scaled""")
def scale_global(spark, folder):
    series = tables.user_series(spark, folder)
    return points(P.scale_global(series, series))


@query("scale_minmax", f"""WITH {EMB},
x AS (SELECT series_id, unnest(v) AS x, unnest(range(0, len(v))) AS pos FROM emb),
b AS (SELECT pos, min(x) AS lo, max(x) AS hi FROM x GROUP BY pos)
SELECT series_id, pos, round((x - lo) / (hi - lo), 6) AS x FROM x JOIN b USING (pos)""")
def scale_minmax(spark, folder):
    rows = tables.emb_series(spark, folder).select("series_id", F.col("values").alias("features"))
    return points(P.scale_minmax(rows, rows), "features")


@query("series_limits", f"""WITH {USERS}, {CUSTOMERS}, {PARTS}, {EMB},
n AS (SELECT 'users' AS source, len(v) AS n FROM users UNION ALL SELECT 'customers', len(v) FROM customers
  UNION ALL SELECT 'parts', len(v) FROM parts UNION ALL SELECT 'embeddings', len(v) FROM emb)
SELECT source, min(n) AS min_len, CASE WHEN max(n) > 20 THEN max(n) // 2 ELSE max(n) END AS max_len,
  floor(sqrt(min(n)))::BIGINT + 1 AS max_shaps, min(n) > 4 AS valid FROM n GROUP BY source""")
def series_limits(spark, folder):
    out = None
    for name, series in (("users", tables.user_series), ("customers", tables.customer_series),
                         ("parts", tables.part_series), ("embeddings", tables.emb_series)):
        row = P.series_limits(series(spark, folder)).select(
            F.lit(name).alias("source"), *[F.col(c).cast("long") for c in ("min_len", "max_len", "max_shaps")], "valid")
        out = row if out is None else out.unionByName(row)
    return out


@query("stratified_split", f"""
SELECT p_partkey AS series_id, p_brand AS label,
  CASE WHEN row_number() OVER (PARTITION BY p_brand ORDER BY {draw_key_sql(7, 'p_partkey')}, p_partkey)
       <= floor(count(*) OVER (PARTITION BY p_brand) * 0.5 + 0.5) THEN 'train' ELSE 'test' END AS split FROM part""")
def stratified_split(spark, folder):
    rows = tables.read(spark, folder, "part").select(
        F.col("p_partkey").alias("series_id"), F.col("p_brand").alias("label"))
    return P.stratified_split(rows, 0.5, seed=7).select("series_id", "label", "split")


@query("split_by_index", """
SELECT doc_id, n_chars, CASE WHEN doc_id IN (SELECT doc_id FROM labels) THEN 'test' ELSE 'train' END AS split
FROM documents""")
def split_by_index(spark, folder):
    docs = tables.read(spark, folder, "documents").select("doc_id", "n_chars")
    return P.split_by_index(docs, tables.read(spark, folder, "labels"), "doc_id")


@query("sample_series", f"""WITH {PARTS}
SELECT series_id, label FROM parts ORDER BY {draw_key_sql(3, 'series_id')}, series_id LIMIT 10""")
def sample_series(spark, folder):
    return P.sample_series(tables.part_series(spark, folder).select("series_id", "label"), 10, seed=3)


@query("filter_class", f"""WITH {CUSTOMERS}
SELECT series_id, label, len(v) AS n FROM customers WHERE label = 'BUILDING'""")
def filter_class(spark, folder):
    return P.filter_class(tables.customer_series(spark, folder), "BUILDING").select(
        "series_id", "label", F.size("values").cast("long").alias("n"))


@query("union_splits", """
SELECT split, count(*) AS n, sum(n_chars)::BIGINT AS chars FROM (
  SELECT n_chars, 'test' AS split FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)
  UNION ALL SELECT n_chars, 'train' FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)) GROUP BY split""")
def union_splits(spark, folder):
    rows = split_by_index(spark, folder)
    both = P.union_splits(rows.where("split = 'train'"), rows.where("split = 'test'"))
    return both.groupBy("split").agg(F.count(F.lit(1)).alias("n"), F.sum("n_chars").alias("chars"))


@query("index_difference", "SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels")
def index_difference(spark, folder):
    return P.index_difference(tables.read(spark, folder, "documents"), tables.read(spark, folder, "labels"), "doc_id")


@query("distinct_labels", f"""WITH {USERS}, {CUSTOMERS}, {PARTS}
SELECT DISTINCT 'users' AS source, label FROM users UNION SELECT 'customers', label FROM customers
UNION SELECT 'parts', label FROM parts""")
def distinct_labels(spark, folder):
    out = None
    for name, series in (("users", tables.user_series), ("customers", tables.customer_series),
                         ("parts", tables.part_series)):
        rows = P.label_map(series(spark, folder)).select(F.lit(name).alias("source"), "label")
        out = rows if out is None else out.unionByName(rows)
    return out


# ------------------------------------------------------------ array functions


@query("subseries", f"""WITH {CUSTOMERS},
w AS (SELECT series_id, label, l AS length, unnest(range(0, len(v) - l + 1)) AS start, v FROM customers, (SELECT unnest([6::BIGINT, 8::BIGINT]) AS l) WHERE len(v) >= l)
SELECT series_id, length, start, round(list_sum(v[start + 1:start + length]), 4) AS total FROM w""")
def subseries(spark, folder):
    out = W.subseries(tables.customer_series(spark, folder), [6, 8])
    return out.select("series_id", F.col("length").cast("long").alias("length"),
                      F.col("start").cast("long").alias("start"), F.round(A.total(F.col("values")), 4).alias("total"))


def paa_sql(v, n, w):
    """Frame means of list ``v`` with ``n`` points in ``w`` frames (SQL text)."""
    return (f"list_transform(range(0, {w}), lambda i: list_avg({v}[i * ({n} // {w}) + 1:"
            f"CASE WHEN i = {w} - 1 THEN {n} ELSE (i + 1) * ({n} // {w}) END]))")


@query("paa", f"""WITH {USERS}
SELECT series_id, unnest(range(0, 7)) AS pos, unnest(list_transform({paa_sql('v', 'len(v)', '7')}, lambda x: round(x, 6))) AS x FROM users""")
def paa(spark, folder):
    series = tables.user_series(spark, folder)
    return points(series.select("series_id", A.paa(F.col("values"), 7).alias("values")))


SYMBOL_SQL = f"len(list_filter({CUTS4}, lambda b: b <= {{x}}))"


@query("sax_breakpoints", f"""WITH g AS (SELECT avg(value) AS m, stddev_pop(value) AS s FROM events),
z AS (SELECT (value - m) / s AS z FROM events, g), c AS (SELECT unnest({CUTS4}) AS cut)
SELECT round(cut, 6) AS cut, count(*) FILTER (z < cut) AS below FROM z, c GROUP BY cut""")
def sax_breakpoints(spark, folder):
    """Standardised event values below each of the equiprobable cut points."""
    events = tables.read(spark, folder, "events").select(F.array("value").alias("values"))
    z = P.scale_global(events, events).select(F.col("values")[0].alias("z"))
    one = z.agg(*[F.count(F.when(F.col("z") < b, 1)).alias(f"c{i}") for i, b in enumerate(BP4)])
    return one.select(F.explode(F.array(*[F.struct(F.round(F.lit(b), 6).alias("cut"), F.col(f"c{i}").alias("below"))
                                          for i, b in enumerate(BP4)])).alias("e")).select("e.*")


@query("sax_symbol", f"""WITH g AS (SELECT avg(value) AS m, stddev_pop(value) AS s FROM events)
SELECT event_id, {SYMBOL_SQL.format(x='(value - m) / s')} AS symbol FROM events, g""")
def sax_symbol(spark, folder):
    events = tables.read(spark, folder, "events").select("event_id", F.array("value").alias("values"))
    z = P.scale_global(events, events)
    return z.select("event_id", A.sax_symbol(F.col("values")[0], 4).cast("long").alias("symbol"))


def letters_sql(values):
    return (f"array_to_string(list_transform({values}, lambda m: "
            f"chr((97 + len(list_filter({CUTS4}, lambda b: b <= m + 1e-12)))::INTEGER)), '')")


EMB_WORDS = EMB + f""",
ez AS (SELECT series_id, label, list_transform(v, lambda x: (x - list_avg(v)) / list_stddev_pop(v)) AS z FROM emb),
ew AS (SELECT series_id, label, list_transform({paa_sql('z', 'len(z)', '8')}, lambda m: len(list_filter({CUTS4}, lambda b: b <= m))) AS w FROM ez)"""


@query("sax_word", f"""WITH {EMB_WORDS}
SELECT series_id, array_to_string(list_transform(w, lambda s: chr((97 + s)::INTEGER)), '') AS word FROM ew""")
def sax_word(spark, folder):
    series = tables.emb_series(spark, folder)
    return series.select("series_id", W.word_string(A.sax_word(A.z_norm(F.col("values")), 8, 4)).alias("word"))


def window_words_sql(source, lengths, word):
    """Words of all z-normalised windows of ``source`` as CTE ``words``."""
    return f"""ww AS (SELECT series_id, label, l AS length, unnest(range(0, greatest(len(v) - l + 1, 0))) AS start, v
  FROM {source}, (SELECT unnest({lengths})::BIGINT AS l)),
wv AS (SELECT series_id, label, length, start, v[start + 1:start + length] AS w FROM ww),
ws AS (SELECT *, list_avg(w) AS m, list_stddev_pop(w) AS sd, list_min(w) = list_max(w) AS flat FROM wv),
wz AS (SELECT series_id, label, length, start,
  CASE WHEN flat THEN list_transform(w, lambda x: 0.0) ELSE list_transform(w, lambda x: (x - m) / sd) END AS z FROM ws),
words AS (SELECT series_id, label, length, start, {letters_sql(paa_sql('z', 'length', str(word)))} AS word FROM wz)"""


USER_WORDS = USERS + ",\n" + window_words_sql("users", "[16, 20]", 8)


def user_words(spark, folder):
    return W.sax_words_of_windows(tables.user_series(spark, folder), [16, 20], 8, 4)


@query("sax_words_of_windows", f"WITH {USER_WORDS} SELECT series_id, length, start, word FROM words")
def sax_words_of_windows(spark, folder):
    return user_words(spark, folder).select(
        "series_id", F.col("length").cast("long").alias("length"), F.col("start").cast("long").alias("start"), "word")


@query("random_mask", f"""WITH {USER_WORDS},
masks AS (SELECT unnest({[i for i in range(len(MASKS))]}) AS iter, unnest({MASKS}) AS kept)
SELECT iter::BIGINT AS iter, array_to_string(list_transform(kept, lambda p: word[p + 1:p + 1]), '') AS masked, count(*) AS n
FROM words, masks GROUP BY ALL""")
def random_mask(spark, folder):
    masked = W.random_mask(user_words(spark, folder), MASKS)
    return masked.groupBy(F.col("iter").cast("long").alias("iter"), "masked").agg(F.count(F.lit(1)).alias("n"))


def cell_sql(a, b):
    table = A.sax_distance_table(4)
    return f"{table}[{a} + 1][{b} + 1]"


@query("sax_distance_table", f"""WITH {EMB_WORDS},
p AS (SELECT unnest(w[1:7]) AS a, unnest(w[2:8]) AS b FROM ew)
SELECT a, b, round({cell_sql('a', 'b')}, 6) AS cell, count(*) AS n FROM p GROUP BY a, b""")
def sax_distance_table(spark, folder):
    """Cell distance of every pair of neighbouring symbols in the words, with its count."""
    word = A.sax_word(A.z_norm(F.col("values")), 8, 4)
    words = tables.emb_series(spark, folder).select(word.alias("w"))
    pairs = words.select(F.explode(F.arrays_zip(F.slice("w", 1, 7).alias("a"), F.slice("w", 2, 7).alias("b"))).alias("p"))
    table = F.array(*[F.array(*[F.lit(x) for x in row]) for row in A.sax_distance_table(4)])
    return pairs.groupBy(F.col("p.a").cast("long").alias("a"), F.col("p.b").cast("long").alias("b")).agg(
        F.count(F.lit(1)).alias("n")).select("a", "b", F.round(table[F.col("a")][F.col("b")], 6).alias("cell"), "n")


@query("sax_distance", f"""WITH {EMB_WORDS},
emb_points AS (SELECT label, unnest(v) AS x, unnest(range(0, len(v))) AS p FROM emb),
em AS (SELECT label, list(x ORDER BY p) AS y FROM (SELECT label, p, round(avg(x), 6) AS x FROM emb_points GROUP BY label, p) GROUP BY label),
mz AS (SELECT label, list_transform(y, lambda x: (x - list_avg(y)) / list_stddev_pop(y)) AS z FROM em),
mw AS (SELECT label, list_transform({paa_sql('z', 'len(z)', '8')}, lambda m: len(list_filter({CUTS4}, lambda b: b <= m))) AS y FROM mz)
SELECT series_id, round(sqrt(64 / 8) * list_sum(list_transform(range(1, 9), lambda i: {cell_sql('w[i]', 'y[i]')})), 6) AS dist,
  round(sqrt(64 / 8) * sqrt(list_sum(list_transform(range(1, 9), lambda i: pow({cell_sql('w[i]', 'y[i]')}, 2)))), 6) AS bound
FROM ew JOIN mw USING (label)""")
def sax_distance(spark, folder):
    """Distance of each series' word to the word of its label's mean series."""
    pairs = label_mean_pairs(tables.emb_series(spark, folder))
    a = A.sax_word(A.z_norm(F.col("x")), 8, 4)
    b = A.sax_word(A.z_norm(F.col("y")), 8, 4)
    words = pairs.select("series_id", F.size("x").alias("n"), a.alias("a"), b.alias("b"))
    args = (F.col("a"), F.col("b"), F.col("n"), 4)
    return words.select("series_id", F.round(A.sax_distance(*args), 6).alias("dist"),
                        F.round(A.sax_distance(*args, squared=True), 6).alias("bound"))


CELLS_SQL = "MAP {" + ", ".join(f"{a * 4 + b}: {r * 4 + c}" for (a, b), (r, c) in W.BITMAP_CELLS.items()) + "}"


@query("sax_bitmap", f"""WITH {GLOBAL},
s AS (SELECT series_id, list_transform(v, lambda x: {SYMBOL_SQL.format(x='x')}) AS s FROM scaled),
p AS (SELECT series_id, len(s) - 1 AS n, unnest(list_transform(range(1, len(s)), lambda i: s[i] * 4 + s[i + 1])) AS p FROM s)
SELECT series_id, (c // 4)::BIGINT AS row, (c % 4)::BIGINT AS col, round(count(*) / any_value(n), 6) AS share
FROM (SELECT series_id, n, {CELLS_SQL}[p] AS c FROM p) GROUP BY series_id, c""")
def sax_bitmap(spark, folder):
    series = tables.user_series(spark, folder)
    return W.sax_bitmap(series, series).withColumn("share", F.round("share", 6))


@query("prefix_stats", f"""WITH {USERS},
x AS (SELECT series_id, unnest(v) AS x, unnest(range(1, len(v) + 1)) AS pos FROM users)
SELECT series_id, pos, round(sum(x) OVER w, 4) AS s1, round(sum(x * x) OVER w, 4) AS s2 FROM x
WINDOW w AS (PARTITION BY series_id ORDER BY pos)
UNION ALL SELECT series_id, 0, 0.0, 0.0 FROM users""")
def prefix_stats(spark, folder):
    stats = W.prefix_stats(tables.user_series(spark, folder))
    both = F.arrays_zip(F.col("s1").alias("s1"), F.col("s2").alias("s2"))
    return stats.select("series_id", F.posexplode(both).alias("p", "e")).select(
        "series_id", F.col("p").cast("long").alias("pos"), F.round("e.s1", 4).alias("s1"), F.round("e.s2", 4).alias("s2"))


@query("cross_prefix", f"""WITH {CUST_PAIRS},
g AS (SELECT series_id, x, y, unnest(range(0, len(x))) AS u FROM pairs),
h AS (SELECT series_id, x, y, u, unnest(range(0, len(y))) AS v FROM g)
SELECT series_id, u, v, round(sum(x[u + 1] * y[v + 1] / 1e6) OVER (PARTITION BY series_id, u - v ORDER BY u), 3) AS m FROM h""")
def cross_prefix(spark, folder):
    pairs = label_mean_pairs(tables.customer_series(spark, folder))
    scaled = pairs.select("series_id", F.transform("x", lambda a: a / 1e3).alias("x"),
                          F.transform("y", lambda a: a / 1e3).alias("y"))
    return W.cross_prefix(scaled).select("series_id", "u", "v", F.round("m", 3).alias("m"))


CORR_SQL = CUST_PAIRS + """,
wu AS (SELECT series_id, y, x[u + 1:u + 6] AS a, u FROM (SELECT *, unnest(range(0, len(x) - 5)) AS u FROM pairs WHERE len(x) >= 6)),
wv AS (SELECT series_id, u, a, y[v + 1:v + 6] AS b, v FROM (SELECT *, unnest(range(0, len(y) - 5)) AS v FROM wu)),
wn AS (SELECT series_id, u, v, list_transform(a, lambda t: (t - list_avg(a)) / list_stddev_pop(a)) AS a,
  list_transform(b, lambda t: (t - list_avg(b)) / list_stddev_pop(b)) AS b FROM wv),
c AS (SELECT series_id, u, v, least(1.0, list_inner_product(a, b) / 6) AS corr FROM wn)"""


@query("window_correlation", f"WITH {CORR_SQL} SELECT series_id, u, v, round(corr, 6) AS corr FROM c")
def window_correlation(spark, folder):
    pairs = label_mean_pairs(tables.customer_series(spark, folder))
    return W.window_correlation(pairs, 6).withColumn("corr", F.round("corr", 6))


@query("window_correlation_small", f"WITH {CORR_SQL} SELECT series_id, u, v, round(corr, 6) AS corr FROM c")
def window_correlation_small(spark, folder):
    """Correlations do not depend on the amplitude: the same pairs scaled by 1e-7."""
    small = lambda c: F.transform(c, lambda x: x * F.lit(1e-7)).alias(c)
    pairs = label_mean_pairs(tables.customer_series(spark, folder)).select("series_id", small("x"), small("y"))
    return W.window_correlation(pairs, 6).withColumn("corr", F.round("corr", 6))


@query("correlation_distance", f"""WITH {CORR_SQL}
SELECT series_id, u, round(min(sqrt(2 * (1 - corr))), 4) AS dist FROM c GROUP BY series_id, u""")
def correlation_distance(spark, folder):
    pairs = label_mean_pairs(tables.customer_series(spark, folder))
    corr = W.window_correlation(pairs, 6)
    return corr.groupBy("series_id", "u").agg(
        F.round(F.min(W.correlation_distance(F.col("corr"))), 4).alias("dist"))


@query("barycenter", f"""WITH {CUST_PAIRS}
SELECT series_id, unnest(range(0, least(len(x), len(y)))) AS pos,
  unnest(list_transform(range(1, least(len(x), len(y)) + 1), lambda i: round((x[i] + y[i]) / 2, 8))) AS x FROM pairs""")
def barycenter(spark, folder):
    pairs = label_mean_pairs(tables.customer_series(spark, folder))
    mid = pairs.select("series_id", A.barycenter(F.col("x"), F.col("y")).alias("values"))
    return points(mid, digits=8)


@query("merge_aligned", f"""WITH {CUST_PAIRS},
d AS (SELECT series_id, x, y, floor(((series_id * 37) % 100) / 100 * (len(y) - len(x)))::BIGINT AS start FROM pairs)
SELECT series_id, start, unnest(range(0, len(x))) AS pos,
  unnest(list_transform(range(1, len(x) + 1), lambda i: round((x[i] + y[i + start]) / 2, 8))) AS x FROM d""")
def merge_aligned(spark, folder):
    """Each customer's series merged with a window of its label's (longer) mean series."""
    pairs = label_mean_pairs(tables.customer_series(spark, folder))
    draw = ((F.col("series_id") * 37) % 100) / 100
    merged = pairs.select("series_id", A.merge_aligned(F.col("x"), F.col("y"), draw).alias("m")).select(
        "series_id", F.col("m.start").cast("long").alias("start"), F.col("m.centroid").alias("values"))
    return points(merged, keep=("series_id", "start"), digits=8)


@query("shapelet_key", f"""WITH {PARTS},
w AS (SELECT v[k + 1:k + 3] AS w FROM (SELECT v, unnest(range(0, len(v) - 2)) AS k FROM parts))
SELECT count(*) AS windows, count(DISTINCT w) AS distinct_windows FROM w""")
def shapelet_key(spark, folder):
    """Windows of three quantities, and how many remain after removing equal ones by key."""
    windows = W.subseries(tables.part_series(spark, folder), [3])
    return windows.agg(F.count(F.lit(1)).alias("windows"),
                       F.count_distinct(A.shapelet_key(F.col("values"))).alias("distinct_windows"))
