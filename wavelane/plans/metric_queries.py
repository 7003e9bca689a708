"""Queries over candidate quality, orderings and discovery."""

from __future__ import annotations

from pyspark.sql import functions as F

from wavelane.operators import discover as E, distance as D, metrics as M, prep as P, ranking as R, symbolic as S, windows as W
from wavelane.plans.distance_queries import RAW, _emb
from wavelane.plans.registry import EMB, EMB_POOL, USERS, query
from wavelane.plans.series_queries import MASKS, USER_WORDS, paa_sql, user_words, window_words_sql
from wavelane.sources import tables

DIST = f"""{EMB_POOL}, {RAW.format(src='emb')},
dist AS (SELECT series_id, label, shapelet_id, round(list_min(d), 6) AS dist FROM dists)"""


def distances(spark, folder):
    dist = D.min_distance(*_emb(spark, folder), carry=("label",))
    return dist.withColumn("dist", F.round("dist", 6))


def spread(spark, folder):
    """Every shapelet has one distance per series, so the series count is the group size."""
    return M.spread_for(tables.emb_series(spark, folder).count())


def splits_sql(key, table="dist"):
    """CTE ``splits``: gain, gap and threshold of every boundary, from dense class counts."""
    return f"""cnt AS (SELECT {key}, dist, label, count(*) AS n FROM {table} GROUP BY ALL),
steps AS (SELECT {key}, dist, sum(n) AS n FROM cnt GROUP BY ALL),
labs AS (SELECT DISTINCT label FROM cnt),
wide AS (SELECT s.*, b.label AS lab FROM steps s, labs b),
grid AS (SELECT g.*, coalesce(c.n, 0) AS c FROM wide g LEFT JOIN cnt c ON c.label = g.lab AND c.dist = g.dist
  AND {' AND '.join(f'c.{k.strip()} = g.{k.strip()}' for k in key.split(','))}),
runs AS (SELECT {key}, dist, n, lab, sum(c) OVER (PARTITION BY {key}, lab ORDER BY dist) AS l,
  sum(c) OVER (PARTITION BY {key}, lab) AS t FROM grid),
ent AS (SELECT {key}, dist, any_value(n) AS n, sum(l) AS nl, sum(t) AS nt,
  sum(CASE WHEN l > 0 THEN l * ln(l) ELSE 0 END) AS sl, sum(CASE WHEN t > l THEN (t - l) * ln(t - l) ELSE 0 END) AS sr,
  sum(CASE WHEN t > 0 THEN t * ln(t) ELSE 0 END) AS st FROM runs GROUP BY {key}, dist),
cum AS (SELECT *, lead(dist) OVER w AS nxt, sum(n * dist) OVER w AS dl, sum(n * dist) OVER (PARTITION BY {key}) AS dt
  FROM ent WINDOW w AS (PARTITION BY {key} ORDER BY dist)),
splits AS (SELECT {key}, dist, nl AS left_rows,
  round(((nt * ln(nt) - st) - (nl * ln(nl) - sl) - ((nt - nl) * ln(nt - nl) - sr)) / nt, 6) AS gain,
  round((dt - dl) / (nt - nl) - dl / nl, 6) AS gap, (dist + nxt) / 2 AS threshold FROM cum WHERE nxt IS NOT NULL),
best AS (SELECT * FROM splits QUALIFY row_number() OVER (PARTITION BY {key} ORDER BY gain DESC, gap DESC, dist) = 1)"""


IG = f"{DIST}, {splits_sql('shapelet_id')}"


@query("ig_score", f"WITH {IG} SELECT shapelet_id, gain, gap, round(threshold, 8) AS threshold FROM best")
def ig_score(spark, folder):
    return M.ig_score(distances(spark, folder), digits=6, spread=spread(spark, folder)).withColumn("threshold", F.round("threshold", 8))


@query("ig_threshold", f"WITH {IG} SELECT shapelet_id, round(threshold, 8) AS threshold FROM best")
def ig_threshold(spark, folder):
    return M.ig_threshold(distances(spark, folder), digits=6, spread=spread(spark, folder)).withColumn("threshold", F.round("threshold", 8))


@query("information_gain", f"WITH {IG} SELECT shapelet_id, dist, left_rows::BIGINT AS left_rows, gain FROM splits")
def information_gain(spark, folder):
    """Gain of every possible split of every shapelet's ordered distances."""
    splits = M.split_gains(distances(spark, folder), digits=6, spread=spread(spark, folder))
    return splits.where(F.col("gain").isNotNull()).select(
        "shapelet_id", "dist", F.col("left_rows").cast("long").alias("left_rows"), "gain")


@query("entropy", """WITH c AS (SELECT p_type, p_brand, count(*) AS n FROM part GROUP BY ALL),
t AS (SELECT p_type, sum(n) AS t FROM c GROUP BY p_type)
SELECT p_type, any_value(t)::BIGINT AS n, round(-sum(n / t * ln(n / t)), 6) AS entropy FROM c JOIN t USING (p_type) GROUP BY p_type""")
def entropy(spark, folder):
    out = M.entropy(tables.read(spark, folder, "part"), ["p_type"], "p_brand")
    return out.select("p_type", "n", F.round("entropy", 6).alias("entropy"))


@query("ig_score_bucketed", f"WITH {IG} SELECT shapelet_id, gain, gap FROM best")
def ig_score_bucketed(spark, folder):
    """The two-level form used for groups beyond one task."""
    return M.ig_score(distances(spark, folder), digits=6, spread=M.SPREAD).select("shapelet_id", "gain", "gap")


@query("top_shapelets", f"""WITH {IG} SELECT shapelet_id, gain, gap FROM best
ORDER BY gain DESC, gap DESC, shapelet_id DESC LIMIT 10""")
def top_shapelets(spark, folder):
    scored = M.ig_score(distances(spark, folder), digits=6, spread=spread(spark, folder))
    return R.top_shapelets(scored, 10, tie=("shapelet_id",)).select("shapelet_id", "gain", "gap")


@query("cumulative_class_counts", f"""WITH {DIST},
cnt AS (SELECT shapelet_id, dist, label, count(*) AS n FROM dist GROUP BY ALL)
SELECT shapelet_id, dist, label, (sum(n) OVER (PARTITION BY shapelet_id, label ORDER BY dist))::BIGINT AS left_n,
  (sum(n) OVER (PARTITION BY shapelet_id, label) - sum(n) OVER (PARTITION BY shapelet_id, label ORDER BY dist))::BIGINT AS right_n FROM cnt""")
def cumulative_class_counts(spark, folder):
    return M.cumulative_class_counts(distances(spark, folder), digits=6).drop("n")


@query("next_distance", f"""WITH {DIST}, d AS (SELECT DISTINCT shapelet_id, dist FROM dist)
SELECT shapelet_id, dist, lead(dist) OVER w AS next_dist, round((dist + lead(dist) OVER w) / 2, 8) AS threshold FROM d
WINDOW w AS (PARTITION BY shapelet_id ORDER BY dist)""")
def next_distance(spark, folder):
    return M.next_distance(distances(spark, folder), digits=6).withColumn("threshold", F.round("threshold", 8))


@query("average_rank", """
SELECT l_returnflag AS grp, l_quantity AS value, count(*) AS t,
  avg(r) AS rank FROM (SELECT l_returnflag, l_quantity, row_number() OVER (PARTITION BY l_returnflag ORDER BY l_quantity) AS r FROM lineitem)
GROUP BY l_returnflag, l_quantity""")
def average_rank(spark, folder):
    rows = tables.read(spark, folder, "lineitem").select(
        F.col("l_returnflag").alias("grp"), F.col("l_quantity").alias("value"))
    return M.average_ranks(rows, ["grp"], "value").select("grp", "value", "t", "rank")


@query("f_score", f"""WITH {DIST},
c AS (SELECT shapelet_id, label, count(*) AS n, avg(dist) AS m, var_pop(dist) * count(*) AS ss FROM dist GROUP BY ALL),
g AS (SELECT shapelet_id, avg(dist) AS gm, count(*) AS nn FROM dist GROUP BY shapelet_id)
SELECT shapelet_id, round((sum(n * pow(m - gm, 2)) / (count(*) - 1)) / (sum(ss) / (any_value(nn) - count(*))), 6) AS score
FROM c JOIN g USING (shapelet_id) GROUP BY shapelet_id""")
def f_score(spark, folder):
    return M.f_score(distances(spark, folder)).withColumn("score", F.round("score", 6))


@query("kruskal_score", f"""WITH {DIST},
r AS (SELECT shapelet_id, label, dist, rank() OVER (PARTITION BY shapelet_id ORDER BY dist)
  + (count(*) OVER (PARTITION BY shapelet_id, dist) - 1) / 2 AS r FROM dist),
t AS (SELECT shapelet_id, sum(t * t * t - t) AS ties, sum(t) AS n FROM (SELECT shapelet_id, dist, count(*) AS t FROM dist GROUP BY ALL) GROUP BY shapelet_id),
s AS (SELECT shapelet_id, sum(sr * sr / n) AS s FROM (SELECT shapelet_id, label, sum(r) AS sr, count(*) AS n FROM r GROUP BY ALL) GROUP BY shapelet_id)
SELECT shapelet_id, round((12.0::DOUBLE / (n * (n + 1)) * s - 3 * (n + 1)) / (1 - ties::DOUBLE / (n * n * n - n)), 6) AS score
FROM s JOIN t USING (shapelet_id)""")
def kruskal_score(spark, folder):
    return M.kruskal_score(distances(spark, folder), digits=6, spread=spread(spark, folder)).withColumn("score", F.round("score", 6))


@query("mood_median", f"""WITH {DIST},
m AS (SELECT shapelet_id, median(dist) AS med, count(*) AS nn FROM dist GROUP BY shapelet_id),
c AS (SELECT d.shapelet_id, label, count(*) AS n, count(*) FILTER (dist > med) AS a FROM dist d JOIN m USING (shapelet_id) GROUP BY ALL),
t AS (SELECT shapelet_id, sum(a) AS ta, sum(n) AS tn FROM c GROUP BY shapelet_id),
e AS (SELECT shapelet_id, a, n - a AS b, ta * n / tn AS ea, (tn - ta) * n / tn AS eb FROM c JOIN t USING (shapelet_id))
SELECT shapelet_id, round(sum((a - ea) * (a - ea) / ea + (b - eb) * (b - eb) / eb), 6) AS score FROM e GROUP BY shapelet_id""")
def mood_median(spark, folder):
    return M.mood_median(distances(spark, folder), digits=6, spread=spread(spark, folder)).withColumn("score", F.round("score", 6))


@query("class_scatter", f"""WITH {DIST},
c AS (SELECT shapelet_id, label, count(*) AS n, avg(dist) AS m, var_samp(dist) AS v FROM dist GROUP BY ALL),
g AS (SELECT shapelet_id, avg(dist) AS gm FROM dist GROUP BY shapelet_id),
t AS (SELECT shapelet_id // 4 AS set_id, sum(n * pow(m - gm, 2)) AS sb, sum(v) AS sw FROM c JOIN g USING (shapelet_id) GROUP BY ALL)
SELECT set_id::BIGINT AS set_id, round(sb / (sw + sb), 6) AS score FROM t""")
def class_scatter(spark, folder):
    """Scatter ratio of the four-shapelet set of every label."""
    rows = distances(spark, folder).withColumn("set_id", F.floor(F.col("shapelet_id") / 4).cast("long"))
    return M.class_scatter(rows, ["set_id"]).withColumn("score", F.round("score", 6))


@query("bhattacharyya", f"""WITH {DIST},
b AS (SELECT shapelet_id, min(dist) AS lo, max(dist) AS hi FROM dist GROUP BY shapelet_id),
n AS (SELECT shapelet_id, label, least(floor((dist - lo) / ((hi - lo) / 10)), 9) AS cell, count(*) AS n
  FROM dist JOIN b USING (shapelet_id) WHERE hi - lo >= 1e-5 GROUP BY ALL),
t AS (SELECT shapelet_id, label, sum(n) AS t FROM n GROUP BY ALL),
k AS (SELECT shapelet_id, count(*) AS k FROM t GROUP BY shapelet_id),
p AS (SELECT shapelet_id, cell, product(n / t) AS p, count(*) AS k FROM n JOIN t USING (shapelet_id, label) GROUP BY ALL),
o AS (SELECT shapelet_id, sum(pow(p, 1.0 / k)) AS s FROM p JOIN k USING (shapelet_id, k) WHERE p <> 1 GROUP BY shapelet_id)
SELECT b.shapelet_id, round(CASE WHEN hi - lo < 1e-5 THEN 1.0 ELSE coalesce(s, 0.0) END, 6) AS score FROM b LEFT JOIN o USING (shapelet_id)""")
def bhattacharyya(spark, folder):
    """Class overlap of every shapelet taken as a set of its own."""
    return M.bhattacharyya(distances(spark, folder), ["shapelet_id"]).withColumn("score", F.round("score", 6))


@query("bhattacharyya_sets", f"""WITH {DIST},
b AS (SELECT shapelet_id, min(dist) AS lo, max(dist) AS hi FROM dist GROUP BY shapelet_id),
x AS (SELECT shapelet_id // 4 AS set_id, series_id, label, list(least(floor((dist - lo) / ((hi - lo) / 2)), 1) ORDER BY shapelet_id) AS cell
  FROM dist JOIN b USING (shapelet_id) WHERE hi - lo >= 1e-5 GROUP BY ALL),
n AS (SELECT set_id, cell, label, count(*) AS n FROM x GROUP BY ALL),
t AS (SELECT set_id, label, sum(n) AS t FROM n GROUP BY ALL),
k AS (SELECT set_id, count(*) AS k FROM t GROUP BY set_id),
p AS (SELECT set_id, cell, product(n / t) AS p, count(*) AS k FROM n JOIN t USING (set_id, label) GROUP BY ALL),
o AS (SELECT set_id, sum(pow(p, 1.0 / k)) AS s FROM p JOIN k USING (set_id, k) WHERE p <> 1 GROUP BY set_id)
SELECT k.set_id::BIGINT AS set_id, round(coalesce(s, 0.0), 6) AS score FROM k LEFT JOIN o USING (set_id)""")
def bhattacharyya_sets(spark, folder):
    """Class overlap of every label's four-shapelet set, on a two-cell grid per shapelet."""
    rows = distances(spark, folder).withColumn("set_id", F.floor(F.col("shapelet_id") / 4).cast("long"))
    return M.bhattacharyya(rows, ["set_id"], cells=2).withColumn("score", F.round("score", 6))


@query("distances_by_class", f"""WITH {DIST}
SELECT shapelet_id, label, count(*) AS n, min(dist) AS lo, round(avg(dist), 12) AS mean, max(dist) AS hi FROM dist GROUP BY ALL""")
def distances_by_class(spark, folder):
    return M.distances_by_class(distances(spark, folder)).withColumn("mean", F.round("mean", 12))


# ------------------------------------------------------------ word collisions

MASKED = f"""{USER_WORDS},
masks AS (SELECT unnest({list(range(len(MASKS)))}) AS iter, unnest({MASKS}) AS kept),
mw AS (SELECT series_id, label, length, start, iter, array_to_string(list_transform(kept, lambda p: word[p + 1:p + 1]), '') AS masked FROM words, masks),
bucket AS (SELECT length, iter, masked, label AS cls, count(DISTINCT series_id) AS n FROM mw GROUP BY ALL),
hits AS (SELECT w.series_id, w.length, w.start, w.iter, cls, n FROM mw w JOIN bucket USING (length, iter, masked))"""


def masked_users(spark, folder):
    series = P.encode_labels(tables.user_series(spark, folder))
    words = W.sax_words_of_windows(series, [16, 20], 8, 4, keep=("label_index",))
    labels = [r["label"] for r in P.label_map(series).orderBy("label_index").collect()]
    return W.random_mask(words, MASKS), labels


@query("word_collision", f"""WITH {MASKED}
SELECT series_id, length, start, iter::BIGINT AS iter, cls, n FROM hits""")
def word_collision(spark, folder):
    masked, labels = masked_users(spark, folder)
    hits = S.word_collision(masked, len(labels))
    names = F.array(*[F.lit(l) for l in labels])
    return hits.select("series_id", F.col("length").cast("long").alias("length"), F.col("start").cast("long").alias("start"),
                       F.col("iter").cast("long").alias("iter"), F.posexplode("counts").alias("_c", "n")).where(
        "n > 0").select("series_id", "length", "start", "iter", names[F.col("_c")].alias("cls"), "n")


POWER = f"""{MASKED},
score AS (SELECT series_id, length, start, cls, sum(n) AS s FROM hits GROUP BY ALL),
size AS (SELECT label AS cls, count(*) * {len(MASKS)} AS top FROM users GROUP BY label),
keys AS (SELECT DISTINCT series_id, length, start FROM words),
dense AS (SELECT k.*, z.cls, 2 * coalesce(s, 0) - top AS d FROM (SELECT * FROM keys, size) z
  JOIN keys k USING (series_id, length, start) LEFT JOIN score c ON c.series_id = z.series_id AND c.length = z.length AND c.start = z.start AND c.cls = z.cls),
power AS (SELECT series_id, length, start, (sum(abs(d)) - abs(max(d)) - abs(min(d)) + abs(max(d) - min(d)))::BIGINT AS power
  FROM dense GROUP BY ALL)"""


@query("window_class_score", f"""WITH {MASKED}
SELECT series_id, length, start, cls, sum(n)::BIGINT AS score FROM hits GROUP BY ALL""")
def window_class_score(spark, folder):
    masked, labels = masked_users(spark, folder)
    names = F.array(*[F.lit(l) for l in labels])
    scores = S.window_class_score(masked, len(labels))
    return scores.select("series_id", F.col("length").cast("long").alias("length"), F.col("start").cast("long").alias("start"),
                         F.posexplode("scores").alias("_c", "score")).where("score > 0").select(
        "series_id", "length", "start", names[F.col("_c")].alias("cls"), "score")


def powers(spark, folder):
    return E.window_powers(tables.user_series(spark, folder).persist(), [16, 20], 4, 8, MASKS).select(
        "series_id", F.col("length").cast("long").alias("length"), F.col("start").cast("long").alias("start"), "power")


@query("distinguishing_power", f"WITH {POWER} SELECT * FROM power")
def distinguishing_power(spark, folder):
    return powers(spark, folder)


@query("top_candidates", f"""WITH {POWER}
SELECT series_id, length, start, power, row_number() OVER (PARTITION BY length ORDER BY power DESC, series_id, start) AS rank
FROM power QUALIFY rank <= 25""")
def top_candidates(spark, folder):
    return R.top_candidates(powers(spark, folder), 25).withColumn("rank", F.col("rank").cast("long"))


# ----------------------------------------------------------------- discovery


def candidates_sql(source, lengths, corr=False):
    """CTE ``dist``: z-normalised distance of every window to every series (equal lengths only)."""
    body = ("sqrt(2 * (1 - least(1.0, max(list_inner_product(a.z, b.z)) / a.length)))" if corr
            else "min(list_distance(a.z, b.z))")
    return f"""{window_words_sql(source, lengths, 8)},
dist AS (SELECT a.series_id AS cand, a.start, a.length, b.label, b.series_id AS other, round({body}, 6) AS dist
  FROM wz a JOIN wz b ON a.length = b.length GROUP BY a.series_id, a.start, a.length, b.label, b.series_id)"""


FOUND = """SELECT cand AS series_id, start, length, gain, gap FROM best
ORDER BY gain DESC, gap DESC, cand DESC, start DESC, length DESC LIMIT 10"""


def found(df):
    return df.select("series_id", F.col("start").cast("long").alias("start"),
                     F.col("length").cast("long").alias("length"), "gain", "gap")


SEARCH_LENGTHS = [8, 24, 48]


@query("discover_exhaustive", f"WITH {USERS}, {candidates_sql('users', SEARCH_LENGTHS)}, {splits_sql('cand, start, length')} {FOUND}")
def discover_exhaustive(spark, folder):
    series = tables.user_series(spark, folder).persist()  # read several times: built from the events once
    return found(E.discover_exhaustive(series, lengths=SEARCH_LENGTHS, n=10, digits=6))


@query("discover_fast", f"WITH {USERS}, {candidates_sql('users', SEARCH_LENGTHS, corr=True)}, {splits_sql('cand, start, length')} {FOUND}")
def discover_fast(spark, folder):
    series = tables.user_series(spark, folder).persist()
    return found(E.discover_fast(series, lengths=SEARCH_LENGTHS, n=10, digits=6))


@query("discover_sax", f"""WITH {POWER},
top AS (SELECT series_id, length, start FROM power QUALIFY row_number() OVER (PARTITION BY length ORDER BY power DESC, series_id, start) <= 25),
dist AS (SELECT a.series_id AS cand, a.start, a.length, b.label, b.series_id AS other, round(min(list_distance(a.z, b.z)), 6) AS dist
  FROM wz a JOIN top USING (series_id, length, start) JOIN wz b ON a.length = b.length GROUP BY a.series_id, a.start, a.length, b.label, b.series_id),
{splits_sql('cand, start, length')} {FOUND}""")
def discover_sax(spark, folder):
    # read several times: built from the events once
    series = tables.user_series(spark, folder).persist()
    return found(E.discover_sax(series, lengths=[16, 20], n=10, word=8, candidates=25,
                                masks=MASKS, digits=6))
