"""Queries over evolved and swarm discovery, trees and classifiers."""

from __future__ import annotations

import re
import uuid

from pyspark.ml.functions import array_to_vector
from pyspark.sql import Window, functions as F

from wavelane.functions import breeding as B
from wavelane.ml import classifiers as C, machines as S
from wavelane.ml.estimators import GeneticShapelets, ShapeletModel, ShapeletTransformer, ShapeletTreeClassifier
from wavelane.operators import distance as D, evolve as V, fitness as Fit, prep as P, ranking as R, reports as Z, tree as T
from wavelane.plans.distance_queries import RAW, _emb
from wavelane.plans.metric_queries import DIST, FOUND, SEARCH_LENGTHS, candidates_sql, distances, splits_sql
from wavelane.plans.registry import EMB, EMB_POOL, PARTS, USERS, draw_key_sql, query, uniform_sql
from wavelane.plans.series_queries import label_mean_pairs
from wavelane.runtime import attach_row, scratch_folder
from wavelane.sources import pools, tables


def shapelet_points(df, digits=9):
    return df.select("shapelet_id", F.posexplode("values").alias("p", "x")).select(
        "shapelet_id", F.col("p").cast("long").alias("pos"), F.round("x", digits).alias("x"))


def features(spark, folder):
    """Distances of every embedding to the pool, with integer labels."""
    series, pool = _emb(spark, folder)
    return D.distance_features(series, pool, keep=("series_id", "label"))


def vectors(spark, folder):
    return features(spark, folder).select(
        "series_id", F.col("label").cast("double").alias("label"), array_to_vector("features").alias("features")).persist()


# ---------------------------------------------------------------- evolution steps


def _population(spark, folder, size=6):
    series = P.encode_labels(tables.emb_series(spark, folder)).select("series_id", "label_index", "values")
    return series, V.write_through(V.initial_population(series, size, 5, 11, 64, 32))


@query("init_random", f"""WITH {EMB},
draws AS (SELECT ind_id, pos, 4 + floor({uniform_sql(2, 'ind_id', 'pos')} * 28)::INT AS len,
    floor({uniform_sql(3, 'ind_id', 'pos')} * (SELECT count(*) FROM emb)) AS place FROM range(8) a(ind_id), range(3) b(pos)),
picked AS (SELECT *, dense_rank() OVER (ORDER BY place) - 1 AS i, floor({uniform_sql(4, 'ind_id', 'pos')} * (64 - len))::INT AS start FROM draws),
ordered AS (SELECT v, row_number() OVER (ORDER BY {draw_key_sql(1, 'series_id')}, series_id) - 1 AS i FROM emb),
windows AS (SELECT ind_id, pos, v[start + 1:start + len] AS w FROM picked JOIN ordered USING (i))
SELECT ind_id, pos, unnest(range(0, len(w))) AS point, unnest(list_transform(w, lambda x: round(x, 6))) AS x FROM windows""")
def init_random(spark, folder):
    series = tables.emb_series(spark, folder)
    sets = spark.range(8).select(F.col("id").alias("ind_id"), F.lit(3).alias("k"))
    drawn = V.init_random(series, sets, 1, 64, 32).select("ind_id", F.col("pos").cast("long").alias("pos"), F.posexplode("values").alias("point", "x"))
    return drawn.select("ind_id", "pos", F.col("point").cast("long").alias("point"), F.round("x", 6).alias("x"))


@query("init_kmeans")
def init_kmeans(spark, folder):
    series = tables.emb_series(spark, folder)
    sets = spark.range(8).select(F.col("id").alias("ind_id"), F.lit(3).alias("k"))
    return V.init_kmeans(series, sets, 1, 64, 32).select("ind_id", "pos", F.size("values").alias("n"))


@query("init_motif")
def init_motif(spark, folder):
    found = V.init_motif(tables.emb_series(spark, folder), 16, draws=40, seed=2)
    return found.select("shapelet_id", F.size("values").alias("n"), "profile")


def _bred(spark, folder, crossovers, mutations):
    """The label sets (four 16-point shapelets each) as sources, and what one sure step makes of them."""
    pool = pools.emb_pool(tables.emb_series(spark, folder))
    source = pool.select(F.floor(F.col("shapelet_id") / 4).cast("long").alias("ind_id"),
                         (F.col("shapelet_id") % 4).cast("int").alias("pos"), "values")
    fresh = source.where("pos = 0").withColumn("ind_id", (F.col("ind_id") + 3) % 10)
    bred = V.write_through(V.breed_population(source, fresh, 3, 1, crossovers, mutations, 1.0, 1.0))
    return source, bred


def _is_part(whole, part):
    """Whether an array is a run of another, as a column."""
    starts = F.sequence(F.lit(0), F.greatest(F.size(whole) - F.size(part), F.lit(0)))
    return F.exists(starts, lambda k: F.slice(whole, k + 1, F.size(part)) == part)


def _kept(spark, folder, mutation):
    """Per set: shapelets afterwards, how many of them are sources, and how many are runs of a source of any set."""
    source, bred = _bred(spark, folder, [], [mutation])
    sources = source.agg(F.collect_list("values").alias("sources"))  # the pool: four per label
    told = attach_row(bred, sources).select(
        "ind_id", F.array_contains("sources", F.col("values")).cast("long").alias("same"),
        F.exists("sources", lambda s: _is_part(s, F.col("values"))).cast("long").alias("run"))
    return told.groupBy("ind_id").agg(F.count(F.lit(1)).alias("n"), F.sum("same").alias("same"), F.sum("run").alias("run"))


def _kept_sql(n: int, same: int, run: int) -> str:
    return f"SELECT DISTINCT label::BIGINT AS ind_id, {n}::BIGINT AS n, {same}::BIGINT AS same, {run}::BIGINT AS run FROM embeddings"


@query("mutate_remove", _kept_sql(3, 3, 3))
def mutate_remove(spark, folder):
    return _kept(spark, folder, B.mutate_remove)


@query("mutate_add", _kept_sql(5, 5, 5))
def mutate_add(spark, folder):
    return _kept(spark, folder, B.mutate_add)


@query("mutate_mask", _kept_sql(4, 3, 4))
def mutate_mask(spark, folder):
    return _kept(spark, folder, B.mutate_mask)


@query("mutate_noise", "SELECT DISTINCT label::BIGINT AS ind_id, 4::BIGINT AS n, true AS others_kept, true AS near FROM embeddings")
def mutate_noise(spark, folder):
    """At most one shapelet of a set changes, and no point by more than six deviations."""
    source, bred = _bred(spark, folder, [], [B.mutate_noise])
    both = bred.join(source.withColumnRenamed("values", "old"), ["ind_id", "pos"]).select(
        "ind_id", (F.col("values") == F.col("old")).cast("int").alias("same"),
        F.array_max(F.zip_with("values", "old", lambda a, b: F.abs(a - b))).alias("far"))
    return both.groupBy("ind_id").agg(F.count(F.lit(1)).alias("n"), (F.sum("same") >= 3).alias("others_kept"), (F.max("far") < 0.6).alias("near"))


def _pair_points(rows):
    """Per pair of sets: shapelets, points, and the sum of the points and of their squares."""
    points = rows.select(F.floor(F.col("ind_id") / 2).cast("long").alias("pair"), F.posexplode("values").alias("at", "x"))
    return points.groupBy("pair").agg(F.sum((F.col("at") == 0).cast("long")).alias("n"), F.count(F.lit(1)).alias("points"),
                                      F.round(F.sum("x"), 5).alias("total"), F.round(F.sum(F.col("x") * F.col("x")), 5).alias("squares"))


PAIR_POINTS = f"""WITH {EMB_POOL}, points AS (SELECT shapelet_id // 8 AS pair, shapelet_id, unnest(s) AS x FROM pool)
SELECT pair, count(DISTINCT shapelet_id) AS n, count(*) AS points, round(sum(x), 5) AS total"""


@query("cross_points", f"{PAIR_POINTS}, count(DISTINCT shapelet_id) AS kept FROM points GROUP BY pair")
def cross_points(spark, folder):
    """Whole shapelets change sets; none is lost, doubled or altered."""
    source, bred = _bred(spark, folder, [B.cross_points], [])
    pair = F.floor(F.col("ind_id") / 2).cast("long").alias("pair")
    kept = bred.select(pair, "values").distinct().join(source.select(pair, "values").distinct(), ["pair", "values"]).groupBy("pair").agg(
        F.count(F.lit(1)).alias("kept"))
    return _pair_points(bred).drop("squares").join(kept, "pair")


@query("cross_shapelet_points", f"{PAIR_POINTS}, round(sum(x * x), 5) AS squares FROM points GROUP BY pair")
def cross_shapelet_points(spark, folder):
    """Points change shapelets; the points of a pair of sets stay the same."""
    return _pair_points(_bred(spark, folder, [lambda a, b, rng: B.cross_shapelet_points(a, b, rng, 1.0)], [])[1])


@query("cross_random_merge", f"{PAIR_POINTS} FROM points GROUP BY pair")
def cross_random_merge(spark, folder):
    """Both segments of a merge become their mean, so the sum of a pair's points stays."""
    return _pair_points(_bred(spark, folder, [lambda a, b, rng: B.cross_random_merge(a, b, rng, 1.0)], [])[1]).drop("squares")


@query("cross_merge", f"""WITH {EMB_POOL}
SELECT DISTINCT shapelet_id // 8 AS pair, 4::BIGINT AS n, 4::BIGINT AS explained FROM pool""")
def cross_merge(spark, folder):
    """Every shapelet of the first set is a source, or the mean of one of each set."""
    source, bred = _bred(spark, folder, [B.cross_merge], [])
    pair = F.floor(F.col("ind_id") / 2).cast("long").alias("pair")
    sets = source.groupBy(pair).agg(F.collect_list(F.when(F.col("ind_id") % 2 == 0, F.col("values"))).alias("one"),
                                    F.collect_list(F.when(F.col("ind_id") % 2 == 1, F.col("values"))).alias("two"))
    first = bred.where("ind_id % 2 = 0").select(pair, "values").join(sets, "pair")
    mean = lambda a, b: F.forall(F.zip_with(F.zip_with(a, b, lambda x, y: (x + y) / 2), F.col("values"), lambda m, v: F.abs(m - v)), lambda d: d < 1e-9)
    known = F.array_contains("one", F.col("values")) | F.exists("one", lambda a: F.exists("two", lambda b: mean(a, b)))
    return first.groupBy("pair").agg(F.count(F.lit(1)).alias("n"), F.sum(known.cast("long")).alias("explained"))


@query("gak_similarity")
def gak_similarity(spark, folder):
    """Alignment similarity of every customer's series and the mean series of its label."""
    import pandas as pd
    pairs = label_mean_pairs(tables.customer_series(spark, folder))
    scaled = pairs.select("series_id", F.transform("x", lambda a: a / 1e5).alias("x"), F.transform("y", lambda a: a / 1e5).alias("y"))

    def run(frames):
        for frame in frames:
            sims = B.paired_gak(frame["x"].tolist(), frame["y"].tolist())
            yield pd.DataFrame({"series_id": frame["series_id"], "similarity": sims})

    return scaled.mapInPandas(run, "series_id long, similarity double")


def _scores(spark, folder, fitness):
    series, population = _population(spark, folder)
    rows = V.score_population(series, population, 10, fitness, max_passes=40)
    return spark.createDataFrame([(int(i), float(s), int(p)) for i, s, p in rows], "ind_id long, score double, points long")


@query("logloss_fitness")
def logloss_fitness(spark, folder):
    return _scores(spark, folder, Fit.logloss_fitness)


@query("logloss_fitness_location")
def logloss_fitness_location(spark, folder):
    return _scores(spark, folder, Fit.logloss_fitness_location)


@query("f1_fitness")
def f1_fitness(spark, folder):
    return _scores(spark, folder, Fit.f1_fitness)


# One set per label: its four mean-series segments.
SETS = f"""{DIST},
c AS (SELECT shapelet_id, label, count(*) AS n, avg(d) AS m, var_samp(d) AS v
  FROM (SELECT shapelet_id, label, list_min(d) AS d FROM dists) GROUP BY ALL),
g AS (SELECT shapelet_id, sum(n * m) / sum(n) AS gm FROM c GROUP BY shapelet_id),
t AS (SELECT shapelet_id // 4 AS ind_id, sum(n * pow(m - gm, 2)) AS sb, sum(v) AS sw FROM c JOIN g USING (shapelet_id) GROUP BY ALL),
pts AS (SELECT shapelet_id // 4 AS ind_id, sum(len(s)) AS points FROM pool GROUP BY ALL),
scored AS (SELECT ind_id::BIGINT AS ind_id, round(sb / (sw + sb), 6) AS score, points::BIGINT AS points FROM t JOIN pts USING (ind_id))"""


def label_sets(spark, folder):
    series, pool = _emb(spark, folder)
    sets = pool.select(F.floor(F.col("shapelet_id") / 4).cast("long").alias("ind_id"),
                       (F.col("shapelet_id") % 4).cast("int").alias("pos"), "values")
    rows = V.score_population(P.encode_labels(series), sets, 10, Fit.class_scatter_fitness)
    return spark.createDataFrame([(int(i), float(s), int(p)) for i, s, p in rows],
                                 "ind_id long, score double, points long").withColumn("score", F.round("score", 6))


@query("class_scatter_fitness", f"WITH {SETS} SELECT * FROM scored")
def class_scatter_fitness(spark, folder):
    return label_sets(spark, folder)


TOURNAMENT = f"""{SETS},
draws AS (SELECT slot, (slot * 7 + i * 3) % 10 AS ind_id FROM range(9) a(slot), range(3) b(i)),
winners AS (SELECT slot, ind_id FROM draws JOIN scored USING (ind_id)
  QUALIFY row_number() OVER (PARTITION BY slot ORDER BY score DESC, points, ind_id) = 1)"""


def winners(spark, folder):
    scored = label_sets(spark, folder)
    draws = spark.range(9).select(F.col("id").alias("slot"), F.explode(F.array(*[
        (F.col("id") * 7 + i * 3) % 10 for i in range(3)])).alias("ind_id"))
    return scored, R.tournament(scored, draws)


@query("tournament", f"WITH {TOURNAMENT} SELECT * FROM winners")
def tournament(spark, folder):
    return winners(spark, folder)[1]


@query("elitist_union", f"""WITH {TOURNAMENT}
SELECT * FROM winners UNION ALL (SELECT 9, ind_id FROM scored ORDER BY score DESC, points, ind_id LIMIT 1)""")
def elitist_union(spark, folder):
    scored, won = winners(spark, folder)
    best = R.select_best(scored, tie=("ind_id",)).select(F.lit(9).cast("long").alias("slot"), "ind_id")
    return R.elitist_union(won, best)


# --------------------------------------------------------------------- discovery


@query("discover_genetic")
def discover_genetic(spark, folder):
    found = V.discover_genetic(tables.emb_series(spark, folder), population_size=6, iterations=2, max_shaps=5, seed=3,
                               max_passes=40)
    return shapelet_points(found.shapelets)


@query("evolve_loop")
def evolve_loop(spark, folder):
    """Score statistics per generation with the one-aggregation fitness."""
    return V.discover_genetic(tables.emb_series(spark, folder), population_size=6, iterations=2, max_shaps=5, seed=3,
                              fitness=Fit.class_scatter_fitness).history


@query("discover_genetic_single")
def discover_genetic_single(spark, folder):
    found = V.discover_genetic_single(tables.emb_series(spark, folder), population_size=6, iterations=2, seed=3,
                                      fitness=Fit.class_scatter_fitness)
    return shapelet_points(found.shapelets)


@query("discover_swarm")
def discover_swarm(spark, folder):
    return shapelet_points(V.discover_swarm(tables.emb_series(spark, folder), particles=6, iterations=2, seed=3).shapelets)


@query("shapelet_transformer", f"""WITH {USERS}, {candidates_sql('users', SEARCH_LENGTHS)}, {splits_sql('cand, start, length')},
pick AS (SELECT row_number() OVER (ORDER BY gain DESC, gap DESC, cand DESC, start DESC, length DESC) - 1 AS slot, cand, start, length FROM best
  ORDER BY slot LIMIT 3),
s AS (SELECT slot, v[start + 1:start + length] AS s FROM pick JOIN users ON cand = series_id)
SELECT series_id, slot, round(list_min(list_transform(range(0, len(v) - len(s) + 1), lambda k: list_distance(v[k+1:k+len(s)], s))), 6) AS x FROM users, s""")
def shapelet_transformer(spark, folder):
    """Fit by exhaustive search over real lengths, then the raw distance features."""
    series = tables.user_series(spark, folder).persist()  # read several times: built from the events once
    model = ShapeletTransformer(method="exhaustive", nShapelets=3, options={"lengths": SEARCH_LENGTHS, "digits": 6}).fit(series)
    from pyspark.ml.functions import vector_to_array
    out = model.transform(series).select("series_id", F.posexplode(vector_to_array("features")).alias("slot", "x"))
    return out.select("series_id", F.col("slot").cast("long").alias("slot"), F.round("x", 6).alias("x"))


@query("transform", f"""WITH {EMB_POOL}, {RAW.format(src='emb')}
SELECT series_id, row_number() OVER (PARTITION BY series_id ORDER BY shapelet_id) - 1 AS slot, round(list_min(d), 6) AS x FROM dists""")
def transform(spark, folder):
    """A fitted pipeline's projection of series to distance vectors, saved and loaded before use."""
    from pyspark.ml import PipelineModel
    from pyspark.ml.functions import vector_to_array
    series, pool = _emb(spark, folder)
    path = f"{scratch_folder(spark)}/model-{uuid.uuid4().hex}"
    PipelineModel([ShapeletModel(pool)]).save(path)
    out = PipelineModel.load(path).transform(series)
    return out.select("series_id", F.posexplode(vector_to_array("features")).alias("slot", "x")).select(
        "series_id", F.col("slot").cast("long").alias("slot"), F.round("x", 6).alias("x"))


# Two levels of splits by windows of real lengths on the users' series. Distances do not depend on the node, so the second
# level reads the same table between series of one node.
def renamed(sql, tail):
    """The split search over other tables: its CTE names with a tail."""
    return re.sub(r"\b(cnt|steps|labs|wide|grid|runs|ent|cum|splits|best)\b", lambda found: found[0] + tail, sql)


ORDER = "ORDER BY gain DESC, gap DESC, cand DESC, start DESC, length DESC"
TREE2 = f"""{USERS}, classes AS (SELECT label, dense_rank() OVER (ORDER BY label) - 1 AS class FROM (SELECT DISTINCT label FROM users)),
{candidates_sql('users', SEARCH_LENGTHS).replace('dist AS (', 'dist AS MATERIALIZED (')}, {splits_sql('cand, start, length')},
root AS (SELECT * FROM best {ORDER} LIMIT 1),
one AS (SELECT d.other AS series_id, d.label, (2 + (d.dist > threshold)::INT)::BIGINT AS node FROM dist d JOIN root USING (cand, start, length)),
mixed AS (SELECT node FROM one GROUP BY node HAVING count(DISTINCT label) > 1),
near AS MATERIALIZED (SELECT a.node, d.* FROM dist d JOIN one a ON d.cand = a.series_id JOIN one b ON d.other = b.series_id AND a.node = b.node
  JOIN mixed ON mixed.node = a.node),
{renamed(splits_sql('node, cand, start, length', 'near'), '2')},
pick AS (SELECT * FROM best2 QUALIFY row_number() OVER (PARTITION BY node {ORDER}) = 1),
two AS (SELECT d.other AS series_id, d.label, (2 * d.node + (d.dist > threshold)::INT)::BIGINT AS node FROM near d JOIN pick USING (node, cand, start, length)),
placed AS (SELECT * FROM two UNION ALL SELECT * FROM one WHERE node NOT IN (SELECT node FROM pick)),
shares AS (SELECT *, n / sum(n) OVER (PARTITION BY node) AS p FROM (SELECT node, class, count(*) AS n FROM placed JOIN classes USING (label) GROUP BY ALL)),
leaf AS (SELECT node, arg_max(class, (n, -class)) AS prediction FROM shares GROUP BY node)"""


def tree2(spark, folder):
    series = tables.user_series(spark, folder).persist()  # read on every level: built from the events once
    return series, T.fit_tree(series, max_depth=2, lengths=SEARCH_LENGTHS, digits=6)


@query("tree_fit", f"""WITH {TREE2}
SELECT 1::BIGINT AS node_id, 0 AS depth, round(threshold, 8) AS threshold, false AS is_leaf FROM root
UNION ALL SELECT node, 1, round(threshold, 8), false FROM pick
UNION ALL SELECT node, (node > 3)::INT + 1, NULL, true FROM (SELECT DISTINCT node FROM placed)""")
def tree_fit(spark, folder):
    return tree2(spark, folder)[1].select("node_id", "depth", F.round("threshold", 8).alias("threshold"), "is_leaf")


@query("tree_fit_levels")
def tree_fit_levels(spark, folder):
    """Three levels of splits by windows of real lengths, on the event values of users."""
    series = tables.user_series(spark, folder).persist()  # read on every level: built from the events once
    tree = T.fit_tree(series, max_depth=3, lengths=SEARCH_LENGTHS)
    return tree.select("node_id", "parent_id", "side", "depth", "threshold", "is_leaf")


@query("tree_predict", f"WITH {TREE2} SELECT series_id, prediction::INT AS prediction FROM placed JOIN leaf USING (node)")
def tree_predict(spark, folder):
    return T.tree_predict(*tree2(spark, folder))


@query("tree_predict_proba", f"WITH {TREE2} SELECT series_id, class::INT AS class, round(p, 9) AS p FROM placed JOIN shares USING (node)")
def tree_predict_proba(spark, folder):
    """A fitted pipeline, saved and loaded: the share of every class in the leaf of a series."""
    from pyspark.ml import Pipeline, PipelineModel
    series = tables.user_series(spark, folder).persist()
    path = f"{scratch_folder(spark)}/tree-{uuid.uuid4().hex}"
    tree = ShapeletTreeClassifier(maxDepth=2, options={"lengths": SEARCH_LENGTHS, "digits": 6})
    Pipeline(stages=[tree]).fit(series).save(path)
    out = PipelineModel.load(path).transform(series)
    return out.select("series_id", F.posexplode("probability").alias("class", "p")).where("p > 0").withColumn("p", F.round("p", 9))


@query("tree_shapelets", f"""WITH {TREE2},
inner_nodes AS (SELECT 1 AS place, 1::BIGINT AS node_id, cand, start, length FROM root
  UNION ALL SELECT 1 + row_number() OVER (ORDER BY node), node, cand, start, length FROM pick)
SELECT place, node_id, unnest(range(0, length)) AS pos, unnest(list_transform(v[start + 1:start + length], lambda x: round(x, 9))) AS x
FROM inner_nodes JOIN users ON cand = users.series_id""")
def tree_shapelets(spark, folder):
    rows = T.tree_shapelets(tree2(spark, folder)[1])
    placed = rows.withColumn("place", F.row_number().over(Window.orderBy("path")))  # the nodes of one tree
    return placed.select("place", "node_id", F.posexplode("values").alias("p", "x")).select(
        "place", "node_id", F.col("p").cast("long").alias("pos"), F.round("x", 9).alias("x"))


# Ten samples of ten series; a sample is part of the series id, and windows meet the series of their own sample.
SAMPLES = f"""{EMB}, samples AS (SELECT run * 1000000 + series_id AS series_id, label, v FROM emb, range(10) r(run)
  QUALIFY row_number() OVER (PARTITION BY run ORDER BY ('0x' || substr(md5(concat_ws('|', run, series_id)), 1, 13))::BIGINT, series_id) <= 10),
{candidates_sql('samples', [8, 16, 24, 32]).replace('ON a.length = b.length', 'ON a.length = b.length AND a.series_id // 1000000 = b.series_id // 1000000')},
{splits_sql('cand, start, length')},
won AS (SELECT length FROM best QUALIFY row_number() OVER (
  PARTITION BY cand // 1000000 ORDER BY gain DESC, gap DESC, cand DESC, start DESC, length DESC) <= 10)"""


@query("estimate_lengths", f"""WITH {SAMPLES}
SELECT floor(quantile_cont(length, 0.25))::BIGINT AS min_len,
  greatest(floor(quantile_cont(length, 0.25)) + 1, floor(quantile_cont(length, 0.75)))::BIGINT AS max_len FROM won""")
def estimate_lengths(spark, folder):
    lo, hi = T.estimate_lengths(tables.emb_series(spark, folder), lengths=[8, 16, 24, 32], digits=6)
    return spark.createDataFrame([(lo, hi)], "min_len long, max_len long")


@query("length_percentiles", f"""WITH {PARTS}
SELECT floor(quantile_cont(len(v), 0.25))::BIGINT AS min_len,
  greatest(floor(quantile_cont(len(v), 0.25)) + 1, floor(quantile_cont(len(v), 0.75)))::BIGINT AS max_len FROM parts""")
def length_percentiles(spark, folder):
    series = tables.part_series(spark, folder)
    return Z.length_percentiles(series.select(F.size("values").alias("length")))


# ------------------------------------------------------------------- classifiers

KNN = f"""{DIST},
f AS (SELECT series_id, any_value(label) AS label, list(dist ORDER BY shapelet_id) AS f FROM (SELECT series_id, label, shapelet_id, list_min(d) AS dist FROM dists) GROUP BY series_id),
nn AS (SELECT a.series_id, b.series_id AS train_id, b.label, round(list_distance(a.f, b.f), 6) AS dist,
  row_number() OVER (PARTITION BY a.series_id ORDER BY round(list_distance(a.f, b.f), 6), b.series_id) AS rank
  FROM f a, f b QUALIFY rank <= 5)"""


@query("knn_join", f"WITH {KNN} SELECT series_id, rank, train_id, dist FROM nn")
def knn_join(spark, folder):
    rows = features(spark, folder)
    return C.knn_join(rows, rows, 5, digits=6).select("series_id", F.col("rank").cast("long").alias("rank"), "train_id", "dist")


@query("knn_join_block", f"WITH {KNN} SELECT series_id, rank, train_id, dist FROM nn")
def knn_join_block(spark, folder):
    """The block form, forced by a broadcast limit of zero points."""
    rows = features(spark, folder)
    return C.knn_join(rows, rows, 5, broadcast_points=0, digits=6).select(
        "series_id", F.col("rank").cast("long").alias("rank"), "train_id", "dist")


def _nearest_sql(rows: str) -> str:
    """Five nearest rows of a table f (series_id, f) by distance rounded to six digits, then id."""
    return f"""WITH {rows}
SELECT a.series_id, b.series_id AS train_id, round(list_distance(a.f, b.f), 6) AS dist,
  row_number() OVER (PARTITION BY a.series_id ORDER BY round(list_distance(a.f, b.f), 6), b.series_id) AS rank
FROM f a, f b QUALIFY rank <= 5"""


@query("knn_join_ties", _nearest_sql("f AS (SELECT p_partkey AS series_id, [p_size::DOUBLE, 0.0] AS f FROM part)"))
def knn_join_ties(spark, folder):
    """Parts by size: far more rows at one distance than neighbours wanted."""
    rows = tables.read(spark, folder, "part").select(
        F.col("p_partkey").alias("series_id"), F.lit(0).alias("label"), F.array(F.col("p_size").cast("double"), F.lit(0.0)).alias("features"))
    return C.knn_join(rows, rows, 5, digits=6).select("series_id", F.col("rank").cast("long").alias("rank"), "train_id", "dist")


@query("knn_join_offset", _nearest_sql("f AS (SELECT vec_id AS series_id, list_transform(embedding, lambda x: x::DOUBLE + 1e8) AS f FROM embeddings)"))
def knn_join_offset(spark, folder):
    """Embeddings far from the origin, where squares of the values lose the differences."""
    rows = tables.emb_series(spark, folder).select("series_id", "label", F.transform("values", lambda x: x + F.lit(1e8)).alias("features"))
    return C.knn_join(rows, rows, 5, digits=6).select("series_id", F.col("rank").cast("long").alias("rank"), "train_id", "dist")


@query("knn_grid", f"""WITH {DIST},
f AS (SELECT series_id, any_value(label) AS label, list(dist ORDER BY shapelet_id) AS f, series_id % 3 AS fold FROM (SELECT series_id, label, shapelet_id, list_min(d) AS dist FROM dists) GROUP BY series_id),
nn AS (SELECT a.series_id, a.label AS truth, b.label, round(list_distance(a.f, b.f), 6) AS dist,
  row_number() OVER (PARTITION BY a.series_id ORDER BY round(list_distance(a.f, b.f), 6), b.series_id) AS rank
  FROM f a JOIN f b ON a.fold <> b.fold QUALIFY rank <= 25),
ks AS (SELECT unnest([1, 3, 5, 7, 13, 25]) AS k),
votes AS (SELECT k, series_id, truth, label, round(sum(1 / dist), 9) AS w FROM nn JOIN ks ON rank <= k GROUP BY ALL),
pred AS (SELECT k, series_id, any_value(truth) AS truth, arg_max(label, (w, -label)) AS p FROM votes GROUP BY k, series_id)
SELECT k, round(avg((p = truth)::INT), 6) AS accuracy FROM pred GROUP BY k""")
def knn_grid(spark, folder):
    rows = features(spark, folder).withColumn("fold", F.col("series_id") % 3)
    return C.knn_grid(rows, ks=(1, 3, 5, 7, 13, 25), fold="fold", digits=6).withColumn("accuracy", F.round("accuracy", 6))


# Three cross-validation runs over the training rows and one run from them to the held-out rows (every fifth id);
# each run fits every member on its own rows.
MEMBERS = f"""{DIST},
f AS (SELECT series_id, any_value(label) AS label, list(x ORDER BY shapelet_id) AS f, series_id % 5 = 0 AS held, series_id % 3 AS fold
  FROM (SELECT series_id, label, shapelet_id, list_min(d) AS x FROM dists) GROUP BY series_id),
tr AS (SELECT run, f.* FROM f, range(4) r(run) WHERE NOT held AND (run = 3 OR fold <> run)),
te AS (SELECT run, f.* FROM f, range(4) r(run) WHERE CASE WHEN run = 3 THEN held ELSE NOT held AND fold = run END),
nn AS (SELECT te.run, te.series_id, tr.label, round(list_distance(te.f, tr.f), 6) AS dist FROM te JOIN tr ON te.run = tr.run
  QUALIFY row_number() OVER (PARTITION BY te.run, te.series_id ORDER BY round(list_distance(te.f, tr.f), 6), tr.series_id) <= 5),
knn AS (SELECT run, series_id, label AS c, sum(1 / dist) / sum(sum(1 / dist)) OVER (PARTITION BY run, series_id) AS p
  FROM nn GROUP BY run, series_id, label),
tp AS (SELECT run, label, unnest(f) AS x, unnest(range(0, len(f))) AS slot FROM tr),
ep AS (SELECT run, series_id, unnest(f) AS x, unnest(range(0, len(f))) AS slot FROM te),
eps AS (SELECT run, 1e-9 * max(v) AS e FROM (SELECT run, var_pop(x) AS v FROM tp GROUP BY run, slot) GROUP BY run),
stat AS (SELECT tp.run, label, slot, avg(x) AS m, var_pop(x) + any_value(e) AS v FROM tp JOIN eps USING (run) GROUP BY tp.run, label, slot),
prior AS (SELECT run, label, ln(count(*) / sum(count(*)) OVER (PARTITION BY run)) AS lp FROM tr GROUP BY run, label),
score AS (SELECT ep.run, series_id, s.label, sum(-0.5 * ln(2 * pi() * v) - (x - m) * (x - m) / (2 * v)) + any_value(lp) AS s
  FROM ep JOIN stat s ON s.run = ep.run AND s.slot = ep.slot JOIN prior ON prior.run = ep.run AND prior.label = s.label GROUP BY ep.run, series_id, s.label),
shifted AS (SELECT run, series_id, label, exp(s - max(s) OVER (PARTITION BY run, series_id)) AS e FROM score),
bayes AS (SELECT run, series_id, label AS c, e / sum(e) OVER (PARTITION BY run, series_id) AS p FROM shifted),
gaps AS (SELECT ep.run, series_id, s.label, exp(-sqrt(sum((x - m) * (x - m)))) AS e FROM ep JOIN stat s ON s.run = ep.run AND s.slot = ep.slot
  GROUP BY ep.run, series_id, s.label),
centroid AS (SELECT run, series_id, label AS c, e / sum(e) OVER (PARTITION BY run, series_id) AS p FROM gaps),
rows AS (SELECT 'knn' AS member, * FROM knn UNION ALL SELECT 'bayes', * FROM bayes UNION ALL SELECT 'centroid', * FROM centroid),
votes AS (SELECT run, series_id, member, arg_max(c, (round(p, 9), -c)) AS c FROM rows GROUP BY run, series_id, member),
acc AS (SELECT member, avg((c = label)::INT) AS w FROM votes JOIN f USING (series_id) WHERE run < 3 GROUP BY member)"""


def ensemble(spark, folder):
    """The ensemble fitted on the training rows, and the held-out rows."""
    rows = features(spark, folder).withColumn("label", F.col("label").cast("long")).withColumn("fold", F.col("series_id") % 3)
    index = rows.where(F.col("series_id") % 5 == 0).select("series_id")
    split = V.write_through(P.split_by_index(rows, index, "series_id"))
    members = {"knn": C.knn_member(5, digits=6), "bayes": C.bayes_member(), "centroid": C.centroid_member()}
    return C.VotingEnsemble(members).fit(split.where("split = 'train'"), fold="fold"), split.where("split = 'test'")


@query("voting_soft", f"""WITH {MEMBERS},
mix AS (SELECT series_id, c, sum(p * w / (SELECT sum(w) FROM acc)) AS p FROM rows JOIN acc USING (member) WHERE run = 3 GROUP BY series_id, c)
SELECT series_id, arg_max(c, (round(p, 9), -c))::BIGINT AS prediction, round(max(p), 6) AS p FROM mix GROUP BY series_id""")
def voting_soft(spark, folder):
    model, rows = ensemble(spark, folder)
    return model.predict_soft(rows).withColumn("p", F.round("p", 6))


@query("voting_hard", f"""WITH {MEMBERS},
mix AS (SELECT series_id, c, sum(w) AS w FROM votes JOIN acc USING (member) WHERE run = 3 GROUP BY series_id, c)
SELECT series_id, arg_max(c, (round(w, 9), -c))::BIGINT AS prediction, round(max(w), 6) AS weight FROM mix GROUP BY series_id""")
def voting_hard(spark, folder):
    model, rows = ensemble(spark, folder)
    return model.predict_hard(rows).withColumn("weight", F.round("weight", 6))


def _predictions(model, rows):
    return model.transform(rows).select("series_id", F.col("prediction").cast("long").alias("prediction"))


@query("logreg_grid")
def logreg_grid(spark, folder):
    rows = vectors(spark, folder)
    return _predictions(C.logreg_grid(rows, penalties=(0.0,), cs=(1.0, 100.0), balanced=(False,), folds=2)[0], rows)


@query("linear_svm_grid")
def linear_svm_grid(spark, folder):
    """Every C and fold in the same passes; the likeliest class by the coupled probabilities of the pairs."""
    rows = vectors(spark, folder)
    likely = F.max_by("class", F.struct(F.round("p", 9), -F.col("class"))).alias("prediction")
    return S.fit_machines(rows, cs=C.C_GRID, folds=3).predict(rows).groupBy("series_id").agg(likely)


@query("quadratic_svm")
def quadratic_svm(spark, folder):
    rows = vectors(spark, folder)
    return _predictions(C.quadratic_svm(rows, max_iter=10)[0], rows)


@query("random_forest_grid")
def random_forest_grid(spark, folder):
    rows = vectors(spark, folder)
    return _predictions(C.random_forest_grid(rows, trees=(10,), depths=(3, 7), folds=2)[0], rows)


@query("decision_tree_grid")
def decision_tree_grid(spark, folder):
    rows = vectors(spark, folder)
    return _predictions(C.decision_tree_grid(rows, leaf_sizes=(1, 5, 13), folds=2, max_depth=7)[0], rows)


@query("naive_bayes", f"""WITH {DIST},
points AS (SELECT series_id, label, shapelet_id, list_min(d) AS x FROM dists),
eps AS (SELECT 1e-9 * max(v) AS e FROM (SELECT var_pop(x) AS v FROM points GROUP BY shapelet_id)),
stat AS (SELECT label, shapelet_id, avg(x) AS m, var_pop(x) + (SELECT e FROM eps) AS v FROM points GROUP BY label, shapelet_id),
prior AS (SELECT label, ln(count(*) / (SELECT count(*) FROM embeddings)) AS p FROM embeddings GROUP BY label),
score AS (SELECT series_id, s.label, sum(-0.5 * ln(2 * pi() * v) - (x - m) * (x - m) / (2 * v)) + any_value(p) AS s
  FROM points JOIN stat s USING (shapelet_id) JOIN prior ON prior.label = s.label GROUP BY series_id, s.label)
SELECT series_id, arg_max(label, s)::BIGINT AS prediction FROM score GROUP BY series_id""")
def naive_bayes(spark, folder):
    rows = vectors(spark, folder)
    return _predictions(C.naive_bayes(rows), rows)


@query("rotation_tree")
def rotation_tree(spark, folder):
    rows = features(spark, folder)
    return C.rotation_tree(rows, max_depth=5).predict(rows.select("series_id", "features"))


@query("rotation_forest")
def rotation_forest(spark, folder):
    rows = features(spark, folder).persist()
    return C.RotationForest(4, max_depth=5).fit(rows).predict(rows.select("series_id", "features"))


@query("discovery_grid")
def discovery_grid(spark, folder):
    """Tune the discovery bounds with a small search, then project with the final shapelets."""
    from pyspark.ml.functions import vector_to_array
    series = tables.emb_series(spark, folder)
    quick = {"populationSize": 4, "iterations": 1, "fitness": Fit.class_scatter_fitness}
    model, max_len, _ = C.discovery_grid(series, lengths=[16, 32], shapelet_counts=[4], folds=2, search=quick, final=quick)
    out = model.transform(series)
    return out.select("series_id", F.lit(max_len).alias("max_len"), F.size(vector_to_array("features")).alias("n"))
