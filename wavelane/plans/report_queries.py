"""Queries over predictions, method comparison and result files."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from wavelane.operators import metrics as M, prep as P, ranking as R, reports as Z
from wavelane.plans.metric_queries import DIST, IG, distances, spread
from wavelane.plans.registry import CUSTOMERS, EMB, EMB_POOL, PARTS, USERS, query
from wavelane.runtime import scratch_folder
from wavelane.sources import pools, readers, tables, writers

# Predictions: each embedding goes to the label of its nearest pool shapelet, with
# probabilities from the distances to the nearest shapelet of every label.
PRED = f"""{DIST},
near AS (SELECT series_id, label, shapelet_id // 4 AS c, min(dist) AS d FROM dist GROUP BY ALL),
soft AS (SELECT series_id, label, c, round(exp(-d) / sum(exp(-d)) OVER (PARTITION BY series_id), 9) AS p FROM near),
pred AS (SELECT series_id AS row_id, any_value(label) AS label_index, arg_max(c, (p, -c))::BIGINT AS prediction,
  list(p ORDER BY c) AS probs FROM soft GROUP BY series_id)"""


def predictions(spark, folder):
    near = distances(spark, folder).groupBy("series_id", (F.floor(F.col("shapelet_id") / 4)).alias("c")).agg(
        F.exp(-F.min("dist")).alias("e"))
    packed = near.groupBy("series_id").agg(F.sum("e").alias("s"), F.sort_array(F.collect_list(F.struct("c", "e"))).alias("_e"))
    probs = F.transform("_e", lambda x: F.round(x["e"] / F.col("s"), 9))
    out = packed.select(F.lit("embeddings").alias("dataset"), F.col("series_id").alias("row_id"), probs.alias("probs"))
    return out.withColumn("prediction", readers.arg_max(F.col("probs")).cast("long"))


def truth(spark, folder):
    return tables.emb_series(spark, folder).select(
        F.lit("embeddings").alias("dataset"), F.col("series_id").alias("row_id"), F.col("label").alias("label_index"))


def joined(spark, folder):
    return Z.truth_join(predictions(spark, folder), truth(spark, folder))


@query("truth_join", f"WITH {PRED} SELECT row_id, label_index, prediction FROM pred")
def truth_join(spark, folder):
    return joined(spark, folder).select("row_id", "label_index", "prediction")


@query("accuracy", f"""WITH {PRED}
SELECT label_index, round(avg((label_index = prediction)::INT), 6) AS accuracy, count(*) AS n FROM pred GROUP BY label_index""")
def accuracy(spark, folder):
    return Z.accuracy(joined(spark, folder), ["label_index"]).withColumn("accuracy", F.round("accuracy", 6))


@query("log_loss", f"""WITH {PRED}
SELECT label_index, round(-avg(ln(probs[label_index + 1])), 6) AS log_loss FROM pred GROUP BY label_index""")
def log_loss(spark, folder):
    return Z.log_loss(joined(spark, folder), ["label_index"]).withColumn("log_loss", F.round("log_loss", 6))


@query("class_probabilities", """
WITH c AS (SELECT p_type AS node, p_brand AS label, count(*) AS n FROM part GROUP BY ALL)
SELECT node, label, n, round(n / sum(n) OVER (PARTITION BY node), 9) AS p FROM c""")
def class_probabilities(spark, folder):
    rows = tables.read(spark, folder, "part").select(F.col("p_type").alias("node"), F.col("p_brand").alias("label"))
    probs = Z.class_probabilities(rows, ["node"], "label")
    return probs.select("node", "class_counts", F.explode("class_probs").alias("label", "p")).select(
        "node", "label", F.col("class_counts")[F.col("label")].alias("n"), F.round("p", 9).alias("p"))


@query("generation_stats", f"""WITH {IG}
SELECT (shapelet_id // 4)::BIGINT AS gen, round(avg(gain), 9) AS avg, round(stddev_pop(gain), 6) AS std, max(gain) AS max,
  min(gain) AS min, round(quantile_cont(gain, 0.25), 8) AS q25, round(quantile_cont(gain, 0.75), 8) AS q75
FROM best GROUP BY ALL""")
def generation_stats(spark, folder):
    scored = M.ig_score(distances(spark, folder), digits=6, spread=spread(spark, folder)).select(
        F.floor(F.col("shapelet_id") / 4).cast("long").alias("gen"), F.col("gain").alias("score"))
    out = Z.generation_stats(scored, ["gen"])
    return out.select("gen", F.round("avg", 9).alias("avg"), F.round("std", 6).alias("std"), "max", "min",
                      F.round("q25", 8).alias("q25"), F.round("q75", 8).alias("q75"))


@query("select_best", f"""WITH {IG}
SELECT shapelet_id, gain AS score, len(s) AS points FROM best JOIN pool USING (shapelet_id)
ORDER BY score DESC, points, shapelet_id LIMIT 1""")
def select_best(spark, folder):
    pool = pools.emb_pool(tables.emb_series(spark, folder)).select(
        "shapelet_id", F.size("values").cast("long").alias("points"))
    scored = M.ig_score(distances(spark, folder), digits=6, spread=spread(spark, folder)).select(
        "shapelet_id", F.col("gain").alias("score"))
    return R.select_best(scored.join(pool, "shapelet_id"), tie=("shapelet_id",))


# Method comparison: segment = data set, priority = method, monthly mean price = measure.
RESULTS = """results AS (
  SELECT c_mktsegment AS dataset, o_orderpriority AS method, strftime(o_orderdate, '%Y-%m') AS run,
         round(avg(o_totalprice), 8) AS accuracy
  FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL),
pairs AS (SELECT a.dataset, a.run, a.accuracy AS x, b.accuracy AS y FROM results a JOIN results b USING (dataset, run)
  WHERE a.method = '1-URGENT' AND b.method = '5-LOW')"""
FIRST, SECOND = "1-URGENT", "5-LOW"


def results(spark, folder):
    orders = tables.read(spark, folder, "orders").join(
        tables.read(spark, folder, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return orders.groupBy(F.col("c_mktsegment").alias("dataset"), F.col("o_orderpriority").alias("method"),
                          F.date_format("o_orderdate", "yyyy-MM").alias("run")).agg(
        F.round(F.avg("o_totalprice"), 8).alias("accuracy"))


WILCOXON = f"""{RESULTS},
d AS (SELECT dataset, round(x - y, 6) AS d, abs(round(x - y, 6)) AS a FROM pairs WHERE x <> y),
r AS (SELECT *, rank() OVER (PARTITION BY dataset ORDER BY a) + (count(*) OVER (PARTITION BY dataset, a) - 1) / 2 AS r,
  count(*) OVER (PARTITION BY dataset, a) AS t FROM d),
w AS (SELECT dataset, count(*) AS n, least(sum(CASE WHEN d > 0 THEN r ELSE 0 END), sum(CASE WHEN d < 0 THEN r ELSE 0 END)) AS statistic,
  sum(t * t - 1) AS ties FROM r GROUP BY dataset),
wz AS (SELECT dataset, n, statistic, round((statistic - n * (n + 1) / 4) / sqrt((n * (n + 1) * (2 * n + 1) - 0.5 * ties) / 24), 6) AS z FROM w)"""


@query("wilcoxon", f"WITH {WILCOXON} SELECT * FROM wz")
def wilcoxon(spark, folder):
    table = results(spark, folder)
    a = table.where(F.col("method") == FIRST).select("dataset", "run", F.col("accuracy").alias("x"))
    b = table.where(F.col("method") == SECOND).select("dataset", "run", F.col("accuracy").alias("y"))
    return Z.wilcoxon(a.join(b, ["dataset", "run"]), ["dataset"], digits=6).select("dataset", "n", "statistic", F.round("z", 6).alias("z"))


@query("compare_methods", f"""WITH {RESULTS},
m AS (SELECT dataset, method, avg(accuracy) AS m, stddev_pop(accuracy) AS s, count(*) AS n FROM results GROUP BY ALL)
SELECT a.dataset, round(a.m, 4) AS mean1, round(b.m, 4) AS mean2, CASE WHEN a.n > 1 AND a.n = b.n THEN round(a.s, 4) END AS std1,
  CASE WHEN a.n > 1 AND a.n = b.n THEN round(b.s, 4) END AS std2, a.n AS runs1, b.n AS runs2
FROM m a JOIN m b USING (dataset) WHERE a.method = '1-URGENT' AND b.method = '5-LOW'""")
def compare_methods(spark, folder):
    out = Z.compare_methods(results(spark, folder), FIRST, SECOND)
    return out.select("dataset", *[F.round(c, 4).alias(c) for c in ("mean1", "mean2", "std1", "std2")], "runs1", "runs2")


@query("compare_table", f"""WITH {WILCOXON},
m AS (SELECT dataset, method, avg(accuracy) AS m, count(*) AS n FROM results GROUP BY ALL)
SELECT a.dataset, round(a.m, 4) AS mean1, round(b.m, 4) AS mean2, CASE WHEN a.n > 1 AND a.n = b.n THEN statistic END AS statistic,
  CASE WHEN a.n > 1 AND a.n = b.n THEN z END AS z
FROM m a JOIN m b USING (dataset) LEFT JOIN wz USING (dataset) WHERE a.method = '1-URGENT' AND b.method = '5-LOW'""")
def compare_table(spark, folder):
    out = Z.compare_table(results(spark, folder), FIRST, SECOND, digits=6)
    return out.select("dataset", F.round("mean1", 4).alias("mean1"), F.round("mean2", 4).alias("mean2"),
                      "statistic", F.round("z", 6).alias("z"))


MWU = """s AS (SELECT c_mktsegment AS dataset, o_orderpriority AS method, o_totalprice AS value
  FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderpriority IN ('1-URGENT', '5-LOW')),
r AS (SELECT *, rank() OVER (PARTITION BY dataset ORDER BY value) + (count(*) OVER (PARTITION BY dataset, value) - 1) / 2 AS r,
  count(*) OVER (PARTITION BY dataset, value) AS t FROM s),
g AS (SELECT dataset, (count(*) FILTER (method = '1-URGENT'))::DOUBLE AS n1, (count(*) FILTER (method = '5-LOW'))::DOUBLE AS n2,
  sum(r) FILTER (method = '1-URGENT') AS r1, sum(t * t - 1)::DOUBLE AS ties,
  avg(value) FILTER (method = '1-URGENT') AS m1, avg(value) FILTER (method = '5-LOW') AS m2 FROM r GROUP BY dataset),
u AS (SELECT *, n1 * n2 + n1 * (n1 + 1) / 2 - r1 AS u1, n1 + n2 AS n FROM g),
z AS (SELECT *, (greatest(u1, n1 * n2 - u1) - (n1 * n2 / 2 + 0.5)) / sqrt((1 - ties / (n * n * n - n)) * n1 * n2 * (n + 1) / 12) AS z FROM u)"""


@query("mann_whitney", f"""WITH {MWU}
SELECT dataset, n1::BIGINT AS n1, n2::BIGINT AS n2, least(u1, n1 * n2 - u1) AS u, round(z, 6) AS z,
  CASE WHEN abs(z) < 1.6448536269514722 THEN chr(92) WHEN m1 > m2 THEN '+' ELSE '-' END AS flag FROM z""")
def mann_whitney(spark, folder):
    orders = tables.read(spark, folder, "orders").join(
        tables.read(spark, folder, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    samples = orders.select(F.col("c_mktsegment").alias("dataset"), F.col("o_orderpriority").alias("method"),
                            F.col("o_totalprice").alias("value"))
    return Z.mann_whitney(samples, ["dataset"], "method", FIRST, SECOND).select(
        "dataset", "n1", "n2", "u", F.round("z", 6).alias("z"), "flag")


@query("sort_report", f"""WITH {RESULTS},
m AS (SELECT dataset, method, avg(accuracy) AS m FROM results GROUP BY ALL)
SELECT a.dataset, round(a.m - b.m, 4) AS difference FROM m a JOIN m b USING (dataset)
WHERE a.method = '1-URGENT' AND b.method = '5-LOW' ORDER BY difference, a.dataset""")
def sort_report(spark, folder):
    table = Z.compare_methods(results(spark, folder), FIRST, SECOND)
    return Z.sort_report(table, F.round(F.col("mean1") - F.col("mean2"), 4)).select("dataset", "difference")


@query("mixed_report", """WITH s AS (SELECT c_mktsegment AS dataset, o_orderpriority AS method, o_totalprice AS value
  FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderpriority IN ('1-URGENT', '5-LOW', '3-MEDIUM')),
a AS (SELECT dataset, o AS against, method = '1-URGENT' AS is_first, value FROM s, (VALUES ('5-LOW'), ('3-MEDIUM')) v(o) WHERE method IN ('1-URGENT', o)),
r AS (SELECT *, rank() OVER (PARTITION BY dataset, against ORDER BY value) + (count(*) OVER (PARTITION BY dataset, against, value) - 1) / 2 AS r,
  count(*) OVER (PARTITION BY dataset, against, value) AS t FROM a),
g AS (SELECT dataset, against, (count(*) FILTER (is_first))::DOUBLE AS n1, (count(*) FILTER (NOT is_first))::DOUBLE AS n2,
  sum(r) FILTER (is_first) AS r1, sum(t * t - 1)::DOUBLE AS ties, avg(value) FILTER (is_first) AS m1, avg(value) FILTER (NOT is_first) AS m2
  FROM r GROUP BY ALL),
u AS (SELECT *, n1 * n2 + n1 * (n1 + 1) / 2 - r1 AS u1, n1 + n2 AS n FROM g),
z AS (SELECT *, (greatest(u1, n1 * n2 - u1) - (n1 * n2 / 2 + 0.5)) / sqrt((1 - ties / (n * n * n - n)) * n1 * n2 * (n + 1) / 12) AS z FROM u),
f AS (SELECT *, CASE WHEN abs(z) < 1.6448536269514722 THEN chr(92) WHEN m1 > m2 THEN '+' ELSE '-' END AS flag FROM z),
facts AS (SELECT c_mktsegment AS dataset, count(*) AS series, count(DISTINCT c_nationkey) AS classes FROM customer GROUP BY ALL)
SELECT p.dataset, series, classes, p.n1::BIGINT AS runs, round(p.m1, 4) AS mean, round(p.m2, 4) AS mean_1, round(p.z, 6) AS z_1, p.flag AS flag_1,
  round(p.m1 - p.m2, 4) AS difference_1, round(q.m2, 4) AS mean_2, round(q.z, 6) AS z_2, q.flag AS flag_2, round(p.m1 - q.m2, 4) AS difference_2
FROM f p JOIN f q USING (dataset) JOIN facts USING (dataset) WHERE p.against = '5-LOW' AND q.against = '3-MEDIUM' ORDER BY difference_1, p.dataset""")
def mixed_report(spark, folder):
    customers = tables.read(spark, folder, "customer")
    samples = tables.read(spark, folder, "orders").join(customers, F.col("o_custkey") == F.col("c_custkey")).select(
        F.col("c_mktsegment").alias("dataset"), F.col("o_orderpriority").alias("method"), F.col("o_totalprice").alias("value"))
    facts = customers.groupBy(F.col("c_mktsegment").alias("dataset")).agg(
        F.count(F.lit(1)).alias("series"), F.countDistinct("c_nationkey").alias("classes"))
    table = Z.mixed_report(samples, FIRST, [SECOND, "3-MEDIUM"], facts)
    rounded = [F.round(c, 6 if c[0] == "z" else 4).alias(c) for i in (1, 2) for c in (f"mean_{i}", f"z_{i}", f"difference_{i}")]
    return table.select("dataset", "series", "classes", "runs", F.round("mean", 4).alias("mean"), "flag_1", "flag_2", *rounded)


@query("sort_by_cost", f"""WITH {USERS}, {CUSTOMERS}, {PARTS}, {EMB},
n AS (SELECT 'users' AS source, count(*) AS n, max(len(v)) AS m FROM users UNION ALL SELECT 'customers', count(*), max(len(v)) FROM customers
  UNION ALL SELECT 'parts', count(*), max(len(v)) FROM parts UNION ALL SELECT 'embeddings', count(*), max(len(v)) FROM emb)
SELECT source, n, m, pow(n, 2) * pow(m, 3) AS cost FROM n ORDER BY cost""")
def sort_by_cost(spark, folder):
    out = None
    for name, series in (("users", tables.user_series), ("customers", tables.customer_series),
                         ("parts", tables.part_series), ("embeddings", tables.emb_series)):
        row = series(spark, folder).agg(F.lit(name).alias("source"), F.count(F.lit(1)).alias("n"),
                                        F.max(F.size("values")).cast("long").alias("m"))
        out = row if out is None else out.unionByName(row)
    return R.sort_by_cost(out)


# ------------------------------------------------- result files, written and read back


def _folder(spark, name):
    return f"{scratch_folder(spark)}/{name}-{uuid.uuid4().hex}"


@query("read_predictions", f"""WITH {PRED}
SELECT 'embeddings' AS dataset, 'nearest' AS method, row_id, prediction, round(probs[prediction + 1], 6) AS p FROM pred""")
def read_predictions(spark, folder):
    """Probability CSVs written by ``write_predictions``, found by glob and parsed."""
    root = _folder(spark, "predictions")
    table = predictions(spark, folder)
    classes = tables.emb_series(spark, folder).agg(F.max("label")).first()[0] + 1
    writers.write_predictions(table, f"{root}/embeddings_nearest_0", classes)
    rows = readers.read_predictions(spark, f"{root}/*_proba/*.csv", from_folder=True)
    return rows.select("dataset", "method", "row_id", F.col("prediction").cast("long").alias("prediction"),
                       F.round(F.col("probs")[F.col("prediction")], 6).alias("p"))


@query("write_predictions", f"WITH {PRED} SELECT row_id, prediction FROM pred")
def write_predictions(spark, folder):
    root = _folder(spark, "hard")
    classes = tables.emb_series(spark, folder).agg(F.max("label")).first()[0] + 1
    writers.write_predictions(predictions(spark, folder), f"{root}/run", classes)
    return spark.read.csv(f"{root}/run_hard", header=True, schema="row_id long, prediction long")


POOL_POINTS = f"""WITH {EMB_POOL}
SELECT shapelet_id, unnest(range(0, len(s))) AS pos, unnest(s) AS x FROM pool"""


def _points(df):
    return df.select("shapelet_id", F.posexplode("values").alias("p", "x")).select(
        "shapelet_id", F.col("p").cast("long").alias("pos"), "x")


@query("write_shapelets", POOL_POINTS)
def write_shapelets(spark, folder):
    path = _folder(spark, "shapelets")
    writers.write_shapelets(pools.emb_pool(tables.emb_series(spark, folder)), path)
    return _points(writers.read_shapelets(spark, path))


@query("read_shapelets_text", f"""WITH {EMB_POOL}
SELECT round(list_sum(s), 6) AS total, len(s) AS n FROM pool""")
def read_shapelets_text(spark, folder):
    path = _folder(spark, "text")
    writers.write_shapelets_text(pools.emb_pool(tables.emb_series(spark, folder)), path)
    back = readers.read_shapelets_text(spark, path)
    total = F.aggregate("values", F.lit(0.0), lambda a, x: a + x)
    return back.select(F.round(total, 6).alias("total"), F.size("values").cast("long").alias("n"))


@query("write_split", """
SELECT doc_id AS row_id, n_chars AS label FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)""")
def write_split(spark, folder):
    path = _folder(spark, "split")
    docs = tables.read(spark, folder, "documents").select("doc_id", "n_chars")
    split = P.split_by_index(docs, tables.read(spark, folder, "labels"), "doc_id")
    writers.write_split(split.where("split = 'test'"), path, "doc_id", "n_chars")
    return spark.read.csv(path, header=True, schema="row_id long, label long")


@query("read_archive", f"""WITH {CUSTOMERS}
SELECT 'customers' AS dataset, 'train' AS split, label, len(v) AS n, round(list_sum(v), 2) AS total FROM customers""")
def read_archive(spark, folder):
    """Customer series written as labelled lines and read back as an archive folder."""
    root = _folder(spark, "archive")
    series = tables.customer_series(spark, folder)
    line = F.concat_ws(",", F.concat(F.array("label"), F.col("values").cast("array<string>")))
    series.select(line.alias("value")).write.mode("overwrite").text(f"{root}/customers_TRAIN.txt")
    rows = readers.read_archive(spark, f"{root}/*_TRAIN.txt", from_folder=True)
    total = F.aggregate("values", F.lit(0.0), lambda a, x: a + x)
    return rows.select("dataset", "split", "label", F.size("values").cast("long").alias("n"), F.round(total, 2).alias("total"))
