"""Genetic and swarm discovery. Populations are tables; each generation is a few Spark jobs.

A population table has (ind_id, pos, values). Every generation breeds pairs in grouped tasks,
writes the offspring to the shared folder, computes distances for the distinct
changed shapelets once, scores all changed sets together, and selects by joins. The driver
keeps scores and the stop counter only. Population size and shapelets per set are
parameters, so nothing collected here grows with the series.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from wavelane.functions import breeding as B
from wavelane.operators import distance as D, fitness as Fit, metrics as M, prep as P, ranking as R
from wavelane.runtime import BROADCAST_POINTS, discard, table_size, write_through

POPULATION = "ind_id long, pos int, values array<double>"


def _numbered_rows(series: DataFrame, seed: int, rows: int) -> DataFrame:
    """(series_id, _i): the first ``rows`` series of a random order; ``rows`` is a number of draws, so only that many ids meet."""
    key = P.random_key(seed, "series_id")
    ids = series.select("series_id").orderBy(key, "series_id").limit(rows)
    return ids.withColumn("_i", F.row_number().over(Window.orderBy(key, "series_id")) - 1)


def random_windows(series: DataFrame, draws: DataFrame, seed: int, min_len: int, max_len: int,
                   lengths: DataFrame | None = None) -> DataFrame:
    """A random window of any series for every row of ``draws`` (ind_id, pos): adds values.

    length U[4, min(min_len, max_len)), start U[0, min_len - length). With ``lengths`` (ind_id, length) the windows of one
    set share a length. A draw is a place U[0, n) in a random order of all series. Only as many series as there are
    distinct places are read: the places are numbered, and the order begins with that many random series.
    """
    n, wanted = series.count(), draws.count()
    top = min(min_len, max_len)
    keys = tuple(draws.columns)
    if lengths is None:
        picked = draws.withColumn("length", (4 + F.floor(P.uniform(seed + 1, *keys) * max(top - 4, 1))).cast("int"))
    else:
        picked = draws.join(lengths, "ind_id")
    picked = picked.withColumn("_place", F.floor(P.uniform(seed + 2, *keys) * n)).withColumn(
        "start", F.floor(P.uniform(seed + 3, *keys) * (min_len - F.col("length"))).cast("int")).withColumn(
        "_i", F.dense_rank().over(Window.orderBy("_place")) - 1)  # one row per draw
    sample = series.select("series_id", "values").join(_numbered_rows(series, seed, min(wanted, n)), "series_id")
    out = picked.join(sample, "_i")
    return out.select(*draws.columns, F.slice("values", F.col("start") + 1, F.col("length")).alias("values"))


def init_random(series, individuals: DataFrame, seed, min_len, max_len) -> DataFrame:
    """individuals: (ind_id, k). One random window per shapelet."""
    draws = individuals.select("ind_id", F.explode(F.sequence(F.lit(0), F.col("k") - 1)).alias("pos"))
    return random_windows(series, draws, seed, min_len, max_len).select("ind_id", "pos", "values")


def init_kmeans(series, individuals: DataFrame, seed, min_len, max_len) -> DataFrame:
    """k centroids of max(k, sqrt(n)) windows of one common length; k = 1 draws at random."""
    n = series.count()
    single = init_random(series, individuals.where("k = 1"), seed, min_len, max_len)
    many = individuals.where("k > 1")
    draw = F.greatest(F.col("k"), F.lit(int(np.sqrt(n))))
    draws = many.select("ind_id", "k", F.explode(F.sequence(F.lit(0), draw - 1)).alias("pos"))
    top = min(min_len, max_len)
    lengths = many.select("ind_id", (4 + F.floor(P.uniform(seed + 4, "ind_id") * max(top - 4, 1))).cast("int").alias("length"))
    windows = random_windows(series, draws, seed + 5, min_len, max_len, lengths)

    def cluster(frame: pd.DataFrame) -> pd.DataFrame:
        ind, k = int(frame["ind_id"].iloc[0]), int(frame["k"].iloc[0])
        frame = frame.sort_values("pos")
        centres = B.centroids(np.stack(frame["values"].to_numpy()), k, np.random.default_rng([seed, ind]))
        return pd.DataFrame({"ind_id": ind, "pos": range(len(centres)), "values": list(centres)})

    return single.unionByName(windows.groupBy("ind_id").applyInPandas(cluster, POPULATION))


INITIALISERS = [init_random, init_kmeans]


def initial_population(series, size, max_shaps, seed, min_len, max_len, init_ops=None, n_shapelets=None) -> DataFrame:
    """(ind_id, pos, values): every set draws its size U[2, max_shaps) and its initialiser."""
    init_ops = init_ops or INITIALISERS
    spark = series.sparkSession
    k = (F.lit(n_shapelets) if n_shapelets else
         2 + F.floor(P.uniform(seed, "ind_id", F.lit("k")) * max(max_shaps - 2, 1))).cast("int")
    table = spark.range(size).select(F.col("id").alias("ind_id")).withColumn("k", k).withColumn(
        "_op", F.floor(P.uniform(seed, "ind_id", F.lit("op")) * len(init_ops)))
    parts = [op(series, table.where(F.col("_op") == i).drop("_op"), seed + 10 * (i + 1), min_len, max_len)
             for i, op in enumerate(init_ops)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.select("ind_id", F.col("pos").cast("int").alias("pos"), "values")


def breed_population(population: DataFrame, fresh: DataFrame, seed: int, generation: int, crossovers, mutations,
                     crossover_prob: float, mutation_prob: float) -> DataFrame:
    """Adjacent sets are crossed and mutated in one grouped task: (ind_id, pos, values, changed).

    ``fresh`` holds one spare random shapelet per set, for the add mutation.
    """
    rows = population.withColumn("kind", F.lit(0)).unionByName(
        fresh.select("ind_id", "pos", "values").withColumn("kind", F.lit(1)))
    rows = rows.withColumn("pair_id", F.floor(F.col("ind_id") / 2).cast("long"))

    def step(frame: pd.DataFrame) -> pd.DataFrame:
        pair = int(frame["pair_id"].iloc[0])
        rng = np.random.default_rng([seed, generation, pair])
        frame = frame.sort_values(["ind_id", "pos"])
        ids = sorted(int(i) for i in frame.loc[frame["kind"] == 0, "ind_id"].unique())
        sets = [[np.asarray(v, dtype=float) for v in frame.loc[(frame["kind"] == 0) & (frame["ind_id"] == i), "values"]]
                for i in ids]
        spare = [np.asarray(v, dtype=float) for v in frame.loc[frame["kind"] == 1, "values"]]

        def fresh_shapelet():
            return spare.pop() if spare else sets[0][int(rng.integers(len(sets[0])))]

        bred = B.breed(sets[0], sets[1] if len(sets) > 1 else None, rng, crossovers, mutations,
                       crossover_prob, mutation_prob, fresh_shapelet)
        out = [(i, p, np.asarray(v, dtype=float), changed)
               for i, (shapelets, changed) in zip(ids, bred) for p, v in enumerate(shapelets)]
        return pd.DataFrame(out, columns=["ind_id", "pos", "values", "changed"])

    return rows.groupBy("pair_id").applyInPandas(step, POPULATION + ", changed boolean")


def score_population(series: DataFrame, population: DataFrame, classes: int, fitness, normed: bool = False,
                     max_passes: int = 100, verbose: bool = False) -> list[tuple[int, float, int]]:
    """(ind_id, score, points) of every set; equal shapelets share one distance column."""
    keyed = population.withColumn("shapelet_id", F.xxhash64("values"))
    pool = keyed.select("shapelet_id", "values").dropDuplicates(["shapelet_id"]).persist()
    # distinct shapelets of a population, numbered in the order of the feature columns
    slots = pool.select("shapelet_id", (F.row_number().over(Window.orderBy("shapelet_id")) - 1).alias("s"))
    members = keyed.join(slots, "shapelet_id").groupBy("ind_id").agg(
        F.sort_array(F.collect_list(F.struct("pos", "s"))).alias("_m"), F.sum(F.size("values")).alias("points")).select(
        "ind_id", F.transform("_m", lambda e: e["s"]).alias("slots"), "points").persist()
    # read by every training pass; recomputed from the series if an executor is lost
    features = D.distance_features(series, pool, "znorm" if normed else "raw", "swap" if normed else "inf",
                                   location=getattr(fitness, "needs_location", False),
                                   keep=("series_id", "label_index")).persist()
    scores = fitness(features, members.select("ind_id", "slots"), classes, max_passes, verbose)
    out = [(r["ind_id"], float(r["score"]), int(r["points"])) for r in
           scores.join(members, "ind_id").select("ind_id", "score", "points").collect()]
    for df in (features, members, pool):
        df.unpersist()
    return out


@dataclass
class Evolved:
    """Result of a genetic search."""
    shapelets: DataFrame   # (shapelet_id, values)
    score: float
    history: DataFrame     # generation, avg, std, max, min, q25, q75
    scores: list = field(default_factory=list)


def discover_genetic(series: DataFrame, population_size: int = 50, iterations: int = 25, mutation_prob: float = 0.1,
                     crossover_prob: float = 0.4, wait: int = 10, normed: bool = False, max_len: int | None = None,
                     max_shaps: int | None = None, fitness=None, init_ops=None, cx_ops=None, mut_ops=None,
                     seed: int = 0, n_shapelets: int | None = None, max_passes: int = 100,
                     verbose: bool = False) -> Evolved:
    """Evolve shapelet sets against a fitness; series has (series_id, label, values)."""
    import inspect
    spark = series.sparkSession
    fitness = fitness or Fit.logloss_fitness
    if not callable(fitness) or len(inspect.signature(fitness).parameters) != 5:
        raise ValueError("fitness must be a callable with five parameters")
    cx_ops = B.CROSSOVERS if cx_ops is None else cx_ops
    mut_ops = B.MUTATIONS if mut_ops is None else mut_ops

    encoded = P.encode_labels(series).select("series_id", "label_index", F.col("values").cast("array<double>").alias("values"))
    encoded = encoded.persist()  # scanned every generation; the source can rebuild it
    min_len, default_len, default_shaps = P.checked_limits(encoded)
    max_len = max_len or default_len
    max_shaps = max_shaps or default_shaps
    classes = encoded.agg(F.max("label_index")).first()[0] + 1

    def score(table):
        return score_population(encoded, table, classes, fitness, normed, max_passes, verbose)

    population = write_through(initial_population(encoded, population_size, max_shaps, seed, min_len, max_len,
                                                  init_ops, n_shapelets))
    scores = {i: (s, p) for i, s, p in score(population)}
    # Spare windows of all generations at once, so that a generation reads no series for them.
    spares = write_through(random_windows(encoded, spark.range(population_size).select(
        F.col("id").alias("ind_id"), F.lit(0).alias("pos"), F.explode(F.sequence(F.lit(1), F.lit(max(iterations, 1)))).alias("generation")),
        seed + 1000, min_len, max_len))
    rank = lambda item: (item[1][0], -item[1][1])
    leader = max(scores.items(), key=rank)
    best_score, best, idle, history = float("-inf"), write_through(population.where(F.col("ind_id") == leader[0])), 0, []
    for it in range(1, iterations + 1):
        if idle >= wait:
            break
        fresh = spares.where(F.col("generation") == it).drop("generation")
        bred = write_through(breed_population(population, fresh, seed, it, cx_ops, mut_ops, crossover_prob, mutation_prob))
        changed = bred.where("changed")
        offspring = dict(scores)
        if changed.limit(1).count():
            offspring.update({i: (s, p) for i, s, p in score(changed.select("ind_id", "pos", "values"))})

        table = spark.createDataFrame([(int(i), float(s), int(p)) for i, (s, p) in offspring.items()],
                                      "ind_id long, score double, points long")
        winners = [(r["slot"], r["ind_id"]) for r in R.tournament(
            table, R.tournament_draws(spark, population_size - 1, population_size, seed + it)).orderBy("slot").collect()]
        # best of parents and offspring; a parent wins only when strictly better
        top_child, top_parent = max(offspring.items(), key=rank), max(scores.items(), key=rank)
        elite_from_parent = rank(top_parent) > rank(top_child)
        elite = top_parent if elite_from_parent else top_child

        slots = spark.createDataFrame([(int(s), int(i)) for s, i in winners], "slot long, ind_id long")
        body = bred.drop("changed").join(F.broadcast(slots), "ind_id").select(
            F.col("slot").alias("ind_id"), "pos", "values")
        source = population if elite_from_parent else bred.drop("changed")
        last = source.where(F.col("ind_id") == elite[0]).select(
            F.lit(population_size - 1).cast("long").alias("ind_id"), "pos", "values")
        old, population = population, write_through(R.elitist_union(body, last))
        scores = {int(s): offspring[i] for s, i in winners}
        scores[population_size - 1] = elite[1]

        history += [(it, s) for s, _ in scores.values()]
        top = max(s for s, _ in scores.values())
        if verbose:
            print(f"generation {it}: best {top:.6f}")
        idle += 1
        if top > best_score:
            best_score, idle = top, 0
            best = write_through(population.where(F.col("ind_id") == population_size - 1))
        discard(old, bred)
    discard(spares, population)
    encoded.unpersist()
    if not history:
        best_score, history = leader[1][0], [(0, s) for s, _ in scores.values()]
    from wavelane.operators.reports import generation_stats
    stats = generation_stats(spark.createDataFrame(history, "generation int, score double"), ["generation"])
    shapelets = best.select(F.col("pos").cast("long").alias("shapelet_id"), "values")
    return Evolved(shapelets, best_score, stats.orderBy("generation"), history)


def discover_genetic_single(series: DataFrame, **options) -> Evolved:
    """Sets of one shapelet: random initialisation, merges and exchanges, mutation by mask only."""
    options = {"init_ops": [init_random], "cx_ops": B.CROSSOVERS, "mut_ops": [B.mutate_mask], **options}
    return discover_genetic(series, n_shapelets=1, **options)


def init_motif(series: DataFrame, length: int, draws: int = 100, seed: int = 0) -> DataFrame:
    """Window of sampled, joined series that is farthest from its nearest other window.

    Windows within half a length of each other are not compared. ``draws`` bounds the sample.
    """
    sample = series.select("series_id", "values").join(_numbered_rows(series, seed, draws), "series_id")
    if table_size(sample)[1] > BROADCAST_POINTS:
        raise ValueError("the sampled series are too long to join; use fewer draws")
    rows = sample.orderBy("_i").select("_i", "values").collect()  # at most ``draws`` series
    joined = np.concatenate([np.asarray(r["values"], dtype=float) for r in rows])
    spark = series.sparkSession
    shared = spark.sparkContext.broadcast(joined)
    count = len(joined) - length + 1

    def nearest(frames):
        from wavelane.functions.kernels import z_norm
        x = shared.value
        windows = z_norm(np.lib.stride_tricks.sliding_window_view(x, length))
        for frame in frames:
            start = frame["id"].to_numpy()
            gap = 2 * (length - windows[start] @ windows.T)
            near = np.abs(start[:, None] - np.arange(count)[None, :]) < max(length // 2, 1)
            gap = np.where(near, np.inf, gap).min(axis=1)
            yield pd.DataFrame({"start": start, "profile": np.sqrt(np.maximum(gap, 0))})

    best = spark.range(count).mapInPandas(nearest, "start long, profile double").where(
        F.col("profile") < float("inf")).orderBy(F.desc("profile"), "start").limit(1).first()
    values = joined[best["start"]:best["start"] + length]
    return spark.createDataFrame([(0, [float(v) for v in values], float(best["profile"]))],
                                 "shapelet_id long, values array<double>, profile double")


# --------------------------------------------------------------------- swarm


def discover_swarm(series: DataFrame, particles: int = 50, iterations: int = 25, wait: int = 5, smin: float = -0.25,
                   smax: float = 0.25, phi1: float = 1.0, phi2: float = 1.0, min_len: int = 4,
                   max_len: int | None = None, metric: str = "ig", seed: int = 0, digits: int = 9) -> Evolved:
    """Particles are shapelets that move towards their own and the common best."""
    spark = series.sparkSession
    encoded = P.encode_labels(series).select(
        "series_id", F.col("label_index").alias("label"), F.col("values").cast("array<double>").alias("values")).persist()
    count = encoded.count()
    low = P.checked_limits(encoded)[0]
    max_len = max_len or low
    columns = ("gain", "gap") if metric == "ig" else ("score",)
    draws = spark.range(particles).select(F.col("id").alias("ind_id"), F.lit(0).alias("pos"))
    lengths = draws.select("ind_id", (min_len + F.floor(P.uniform(seed + 7, "ind_id") * max(min(max_len, low) - min_len, 1))).cast("int").alias("length"))
    start = random_windows(encoded, draws, seed, low, max_len, lengths)
    state = "particle_id long, position array<double>, velocity array<double>, best array<double>, score array<double>"

    swarm = write_through(start.select(
        F.col("ind_id").alias("particle_id"), F.col("values").alias("position"),
        F.transform("values", lambda x, i: smin + (smax - smin) * P.uniform(seed + 8, F.col("ind_id"), i)).alias("velocity"),
        F.lit(None).cast("array<double>").alias("best"), F.lit(None).cast("array<double>").alias("score")))
    best, best_score, idle, history = None, None, 0, []
    for it in range(iterations):
        shapelets = swarm.select(F.col("particle_id").alias("shapelet_id"), F.col("position").alias("values"))
        dist = D.min_distance(encoded, shapelets, "znorm", "swap", carry=("label",))
        spread = M.spread_for(count)
        scored = (M.f_score(dist) if metric == "f" else M.METRICS[metric](dist, digits=digits, spread=spread)).select(
            F.col("shapelet_id").alias("particle_id"), F.array(*columns).alias("now"))
        better = F.col("score").isNull() | (F.col("now") > F.col("score"))
        judged = write_through(swarm.join(scored, "particle_id").select(
            "particle_id", "position", "velocity", F.when(better, F.col("position")).otherwise(F.col("best")).alias("best"),
            F.when(better, F.col("now")).otherwise(F.col("score")).alias("score"), "now"))
        history += [(it, float(r["now"][0])) for r in judged.select("now").collect()]
        top = judged.orderBy(F.desc("score"), "particle_id").limit(1).first()
        idle += 1
        if best_score is None or list(top["score"]) > best_score:
            best, best_score, idle = list(top["best"]), list(top["score"]), 0
        if idle >= wait:
            break
        target = np.asarray(best)

        def move(frames, it=it, target=target):
            from wavelane.functions.kernels import best_match
            for frame in frames:
                out = []
                for pid, x, v, own, s in zip(frame["particle_id"], frame["position"], frame["velocity"], frame["best"], frame["score"]):
                    rng = np.random.default_rng([seed, it, int(pid)])
                    x, v, own = np.array(x, float), np.array(v, float), np.array(own, float)
                    u1, u2 = rng.uniform(0, phi1, len(x)), rng.uniform(0, phi2, len(x))
                    if len(x) < len(target):
                        at = int(best_match(target[None], x[None], "znorm", True)[1][0, 0])
                        part, goal = slice(None), target[at:at + len(x)]
                    else:
                        at = int(best_match(x[None], target[None], "znorm", True)[1][0, 0])
                        part, goal = slice(at, at + len(target)), target
                    pull = u1[part] * (own - x)[part] + u2[part] * (goal - x[part])
                    v[part] = 0.729 * v[part] + np.clip(1.49445 * pull, smin, smax)
                    x[part] += v[part]
                    out.append((pid, x, v, own, s))
                yield pd.DataFrame(out, columns=["particle_id", "position", "velocity", "best", "score"])

        swarm = write_through(judged.drop("now").mapInPandas(move, state))
    encoded.unpersist()
    from wavelane.operators.reports import generation_stats
    stats = generation_stats(spark.createDataFrame(history, "generation int, score double"), ["generation"])
    found = spark.createDataFrame([(0, [float(v) for v in best])], "shapelet_id long, values array<double>")
    return Evolved(found, best_score[0], stats.orderBy("generation"), history)
