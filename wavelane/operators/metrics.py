"""Quality of shapelets from their distances: long rows (keys..., label, dist).

A candidate's ordered distances may be a large group, so running sums are taken in two levels: rows are dealt by range
partitions of (keys, distance), whose cuts Spark takes from the rows themselves, so neither one candidate nor a narrow band of values
nor their sign decides how much one task orders. Totals of a partition give the offsets of the next, and one partition's part of a
key is ordered at a time. ``spread=0`` orders a whole group in one task, for groups whose size the caller has checked.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from wavelane.runtime import write_through

SPREAD = 1  # dealt by range partitions
GROUP_ROWS = 1_000_000  # largest group ordered by one task


def spread_for(group_rows: int) -> int:
    """0 where a counted group may be ordered by one task, else the form dealt by range partitions."""
    return 0 if group_rows <= GROUP_ROWS else SPREAD


def dealt(df: DataFrame, keys: list[str], order: str, parts: int | None = None) -> DataFrame:
    """Rows with the number ``_b`` of their range partition of (keys, order), which ascends with order within a key; written once.

    Without ``parts`` Spark sets their number and may join small ones.
    """
    ranged = df.repartitionByRange(*([parts] if parts else []), *keys, order)
    return write_through(ranged.withColumn("_b", F.spark_partition_id()))


def n_log_n(n: Column) -> Column:
    return F.when(n > 0, n * F.log(n.cast("double"))).otherwise(F.lit(0.0))


def running_sums(df: DataFrame, keys: list[str], order: str, sums: list[str], spread: int = SPREAD,
                 cluster: list[str] | None = None) -> DataFrame:
    """Inclusive running sums of ``sums`` by ``order`` within ``keys``.

    (keys, order) must be unique. Adds ``cum_*``, ``all_*`` per sum column and
    ``next_order``, the following order value. ``cluster`` (a subset of keys) is the
    partitioning to set here, so that later steps grouped by it need no further shuffle.
    The dealt form keeps its partition column ``_b`` for the same reason.
    """
    if not spread:
        part = df.repartition(*cluster) if cluster else df
        by = Window.partitionBy(*keys)
        run = by.orderBy(order)
        upto = run.rowsBetween(Window.unboundedPreceding, Window.currentRow)
        return part.select("*", *[F.sum(s).over(upto).alias(f"cum_{s}") for s in sums],
                           F.lead(order).over(run).alias("next_order")).select(
            "*", *[F.sum(s).over(by).alias(f"all_{s}") for s in sums])

    rows = df if "_b" in df.columns else dealt(df, cluster or keys, order)
    if cluster:
        rows = rows.repartition(*cluster, "_b")
    totals = rows.groupBy(*keys, "_b").agg(*[F.sum(s).alias(f"_t_{s}") for s in sums],
                                           F.min(order).alias("_first"))
    by = Window.partitionBy(*keys)
    run = by.orderBy("_b")
    before = run.rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        *keys, "_b", F.lead("_first").over(run).alias("_next"),
        *[F.coalesce(F.sum(f"_t_{s}").over(before), F.lit(0)).alias(f"_o_{s}") for s in sums],
        *[F.sum(f"_t_{s}").over(by).alias(f"all_{s}") for s in sums])
    inner = Window.partitionBy(*keys, "_b").orderBy(order)
    upto = inner.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    joined = rows.join(offsets, [*keys, "_b"])
    kept = [c for c in df.columns if c != "_b"]
    out = joined.select(
        *kept, "_b", "_next", *[f"all_{s}" for s in sums],
        *[(F.col(f"_o_{s}") + F.sum(s).over(upto)).alias(f"cum_{s}") for s in sums],
        F.lead(order).over(inner).alias("_lead"))
    return out.withColumn("next_order", F.coalesce("_lead", "_next")).drop("_lead", "_next")


def distance_counts(distances: DataFrame, keys: list[str], digits: int = 9) -> DataFrame:
    """(keys, dist, label, n): equal distances collapsed before any ordering."""
    return distances.where(F.col("dist").isNotNull()).groupBy(
        *keys, F.round("dist", digits).alias("dist"), "label").agg(F.count(F.lit(1)).alias("n"))


def _counted_once(distances, keys, digits, spread) -> DataFrame:
    """Collapsed distances; the dealt forms read them several times, so there they are written and the join runs once."""
    counts = distance_counts(distances, keys, digits)
    return dealt(counts, keys, "dist") if spread else counts


def _class_runs(distances, keys, digits, spread) -> DataFrame:
    counts = _counted_once(distances, keys, digits, spread)
    return running_sums(counts, [*keys, "label"], "dist", ["n"], spread, cluster=keys)


def cumulative_class_counts(distances: DataFrame, keys=("shapelet_id",), digits: int = 9,
                            spread: int = SPREAD) -> DataFrame:
    """Per (keys, dist, label): rows of the label at or left of dist, and right of it."""
    keys = list(keys)
    return _class_runs(distances, keys, digits, spread).select(
        *keys, "dist", "label", "n", F.col("cum_n").alias("left_n"),
        (F.col("all_n") - F.col("cum_n")).alias("right_n"))


def next_distance(distances: DataFrame, keys=("shapelet_id",), digits: int = 9,
                  spread: int = SPREAD) -> DataFrame:
    """Distinct distances with the next larger one and the midpoint between them."""
    keys = list(keys)
    rows = distance_counts(distances, keys, digits).groupBy(*keys, "dist").agg(F.sum("n").alias("n"))
    run = running_sums(rows, keys, "dist", ["n"], spread)
    return run.select(*keys, "dist", F.col("next_order").alias("next_dist"),
                      ((F.col("dist") + F.col("next_order")) / 2).alias("threshold"))


def entropy_of_counts(n_col: str = "n") -> Column:
    """Aggregate: natural-log entropy of class counts, ln N - sum(n ln n) / N."""
    n = F.sum(n_col)
    return F.log(n.cast("double")) - F.sum(n_log_n(F.col(n_col))) / n


def entropy(df: DataFrame, keys: list[str], label: str = "label") -> DataFrame:
    counts = df.groupBy(*keys, label).agg(F.count(F.lit(1)).alias("n"))
    return counts.groupBy(*keys).agg(F.sum("n").alias("n"), entropy_of_counts().alias("entropy"))


def split_gains(distances: DataFrame, keys=("shapelet_id",), digits: int = 9,
                spread: int = SPREAD) -> DataFrame:
    """Every boundary between distinct distances with its gain, gap and threshold.

    Class entropies are kept as running sums of n ln n, whose change at a row needs only
    that row's class, so no row is repeated per class.
    """
    keys = list(keys)
    runs = _class_runs(distances, keys, digits, spread)
    left, n = F.col("cum_n"), F.col("n")
    right = F.col("all_n") - left
    steps = runs.groupBy(*keys, *(["_b"] if spread else []), "dist").agg(
        F.sum(n).alias("n"), F.sum(n * F.col("dist")).alias("d"),
        F.sum(n_log_n(left) - n_log_n(left - n)).alias("dl"),
        F.sum(n_log_n(right) - n_log_n(right + n)).alias("dr"))
    run = running_sums(steps, keys, "dist", ["n", "d", "dl", "dr"], spread)
    total, lo = F.col("all_n"), F.col("cum_n")
    hi = total - lo
    # all_dl is sum(n ln n) over the classes of the whole group
    prior = n_log_n(total) - F.col("all_dl")
    h_left = n_log_n(lo) - F.col("cum_dl")
    h_right = n_log_n(hi) - (F.col("all_dl") + F.col("cum_dr"))
    return run.select(
        *keys, "dist", "next_order", total.alias("rows"), lo.alias("left_rows"),
        F.when(hi > 0, F.round((prior - h_left - h_right) / total, digits)).alias("gain"),
        F.when(hi > 0, F.round((F.col("all_d") - F.col("cum_d")) / hi - F.col("cum_d") / lo, digits)).alias("gap"),
        F.when(hi > 0, (F.col("dist") + F.col("next_order")) / 2).alias("threshold"))


def _best_splits(distances, keys, digits, spread) -> DataFrame:
    """Best split per key, with the smallest distance."""
    splits = split_gains(distances, keys, digits, spread)
    best = splits.groupBy(*keys).agg(
        F.max("rows").alias("_rows"), F.min("dist").alias("_low"),
        F.max(F.when(F.col("gain").isNotNull(), F.struct(
            "gain", "gap", (-F.col("dist")).alias("_d"), "threshold"))).alias("_b"))
    none = F.when(F.col("_rows") >= 2, F.lit(float("-inf")))
    return best.select(*keys, F.coalesce("_b.gain", none).alias("gain"),
                       F.coalesce("_b.gap", none).alias("gap"), F.col("_b.threshold").alias("threshold"), "_low")


def ig_score(distances: DataFrame, keys=("shapelet_id",), digits: int = 9,
             spread: int = SPREAD) -> DataFrame:
    """Best split per key: gain, gap and threshold; larger gap, then smaller distance, on ties.

    -inf where all distances are equal, null where there are fewer than two rows.
    """
    return _best_splits(distances, list(keys), digits, spread).drop("_low")


def ig_threshold(distances: DataFrame, keys=("shapelet_id",), digits: int = 9,
                 spread: int = SPREAD) -> DataFrame:
    """Midpoint of the best split; the common distance where all are equal."""
    keys = list(keys)
    return _best_splits(distances, keys, digits, spread).select(
        *keys, F.when(F.col("gain").isNotNull(), F.coalesce("threshold", "_low")).alias("threshold"))


def f_score(distances: DataFrame, keys=("shapelet_id",)) -> DataFrame:
    """One-way ANOVA F over classes; -inf where undefined."""
    keys = list(keys)
    per = distances.groupBy(*keys, "label").agg(
        F.count("dist").alias("n"), F.avg("dist").alias("m"), F.var_pop("dist").alias("v"))
    g = per.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("k"), F.sum("n").alias("N"), F.sum(F.col("n") * F.col("m")).alias("s"),
        F.sum(F.col("n") * F.col("v")).alias("ssw"),
        F.collect_list(F.struct("n", "m")).alias("c"))  # one entry per class
    grand = F.col("s") / F.col("N")
    ssb = F.aggregate("c", F.lit(0.0), lambda a, e: a + e["n"] * (e["m"] - grand) * (e["m"] - grand))
    g = g.select(*keys, "k", "N", "ssw", ssb.alias("ssb"))
    f = (F.col("ssb") / (F.col("k") - 1)) / (F.col("ssw") / (F.col("N") - F.col("k")))
    undefined = (F.col("k") < 2) | (F.col("N") <= F.col("k")) | ((F.col("ssw") == 0) & (F.col("ssb") == 0))
    return g.select(*keys, F.when(undefined, F.lit(float("-inf"))).when(
        F.col("ssw") == 0, F.lit(float("inf"))).otherwise(f).alias("score"))


def average_ranks(rows: DataFrame, keys, value: str, spread: int = SPREAD, weight: str | None = None) -> DataFrame:
    """Distinct values per key with tie count ``t`` and average rank ``rank``."""
    keys = list(keys)
    n = F.sum(weight) if weight else F.count(F.lit(1))
    counts = rows.groupBy(*keys, value).agg(n.alias("t"))
    run = running_sums(counts, keys, value, ["t"], spread)
    return run.select(*keys, value, "t", F.col("all_t").alias("rows"),
                      (F.col("cum_t") - F.col("t") + (F.col("t") + 1) / 2).alias("rank"))


def kruskal_score(distances: DataFrame, keys=("shapelet_id",), digits: int = 9,
                  spread: int = SPREAD) -> DataFrame:
    """Kruskal-Wallis H with tie correction; -inf where all distances are equal."""
    keys = list(keys)
    counts = _counted_once(distances, keys, digits, spread)
    if spread:
        ranks = average_ranks(counts, keys, "dist", spread, weight="n")
        ranked = counts.join(ranks, [*keys, "dist"])
    else:
        by = Window.partitionBy(*keys)
        tied = counts.withColumn("t", F.sum("n").over(Window.partitionBy(*keys, "dist")))
        upto = F.sum("n").over(by.orderBy("dist").rangeBetween(Window.unboundedPreceding, Window.currentRow))
        ranked = tied.withColumn("rank", upto - F.col("t") + (F.col("t") + 1) / 2).withColumn("rows", F.sum("n").over(by))
    # a tied value's t^3 - t is shared among its rows
    per = ranked.groupBy(*keys, "label").agg(
        F.sum("n").alias("n"), F.sum(F.col("n") * F.col("rank")).alias("r"), F.max("rows").alias("total"),
        F.sum(F.col("n") * (F.col("t").cast("double") * F.col("t") - 1)).alias("ties"))
    s = per.groupBy(*keys).agg(F.sum(F.col("r") * F.col("r") / F.col("n")).alias("s"), F.count(F.lit(1)).alias("k"),
                               F.max("total").alias("total"), F.sum("ties").alias("ties"))
    n = F.col("total").cast("double")
    h = 12 / (n * (n + 1)) * F.col("s") - 3 * (n + 1)
    fix = 1 - F.col("ties") / (n * n * n - n)
    return s.select(
        *keys, F.when((F.col("total") < 2) | (fix == 0) | (F.col("k") < 2), F.lit(float("-inf")))
        .otherwise(h / fix).alias("score"))


def grand_median(distances: DataFrame, keys, digits: int = 9, spread: int = SPREAD) -> DataFrame:
    """Exact median per key from running counts: the mean of the two middle values."""
    keys = list(keys)
    rows = distance_counts(distances, keys, digits).groupBy(*keys, "dist").agg(F.sum("n").alias("n"))
    run = running_sums(rows, keys, "dist", ["n"], spread)
    lo = F.floor((F.col("all_n") + 1) / 2)
    hi = F.ceil((F.col("all_n") + 1) / 2)
    before = F.col("cum_n") - F.col("n")
    return run.groupBy(*keys).agg(
        ((F.max(F.when((before < lo) & (lo <= F.col("cum_n")), F.col("dist")))
          + F.max(F.when((before < hi) & (hi <= F.col("cum_n")), F.col("dist")))) / 2).alias("median"))


def mood_median(distances: DataFrame, keys=("shapelet_id",), digits: int = 9,
                spread: int = SPREAD) -> DataFrame:
    """Chi-square of class counts above the grand median, continuity-corrected for two classes.

    -inf where no distance lies above the median.
    """
    keys = list(keys)
    med = grand_median(distances, keys, digits, spread)
    counts = distance_counts(distances, keys, digits).join(med, keys)
    per = counts.groupBy(*keys, "label").agg(
        F.sum("n").alias("n"),
        F.sum(F.when(F.col("dist") > F.col("median"), F.col("n")).otherwise(0)).alias("above"))
    g = per.groupBy(*keys).agg(
        F.sum("n").alias("N"), F.sum("above").alias("A"), F.count(F.lit(1)).alias("k"),
        F.collect_list(F.struct("n", "above")).alias("c"))  # one entry per class

    def cell(observed, row_total, n):
        expected = row_total * n / F.col("N")
        diff = F.abs(observed - expected)
        diff = F.when((F.col("k") == 2) & (diff > 0), diff - 0.5).otherwise(diff)
        return diff * diff / expected

    below = F.col("N") - F.col("A")
    chi = F.aggregate("c", F.lit(0.0), lambda a, e: a + cell(e["above"], F.col("A"), e["n"])
                      + cell(e["n"] - e["above"], below, e["n"]))
    return g.select(*keys, F.when((F.col("A") == 0) | (below == 0) | (F.col("k") < 2),
                                  F.lit(float("-inf"))).otherwise(chi).alias("score"))


METRICS = {"ig": ig_score, "f": f_score, "kruskal": kruskal_score, "mood": mood_median}


def class_scatter(distances: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Between-class share of the scatter of a shapelet set: tr(Sb) / tr(Sw + Sb).

    Only traces are needed, so each feature contributes its own class moments.
    """
    keys = list(keys or [])
    per = distances.groupBy(*keys, "shapelet_id", "label").agg(
        F.count("dist").alias("n"), F.avg("dist").alias("m"), F.var_samp("dist").alias("v"))
    one = per.groupBy(*keys, "shapelet_id").agg(
        F.sum("n").alias("N"), F.sum(F.col("n") * F.col("m")).alias("s"), F.sum("v").alias("sw"),
        F.collect_list(F.struct("n", "m")).alias("c"))  # one entry per class
    grand = F.col("s") / F.col("N")
    sb = F.aggregate("c", F.lit(0.0), lambda a, e: a + e["n"] * (e["m"] - grand) * (e["m"] - grand))
    traces = one.select(*keys, "sw", sb.alias("sb")).groupBy(*keys).agg(
        F.sum("sw").alias("sw"), F.sum("sb").alias("sb"))
    return traces.select(*keys, (F.col("sb") / (F.col("sw") + F.col("sb"))).alias("score"))


def bhattacharyya(distances: DataFrame, keys: list[str] | None = None, cells: int = 10) -> DataFrame:
    """Overlap of the class histograms over a grid of ``cells`` per feature, per shapelet set.

    Input has one row per (keys, series_id, shapelet_id); ``keys`` name the set. Features with a
    range below 1e-5 are left out; a set with none left scores 1. A row's cell has one
    entry per shapelet of the set.
    """
    whole = keys is None
    rows = distances.withColumn("_set", F.lit(0)) if whole else distances
    keys = ["_set"] if whole else list(keys)
    bounds = rows.groupBy(*keys, "shapelet_id").agg(F.min("dist").alias("lo"), F.max("dist").alias("hi"))
    used = bounds.where(F.col("hi") - F.col("lo") >= 1e-5)
    width = (F.col("hi") - F.col("lo")) / cells
    cell = F.least(F.floor((F.col("dist") - F.col("lo")) / width), F.lit(cells - 1)).cast("int")
    placed = rows.join(used, [*keys, "shapelet_id"]).groupBy(*keys, "series_id", "label").agg(
        F.sort_array(F.collect_list(F.struct("shapelet_id", cell.alias("c")))).alias("_c"))
    counts = placed.groupBy(*keys, F.transform("_c", lambda e: e["c"]).alias("cell"), "label").agg(
        F.count(F.lit(1)).alias("n"))
    totals = counts.groupBy(*keys, "label").agg(F.sum("n").alias("total"))
    classes = totals.groupBy(*keys).agg(F.count(F.lit(1)).alias("classes"))
    shares = counts.join(totals, [*keys, "label"]).groupBy(*keys, "cell").agg(
        F.count(F.lit(1)).alias("k"), F.product(F.col("n") / F.col("total")).alias("p"))
    # a cell missing one class has product 0
    terms = shares.join(classes, keys).where((F.col("k") == F.col("classes")) & (F.col("p") != 1))
    overlap = terms.groupBy(*keys).agg(F.sum(F.pow("p", 1 / F.col("classes"))).alias("overlap"))
    sets = bounds.groupBy(*keys).agg(F.count(F.when(F.col("hi") - F.col("lo") >= 1e-5, 1)).alias("features"))
    out = sets.join(overlap, keys, "left").select(*keys, F.when(F.col("features") == 0, F.lit(1.0)).otherwise(
        F.coalesce("overlap", F.lit(0.0))).alias("score"))
    return out.drop("_set") if whole else out


def distances_by_class(distances: DataFrame, keys=("shapelet_id",)) -> DataFrame:
    """Distance summary per class: rows, range and mean."""
    return distances.groupBy(*keys, "label").agg(
        F.count("dist").alias("n"), F.min("dist").alias("lo"), F.avg("dist").alias("mean"),
        F.max("dist").alias("hi"))
