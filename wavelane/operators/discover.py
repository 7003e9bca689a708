"""Shapelet discovery by exhaustive, running-sum and symbolic search.

Each search returns (series_id, start, length, score columns, values), best first. If the
series pass a size check they are shipped to every task. A task correlates all its candidates with
them in single precision; the known error bounds every gain, and what can still be among its n best
is scored in double precision. Larger collections are
searched block against block: class histograms of distances bound every gain, and only
windows that can still win go through the distance join and the split search. Series with equal
values and label have equal windows and distances, so the search by gain holds one of them with
their number; the copies of its best windows are put back at the end.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

from wavelane.functions import kernels
from wavelane.operators import distance as D, metrics as M, prep as P, ranking as R, symbolic as S, windows as W
from wavelane.runtime import attach_row, fits_broadcast, table_size, write_through

CANDIDATES = 512        # candidates of one length that are scored together, at most
DISTANCE_CELLS = 4 * 1024 * 1024  # of their distances to a pool
CORRELATION_CELLS = 32 * 1024 * 1024  # of their correlations in single precision
SETTLED = 64            # candidates that are scored together in double precision, once bounded
SMALL_POOL = 128        # series up to which bounds would cost more than they save
SERIES_BLOCK = 4_096    # series of a block beyond the size check
SCORES = {"ig": ("gain", "gap")}


def score_columns(metric: str) -> tuple[str, ...]:
    return SCORES.get(metric, ("score",))


def default_lengths(series: DataFrame, min_len: int | None, max_len: int | None,
                    lengths: list[int] | None, least: int = 4) -> list[int]:
    if lengths is not None:
        return sorted(int(l) for l in lengths)
    if max_len is None:
        max_len = series.agg(F.max(F.size("values"))).first()[0]
    return W.length_range(least if min_len is None else min_len, max_len)


def pair_estimate(series: DataFrame, lengths: list[int]) -> int:
    """Candidate-series pairs a search over these lengths scores."""
    n = F.size("values")
    count = sum((F.greatest(n - l + 1, F.lit(0)) for l in lengths), F.lit(0))
    row = series.agg(F.sum(count).alias("c"), F.count(F.lit(1)).alias("n")).first()
    return int(row["c"] or 0) * int(row["n"])


def _shared_series(series: DataFrame, by: str | None):
    """Label indices, values and weights of all (size-checked) series, per group."""
    key = F.col(by) if by else F.lit(0)
    table = series.select(key.alias("g"), "label_index", _weight(series), F.col("values").cast("array<double>").alias("values")).orderBy("g").toArrow()
    keys, label = np.array(table.column("g").to_pylist()), table.column("label_index").to_numpy().astype(np.int64)
    weight = table.column("weight").to_numpy().astype(np.int64)
    pool = kernels.Ragged.from_arrow(table.column("values"))
    groups = {}
    for g in np.unique(keys):
        at = np.flatnonzero(keys == g)  # one run, rows are in group order
        lo, hi = at[0], at[-1] + 1
        start = pool.starts[lo]
        groups[g.item()] = (label[lo:hi], kernels.Ragged(
            pool.flat[start:start + pool.lengths[lo:hi].sum()], pool.lengths[lo:hi]), _weights(weight[lo:hi]))
    return groups


def _weight(series: DataFrame):
    return (F.col("weight") if "weight" in series.columns else F.lit(1)).cast("long").alias("weight")


def _weights(weight: np.ndarray) -> np.ndarray | None:
    return weight if (weight > 1).any() else None


def merge_copies(series: DataFrame, by: str | None = None) -> DataFrame:
    """One row for the series of a group with equal label and values: the largest series_id, and their number as ``weight``."""
    return write_through(series.groupBy(*([by] if by else []), "label", "values").agg(
        F.max("series_id").alias("series_id"), F.count(F.lit(1)).alias("weight")))


def _with_copies(series: DataFrame, merged: DataFrame, scored: DataFrame, n: int, columns: tuple[str, ...], by: str | None) -> DataFrame:
    """The n best windows of merged series, once for every series that holds them.

    Copies share the score, start and length, and a merged row has the largest series_id of its copies, so its window comes
    before theirs: the n best of all are among these.
    """
    lead = [by] if by else []
    best = _best(scored, n, columns, by).select(*lead, "series_id", "start", "length", *columns)
    of = merged.select(*lead, "series_id", F.col("label").alias("_label"), F.col("values").alias("_values"))
    known = of.join(F.broadcast(best), [*lead, "series_id"]).drop("series_id")  # n rows per group
    found = known.select(*[F.col(c).alias(f"_g_{c}") if c in lead else c for c in known.columns])
    same = F.col("label").eqNullSafe(F.col("_label")) & (F.col("values") == F.col("_values"))
    for c in lead:
        same &= F.col(c) == F.col(f"_g_{c}")
    return series.select(*lead, "series_id", "label", "values").join(F.broadcast(found), same).select(
        *lead, "series_id", "start", "length", *columns)


def _spread_tasks(df: DataFrame, rows: int) -> DataFrame:
    tasks = max(1, min(rows, 4 * df.sparkSession.sparkContext.defaultParallelism))
    return df.repartition(tasks, "series_id")


def _distances(cand: np.ndarray, windows: kernels.Windows, metric: str, on_short: str) -> np.ndarray:
    """Distances (k, series) of raw candidate windows to a pool; series that are shorter or very long are matched one by one."""
    dist = kernels.closest_windows(kernels.z_norm(cand), windows, metric)
    pool, others = windows.pool, windows.others
    if len(others):
        few = kernels.Ragged.from_lists([pool.flat[a:a + n] for a, n in zip(pool.starts[others], pool.lengths[others])])
        same = kernels.Ragged(cand.reshape(-1), np.full(len(cand), cand.shape[1]))
        dist[:, others] = kernels.ragged_match(few, same, metric, on_short)[0].T
    return dist


def _correlations(cand: np.ndarray, windows: kernels.UnitWindows, metric: str, on_short: str) -> np.ndarray:
    """Correlations (k, series) that stand for the distances of raw candidate windows to a pool, in single precision; -2 for inf."""
    corr = kernels.closest_correlations(cand, windows, metric)
    pool, short, length = windows.pool, windows.short, cand.shape[1]
    if len(short) and on_short == "swap":
        few = kernels.Ragged.from_lists([pool.flat[a:a + n] for a, n in zip(pool.starts[short], pool.lengths[short])])
        same = kernels.Ragged(cand.reshape(-1), np.full(len(cand), length))
        square = kernels.ragged_match(few, same, metric, on_short)[0] ** 2
        corr[short] = np.maximum(1.0 - square / (2.0 if metric == "corr" else 2.0 * length), -2.0)
    return corr.T


def _largest(metric: str, length: int) -> float:
    """What no distance of windows of this length exceeds."""
    return 2.0 if metric == "corr" else 2.0 * length ** 0.5


def _candidates(own: kernels.Ragged, rows: np.ndarray, length: int, together: int = CANDIDATES):
    """Windows of one length of the rows, some at a time: (row of each, start of each, windows)."""
    rows = rows[own.lengths[rows] >= length]
    counts = own.lengths[rows] - length + 1
    row = np.repeat(rows, counts)
    start = np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts)
    for a in range(0, len(row), together):
        r, s = row[a:a + together], start[a:a + together]
        yield r, s, own.flat[(own.starts[r] + s)[:, None] + np.arange(length)]


class _Best:
    """The n best gains that a task has found in a group; all are wanted where n is None."""

    def __init__(self, n: int | None, digits: int):
        self.n, self.slack, self.top = n, 10.0 ** -digits, np.zeros(0)

    def add(self, gains: np.ndarray) -> None:
        if self.n is not None:
            self.top = -np.sort(-np.append(self.top, gains[np.isfinite(gains)]))[:self.n]

    def floor(self) -> float:
        """What a bound must reach to be among the n best; gains are rounded, so they may exceed their bound by a little."""
        return self.top[-1] - self.slack if self.n is not None and len(self.top) >= self.n else -np.inf


def _scored(own: kernels.Ragged, rows: np.ndarray, length: int, group: tuple, classes: int, best: _Best, metric: str, on_short: str, digits: int):
    """(row, start, scores) of the windows of the rows that can be among the n best of their group, some at a time."""
    label, pool, weight = group
    together = max(1, min(CANDIDATES, DISTANCE_CELLS // len(pool)))
    exact = kernels.Windows(pool, length, together)

    def settle(row, start):
        cand = own.flat[(own.starts[row] + start)[:, None] + np.arange(length)]
        scores = kernels.split_scores(_distances(cand, exact, metric, on_short), label, classes, digits, weight)
        best.add(scores[0])
        may = ~(scores[0] < best.floor())  # what is not a number stays
        return row[may], start[may], [s[may] for s in scores]

    if best.n is None or len(pool) <= SMALL_POOL:
        for row, start, _ in _candidates(own, rows, length, together):
            yield settle(row, start)
        return
    unit, error = kernels.UnitWindows(pool, length), kernels.correlation_error(length)
    waiting = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)  # row, start and bound of windows that are still to be scored

    def settle_waiting():
        row, start, up = (x[np.argsort(-waiting[2], kind="stable")] for x in waiting)
        while len(row) and up[0] >= best.floor():
            some = np.flatnonzero(up >= best.floor())[:SETTLED]
            yield settle(row[some], start[some])
            row, start, up = (x[len(some):] for x in (row, start, up))

    for row, start, cand in _candidates(own, rows, length, max(1, min(CANDIDATES, CORRELATION_CELLS // len(pool)))):
        up = kernels.gain_limits(_correlations(cand, unit, metric, on_short), label, classes, error, weight)
        waiting = tuple(np.append(x, y) for x, y in zip(waiting, (row, start, up)))
        may = waiting[2] >= best.floor()
        waiting = tuple(x[may] for x in waiting)
        if may.sum() >= SETTLED or best.floor() == -np.inf:
            yield from settle_waiting()
            waiting = tuple(x[:0] for x in waiting)
    yield from settle_waiting()


def score_windows_shared(series: DataFrame, lengths: list[int], fast: bool, digits: int = 9,
                         by: str | None = None, n: int | None = None) -> DataFrame:
    """Gain of every window, computed beside a shared copy of all (size-checked) series; a series counts ``weight`` times.

    With ``by``, windows meet only the series of their own group. With ``n``, windows whose gain, or its bound, stays below the n-th
    best gain that the same task has found in the group are left out: they cannot be among the n best.
    """
    encoded = P.encode_labels(series)
    groups = _shared_series(encoded, by)
    if not groups:
        raise ValueError("no series")
    classes = max(int(y.max()) for y, *_ in groups.values()) + 1
    shared = series.sparkSession.sparkContext.broadcast(groups)
    lead = [by] if by else []
    metric, on_short = ("corr", "inf") if fast else ("znorm", "swap")
    schema = T.StructType([series.schema[c] for c in (*lead, "series_id")] + [
        T.StructField("length", T.IntegerType()), T.StructField("start", T.IntegerType()),
        T.StructField("gain", T.DoubleType()), T.StructField("gap", T.DoubleType()),
        T.StructField("threshold", T.DoubleType())])
    names = schema.fieldNames()

    def emit(batch, rows, length, starts, scores):
        rows = pa.array(rows)
        return pa.RecordBatch.from_arrays(
            [batch.column(c).take(rows) for c in (*lead, "series_id")]
            + [pa.array(np.full(len(starts), length, np.int32)), pa.array(starts.astype(np.int32))]
            + [pa.array(s) for s in scores], names=names)

    def run(batches):
        groups, best = shared.value, {}
        for batch in batches:
            own = kernels.Ragged.from_arrow(batch.column("values"))
            keys = np.array(batch.column(by).to_pylist()) if by else np.zeros(len(own), dtype=int)
            for g in np.unique(keys).tolist():
                top = best.setdefault(g, _Best(n, digits))
                for length in lengths:
                    for rows, starts, scores in _scored(own, np.flatnonzero(keys == g), length, groups[g], classes, top, metric, on_short, digits):
                        yield emit(batch, rows, length, starts, scores)

    rows = sum(len(y) for y, *_ in groups.values())
    own = series.select(*lead, "series_id", F.col("values").cast("array<double>").alias("values"))
    return _spread_tasks(own, rows).mapInArrow(run, schema)


def likely_windows(series: DataFrame, lengths: list[int], fast: bool, n: int, digits: int = 9, by: str | None = None,
                   block: int = SERIES_BLOCK) -> DataFrame:
    """Windows that can be among the n best by gain, for series beyond the size check: (by, series_id, start, length).

    Series are hashed to blocks, and each pair of blocks counts the distances of its windows by bucket and class. The counts of
    a window are added up over all blocks, so what leaves a block does not grow with its series, and bound the window's
    best gain from both sides. Windows whose upper bound stays below the n-th largest lower bound are out.
    """
    lead = [by] if by else []
    metric, on_short = ("corr", "inf") if fast else ("znorm", "swap")
    encoded = P.encode_labels(series).select(*lead, "series_id", "label_index", _weight(series), F.col("values").cast("array<double>").alias("values"))
    facts = encoded.agg(F.count(F.lit(1)).alias("n"), F.sum(F.size("values")).alias("points"), F.max("label_index").alias("label")).first()
    classes = (facts["label"] or 0) + 1
    blocks = max(1, -(-facts["n"] // block), -(-(facts["points"] or 0) // D.BLOCK_POINTS))
    hashed = encoded.withColumn("_b", F.pmod(F.xxhash64("series_id"), F.lit(blocks)))
    every = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)).cast("array<bigint>"))
    sources = hashed.withColumn("_p", every)
    # aliases keep both sides apart
    pools = hashed.select(*[F.col(c).alias("_p" if c == "_b" else c) for c in hashed.columns]).withColumn("_b", every)
    keys = [*lead, "_b", "_p"]
    id_fields = [series.schema[c] for c in (*lead, "series_id")]
    counted = T.StructType(id_fields + [T.StructField("length", T.IntegerType()), T.StructField("start", T.IntegerType()),
                                        T.StructField("counts", T.BinaryType())])
    counted_arrow = to_arrow_schema(counted)

    def count(left, right):
        own, pool = (kernels.Ragged.from_arrow(t.column("values")) for t in (left, right))
        label = right.column("label_index").to_numpy().astype(np.int64)
        weight = _weights(right.column("weight").to_numpy().astype(np.int64))
        out = []
        for length in lengths if len(pool) else ():
            windows = kernels.Windows(pool, length, CANDIDATES)
            for rows, starts, cand in _candidates(own, np.arange(len(own)), length):
                counts = kernels.distance_histograms(_distances(cand, windows, metric, on_short), label, classes, _largest(metric, length),
                                                     digits, weight)
                packed = counts.astype("<i4").reshape(len(rows), -1)
                out.append(pa.Table.from_arrays(
                    [left.column(c).take(pa.array(rows)) for c in (*lead, "series_id")]
                    + [pa.array(np.full(len(rows), length, np.int32)), pa.array(starts.astype(np.int32)), pa.array([c.tobytes() for c in packed], pa.binary())],
                    schema=counted_arrow))
        return pa.concat_tables(out) if out else counted_arrow.empty_table()

    bounded = T.StructType(counted.fields[:-1] + [T.StructField("low", T.DoubleType()), T.StructField("up", T.DoubleType())])
    bounded_arrow = to_arrow_schema(bounded)

    def bound(table):
        start = table.column("start").to_numpy()
        names, at = np.unique(start, return_inverse=True)
        total = np.zeros((len(names), (kernels.BUCKETS + 1) * classes), np.int64)
        np.add.at(total, at, np.frombuffer(b"".join(table.column("counts").to_pylist()), "<i4").reshape(len(start), -1))
        low, up = kernels.gain_bounds(total.reshape(len(names), -1, classes))
        first = pa.array(np.unique(at, return_index=True)[1])
        return pa.Table.from_arrays([table.column(c).take(first) for c in (*lead, "series_id", "length", "start")] + [pa.array(low), pa.array(up)],
                                    schema=bounded_arrow)

    counts = sources.groupBy(*keys).cogroup(pools.groupBy(*keys)).applyInArrow(count, counted)
    bounds = write_through(counts.groupBy(*lead, "series_id", "length").applyInArrow(bound, bounded))
    best = bounds.withColumn("_r", F.row_number().over(Window.partitionBy(*lead).orderBy(F.desc("low")))).where(F.col("_r") <= n) \
        if by else bounds.orderBy(F.desc("low")).limit(n)
    floors = best.groupBy(*lead).agg(F.when(F.count(F.lit(1)) == n, F.min("low")).alias("_floor"))
    # One row per group, or a single one.
    near = bounds.join(F.broadcast(floors), by) if by else attach_row(bounds, floors)
    return near.where(F.col("_floor").isNull() | (F.col("up") >= F.col("_floor") - 10.0 ** -digits)).select(*lead, "series_id", "start", "length")


def candidate_distances(series: DataFrame, candidates: DataFrame, metric: str = "znorm", on_short: str = "swap",
                        by: str | None = None, broadcast_points: int | None = None) -> DataFrame:
    """(by, series_id, start, length, label, dist) of candidate windows to all series of their group."""
    shapelets = candidates.select(*([by] if by else []),
                                  F.struct("series_id", "start", "length").alias("shapelet_id"), "values")
    long = D.min_distance(series, shapelets, metric, on_short, carry=("label",), by=by,
                          broadcast_points=broadcast_points)
    return long.select(*([by] if by else []), "shapelet_id.*", "label", "dist")


def score_candidates(series: DataFrame, candidates: DataFrame, metric: str, distance: str, digits: int,
                     on_short: str = "swap", by: str | None = None, broadcast_points: int | None = None) -> DataFrame:
    keys = [*([by] if by else []), "series_id", "start", "length"]
    dist = candidate_distances(series, candidates, distance, on_short, by, broadcast_points)
    if metric == "f":
        return M.f_score(dist, keys)
    # an ordered group holds one row per series
    return M.METRICS[metric](dist, keys, digits=digits, spread=M.spread_for(series.count()))


def _best(scored: DataFrame, n: int, columns: tuple[str, ...], by: str | None) -> DataFrame:
    if not by:
        return R.top_shapelets(scored, n, columns)
    rank = F.row_number().over(Window.partitionBy(by).orderBy(*[F.desc(c) for c in (*columns, "series_id", "start", "length")]))
    return scored.withColumn("_r", rank).where(F.col("_r") <= n).drop("_r")


def _finish(series: DataFrame, scored: DataFrame, n: int, metric: str, by: str | None = None) -> DataFrame:
    columns = score_columns(metric)
    lead = [by] if by else []
    order = [F.desc(c) for c in (*columns, "series_id", "start", "length")]
    best = _best(scored, n, columns, by)
    keep = [*lead, "series_id", "start", "length", *columns]
    # best has n rows per group, n being the caller's parameter
    joined = series.select(*lead, "series_id", F.col("values").alias("_v")).join(F.broadcast(best), [*lead, "series_id"])
    return joined.select(*keep, F.slice("_v", F.col("start") + 1, F.col("length")).alias("values")).orderBy(*lead, *order)


def _discover(series, lengths, n, metric, fast, digits, broadcast_points, by=None):
    lead = [by] if by else []
    if metric == "ig":
        merged = merge_copies(series, by)
        rows, points = table_size(merged)
        if fits_broadcast(rows, points, broadcast_points):
            scored = score_windows_shared(merged, lengths, fast, digits, by, n)
        else:
            likely = write_through(likely_windows(merged, lengths, fast, n, digits, by))
            candidates = likely.join(merged.select(*lead, "series_id", F.col("values").alias("_v")), [*lead, "series_id"]).select(
                *lead, "series_id", "start", "length", F.slice("_v", F.col("start") + 1, F.col("length")).alias("values"))
            scored = score_candidates(series, candidates, metric, "corr" if fast else "znorm", digits,
                                      "inf" if fast else "swap", by, broadcast_points)
        if merged.agg(F.max("weight")).first()[0] > 1:
            scored = _with_copies(series, merged, scored, n, score_columns(metric), by)
    else:
        candidates = W.subseries(series, lengths, keep=(by,) if by else ())
        scored = score_candidates(series, candidates, metric, "corr" if fast else "znorm", digits,
                                  "inf" if fast else "swap", by, broadcast_points)
    return _finish(series, scored, n, metric, by)


def discover_exhaustive(series: DataFrame, min_len: int | None = None, max_len: int | None = None, n: int = 1,
                        metric: str = "ig", lengths: list[int] | None = None, digits: int = 9,
                        by: str | None = None, broadcast_points: int | None = None) -> DataFrame:
    """Score every window by its z-normalised distance to every series (of its group ``by``)."""
    lengths = default_lengths(series, min_len, max_len, lengths)
    return _discover(series, lengths, n, metric, False, digits, broadcast_points, by)


def discover_fast(series: DataFrame, min_len: int | None = None, max_len: int | None = None, n: int = 1,
                  metric: str = "ig", lengths: list[int] | None = None, digits: int = 9,
                  by: str | None = None, broadcast_points: int | None = None) -> DataFrame:
    """The same candidates by correlation distance."""
    lengths = default_lengths(series, min_len, max_len, lengths)
    return _discover(series, lengths, n, metric, True, digits, broadcast_points, by)


def window_powers(series: DataFrame, lengths: list[int], alphabet: int, word_length: int,
                  masks: list[list[int]], by: str | None = None) -> DataFrame:
    """Class power of every window from masked word collisions: (by, length, series_id, start, power)."""
    encoded = P.encode_labels(series)
    lead = [by] if by else []
    classes = encoded.agg(F.max("label_index")).first()[0] + 1
    sizes = encoded.groupBy(*lead).agg(F.array(*[
        F.count(F.when(F.col("label_index") == c, 1)) for c in range(classes)]).alias("sizes"))
    # Read for every count and join below: the words are made once.
    words = write_through(W.sax_words_of_windows(encoded, lengths, word_length, alphabet, keep=(*lead, "label_index")))
    scores = S.window_class_score(W.random_mask(words, masks), classes, by=lead)
    return S.distinguishing_power(scores, sizes, len(masks), by=lead)


def discover_sax(series: DataFrame, min_len: int | None = None, max_len: int | None = None, n: int = 1,
                 metric: str = "ig", alphabet: int = 4, word: int = 16, candidates: int = 100,
                 iterations: int = 5, mask_size: int = 3, seed: int = 0, lengths: list[int] | None = None,
                 masks: list[list[int]] | None = None, digits: int = 9, by: str | None = None,
                 broadcast_points: int | None = None) -> DataFrame:
    """Keep the strongest windows per length by word collisions, then score them exactly."""
    lengths = default_lengths(series, min_len, max_len, lengths, least=word)
    masks = masks or W.draw_masks(word, mask_size, iterations, seed)
    lead = [by] if by else []
    powers = window_powers(series, lengths, alphabet, word, masks, by)
    top = R.top_candidates(powers, candidates, by=lead).select(*lead, "series_id", "start", "length")
    # at most candidates x lengths rows per group, both parameters
    windows = series.select(*lead, "series_id", F.col("values").alias("_v")).join(
        F.broadcast(top), [*lead, "series_id"]).select(
        *lead, "series_id", "start", "length", F.slice("_v", F.col("start") + 1, F.col("length")).alias("values"))
    scored = score_candidates(series, windows, metric, "znorm", digits, "swap", by, broadcast_points)
    return _finish(series, scored, n, metric, by)


METHODS = {"exhaustive": discover_exhaustive, "fast": discover_fast, "sax": discover_sax}
