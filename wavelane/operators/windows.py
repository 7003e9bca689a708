"""Window, symbol and prefix-sum tables built from series."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from wavelane.functions import arrays as A, kernels

FIRST_LETTER, LAST_CODE = ord("a"), 0xD7FF  # symbols are code points from "a" on, up to the surrogates


def subseries(series: DataFrame, lengths: list[int], keep: tuple[str, ...] = ("label",)) -> DataFrame:
    """Every window of every given length: (series_id, keep..., length, start, values)."""
    out = series.select("series_id", *keep, "values", F.explode(F.array(*[F.lit(int(l)) for l in lengths])).alias("length"))
    n = F.size("values")
    starts = F.when(n >= F.col("length"), F.sequence(F.lit(0), n - F.col("length")))
    return out.select("series_id", *keep, "values", "length", F.explode(starts).alias("start")).select(
        "series_id", *keep, "length", "start",
        F.slice("values", F.col("start") + 1, F.col("length")).alias("values"))


def length_range(min_len: int, max_len: int) -> list[int]:
    """Lengths min_len .. max_len - 1."""
    return list(range(min_len, max_len))


def word_string(symbols: Column) -> Column:
    """Symbols 0, 1, ... as characters a, b, ... and the code points that follow z."""
    return F.concat_ws("", F.transform(symbols, lambda s: F.decode(F.unhex(F.lpad(F.hex(s + FIRST_LETTER), 4, "0")), "UTF-16BE")))


def sax_words_of_windows(series: DataFrame, lengths: list[int], word_length: int, alphabet: int,
                         keep: tuple[str, ...] = ("label",)) -> DataFrame:
    """Symbol word of every z-normalised window, as letters.

    A narrow Arrow stage: windows are built, normalised and averaged per batch, so no
    window values leave the task. Words longer than the window are cut to its length.
    """
    if alphabet > LAST_CODE - FIRST_LETTER:
        raise ValueError("alphabet too large")
    cuts = np.array(A.sax_breakpoints(alphabet))
    keep = tuple(keep)
    schema = T.StructType([series.schema["series_id"]] + [series.schema[c] for c in keep] + [
        T.StructField("length", T.IntegerType()), T.StructField("start", T.IntegerType()),
        T.StructField("word", T.StringType())])
    names = schema.fieldNames()

    def words(x: np.ndarray, length: int) -> np.ndarray:
        w = min(word_length, length)
        frame = length // w
        edges = np.arange(w) * frame
        z = kernels.z_norm(np.lib.stride_tricks.sliding_window_view(x, length, axis=1))
        sizes = np.diff(np.append(edges, length))
        means = np.add.reduceat(z, edges, axis=2) / sizes
        # means that sit on a cut up to rounding go to the upper region
        symbols = np.searchsorted(cuts, means + 1e-12, side="right").astype(np.uint32)
        codes = np.ascontiguousarray(symbols + np.uint32(FIRST_LETTER))  # numpy text is 32 bits a character
        return codes.reshape(-1, w).view(f"U{w}").reshape(-1)

    def run(batches):
        for batch in batches:
            own = kernels.Ragged.from_arrow(batch.column("values"))
            for n, rows in kernels.ragged_groups(own.lengths):
                for length in lengths:
                    if length > n or length < 1:
                        continue
                    count = n - length + 1
                    step = max(1, kernels.BLOCK_CELLS // (count * length))
                    for a in range(0, len(rows), step):
                        part = rows[a:a + step]
                        text = words(own.block(part, n), length)
                        take = pa.array(np.repeat(part, count))
                        cols = [batch.column(c).take(take) for c in ("series_id", *keep)]
                        cols += [pa.array(np.full(len(text), length, np.int32)),
                                 pa.array(np.tile(np.arange(count, dtype=np.int32), len(part))),
                                 pa.array(text)]
                        yield pa.RecordBatch.from_arrays(cols, names=names)

    return series.select("series_id", *keep, F.col("values").cast("array<double>").alias("values")).mapInArrow(
        run, schema)


def draw_masks(word_length: int, mask_size: int, iterations: int, seed: int = 0) -> list[list[int]]:
    """Kept word positions per iteration, in order; the same for every word."""
    rng = np.random.default_rng(seed)
    kept = max(1, word_length - mask_size)
    return [sorted(int(p) for p in rng.choice(word_length, kept, replace=False)) for _ in range(iterations)]


def random_mask(words: DataFrame, masks: list[list[int]]) -> DataFrame:
    """One row per word and mask iteration, with the kept letters only."""
    kept = F.array(*[F.struct(F.lit(i).alias("iter"), F.concat(*[F.substring("word", p + 1, 1) for p in mask])
                              .alias("masked")) for i, mask in enumerate(masks)])
    return words.select("*", F.explode(kept).alias("_m")).select("*", "_m.iter", "_m.masked").drop("_m")


def prefix_stats(series: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Adds ``s1`` and ``s2``: running sums of values and squares with a leading 0."""
    keep = tuple(keep)
    lists = T.ArrayType(T.DoubleType())
    schema = T.StructType([series.schema["series_id"]] + [series.schema[c] for c in keep]
                          + [T.StructField("s1", lists), T.StructField("s2", lists)])
    names = schema.fieldNames()

    def run(batches):
        for batch in batches:
            own = kernels.Ragged.from_arrow(batch.column("values"))
            offsets = np.concatenate(([0], np.cumsum(own.lengths + 1))).astype(np.int32)
            outs = []
            for power in (1, 2):
                out = np.zeros(offsets[-1])
                for n, rows, x in own.groups():
                    out[offsets[:-1][rows][:, None] + np.arange(1, n + 1)] = np.cumsum(x ** power, axis=1)
                outs.append(pa.ListArray.from_arrays(pa.array(offsets), pa.array(out)))
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in ("series_id", *keep)] + outs, names=names)

    return series.select("series_id", *keep, F.col("values").cast("array<double>").alias("values")).mapInArrow(
        run, schema)


def cross_prefix(pairs: DataFrame, x: str = "x", y: str = "y") -> DataFrame:
    """Diagonal running cross products of two arrays per row: (series_id, u, v, m)."""
    schema = T.StructType([pairs.schema["series_id"], T.StructField("u", T.LongType()),
                           T.StructField("v", T.LongType()), T.StructField("m", T.DoubleType())])

    def run(batches):
        for batch in batches:
            left = kernels.Ragged.from_arrow(batch.column(x))
            right = kernels.Ragged.from_arrow(batch.column(y))
            for i in range(len(left)):
                n, m = int(left.lengths[i]), int(right.lengths[i])
                a = left.flat[left.starts[i]:left.starts[i] + n]
                b = right.flat[right.starts[i]:right.starts[i] + m]
                grid = kernels.cross_prefix(a, b)[0, 1:, 1:]
                u, v = np.divmod(np.arange(n * m), max(m, 1))
                sid = batch.column("series_id").take(pa.array(np.full(n * m, i)))
                yield pa.RecordBatch.from_arrays(
                    [sid, pa.array(u), pa.array(v), pa.array(grid.reshape(-1))], names=schema.fieldNames())

    return pairs.select("series_id", x, y).mapInArrow(run, schema)


def window_correlation(pairs: DataFrame, length: int, x: str = "x", y: str = "y") -> DataFrame:
    """Pearson correlation of x[u:u+l] and y[v:v+l] by running sums: (series_id, u, v, corr).

    A zero deviation counts as 1 and the correlation is capped at 1.
    """
    schema = T.StructType([pairs.schema["series_id"], T.StructField("u", T.LongType()),
                           T.StructField("v", T.LongType()), T.StructField("corr", T.DoubleType())])

    def run(batches):
        for batch in batches:
            left = kernels.Ragged.from_arrow(batch.column(x))
            right = kernels.Ragged.from_arrow(batch.column(y))
            both = left.lengths * (right.lengths.max(initial=0) + 1) + right.lengths  # pairs of equal lengths are matched together
            for _, alike in kernels.ragged_groups(both):
                n, m = int(left.lengths[alike[0]]), int(right.lengths[alike[0]])
                if min(n, m) < length:
                    continue
                step = max(1, kernels.SEARCH_CELLS // ((n + 1) * (m + 1)))
                for rows in (alike[k:k + step] for k in range(0, len(alike), step)):
                    corr = kernels.paired_correlations(left.block(rows, n), right.block(rows, m), length)
                    cells = corr.shape[1] * corr.shape[2]
                    u, v = np.divmod(np.arange(cells), corr.shape[2])
                    sid = batch.column("series_id").take(pa.array(np.repeat(rows, cells)))
                    yield pa.RecordBatch.from_arrays([sid, pa.array(np.tile(u, len(rows))), pa.array(np.tile(v, len(rows))),
                                                      pa.array(corr.reshape(-1))], names=schema.fieldNames())

    return pairs.select("series_id", x, y).mapInArrow(run, schema)


def correlation_distance(corr: Column) -> Column:
    return F.sqrt(2 * (1 - F.least(corr, F.lit(1.0))))


# Fixed cells of adjacent symbol pairs in the 4 x 4 grid.
BITMAP_CELLS = {
    (0, 0): (0, 0), (0, 1): (0, 1), (0, 2): (1, 0), (0, 3): (1, 1),
    (1, 0): (0, 2), (1, 1): (0, 3), (1, 2): (1, 2), (1, 3): (1, 3),
    (2, 0): (2, 0), (2, 1): (2, 1), (2, 2): (3, 0), (2, 3): (3, 1),
    (3, 0): (2, 2), (3, 1): (2, 3), (3, 2): (3, 2), (3, 3): (3, 3),
}


def sax_bitmap(train: DataFrame, series: DataFrame) -> DataFrame:
    """Shares of adjacent symbol pairs per series: (series_id, row, col, share); empty cells omitted.

    Points are scaled by the mean and deviation of all training points.
    """
    from wavelane.operators.prep import scale_global

    cells = F.create_map(*[F.lit(v) for pair, cell in BITMAP_CELLS.items()
                           for v in (pair[0] * 4 + pair[1], cell[0] * 4 + cell[1])])
    symbols = F.transform("values", lambda x: A.sax_symbol(x, 4))
    scaled = scale_global(train, series).select("series_id", symbols.alias("_s"))
    pairs = F.zip_with(F.slice("_s", F.lit(1), F.size("_s") - 1), F.slice("_s", F.lit(2), F.size("_s") - 1),
                       lambda a, b: a * 4 + b)
    exploded = scaled.where(F.size("_s") > 1).select(
        "series_id", (F.size("_s") - 1).alias("_n"), F.explode(pairs).alias("_p"))
    counts = exploded.groupBy("series_id", "_n", "_p").agg(F.count(F.lit(1)).alias("n"))
    cell = cells[F.col("_p")]
    return counts.select("series_id", F.floor(cell / 4).cast("long").alias("row"),
                         (cell % 4).cast("long").alias("col"), (F.col("n") / F.col("_n")).alias("share"))
