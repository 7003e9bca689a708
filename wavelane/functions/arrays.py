"""Column expressions over ``array<double>`` series."""

from __future__ import annotations

from statistics import NormalDist

from pyspark.sql import Column, functions as F


def let(value: Column, body) -> Column:
    """Bind ``value`` once inside a higher-order expression."""
    return F.transform(F.array(value), body)[0]


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, x: acc + x)


def mean(values: Column) -> Column:
    return total(values) / F.size(values)


def moments(values: Column) -> Column:
    """struct(mean, std): population deviation, exactly 0 for a constant array."""
    def body(v):
        return let(mean(v), lambda m: F.struct(
            m.alias("mean"),
            F.when(F.array_max(v) == F.array_min(v), F.lit(0.0)).otherwise(F.sqrt(
                F.aggregate(v, F.lit(0.0), lambda acc, x: acc + (x - m) * (x - m))
                / F.size(v))).alias("std")))

    return let(values, body)


def z_norm(values: Column) -> Column:
    """(x - mean) / population std; a constant array becomes zeros."""
    return let(values, lambda v: let(moments(v), lambda m: F.transform(
        v, lambda x: F.when(m["std"] == 0, F.lit(0.0)).otherwise((x - m["mean"]) / m["std"]))))


def subseries(values: Column, length: int) -> Column:
    """All windows of ``length`` points as array<struct(start, window)>; empty if too short."""
    starts = F.when(F.size(values) >= length, F.sequence(F.lit(0), F.size(values) - length)).otherwise(
        F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.struct(
        i.alias("start"), F.slice(values, i + 1, F.lit(length)).alias("window")))


def paa(values: Column, frames: int) -> Column:
    """Frame means; a frame has floor(n / frames) points and the last takes the rest."""
    def body(v):
        n = F.size(v)
        w = F.least(F.lit(frames), n)
        frame = F.floor(n / w).cast("int")
        return F.transform(F.sequence(F.lit(0), w - 1), lambda i: mean(
            F.slice(v, i * frame + 1, F.when(i == w - 1, n - i * frame).otherwise(frame))))

    return let(values, body)


def sax_breakpoints(alphabet: int) -> list[float]:
    """alphabet - 1 cut points of N(0, 1) into equally likely regions."""
    return [NormalDist().inv_cdf(i / alphabet) for i in range(1, alphabet)]


def sax_symbol(x: Column, alphabet: int) -> Column:
    """Index of the half-open region [lo, hi) holding x."""
    symbol = F.lit(0)
    for b in sax_breakpoints(alphabet):
        symbol = symbol + F.when(x >= F.lit(b), 1).otherwise(0)
    return symbol


def sax_word(values: Column, frames: int, alphabet: int) -> Column:
    return F.transform(paa(values, frames), lambda x: sax_symbol(x, alphabet))


def sax_distance_table(alphabet: int) -> list[list[float]]:
    """0 for equal or adjacent symbols, else the gap between their regions."""
    cuts = sax_breakpoints(alphabet)
    return [[0.0 if abs(a - b) <= 1 else cuts[max(a, b) - 1] - cuts[min(a, b)]
             for b in range(alphabet)] for a in range(alphabet)]


def sax_distance(a: Column, b: Column, length: Column, alphabet: int, squared: bool = False) -> Column:
    """sqrt(n / w) times the sum of cell distances; ``squared`` gives the published lower bound."""
    table = F.array(*[F.array(*[F.lit(x) for x in row]) for row in sax_distance_table(alphabet)])
    cells = F.zip_with(a, b, lambda x, y: table[x][y])
    if squared:
        body = F.sqrt(F.aggregate(cells, F.lit(0.0), lambda acc, x: acc + x * x))
    else:
        body = total(cells)
    return F.sqrt(length / F.size(a)) * body


def barycenter(a: Column, b: Column) -> Column:
    """Element-wise mean over the common prefix; the longer tail is dropped."""
    n = F.least(F.size(a), F.size(b))
    return F.zip_with(F.slice(a, F.lit(1), n), F.slice(b, F.lit(1), n), lambda x, y: (x + y) / 2)


def merge_aligned(a: Column, b: Column, draw: Column) -> Column:
    """struct(start, centroid): the shorter array averaged with a window of the longer.

    ``draw`` in [0, 1) picks the window start among the first |len(a) - len(b)| offsets.
    """
    short = F.when(F.size(a) <= F.size(b), a).otherwise(b)
    long = F.when(F.size(a) <= F.size(b), b).otherwise(a)
    start = F.floor(draw * (F.size(long) - F.size(short))).cast("int")
    return let(start, lambda s: F.struct(
        s.alias("start"), barycenter(F.slice(long, s + 1, F.size(short)), short).alias("centroid")))


def shapelet_key(values: Column) -> Column:
    """Content key of a shapelet, for removing duplicates."""
    return F.xxhash64(values)
