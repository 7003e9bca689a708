"""Maximal periodic runs of words, and texts without the repeated words.

A run is a stretch of consecutive words with smallest period q (words q apart are equal) that is at least ``exponent`` periods
and ``least`` words long and that no neighbouring word extends. Method, per text: a suffix array of words with its LCP values;
every LCP interval is a repeated stretch of as many words as its LCP value d. Of each interval, the suffixes of all children but
the largest are asked whether the suffix d words on, or d words back, lies in the interval too, in another child: then two
copies stand next to each other and the word after them differs (a branching tandem). Rotating such a square to the left as
far as words agree gives the run that ends there; squares of a multiple of the period give the same stretch and merge into it.
No tree nodes are made: intervals come from the next smaller LCP values on both sides.

The texts of an Arrow batch are searched together, some hundred thousand words at a time. The number of the text is part of
every word's code, so no repeat crosses texts. A text is searched whole; memory is about 4 bytes per word for every doubling
of its longest repeat. Narrow: no shuffle, one row in, one row out, so a lost task is simply run again.

Cases: null, empty and blank texts have no words: no runs, and an empty collapsed text (never null). Repeated rows give equal
rows. Other columns pass through; one named like the result is replaced. An empty table stays empty. Runs may overlap; a word
goes if any run holds it after its first period. Words are parted by space, tab, line feed, vertical tab, form feed and
carriage return, nothing else.
"""

from __future__ import annotations

from collections import defaultdict
from itertools import count

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

BLOCK_WORDS = 400_000   # words searched together; a longer text is a block of its own
SLICE = 1 << 20         # suffixes asked at once

RESULT = "runs array<struct<start: long, length: long, period: long>>, collapsed string"


def suffix_ranks(codes: np.ndarray, stop: np.ndarray) -> list[np.ndarray]:
    """Ranks by the first 1, 2, 4, ... words, the last one without ties; ``stop`` is the end of each position's text."""
    n = len(codes)
    order = np.argsort(codes, kind="stable")
    first = np.ones(n, bool)
    first[1:] = codes[order][1:] != codes[order][:-1]
    at = np.maximum.accumulate(np.where(first, np.arange(n), 0))
    rank = np.empty(n, np.int32)
    rank[order] = at
    levels, width = [rank], 1
    tied = order[np.bincount(at, minlength=n)[at] > 1]
    while len(tied):
        ahead = tied + width
        second = np.where(ahead < stop[tied], rank[np.minimum(ahead, n - 1)].astype(np.int64) + 1, 0)
        key = rank[tied].astype(np.int64) * (n + 1) + second
        by = np.argsort(key)
        tied, key = tied[by], key[by]
        old, place = key // (n + 1), np.arange(len(tied))
        first = np.ones(len(tied), bool)
        first[1:] = key[1:] != key[:-1]
        opens = np.ones(len(tied), bool)
        opens[1:] = old[1:] != old[:-1]
        group = np.maximum.accumulate(np.where(first, place, 0))
        whole = np.maximum.accumulate(np.where(opens, place, 0))
        rank = rank.copy()
        rank[tied] = old + group - whole
        levels.append(rank)
        width *= 2
        tied = tied[np.bincount(group, minlength=len(tied))[group] > 1]
    return levels


def common_prefixes(levels: list[np.ndarray], suffixes: np.ndarray) -> np.ndarray:
    """Words that each suffix shares with the one before it in order; -1 at both ends of the array (one more entry)."""
    n = len(suffixes)
    shared = np.zeros(n + 1, np.int64)
    shared[0] = shared[n] = -1
    left, right = suffixes[:-1], suffixes[1:]
    some = np.flatnonzero(levels[0][left] == levels[0][right])
    a, b = left[some].copy(), right[some].copy()
    for k in range(len(levels) - 1, -1, -1):
        inside = np.flatnonzero((a < n) & (b < n))
        agree = inside[levels[k][a[inside]] == levels[k][b[inside]]]
        a[agree] += 1 << k
        b[agree] += 1 << k
    shared[some + 1] = a - left[some]
    return shared


def next_smaller(values: np.ndarray, which: np.ndarray, step: int) -> np.ndarray:
    """For the chosen places the nearest place on one side with a smaller value; pointers skip over what others have passed."""
    link = np.arange(len(values)) + step
    left = which
    while True:
        left = left[values[link[left]] >= values[left]]
        if not len(left):
            return link[which]
        link[left] = link[link[left]]


def branching_squares(codes: np.ndarray, start: np.ndarray, stop: np.ndarray):
    """(first word, period) of squares whose next word breaks the period, and the ranks they were found by."""
    n = len(codes)
    levels = suffix_ranks(codes, stop)
    rank = levels[-1]
    suffixes = np.empty(n, np.int64)
    suffixes[rank] = np.arange(n)
    shared = common_prefixes(levels, suffixes)
    cut = np.flatnonzero(shared > 0)
    none = np.zeros(0, np.int64)
    if not len(cut):
        return none, none, levels
    low, high = next_smaller(shared, cut, -1), next_smaller(shared, cut, 1)
    by = np.lexsort((cut, shared[cut], low))                    # the cuts of an interval stand together, in order
    cut, low, high, depth = cut[by], low[by], high[by], shared[cut[by]]
    opens = np.ones(len(cut), bool)
    opens[1:] = (low[1:] != low[:-1]) | (depth[1:] != depth[:-1])
    interval = np.cumsum(opens) - 1
    head = np.flatnonzero(opens)
    # Children: one before the first cut of an interval, and one after every cut.
    owner = np.insert(interval, head, interval[head])
    begin = np.insert(cut, head, low[head])
    last = np.ones(len(owner), bool)
    last[:-1] = owner[1:] != owner[:-1]
    end = np.where(last, high[head][owner], np.append(begin[1:], 0))
    size = end - begin
    child_head = head + np.arange(len(head))
    largest = np.flatnonzero(size == np.maximum.reduceat(size, child_head)[owner])
    smaller = np.ones(len(owner), bool)
    smaller[largest[np.unique(owner[largest], return_index=True)[1]]] = False
    begin, end, size, owner = begin[smaller], end[smaller], size[smaller], owner[smaller]
    low, high, depth = low[head], high[head], depth[head]

    ends = np.cumsum(size)
    found = []
    for at in range(0, int(ends[-1]), SLICE):
        place = np.arange(at, min(at + SLICE, int(ends[-1])))
        child = np.searchsorted(ends, place, "right")
        suffix = suffixes[begin[child] + place - (ends[child] - size[child])]
        mine = owner[child]
        d = depth[mine]
        for other, first in ((suffix + d, suffix), (suffix - d, suffix - d)):
            inside = (other >= start[suffix]) & (other < stop[suffix])
            seat = rank[np.where(inside, other, 0)]
            hit = inside & (seat >= low[mine]) & (seat < high[mine]) & ((seat < begin[child]) | (seat >= end[child]))
            found.append(np.stack([first[hit], d[hit]]))
    squares = np.unique(np.concatenate(found, axis=1), axis=1)
    return squares[0], squares[1], levels


def find_runs(codes: np.ndarray, sizes: np.ndarray, exponent: int, least: int) -> np.ndarray:
    """Rows (first word, length, period) in order of first word and period; ``sizes`` are the words of each text in ``codes``."""
    n, ends = len(codes), np.cumsum(sizes)
    if not n:
        return np.zeros((0, 3), np.int64)
    stop, start = np.repeat(ends, sizes), np.repeat(ends - sizes, sizes)
    first, period, levels = branching_squares(codes, start, stop)
    edge, moved = start[first], first.copy()
    for k in range(len(levels) - 1, -1, -1):                    # rotate to the left, 2^k words at a time
        back = moved - (1 << k)
        inside = np.flatnonzero(back >= edge)
        agree = inside[levels[k][back[inside]] == levels[k][back[inside] + period[inside]]]
        moved[agree] = back[agree]
    length = first + 2 * period - moved
    long = length >= np.maximum(least, exponent * period)
    moved, length, period = moved[long], length[long], period[long]
    by = np.lexsort((period, length, moved))
    moved, length, period = moved[by], length[by], period[by]
    smallest = np.ones(len(moved), bool)
    smallest[1:] = (moved[1:] != moved[:-1]) | (length[1:] != length[:-1])
    moved, length, period = moved[smallest], length[smallest], period[smallest]
    by = np.lexsort((period, moved))
    return np.stack([moved[by], length[by], period[by]], axis=1)


def _block(split: list[list[bytes]], exponent: int, least: int) -> list[tuple[list[dict], str]]:
    sizes = np.array([len(words) for words in split], np.int64)
    number: dict = defaultdict(count().__next__)
    words = [w for text in split for w in text]
    plain = np.fromiter(map(number.__getitem__, words), np.int64, len(words))
    runs = find_runs(np.repeat(np.arange(len(sizes)), sizes) * len(number) + plain, sizes, exponent, least)
    edges = np.zeros(len(words) + 1, np.int64)
    np.add.at(edges, runs[:, 0] + runs[:, 2], 1)
    np.add.at(edges, runs[:, 0] + runs[:, 1], -1)
    dropped = np.cumsum(edges[:-1]) > 0
    begins = np.concatenate([[0], np.cumsum(sizes)])
    parts = np.searchsorted(runs[:, 0], begins)
    out = []
    for k, text in enumerate(split):
        base, mine = begins[k], runs[parts[k]:parts[k + 1]]
        if len(mine):
            text = [text[i] for i in np.flatnonzero(~dropped[base:begins[k + 1]])]
        out.append(([{"start": s, "length": m, "period": p} for s, m, p in (mine - [base, 0, 0]).tolist()], b" ".join(text).decode()))
    return out


def periodic_runs(docs: DataFrame, text: str = "text", into: str = "periodic", exponent: int = 4, least: int = 6,
                  block: int = BLOCK_WORDS) -> DataFrame:
    """Add a struct: runs (start, length, period in words; by start, then period) and the collapsed text."""
    @F.pandas_udf(RESULT)
    def search(texts: pd.Series) -> pd.DataFrame:
        found, waiting, held = [], [], 0
        for value in texts:
            words = bytes(value).split() if value is not None else []  # bytes are parted at ASCII white space only
            if waiting and held + len(words) > block:
                found += _block(waiting, exponent, least)
                waiting, held = [], 0
            waiting.append(words)
            held += len(words)
        found += _block(waiting, exponent, least)
        return pd.DataFrame(found, columns=["runs", "collapsed"])

    return docs.withColumn(into, search(F.col(text).cast("binary")))


def strongest(runs: Column) -> Column:
    """The run with the greatest exact length / period; ties go to the first in order; null without runs."""
    return F.aggregate(runs, F.lit(None).cast("struct<start: long, length: long, period: long>"), lambda best, r: F.when(
        best.isNull() | (r["length"] * best["period"] > best["length"] * r["period"]), r).otherwise(best))


def listing(runs: Column) -> Column:
    """Every run as a line of start, length and period."""
    return F.concat_ws("", F.transform(runs, lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))))
