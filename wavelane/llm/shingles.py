"""Word shingles as sorted 64-bit hashes, in numpy, for texts of any length."""

from __future__ import annotations

import numpy as np
import pandas as pd

WORDS = 5
RUN = 1 << 18  # characters hashed at once
_BASE = np.uint64(0x9E3779B97F4A7C55)
_state: dict = {}


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _powers(n: int):
    """Powers of an odd base and of its inverse modulo 2^64."""
    if len(_state.get("up", ())) < n:
        size = 1 << max(n, RUN * 2).bit_length()
        inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
        for name, base in (("up", _BASE), ("down", inverse)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _state[name] = np.cumprod(steps, dtype=np.uint64)
    return _state["up"], _state["down"]


def _table() -> np.ndarray:
    if "word" not in _state:
        _state["word"] = np.array([chr(i).isalnum() for i in range(0x110000)])
    return _state["word"]


def word_points(text: str | None):
    """Lower-cased letters and digits with one blank between words; starts and ends of the words."""
    if not text:
        return np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64)
    points = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), np.uint32)
    inside = _table()[points]
    keep = inside.copy()
    keep[1:] |= inside[:-1]
    kept = np.where(inside, points, 32)[keep].astype(np.uint32)
    solid = inside[keep]
    edge = np.diff(np.concatenate(([False], solid, [False])).astype(np.int8))
    return kept, np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def shingle_hashes(text: str | None, words: int = WORDS) -> np.ndarray:
    """Hashes of all runs of ``words`` words, in order; a shorter text has one shingle of all its words, an empty one none."""
    points, starts, ends = word_points(text)
    if not len(starts):
        return np.zeros(0, np.uint64)
    size = min(words, len(starts))
    first, last = starts[:len(starts) - size + 1], ends[size - 1:]
    out, at = np.empty(len(first), np.uint64), 0
    while at < len(first):
        stop = max(int(np.searchsorted(first, first[at] + RUN)), at + 1)
        low, high = int(first[at]), int(last[stop - 1])
        up, down = _powers(high - low)
        sums = np.concatenate(([np.uint64(0)], np.cumsum((points[low:high].astype(np.uint64) + np.uint64(1)) * up[:high - low], dtype=np.uint64)))
        a, b = first[at:stop] - low, last[at:stop] - low
        out[at:stop] = (sums[b] - sums[a]) * down[a]
        at = stop
    return mix(out)


def shingle_set(text: str | None, words: int = WORDS) -> np.ndarray:
    return np.unique(shingle_hashes(text, words))


def groups(batches, keys: list[str]):
    """Runs of rows with equal keys from batches that are sorted by them, as lists of data frames' rows (one frame each)."""
    rest = None
    for batch in batches:
        rows = batch if rest is None else pd.concat([rest, batch], ignore_index=True)
        if not len(rows):
            continue
        new = np.zeros(len(rows), bool)
        for key in keys:
            column = rows[key].to_numpy()
            new[1:] |= column[1:] != column[:-1]
        at = [0, *np.flatnonzero(new).tolist()]
        columns = {c: rows[c].to_numpy() for c in rows.columns}
        for a, b in zip(at, at[1:]):
            yield {c: v[a:b] for c, v in columns.items()}
        rest = rows.iloc[at[-1]:]
    if rest is not None and len(rest):
        yield {c: rest[c].to_numpy() for c in rest.columns}
