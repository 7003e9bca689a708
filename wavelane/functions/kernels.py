"""Numpy helpers used inside Arrow batches. They see one bounded block at a time."""

from __future__ import annotations

import numpy as np
from numpy.lib.stride_tricks import sliding_window_view

BLOCK_CELLS = 512 * 1024  # float64 cells per intermediate, about 4 MB


def z_norm(rows: np.ndarray) -> np.ndarray:
    """Centre and scale the last axis; constant rows become zero."""
    rows = np.asarray(rows, dtype=np.float64)
    mean = rows.mean(axis=-1, keepdims=True)
    centred = rows - mean
    std = np.sqrt((centred * centred).mean(axis=-1, keepdims=True))
    flat = rows.max(axis=-1, keepdims=True) == rows.min(axis=-1, keepdims=True)
    return np.where(flat, 0.0, centred / np.where(flat | (std == 0), 1.0, std))


def _match_offsets(x, s, metric, first, last):
    """Squared distances of offsets [first, last) of every row of ``x`` to every row of ``s``: (r, w, k), and the windows."""
    l = s.shape[1]
    win = sliding_window_view(x[:, first:last + l - 1], l, axis=1)
    r, w = win.shape[:2]
    win = np.ascontiguousarray(win.reshape(r * w, l))
    if metric != "raw":
        win = z_norm(win)
    dot = win @ s.T
    if metric == "corr":
        d2 = 2.0 * (1.0 - np.minimum(dot / l, 1.0))
    else:
        d2 = (win * win).sum(1)[:, None] + (s * s).sum(1)[None, :] - 2.0 * dot
    return d2.reshape(r, w, -1), win


def _exact(win, s, at, j, metric, product):
    """Squared distances of listed (window, shapelet) pairs from their differences."""
    l = s.shape[1]
    exact = np.empty(len(at))
    step = max(1, BLOCK_CELLS // l)
    for a in range(0, len(at), step):
        e = slice(a, a + step)
        diff = win[at[e]] - s[j[e]]
        exact[e] = np.einsum("ij,ij->i", diff, diff)
        if metric == "corr":  # equal only when both sides have unit variance
            unit = (win[at[e]] != 0).any(axis=1) & (s[j[e]] != 0).any(axis=1)
            exact[e] = np.where(unit, exact[e] / l, product[e])
    return exact


def _match_block(x, s, metric, want_pos):
    """Best match of every row of ``s`` (k, l) in every row of ``x`` (r, n), a run of offsets at a time.

    The product form loses digits where the distance is near zero and cannot order near ties, so windows within its
    rounding bound of the best are measured from the differences. The bound depends on the row and the shapelet alone.
    """
    (r, n), (k, l) = x.shape, s.shape
    offsets = n - l + 1
    if metric == "corr":
        scale = np.full((r, k), float(l))
    elif metric == "raw":
        scale = (np.abs(x).max(axis=1)[:, None] + np.abs(s).max(axis=1)[None, :]) ** 2 * l + 1e-300
    else:  # normalised values are at most sqrt(l)
        scale = np.full((r, k), 4.0 * l * l)
    slack = 1e-11 * scale
    run = max(1, min(offsets, BLOCK_CELLS // max(r * max(l, k), 1)))
    best = np.full((r, k), np.inf)
    pos = np.zeros((r, k), dtype=np.int64) if want_pos else None
    least = np.full((r, k), np.inf)  # of the product form
    for first in range(0, offsets, run):
        last = min(first + run, offsets)
        d2, win = _match_offsets(x, s, metric, first, last)
        w = last - first
        low = d2.min(axis=1)
        np.minimum(least, low, out=least)
        close = d2 <= (least + slack)[:, None, :]
        if not want_pos:
            close &= (least <= 1e-4 * scale)[:, None, :]
            np.minimum(best, np.where(least <= 1e-4 * scale, np.inf, low), out=best)
        i, v, j = np.nonzero(close)
        if not len(i):
            continue
        exact = _exact(win, s, i * w + v, j, metric, d2[i, v, j])
        low = np.full(r * k, np.inf)
        cell = i * k + j
        np.minimum.at(low, cell, exact)
        low = low.reshape(r, k)
        if want_pos:
            # equal up to rounding counts as a tie, and the earliest offset wins
            tie = exact <= low.reshape(-1)[cell] * (1 + 1e-12) + 1e-24 * scale.reshape(-1)[cell]
            at = np.full(r * k, offsets, dtype=np.int64)
            np.minimum.at(at, cell[tie], first + v[tie])
            better = low < best * (1 - 1e-12) - 1e-24 * scale
            pos = np.where(better | np.isinf(best), at.reshape(r, k), pos)
            best = np.where(better | np.isinf(best), low, best)
        else:
            best = np.minimum(best, low)
    best = np.where(np.isinf(best), least, best)
    return np.sqrt(np.maximum(best, 0.0)), pos


def best_match(x, s, metric="raw", want_pos=False):
    """Distances (r, k) and, if wanted, first best offsets (r, k), blocked to bounded memory.

    ``x`` is (r, n), ``s`` is (k, l), l <= n. ``metric``: raw, znorm or corr.
    """
    x = np.asarray(x, dtype=np.float64)
    s = np.asarray(s, dtype=np.float64)
    if metric != "raw":
        s = z_norm(s)
    (r, n), (k, l) = x.shape, s.shape
    w = n - l + 1
    kk = max(1, min(k, max(BLOCK_CELLS // max(w, 1), 64)))
    rr = max(1, min(r, BLOCK_CELLS // (w * max(l, kk))))
    dist = np.empty((r, k))
    pos = np.zeros((r, k), dtype=np.int64) if want_pos else None
    for a in range(0, r, rr):
        for b in range(0, k, kk):
            d, p = _match_block(x[a:a + rr], s[b:b + kk], metric, want_pos)
            dist[a:a + rr, b:b + kk] = d
            if want_pos:
                pos[a:a + rr, b:b + kk] = p
    return dist, pos


def ragged_groups(lengths: np.ndarray):
    """(length, row indices) for each distinct length in a batch."""
    order = np.argsort(lengths, kind="stable")
    cuts = np.flatnonzero(np.diff(lengths[order])) + 1
    for rows in np.split(order, cuts):
        if len(rows):
            yield int(lengths[rows[0]]), rows


class Ragged:
    """A list column as flat values and offsets."""

    def __init__(self, flat: np.ndarray, lengths: np.ndarray):
        self.flat = np.asarray(flat, dtype=np.float64)
        self.lengths = np.asarray(lengths, dtype=np.int64)
        self.starts = np.concatenate(([0], np.cumsum(self.lengths)))[:-1]

    @classmethod
    def from_arrow(cls, column):
        import pyarrow as pa
        import pyarrow.compute as pc

        if isinstance(column, pa.ChunkedArray):
            column = column.combine_chunks()
        lengths = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
        flat = column.flatten().to_numpy(zero_copy_only=False)
        return cls(flat, lengths)

    @classmethod
    def from_lists(cls, lists):
        lists = [np.asarray(v, dtype=np.float64) for v in lists]
        flat = np.concatenate(lists) if lists else np.empty(0)
        return cls(flat, np.array([len(v) for v in lists], dtype=np.int64))

    def __len__(self):
        return len(self.lengths)

    def block(self, rows, length):
        return self.flat[self.starts[rows][:, None] + np.arange(length)[None, :]]

    def groups(self):
        for length, rows in ragged_groups(self.lengths):
            yield length, rows, self.block(rows, length)


def ragged_match(series: Ragged, shapelets: Ragged, metric="raw", on_short="inf",
                 want_pos=False):
    """Distance and offset matrices for ragged series and ragged shapelets.

    ``on_short`` says what happens when a shapelet is longer than the series:
    ``inf`` gives an infinite distance, ``swap`` slides the series over the shapelet.
    """
    r, k = len(series), len(shapelets)
    dist = np.full((r, k), np.inf)
    pos = np.zeros((r, k), dtype=np.int64) if want_pos else None
    pools = list(shapelets.groups())
    for n, rows, x in series.groups():
        for l, cols, s in pools:
            if l == 0 or n == 0:
                continue
            if l <= n:
                d, p = best_match(x, s, metric, want_pos)
            elif on_short == "swap":
                d, p = best_match(s, x, metric, want_pos)
                d, p = d.T, p.T if want_pos else None
            else:
                continue
            dist[np.ix_(rows, cols)] = d
            if want_pos:
                pos[np.ix_(rows, cols)] = p
    return dist, pos


def split_scores(dist: np.ndarray, label: np.ndarray, classes: int, digits: int = 9, weight: np.ndarray | None = None):
    """Best information-gain split of each row of ``dist`` (k, n); a column counts ``weight`` times.

    Returns gain, gap and threshold per row; -inf where no boundary exists.
    """
    k, n = dist.shape
    gain = np.full(k, -np.inf)
    gap = np.full(k, -np.inf)
    tau = np.full(k, np.nan)
    rows = n if weight is None else int(weight.sum())
    if rows < 2:
        return np.full(k, np.nan), np.full(k, np.nan), tau
    if n < 2:
        return gain, gap, tau
    own = np.bincount(label, minlength=classes)
    total = own if weight is None else np.bincount(label, weight, classes).astype(np.int64)
    prior = _n_log_n(np.array([rows]))[0] - _n_log_n(total).sum()

    def steps(upto, size, of):
        """What columns change the terms of their class by when they move to the left."""
        return _n_log_n(upto) - _n_log_n(upto - size), _n_log_n(of - upto) - _n_log_n(of - upto + size)

    of, before = np.repeat(total, own), np.repeat(np.cumsum(total) - total, own)
    if weight is None:  # the r-th column of a class, whichever it is
        left_step, right_step = (x[None, :] for x in steps(np.arange(1, n + 1) - before, 1, of))
        nl = np.arange(1, n)[None, :]
        n_left, n_right = _n_log_n(nl), _n_log_n(rows - nl)
    small = label.astype(np.uint8 if classes <= 256 else np.int64)
    step = max(1, BLOCK_CELLS // (4 * n))
    for a in range(0, k, step):
        d = np.round(dist[a:a + step], digits)
        order = np.argsort(d, axis=1)  # splits lie between distinct distances, so the order of equal ones does not matter
        ds = np.take_along_axis(d, order, axis=1)
        by_class = np.argsort(small[order], axis=1, kind="stable")
        mass = ds
        if weight is not None:
            size = weight[order]
            mass = ds * size
            nl = np.cumsum(size, axis=1)[:, :-1]
            n_left, n_right = _n_log_n(nl), _n_log_n(rows - nl)
            size = np.take_along_axis(size, by_class, axis=1)
            left_step, right_step = steps(np.cumsum(size, axis=1) - before, size, of)
        moves = np.empty(ds.shape)
        np.put_along_axis(moves, by_class, left_step, axis=1)
        s_left = np.cumsum(moves, axis=1)[:, :-1]
        np.put_along_axis(moves, by_class, right_step, axis=1)
        s_right = _n_log_n(total).sum() + np.cumsum(moves, axis=1)[:, :-1]
        g = (prior - (n_left - s_left) - (n_right - s_right)) / rows
        g = np.round(g, digits)
        cum = np.cumsum(mass, axis=1)
        hole = np.round((cum[:, -1:] - cum[:, :-1]) / (rows - nl) - cum[:, :-1] / nl, digits)
        edge = ds[:, 1:] > ds[:, :-1]
        g = np.where(edge, g, -np.inf)
        top = g.max(axis=1, keepdims=True)
        hole = np.where(edge & (g == top), hole, -np.inf)
        at = hole.argmax(axis=1)
        row = np.arange(len(d))
        ok = np.isfinite(top[:, 0])
        gain[a:a + step] = np.where(ok, top[:, 0], -np.inf)
        gap[a:a + step] = np.where(ok, hole[row, at], -np.inf)
        tau[a:a + step] = np.where(ok, (ds[row, at] + ds[row, at + 1]) / 2, np.nan)
    return gain, gap, tau


def cross_prefix(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Diagonal running sums of x[u]*y[v] with a zero border; y may be (r, m)."""
    y = np.atleast_2d(y)
    n, (r, m) = len(x), y.shape
    out = np.zeros((r, n + 1, m + 1))
    for u in range(n):
        out[:, u + 1, 1:] = out[:, u, :-1] + x[u] * y
    return out


def prefix_sums(rows: np.ndarray):
    """Running sums of values and squares along the last axis, with a leading 0."""
    pad = [(0, 0)] * (rows.ndim - 1) + [(1, 0)]
    return np.pad(np.cumsum(rows, -1), pad), np.pad(np.cumsum(rows * rows, -1), pad)


def window_moments(rows: np.ndarray, l: int):
    """Mean, deviation and reliability of every window of length l, for rows of unit scale.

    A constant window (minimum = maximum) has deviation 1, so its covariances give correlation 0. Windows whose deviation
    is too small against the row for running sums are marked as not reliable.
    """
    s1, s2 = prefix_sums(rows)
    mean = (s1[..., l:] - s1[..., :-l]) / l
    var = (s2[..., l:] - s2[..., :-l]) / l - mean * mean
    windows = sliding_window_view(rows, l, axis=-1)
    flat = windows.max(axis=-1) == windows.min(axis=-1)
    sure = flat | (var > 1e-5)
    return mean, np.where(flat | ~sure, 1.0, np.sqrt(np.maximum(var, 1e-300))), flat, sure


def window_correlations(x: np.ndarray, y: np.ndarray, l: int) -> np.ndarray:
    """Correlation (u, v) of every window of x with every window of y."""
    return paired_correlations(np.asarray(x)[None], np.asarray(y)[None], l)[0]


def paired_correlations(x: np.ndarray, y: np.ndarray, l: int) -> np.ndarray:
    """Correlations (p, u, v) of the windows of paired rows of (p, n) and (p, m), by running sums.

    Both series are scaled to unit deviation first, so amplitude and offset do not matter; windows that hardly vary against
    their series are correlated from their own values.
    """
    x, y = z_norm(x), z_norm(y)
    (p, n), m = x.shape, y.shape[1]
    cross = np.zeros((p, n + 1, m + 1))
    for u in range(n):
        cross[:, u + 1, 1:] = cross[:, u, :-1] + x[:, u, None] * y
    mx, dx, flat_x, sure_x = window_moments(x, l)
    my, dy, flat_y, sure_y = window_moments(y, l)
    cov = cross[:, l:, l:] - cross[:, :-l, :-l] - l * (mx[:, :, None] * my[:, None, :])
    corr = cov / (l * (dx[:, :, None] * dy[:, None, :]))
    for i in np.flatnonzero(~(sure_x.all(axis=1) & sure_y.all(axis=1))):
        wx, wy = z_norm(sliding_window_view(x[i], l)), z_norm(sliding_window_view(y[i], l))
        corr[i, ~sure_x[i]] = wx[~sure_x[i]] @ wy.T / l
        corr[i][:, ~sure_y[i]] = wx @ wy[~sure_y[i]].T / l
    corr[flat_x] = 0.0
    corr.transpose(0, 2, 1)[flat_y] = 0.0
    return np.minimum(1.0, corr)


# ---- window search: many candidates of one length against all windows of that length ------------------------------------------

SEARCH_CELLS = 512 * 1024  # products formed at once; small enough to stay in a core's cache
NEAR = 1e-4                # correlations this close to 1 are measured from the differences
LONG_SERIES = 8 * 1024     # windows of a series that are held at once
HELD_CELLS = 8 * 1024 * 1024  # of the normalised windows that are kept
BUCKETS = 128              # of a distance histogram
UNIT_CELLS = 128 * 1024    # single precision products formed at once
UNIT_ROWS = 4 * 1024       # windows that are normalised together
KEPT_CELLS = 16 * 1024 * 1024  # of the single precision windows that are kept
UNIT_STEPS = 2.0 ** 22     # correlations are ordered in these steps
CLEAR_PLACES = 6           # places after an edge that are looked at for a clear gap


class Windows:
    """The normalised windows of one length of a pool of series, some series at a time; kept if they are few.

    ``others`` are the series that are shorter, or too long to be held.
    """

    def __init__(self, pool: Ragged, length: int, candidates: int = 512):
        self.pool, self.length = pool, length
        counts = pool.lengths - length + 1
        self.fits, self.others = np.flatnonzero((counts > 0) & (counts <= LONG_SERIES)), np.flatnonzero((counts <= 0) | (counts > LONG_SERIES))
        room = max(SEARCH_CELLS // candidates, 1)
        ends = np.cumsum(pool.lengths[self.fits] - length + 1)
        runs = np.searchsorted(ends, np.arange(room, (ends[-1] if len(ends) else 0) + room, room), "right")
        self.cuts = np.unique(np.concatenate([[0], runs, [len(self.fits)]])).astype(int)
        self.kept = [None] * (len(self.cuts) - 1) if len(ends) and ends[-1] * length <= HELD_CELLS else None

    def _run(self, rows: np.ndarray):
        counts = self.pool.lengths[rows] - self.length + 1
        starts = np.cumsum(counts) - counts
        first = np.repeat(self.pool.starts[rows], counts) + np.arange(counts.sum()) - np.repeat(starts, counts)
        windows = z_norm(self.pool.flat[first[:, None] + np.arange(self.length)])
        return rows, starts, windows, windows.any(axis=1)

    def __iter__(self):
        for k, (a, b) in enumerate(zip(self.cuts, self.cuts[1:])):
            run = self.kept[k] if self.kept is not None else None
            if run is None:
                run = self._run(self.fits[a:b])
                if self.kept is not None:
                    self.kept[k] = run
            yield run


def closest_windows(candidates: np.ndarray, windows: Windows, metric: str) -> np.ndarray:
    """Distances (k, series) of normalised candidates to their closest window in every series held; inf for others.

    ``corr``: sqrt(2(1 - correlation)); ``znorm``: Euclidean distance of the normalised windows. One matrix product per run of
    series gives all correlations; the closest window has the largest. Near 1 a product loses digits, so there the windows
    within its rounding bound are measured from the differences.
    """
    k, l = candidates.shape
    out = np.full((len(windows.pool), k), np.inf)
    varied = candidates.any(axis=1)
    for rows, starts, held, moving in windows:
        dots = held @ candidates.T
        stops = np.append(starts[1:], len(held))
        top = np.empty((len(rows), k))
        for n, (a, b) in enumerate(zip(starts.tolist(), stops.tolist())):
            dots[a:b].max(axis=0, out=top[n])
        if metric == "corr":
            square = 2.0 * (1.0 - np.minimum(top / l, 1.0))
        else:
            square = 2.0 * (l - np.minimum(top, l))
            still = np.flatnonzero(~np.logical_and.reduceat(moving, starts))  # series with a constant window
            square[still] = np.minimum(square[still], l)
            square[:, ~varied] = l
            square[np.ix_(still, np.flatnonzero(~varied))] = 0.0
        near = (top >= l * (1.0 - NEAR)) & varied
        for n in np.flatnonzero(near.any(axis=1)).tolist():
            a, b, j = starts[n], stops[n], np.flatnonzero(near[n])
            v, c = np.nonzero(dots[a:b, j] >= top[n, j] - 1e-9 * l)
            gap = held[a + v] - candidates[j[c]]
            least = np.full(len(j), np.inf)
            np.minimum.at(least, c, np.einsum("ij,ij->i", gap, gap))
            square[n, j] = least / l if metric == "corr" else least
        out[rows] = square
    return np.sqrt(np.maximum(out, 0.0)).T


class UnitWindows:
    """The windows of one length of a pool, normalised to length 1 in single precision; kept if they are few.

    Series of equal length lie next to each other, so that one product and one reduction serve several. ``short`` are those without a window.
    """

    def __init__(self, pool: Ragged, length: int):
        self.pool, self.length = pool, length
        counts = np.maximum(pool.lengths - length + 1, 0)
        self.short = np.flatnonzero(counts == 0)
        self.pieces = []  # rows, first offset and number of the windows that are normalised together
        most = max(1, min(UNIT_ROWS, BLOCK_CELLS // max(length, 1)))
        for n, rows in ragged_groups(counts):
            some = max(1, most // max(n, 1))
            self.pieces += [(rows[a:a + some], first, min(most, n - first)) for first in range(0, n, most) for a in range(0, len(rows), some)]
        self.kept = [None] * len(self.pieces) if counts.sum() * length <= KEPT_CELLS else None

    def _piece(self, rows: np.ndarray, first: int, wide: int):
        values = self.pool.flat[(self.pool.starts[rows] + first)[:, None] + np.arange(wide + self.length - 1)]
        unit, still = _unit(sliding_window_view(values, self.length, axis=1))
        return rows, unit, still.any(axis=1)

    def __iter__(self):
        """(rows, windows (rows, offsets, length), whether one of a row is constant); a long series comes in several pieces."""
        for k, piece in enumerate(self.pieces):
            found = self.kept[k] if self.kept is not None else None
            if found is None:
                found = self._piece(*piece)
                if self.kept is not None:
                    self.kept[k] = found
            yield found


def _unit(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Normalised rows of length 1 in single precision, and which of them are constant (all 0)."""
    normed = z_norm(rows)
    return (normed / rows.shape[-1] ** 0.5).astype(np.float32), ~normed.any(axis=-1)


def closest_correlations(candidates: np.ndarray, windows: UnitWindows, metric: str) -> np.ndarray:
    """Correlations (series, k) of raw candidates with their closest windows, off by at most ``correlation_error``; -2 without a window.

    For ``znorm`` it is the correlation that the distance stands for, 1 - square / 2l, so 1/2 if one side alone is constant.
    """
    own, flat = _unit(candidates)
    own = np.ascontiguousarray(own.T)
    k = own.shape[1]
    out = np.full((len(windows.pool), k), -2.0, np.float32)
    room = max(1, UNIT_CELLS // max(k, 1))  # windows whose products stay in a core's cache
    dots = np.empty((room, k), np.float32)
    for rows, held, still in windows:
        r, w, l = held.shape
        some, wide = max(1, room // w), min(w, room)
        top = np.full((r, k), -2.0, np.float32)
        for a in range(0, r, some):
            for b in range(0, w, wide):
                part = held[a:a + some, b:b + wide]
                few, n = part.shape[:2]
                np.matmul(part.reshape(-1, l), own, out=dots[:few * n])
                high = np.maximum.reduce(dots[:few * n].reshape(few, n, k), axis=1)
                np.maximum(top[a:a + some], high, out=top[a:a + some])
        if metric == "znorm":
            top[still] = np.maximum(top[still], 0.5)
            if flat.any():
                top[:, flat] = np.where(still, 1.0, 0.5)[:, None]
        out[rows] = np.maximum(out[rows], top)
    return out


def correlation_error(length: int) -> float:
    """What a correlation in single precision is off at most: its factors are rounded, and its terms summed in any order."""
    return 1.01 * (length + 4) * 2.0 ** -24


def _edges(n: int) -> np.ndarray:
    """Places in an order of n that cut it into parts of at most 255, which are smaller towards both ends."""
    left = [0]
    while left[-1] < n // 2:
        left.append(left[-1] + int(min(255, max(1, 0.8 * left[-1] ** 0.5))))
    left = np.array(left[:-1] + [n // 2])
    return np.unique(np.concatenate([left, n - left]))


def gain_limits(corr: np.ndarray, label: np.ndarray, classes: int, error: float, weight: np.ndarray | None = None) -> np.ndarray:
    """Upper bounds of the best information gain of each row of correlations (k, n) that are off by at most ``error``.

    The columns of a row are put in order. Where neighbours differ by more than their errors, the classes on both sides are
    known, and every split lies between two such places. -2 stands for columns that no split parts: infinitely far, or not numbers.
    """
    k, n = corr.shape
    total = np.bincount(label, weight, classes).astype(np.float64)
    edges = _edges(n)
    gap = int(np.ceil((2 * error + 2.0 ** -22) * UNIT_STEPS)) + 1
    # A step of the correlation and the class, or the column, in one number.
    kind, bits = (np.uint32, 8) if weight is None and classes <= 256 else (np.uint64, 32)
    tags, low = (label if weight is None else np.arange(n)).astype(kind), kind(2 ** bits - 1)
    look = np.minimum(edges[1:-1, None] + np.arange(-1, CLEAR_PLACES), n - 1)
    up = np.empty(k)
    step = max(1, BLOCK_CELLS // n)
    for a in range(0, k, step):
        part = np.empty((len(corr[a:a + step]), n), np.float32)
        for b in range(0, n, 256):  # the given rows may be columns in memory
            part[:, b:b + 256] = corr[a:a + step, b:b + 256]
        numbers = ~np.isnan(part)
        if not numbers.all():
            part = np.where(numbers, part, np.float32(-2.0))
        order = ((part + np.float32(2.0)) * np.float32(UNIT_STEPS)).astype(kind)
        order <<= kind(bits)
        order |= tags
        order.sort(axis=1)
        near = order[:, look]
        clear = (near[:, :, 1:] >> kind(bits)) - (near[:, :, :-1] >> kind(bits)) >= kind(gap)
        before = np.arange(CLEAR_PLACES) < clear.argmax(axis=2)[:, :, None]
        left = _class_counts(order & low, near[:, :, 1:] & low, before, edges, label, classes, weight)
        lost = ~clear.any(axis=2)
        if lost.any():  # then the part goes on to the next place that is known
            left[:, :, 1:-1] *= ~lost[:, None, :]
            np.maximum.accumulate(left, axis=2, out=left)
        far = part <= -1.5
        if far.any():
            ends = far @ ((label[:, None] == np.arange(classes)) * (1.0 if weight is None else weight[:, None]))
            np.maximum(left, ends[:, :, None], out=left)
        up[a:a + step] = np.where(numbers.any(axis=1), _box_gains(left, total).max(axis=1), -np.inf)
    return up


def _class_counts(of: np.ndarray, near: np.ndarray, before: np.ndarray, edges: np.ndarray, label: np.ndarray, classes: int,
                  weight: np.ndarray | None) -> np.ndarray:
    """Rows of every class (k, classes, edges) up to each edge and the marked places after it; ``of`` are classes or, with weights, columns."""
    left = np.zeros((len(of), classes, len(edges)))
    if weight is not None:
        for c in range(classes):
            own = np.where(label == c, weight, 0)
            left[:, c, 1:] = np.cumsum(np.add.reduceat(own[of], edges[:-1], axis=1), axis=1)
            left[:, c, 1:-1] += (own[near] * before).sum(axis=2)
        return left
    for first in range(0, classes, 8):  # eight counts in the bytes of a word
        # A shift by 64 or more, which classes below wrap to, gives 0.
        word, more = (np.left_shift(np.uint64(1), ((x - x.dtype.type(first)) << x.dtype.type(3)).astype(np.uint64)) for x in (of, near))
        inside, more = np.add.reduceat(word, edges[:-1], axis=1), (more * before).sum(axis=2)
        for c in range(min(8, classes - first)):
            byte = np.uint64(8 * c)
            np.cumsum((inside >> byte) & np.uint64(255), axis=1, out=left[:, first + c, 1:])
            left[:, first + c, 1:-1] += (more >> byte) & np.uint64(255)
    return left


def _box_gains(left: np.ndarray, total: np.ndarray) -> np.ndarray:
    """Bounds (k, parts) of the gain of splits whose class counts lie between those at both ends of a part; left is (k, classes, ends).

    The gain is convex in the counts: it is at most that of the lower end plus the steepest growth times the way. It is also at
    most what the rows before the part, those after it and each class inside it would tell.
    """
    size, right = total.sum(), total[None, :, None] - left
    prior = _n_log_n(size) - _n_log_n(total).sum()
    n_left = left.sum(axis=1)
    n_right = size - n_left
    log_left, log_right, log_nl, log_nr = (np.log(np.maximum(x, 1)) for x in (left, right, n_left, n_right))
    below, above = n_left * log_nl - (left * log_left).sum(axis=1), n_right * log_nr - (right * log_right).sum(axis=1)
    way = np.diff(left, axis=2)
    slope = np.minimum(log_left[:, :, 1:] - log_nl[:, None, :-1], 0.0) + np.maximum(log_nr[:, None, :-1] - log_right[:, :, 1:], 0.0)
    grown = prior - below[:, :-1] - above[:, :-1] + (np.maximum(slope, 0.0) * way).sum(axis=1)
    grown[((way > 0) & (right[:, :, 1:] == 0)).any(axis=1)] = np.inf
    return np.minimum(grown, prior - below[:, :-1] - above[:, 1:]) / size


def distance_histograms(dist: np.ndarray, label: np.ndarray, classes: int, largest: float, digits: int,
                        weight: np.ndarray | None = None) -> np.ndarray:
    """Counts (k, buckets, classes) of rounded distances; the last bucket holds what exceeds ``largest``, inf among them.

    A column counts ``weight`` times.
    """
    k, n = dist.shape
    bucket = np.minimum(np.round(dist, digits) * (BUCKETS / largest), BUCKETS).astype(np.int64)
    cell = (np.arange(k)[:, None] * (BUCKETS + 1) + bucket) * classes + label[None, :]
    times = None if weight is None else np.broadcast_to(weight, (k, n)).reshape(-1)
    counts = np.bincount(cell.reshape(-1), times, k * (BUCKETS + 1) * classes)
    return counts.astype(np.int64, copy=False).reshape(k, BUCKETS + 1, classes)


def _n_log_n(n: np.ndarray) -> np.ndarray:
    return n * np.log(np.maximum(n, 1))


def gain_bounds(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(low, up) of the best information gain of each histogram (k, buckets, classes) of class counts by distance.

    Between two buckets the counts on both sides are known, so those gains are reached. A split inside a bucket tells less
    than the parts left of it, right of it and each class inside it would, so that is an upper bound.
    """
    counts = counts.astype(np.float64)
    left = np.cumsum(counts, axis=1)
    total = left[:, -1:, :]
    n = total.sum(axis=2)

    def impurity(c):  # rows times entropy
        return _n_log_n(c.sum(axis=2)) - _n_log_n(c).sum(axis=2)

    prior, below, above = impurity(total), impurity(left), impurity(total - left)
    size = left.sum(axis=2)
    parted = (size > 0) & (size < n)
    low = np.where(parted, prior - below - above, -np.inf).max(axis=1) / np.maximum(n[:, 0], 1)
    before = np.concatenate([np.zeros_like(below[:, :1]), below[:, :-1]], axis=1)
    inside = np.where(counts.sum(axis=2) > 0, prior - before - above, -np.inf)
    return low, inside.max(axis=1) / np.maximum(n[:, 0], 1)
