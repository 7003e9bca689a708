"""Plain loops that state the definitions; used on small inputs only."""

import math
from collections import Counter

import numpy as np


def z_norm(x):
    x = np.asarray(x, float)
    if x.max() == x.min():
        return np.zeros(len(x))
    return (x - x.mean()) / x.std()


def sliding(x, s, metric="raw", on_short="inf"):
    """(dist, first offset)"""
    x, s = np.asarray(x, float), np.asarray(s, float)
    if len(s) > len(x):
        if on_short == "inf":
            return np.inf, 0
        x, s = s, x
    best, pos = np.inf, 0
    for k in range(len(x) - len(s) + 1):
        w = x[k:k + len(s)]
        if metric == "raw":
            d = math.sqrt(((w - s) ** 2).sum())
        elif metric == "znorm":
            d = math.sqrt(((z_norm(w) - z_norm(s)) ** 2).sum())
        else:
            corr = min(1.0, float(z_norm(w) @ z_norm(s)) / len(s))
            d = math.sqrt(2 * (1 - corr))
        if d < best - 1e-12:
            best, pos = d, k
    return best, pos


def entropy(labels):
    n = len(labels)
    return -sum(c / n * math.log(c / n) for c in Counter(labels).values())


def best_split(pairs):
    """(gain, gap, threshold) of (dist, label) pairs."""
    pairs = sorted(pairs, key=lambda p: p[0])
    prior, n = entropy([l for _, l in pairs]), len(pairs)
    best = (-math.inf, -math.inf, None)
    for k in range(n - 1):
        if pairs[k][0] == pairs[k + 1][0]:
            continue
        left, right = pairs[:k + 1], pairs[k + 1:]
        gain = prior - len(left) / n * entropy([l for _, l in left]) - len(right) / n * entropy([l for _, l in right])
        gap = np.mean([d for d, _ in right]) - np.mean([d for d, _ in left])
        if (round(gain, 9), round(gap, 9)) > (round(best[0], 9), round(best[1], 9)):
            best = (gain, gap, (pairs[k][0] + pairs[k + 1][0]) / 2)
    return best
