"""Multinomial logistic regression pieces: sums over a block of rows, and a minimiser.

The objective is 0.5 * |W|^2 + sum of losses, intercepts not penalised. The minimiser is
a generator that asks for one evaluation at a time, so many models can share a data pass.
"""

from __future__ import annotations

import numpy as np


def softmax_sums(x: np.ndarray, y: np.ndarray, w: np.ndarray):
    """Loss, gradient (classes, d + 1; intercept first) and hits over the rows of x."""
    z = x @ w[:, 1:].T + w[:, 0]
    z -= z.max(axis=1, keepdims=True)
    e = np.exp(z)
    s = e.sum(axis=1)
    rows = np.arange(len(y))
    hits = float((z.argmax(axis=1) == y).sum())
    loss = float((np.log(s) - z[rows, y]).sum())
    r = e / s[:, None]
    r[rows, y] -= 1.0
    return loss, np.hstack([r.sum(axis=0)[:, None], r.T @ x]), hits


def gram(x: np.ndarray) -> np.ndarray:
    """Moment matrix of the rows with a leading 1."""
    x1 = np.hstack([np.ones((len(x), 1)), x])
    return x1.T @ x1


def penalised(loss, grad, w):
    g = grad.copy()
    g[:, 1:] += w[:, 1:]
    return loss + 0.5 * float((w[:, 1:] ** 2).sum()), g


def minimise(classes: int, moments: np.ndarray, tol: float = 1e-4, max_passes: int = 100, memory: int = 10):
    """Limited-memory quasi-Newton steps; yields weights, receives (loss, grad), returns whether they settled.

    Starts from the curvature bound 0.5 * moments + penalty, which makes the step scale-free.
    """
    d1 = len(moments)
    curve = 0.5 * moments + np.diag([1e-8 * max(moments[0, 0], 1.0)] + [1.0] * (d1 - 1))
    factor = np.linalg.cholesky(curve + 1e-12 * np.trace(curve) / d1 * np.eye(d1))

    def base(g):
        return np.linalg.solve(factor.T, np.linalg.solve(factor, g.T)).T

    w = np.zeros((classes, d1))
    f, g = yield w
    pairs: list = []
    passes = 1
    while np.abs(g).max() > tol:
        if passes >= max_passes:
            return False
        q, used = g.copy(), []
        for s, y, rho in reversed(pairs):
            a = rho * float((s * q).sum())
            used.append(a)
            q -= a * y
        step = base(q)
        for (s, y, rho), a in zip(pairs, reversed(used)):
            step += (a - rho * float((y * step).sum())) * s
        slope = -float((step * g).sum())
        if slope >= 0:
            step, pairs = base(g), []
            slope = -float((step * g).sum())
        t, moved = 1.0, False
        while passes < max_passes and t > 1e-6:
            trial = w - t * step
            ft, gt = yield trial
            passes += 1
            if ft <= f + 1e-4 * t * slope + 1e-12 * abs(f):
                moved = True
                break
            t *= 0.3
        if not moved:
            return passes < max_passes  # no better point along the step: as near as doubles tell
        s, y = trial - w, gt - g
        sy = float((s * y).sum())
        if sy > 1e-12:
            pairs = (pairs + [(s, y, 1.0 / sy)])[-memory:]
        done = f - ft <= 2.2e-9 * max(abs(f), abs(ft), 1.0)
        w, f, g = trial, ft, gt
        if done:
            break
    return True


def fit_many(problems: dict, evaluate, classes: int, tol: float, max_passes: int) -> dict:
    """Fit all problems together: one call of ``evaluate`` per round for those still open.

    problems: id -> moment matrix. evaluate: {id: weights} -> {id: (loss, grad, hits)}.
    Returns id -> (weights, loss, hits, passes, converged) at the best point.
    """
    runs, asks, last, passes, settled = {}, {}, {}, dict.fromkeys(problems, 0), {}
    for key, moments in problems.items():
        runs[key] = minimise(classes, moments, tol, max_passes)
        asks[key] = next(runs[key])
    while asks:
        sums = evaluate(asks)
        nxt = {}
        for key, w in asks.items():
            loss, grad, hits = sums[key]
            passes[key] += 1
            if key not in last or penalised(loss, grad, w)[0] <= last[key][3]:
                last[key] = (w, loss, hits, penalised(loss, grad, w)[0])
            try:
                nxt[key] = runs[key].send(penalised(loss, grad, w))
            except StopIteration as end:
                settled[key] = bool(end.value)
        asks = nxt
    return {key: (*value[:3], passes[key], settled[key]) for key, value in last.items()}
