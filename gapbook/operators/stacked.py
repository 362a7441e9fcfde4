"""The optimizers for many windows at once: stacks of equal numbers of symbols, all steps in one.

Returns are ``x`` (windows, dates, symbols) with ``whole`` (windows, dates) where a date counts. Results
are those of ``optimizers``, window by window.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

import numpy as np

from gapbook.operators import optimizers as opt


def project_capped(v: np.ndarray, cap: float | None = None, total: np.ndarray | float = 1.0) -> np.ndarray:
    """Each row's nearest point with entries between 0 and ``cap`` that sum to its total, or to what the cap
    allows: the sum of clip(v - t, 0, cap) is a line in t between the places where an entry starts or
    stops to grow, and is worked out at all of these."""
    n = v.shape[1]
    total = np.broadcast_to(np.maximum(total, 0.0), len(v)).astype(float)
    caps = np.maximum(total if cap is None else np.full(len(v), float(cap)), 0.0)[:, None]
    total = np.minimum(total, caps[:, 0] * n)[:, None]
    places = np.concatenate([v, v - caps], axis=1)
    sums = np.clip(v[:, None, :] - places[:, :, None], 0.0, caps[:, :, None]).sum(axis=2)
    low = np.where(sums >= total, places, -np.inf).argmax(axis=1)[:, None]
    high = np.where(sums <= total, places, np.inf).argmin(axis=1)[:, None]
    a, b, fa, fb = (np.take_along_axis(m, k, 1) for m, k in ((places, low), (places, high), (sums, low), (sums, high)))
    falls = fa > fb
    t = np.where(falls, a + (fa - total) / np.where(falls, fa - fb, 1.0) * (b - a), a)
    # where even the lowest place sums to less by rounding, all entries stand at the cap
    t = np.where((sums >= total).any(axis=1)[:, None], t, places.min(axis=1, keepdims=True))
    return np.where(total > 1e-12, np.clip(v - t, 0.0, caps), 0.0)


class Windows:
    """Moments of a stack of windows."""

    def __init__(self, x: np.ndarray, whole: np.ndarray):
        self.whole, self.rows = whole, whole.sum(axis=1)
        self.x = np.where(whole[:, :, None], x, 0.0)
        self.m, self.n = x.shape[0], x.shape[2]
        n = np.maximum(self.rows, 1)[:, None]
        centred = np.where(whole[:, :, None], self.x - self.x.sum(axis=1, keepdims=True) / n[:, :, None], 0.0)
        cov = centred.transpose(0, 2, 1) @ centred / np.maximum(self.rows - 1, 1)[:, None, None]
        self.eye = np.eye(self.n)
        extra = np.maximum(np.trace(cov, axis1=1, axis2=2) / self.n * 1e-8, opt.JITTER)
        self.cov = cov + extra[:, None, None] * self.eye
        self.firm = (self.cov + self.cov.transpose(0, 2, 1)) / 2 + self.eye * opt.JITTER
        self.top = np.maximum(np.linalg.eigvalsh(self.firm)[:, -1], opt.TINY)

    def at_rank(self, values: np.ndarray, place: np.ndarray) -> np.ndarray:
        """Along dates, the values at a place between ranks of each window; ``values`` are sorted with those
        that do not count last."""
        below = place.astype(np.int64)
        shape = (-1, 1) if values.ndim == 2 else (-1, 1, 1)
        low, high = (np.take_along_axis(values, np.clip(k, 0, np.maximum(self.rows - 1, 0)).reshape(shape), 1)[:, 0] for k in (below, below + 1))
        low, high = (np.where(np.isinf(v), 0.0, v) for v in (low, high))  # a window without dates
        part = (place - below).reshape(shape[:-1])
        return low + part * (high - low)

    def winsorized_mean(self, tail: float = 0.02) -> np.ndarray:
        ordered = np.sort(np.where(self.whole[:, :, None], self.x, np.inf), axis=1)
        last = np.maximum(self.rows - 1, 0)
        low, high = self.at_rank(ordered, tail * last), self.at_rank(ordered, (1 - tail) * last)
        clipped = np.clip(self.x, low[:, None, :], high[:, None, :]) * self.whole[:, :, None]
        return clipped.sum(axis=1) / np.maximum(self.rows, 1)[:, None]

    def even(self) -> np.ndarray:
        return np.full((self.m, self.n), 1.0 / self.n)


def _descend(w: np.ndarray, slope: Callable[[np.ndarray], np.ndarray], steps: Iterable[np.ndarray | float], cap: float | None) -> np.ndarray:
    for step in steps:
        w = project_capped(w - step * slope(w), cap)
    return w


def _quadratic(windows: Windows, a: float, b: np.ndarray, cap: float | None, iterations: int) -> np.ndarray:
    """Projected steps down a / 2 w'Cw - b'w from equal weights."""
    step = (1 / (a * windows.top + opt.TINY))[:, None]
    return _descend(windows.even(), lambda w: a * (windows.firm @ w[:, :, None])[:, :, 0] - b, [step] * iterations, cap)


def inverse_volatility(windows: Windows, cap: float | None) -> np.ndarray:
    return project_capped(1 / np.sqrt(np.maximum(np.diagonal(windows.cov, axis1=1, axis2=2), 1e-12)), cap)


def min_cvar(windows: Windows, alpha: float, cap: float | None, iterations: int) -> np.ndarray:
    place = (1 - alpha) * np.maximum(windows.rows - 1, 0)

    def slope(w: np.ndarray) -> np.ndarray:
        r = np.where(windows.whole, (windows.x @ w[:, :, None])[:, :, 0], np.inf)
        worst = r <= windows.at_rank(np.sort(r, axis=1), place)[:, None]
        worst &= windows.whole
        total = (worst[:, None, :].astype(float) @ windows.x)[:, 0]
        return -total / np.maximum(worst.sum(axis=1), 1)[:, None]

    return _descend(inverse_volatility(windows, cap), slope, 0.15 / np.sqrt(np.arange(1, iterations + 1)), cap)


def suite_weights(windows: Windows, method: str, s: opt.OptimizerSettings) -> np.ndarray:
    """Weights of one method of the suite for all windows."""
    cap, zero = s.cap(method), np.zeros((windows.m, windows.n))
    if method == "Kelly 50%":
        mu = windows.winsorized_mean()
        raw = np.maximum((np.linalg.pinv(windows.firm) @ mu[:, :, None])[:, :, 0], 0.0)
        out = project_capped(raw, cap, s.kelly_fraction)
        for k in np.flatnonzero(raw.sum(axis=1) <= 0):
            out[k] = opt.minimum_variance(windows.firm[k], cap)
        return out
    if method == "Mean Variance":
        return _quadratic(windows, s.risk_aversion, windows.winsorized_mean(), cap, s.iterations)
    if method == "Minimum Variance":
        return _quadratic(windows, 2.0, zero, cap, s.iterations)
    if method == "Inverse Volatility":
        return inverse_volatility(windows, cap)
    if method == "CVaR Aware":
        return min_cvar(windows, s.cvar_alpha, cap, s.cvar_iterations)
    if method == "Black-Litterman":
        prior = s.bl_prior_risk * windows.cov.sum(axis=2) / windows.n
        return _quadratic(windows, s.bl_risk_aversion, prior, cap, s.iterations)
    raise ValueError(f"unknown method {method}")


def nightly_weights(windows: Windows, scores: np.ndarray, method: str, s: opt.OptimizerSettings, least_rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Weights of each night's book, and the nights whose window was too short, where scores stood in."""
    if method not in opt.NIGHTLY:
        raise ValueError(f"unknown method {method}")
    short = windows.rows < least_rows
    v = np.maximum(scores, 0.0)
    by_score = project_capped(np.where(v.sum(axis=1, keepdims=True) > 0, v, 1.0), s.max_weight)
    if method == "score_weighted":
        return by_score, np.zeros(len(v), bool)
    if method == "equal_weight":
        own = project_capped(np.ones_like(v), s.max_weight)
    else:
        own = suite_weights(windows, opt.SUITE_NAME[method], s)
    return np.where(short[:, None], by_score, own), short
