"""Portfolio weights of one estimation window, in numpy. Used inside tasks, one group at a time."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping, Sequence
from dataclasses import dataclass
from functools import cached_property

import numpy as np

# Names of the methods as reports show them.
SUITE = ("Kelly 50%", "Mean Variance", "Minimum Variance", "Inverse Volatility", "CVaR Aware", "Black-Litterman")
NIGHTLY = ("score_weighted", "equal_weight", "minimum_variance", "inverse_volatility", "cvar", "kelly", "mean_variance", "black_litterman")
JITTER, TINY = 1e-10, 1e-8


@dataclass(frozen=True)
class OptimizerSettings:
    """Caps (None: no cap) and parameters of all methods."""

    max_weight: float | None = 0.12
    caps: tuple[tuple[str, float | None], ...] = ()
    kelly_fraction: float = 0.5
    risk_aversion: float = 8.0
    cvar_alpha: float = 0.95
    bl_tau: float = 0.05
    bl_prior_risk: float = 2.5
    bl_risk_aversion: float = 8.0
    iterations: int = 750
    cvar_iterations: int = 500

    def __post_init__(self) -> None:
        """Fractions and levels are brought into their range; where one is not finite, or a value has to be
        positive and is not, the default stands in."""
        for name, low, high in (("kelly_fraction", 0.0, 1.0), ("cvar_alpha", 0.5, 0.999)):
            given = float(getattr(self, name))
            object.__setattr__(self, name, min(max(given, low), high) if np.isfinite(given) else type(self).__dataclass_fields__[name].default)
        for name in ("risk_aversion", "bl_tau", "bl_prior_risk", "bl_risk_aversion"):
            if not float(getattr(self, name)) > 0:
                object.__setattr__(self, name, type(self).__dataclass_fields__[name].default)

    def cap(self, method: str) -> float | None:
        value = dict(self.caps).get(method, self.max_weight)
        return None if value is None else min(max(float(value), 0.0), 1.0)

    def parameters(self, method: str) -> str:
        """What a method of the suite is run with, in words."""
        said = {
            SUITE[0]: f"fraction {self.kelly_fraction:g}",
            SUITE[1]: f"risk aversion {self.risk_aversion:g}",
            SUITE[4]: f"tail level {self.cvar_alpha:g}",
            SUITE[5]: f"tau {self.bl_tau:g}, prior risk {self.bl_prior_risk:g}, risk aversion {self.bl_risk_aversion:g}",
        }
        return said.get(method, "")


def project_capped(v: np.ndarray, cap: float | None = None, total: float = 1.0) -> np.ndarray:
    """The nearest point with entries between 0 and ``cap`` that sum to ``total``, or to what the cap
    allows.

    That point is clip(v - t, 0, cap) for one t. As t falls, an entry starts to grow at v and stops
    at v - cap; between these places the sum is a line, so one sort of them and two running sums
    find the line on which it reaches the total.
    """
    v = np.asarray(v, float)
    total = max(float(total), 0.0)
    cap = total if cap is None else max(float(cap), 0.0)
    total = min(total, cap * len(v))
    if total <= 1e-12:
        return np.zeros(len(v))
    places = np.concatenate([v, v - cap])
    order = np.argsort(-places, kind="stable")
    places = places[order]
    growing = np.cumsum(np.where(order < len(v), 1, -1))
    reached = np.concatenate([[0.0], np.cumsum(growing[:-1] * (places[:-1] - places[1:]))])
    k = min(int(np.searchsorted(reached, total)), len(places) - 1)
    t = places[k] + (reached[k] - total) / max(growing[k - 1], 1)
    return np.clip(v - t, 0.0, cap)


def project_simplex(v: np.ndarray, total: float = 1.0) -> np.ndarray:
    """The nearest point with non-negative entries that sum to ``total``."""
    return project_capped(v, None, total)


def covariance(x: np.ndarray) -> np.ndarray:
    """Sample covariance of complete rows with a little added to the diagonal."""
    c = np.atleast_2d(np.cov(x, rowvar=False, ddof=1))
    return c + np.eye(len(c)) * max(np.trace(c) / max(len(c), 1) * 1e-8, JITTER)


def winsorized_mean(x: np.ndarray, tail: float = 0.02) -> np.ndarray:
    low, high = np.quantile(x, [tail, 1 - tail], axis=0)
    return np.clip(x, low, high).mean(axis=0)


def _descend(w: np.ndarray, slope: Callable[[np.ndarray], np.ndarray], steps: Iterable[float], cap: float | None) -> np.ndarray:
    """Projected steps down a slope."""
    for step in steps:
        w = project_capped(w - step * slope(w), cap)
    return w


def _equal(n: int) -> np.ndarray:
    return np.full(n, 1.0 / n)


def _symmetric(c: np.ndarray) -> tuple[np.ndarray, float]:
    c = (c + c.T) / 2 + np.eye(len(c)) * JITTER
    return c, max(float(np.linalg.eigvalsh(c)[-1]), TINY)


def mean_variance(mu: np.ndarray, cov: np.ndarray, risk: float = 8.0, cap: float | None = None, iterations: int = 750) -> np.ndarray:
    """Projected gradient of risk / 2 w'Cw - mu'w from equal weights."""
    c, top = _symmetric(cov)
    return _descend(_equal(len(mu)), lambda w: risk * c @ w - mu, [1 / (risk * top + TINY)] * iterations, cap)


def minimum_variance(cov: np.ndarray, cap: float | None = None, iterations: int = 750) -> np.ndarray:
    c, top = _symmetric(cov)
    return _descend(_equal(len(c)), lambda w: 2 * c @ w, [1 / (2 * top + TINY)] * iterations, cap)


def inverse_volatility(cov: np.ndarray, cap: float | None = None) -> np.ndarray:
    return project_capped(1 / np.sqrt(np.maximum(np.diag(cov), 1e-12)), cap)


def kelly(mu: np.ndarray, cov: np.ndarray, fraction: float = 0.5, cap: float | None = None, iterations: int = 750) -> np.ndarray:
    """The positive part of the growth-optimal weights, brought to a sum of ``fraction``; minimum
    variance where nothing is positive."""
    c, _ = _symmetric(cov)
    raw = np.maximum(np.linalg.pinv(c) @ mu, 0.0)
    if raw.sum() <= 0:
        return minimum_variance(c, cap, iterations)
    return project_capped(raw, cap, min(max(fraction, 0.0), 1.0))


def min_cvar(x: np.ndarray, cov: np.ndarray, alpha: float = 0.95, cap: float | None = None, iterations: int = 500) -> np.ndarray:
    """Subgradient steps on the mean of the worst returns, from inverse volatility. The worst are those
    up to the quantile, interpolated between ranks; the lowest return is always one of them."""
    place = (1 - alpha) * (len(x) - 1)
    below, part = int(place), place - int(place)
    ranks = [below, min(below + 1, len(x) - 1)]

    def slope(w: np.ndarray) -> np.ndarray:
        r = x @ w
        low, high = np.partition(r, ranks)[ranks]
        return -x[r <= low + part * (high - low)].mean(axis=0)

    return _descend(inverse_volatility(cov, cap), slope, 0.15 / np.sqrt(np.arange(1, iterations + 1)), cap)


def black_litterman(cov: np.ndarray, market: np.ndarray | None = None, views: Sequence[tuple[Mapping[int, float], float]] = (), tau: float = 0.05, risk: float = 2.5) -> np.ndarray:
    """Expected returns implied by the market weights, moved by views: each a row of weights by
    position and its return."""
    n = len(cov)
    market = _equal(n) if market is None else project_simplex(market)
    prior = risk * cov @ market
    rows = [(p, q) for view, q in views if np.abs(p := np.array([view.get(i, 0.0) for i in range(n)])).sum() > 0]
    if not rows:
        return prior
    p, q = np.array([r[0] for r in rows]), np.array([r[1] for r in rows])
    sure = np.linalg.pinv(tau * cov)
    doubt = np.diag(1 / np.maximum(np.diag(p @ (tau * cov) @ p.T), TINY))
    return np.linalg.pinv(sure + p.T @ doubt @ p) @ (sure @ prior + p.T @ doubt @ q)


class Estimates:
    """Complete rows of returns, and the moments that methods share, each worked out once."""

    def __init__(self, x: np.ndarray):
        self.x = x

    @cached_property
    def cov(self) -> np.ndarray:
        return covariance(self.x)

    @cached_property
    def mu(self) -> np.ndarray:
        return winsorized_mean(self.x)


def suite_weights(given: Estimates | np.ndarray, method: str, s: OptimizerSettings) -> np.ndarray:
    """Weights of one method of the suite from complete rows of returns."""
    e = given if isinstance(given, Estimates) else Estimates(given)
    cap = s.cap(method)
    if method == "Kelly 50%":
        return kelly(e.mu, e.cov, s.kelly_fraction, cap)
    if method == "Mean Variance":
        return mean_variance(e.mu, e.cov, s.risk_aversion, cap, s.iterations)
    if method == "Minimum Variance":
        return minimum_variance(e.cov, cap, s.iterations)
    if method == "Inverse Volatility":
        return inverse_volatility(e.cov, cap)
    if method == "CVaR Aware":
        return min_cvar(e.x, e.cov, s.cvar_alpha, cap, s.cvar_iterations)
    if method == "Black-Litterman":
        return mean_variance(black_litterman(e.cov, tau=s.bl_tau, risk=s.bl_prior_risk), e.cov, s.bl_risk_aversion, cap, s.iterations)
    raise ValueError(f"unknown method {method}")


SUITE_NAME = {"kelly": SUITE[0], "mean_variance": SUITE[1], "minimum_variance": SUITE[2], "inverse_volatility": SUITE[3], "cvar": SUITE[4], "black_litterman": SUITE[5]}


def nightly_weights(given: Estimates | np.ndarray, scores: np.ndarray, method: str, s: OptimizerSettings, least_rows: int) -> tuple[np.ndarray, bool]:
    """Weights of one night's book, and whether the window was too short and scores stood in."""
    if method not in NIGHTLY:
        raise ValueError(f"unknown method {method}")
    e = given if isinstance(given, Estimates) else Estimates(given)
    short = len(e.x) < least_rows
    if method == "equal_weight" and not short:
        return project_capped(np.ones(len(scores)), s.max_weight), False
    if method == "score_weighted" or short:
        v = np.maximum(scores, 0.0)
        return project_capped(v if v.sum() > 0 else np.ones(len(v)), s.max_weight), short and method != "score_weighted"
    return suite_weights(e, SUITE_NAME[method], s), False
