"""Weights of universes too wide for one task: blocks of moments against numpy on whole matrices."""

import numpy as np
import pandas as pd
import pytest

from gapbook.operators import optimizers as opt
from gapbook.operators import portfolio as pf
from gapbook.operators import solver

SETTINGS = opt.OptimizerSettings(max_weight=0.3, iterations=12, cvar_iterations=6)


def frame(spark, x):
    days = [d.date() for d in pd.bdate_range("2020-01-01", periods=len(x))]
    rows = [(d, f"S{j:02d}", float(v)) for d, row in zip(days, x, strict=True) for j, v in enumerate(row)]
    return spark.createDataFrame(rows, "date date, symbol string, ret double")


def correlated(rng, days, symbols, drift=0.0005):
    common = rng.normal(0, 0.01, (days, 1))
    return drift + common * rng.uniform(0.5, 1.5, symbols) + rng.normal(0, 0.01, (days, symbols)) * rng.uniform(0.5, 2, symbols)


@pytest.fixture(scope="module")
def returns():
    return correlated(np.random.default_rng(11), 90, 7)


@pytest.fixture(scope="module")
def blocks(spark, returns):
    """Stripes of two rows, blocks of two dates."""
    complete = frame(spark, returns)
    made = solver.Blocks(complete, pf.covariance_blocks(complete, block=3), pf.expected_returns(complete, "winsorized"), cells=16)
    yield made
    made.close()


def test_blocks_hold_the_moments(blocks, returns):
    c, w = opt.covariance(returns), np.random.default_rng(1).random((7, 3))
    assert blocks.stripes.count() == 4 and blocks.returns.count() == 45
    assert np.allclose(blocks.product(w), c @ w, rtol=1e-12, atol=1e-16)
    assert np.allclose(blocks.product(w[:, 0]), c @ w[:, 0], rtol=1e-12, atol=1e-16)
    assert np.allclose(blocks.diagonal, np.diag(c), rtol=1e-12) and np.allclose(blocks.mu, opt.winsorized_mean(returns), rtol=1e-12)
    r = returns @ w[:, 0]
    assert np.allclose(blocks.portfolio(w[:, 0]), r) and np.allclose(blocks.mean_of(w[:, 0], np.median(r)), returns[r <= np.median(r)].mean(axis=0))


def test_all_methods_equal_whole_matrices(blocks, returns):
    found = solver.suite_weights(blocks, SETTINGS)
    assert set(found) == set(opt.SUITE)
    for method, w in found.items():
        assert np.allclose(w, opt.suite_weights(returns, method, SETTINGS), atol=1e-8), method


def test_a_set_beyond_one_task_has_the_same_weights(spark, returns):
    methods = ("Minimum Variance", "Kelly 50%", "CVaR Aware")
    complete = frame(spark, returns)
    small = {(r.portfolio, r.symbol): r.weight for r in pf.suite_weights(complete, SETTINGS, methods).collect()}
    large = {(r.portfolio, r.symbol): r.weight for r in pf.suite_weights(complete, SETTINGS, methods, task_cells=100).collect()}
    assert set(small) == set(large) and all(abs(small[k] - large[k]) < 1e-8 for k in small)


def test_kelly_of_singular_covariances_and_without_growth(spark):
    """Fewer dates than symbols; and losses everywhere, where minimum variance stands in."""
    rng = np.random.default_rng(3)
    few, losing = correlated(rng, 5, 8), correlated(rng, 60, 3, drift=-0.05)
    s = opt.OptimizerSettings(max_weight=0.4, iterations=5)
    c, _ = opt._symmetric(opt.covariance(few))
    mu = opt.winsorized_mean(few)
    raw = solver.solved(lambda w: c @ w, np.diag(c), mu)
    assert np.allclose(c @ raw, mu, rtol=1e-6, atol=1e-12)
    assert np.allclose(opt.project_capped(np.maximum(raw, 0), 0.4, 0.5), opt.kelly(mu, opt.covariance(few), 0.5, 0.4), atol=1e-6)
    c, _ = opt._symmetric(opt.covariance(losing))
    c = (c + c.T) / 2
    mu = opt.winsorized_mean(losing)
    if (np.linalg.solve(c, mu) <= 0).all():
        weights = solver._descents(lambda w: c @ w + opt.JITTER * w, solver.greatest_eigenvalue(lambda w: c @ w, 3) + opt.JITTER, {"Kelly 50%": (2.0, np.zeros(3))}, s, 750)
        assert np.allclose(weights["Kelly 50%"], opt.kelly(mu, opt.covariance(losing), 0.5, 0.12 if s.max_weight is None else 0.4), atol=1e-8)


@pytest.mark.parametrize("n", [1, 2, 9, 60])
def test_eigenvalues_and_systems(n):
    rng = np.random.default_rng(n)
    a = rng.normal(size=(n, 2 * n))
    for c in (a @ a.T, np.eye(n), np.diag(np.r_[np.full(n - n // 2, 3.0), np.full(n // 2, 1e-6)])):
        assert solver.greatest_eigenvalue(lambda w, c=c: c @ w, n) == pytest.approx(np.linalg.eigvalsh(c)[-1], rel=1e-10)
        b = rng.normal(size=n)
        assert np.allclose(solver.solved(lambda w, c=c: c @ w, np.diag(c), b), np.linalg.solve(c, b), rtol=1e-6, atol=1e-9)


def test_parameters_out_of_range_stand_for_defaults():
    s = opt.OptimizerSettings(risk_aversion=0.0, bl_tau=-1.0, bl_prior_risk=float("nan"), bl_risk_aversion=3.0, kelly_fraction=7, cvar_alpha=0.1)
    assert opt.OptimizerSettings(kelly_fraction=float("nan")).kelly_fraction == 0.5
    assert (s.risk_aversion, s.bl_tau, s.bl_prior_risk, s.bl_risk_aversion) == (8.0, 0.05, 2.5, 3.0)
    assert (s.kelly_fraction, s.cvar_alpha) == (1.0, 0.5)


def test_views_move_returns_by_the_known_formula(returns):
    """The posterior in its other form, with one inverse of the views' size."""
    c, tau, market = opt.covariance(returns), 0.05, np.array([3.0, 1, 1, 1, 1, 2, 1]) / 10
    p, q = np.array([[1.0, -1, 0, 0, 0, 0, 0], [0, 0, 0.5, 0.5, 0, 0, -1]]), np.array([0.01, -0.02])
    views = [({0: 1.0, 1: -1.0}, 0.01), ({2: 0.5, 3: 0.5, 6: -1.0}, -0.02), ({}, 0.3)]
    prior = 2.5 * c @ market
    doubt = np.diag(np.diag(p @ (tau * c) @ p.T))
    doubt = np.maximum(doubt, np.eye(2) * opt.TINY)
    expected = prior + tau * c @ p.T @ np.linalg.solve(p @ (tau * c) @ p.T + doubt, q - p @ prior)
    assert np.allclose(opt.black_litterman(c, market, views, tau, 2.5), expected, rtol=1e-6)
    assert np.allclose(opt.black_litterman(c, market, (), tau, 2.5), prior)


def test_descents_end_where_no_step_helps(returns):
    """At the end a step down the gradient, projected, leaves the weights: they are optimal."""
    c, mu = opt.covariance(returns), opt.winsorized_mean(returns)
    for w, slope, a in ((opt.mean_variance(mu, c, 8.0, 0.3, 4000), lambda w: 8 * c @ w - mu, 8), (opt.minimum_variance(c, 0.3, 4000), lambda w: 2 * c @ w, 2)):
        step = 1 / (a * np.linalg.eigvalsh(c)[-1])
        assert np.abs(opt.project_capped(w - step * slope(w), 0.3) - w).max() < 1e-7
