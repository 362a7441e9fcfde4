"""The optimizers of many windows at once against those of one window."""

import numpy as np
import pytest

from gapbook.operators import optimizers as opt
from gapbook.operators import stacked


@pytest.mark.parametrize("cap", [None, 0.05, 0.3, 1.0])
def test_projections_equal_single_ones(cap):
    rng = np.random.default_rng(1)
    v = np.concatenate([rng.normal(size=(200, 6)), np.ones((1, 6)), np.zeros((1, 6)), np.full((1, 6), 1 / 6), np.eye(6)[:2] * 5])
    for total in (1.0, 0.5, 0.0):
        got = stacked.project_capped(v, cap, total)
        assert np.allclose(got, [opt.project_capped(r, cap, total) for r in v], atol=1e-12)
    assert np.allclose(stacked.project_capped(v, cap, np.linspace(0, 1, len(v))), [opt.project_capped(r, cap, t) for r, t in zip(v, np.linspace(0, 1, len(v)), strict=True)], atol=1e-12)


@pytest.mark.parametrize("n", [1, 2, 8])
def test_nights_equal_single_windows(n):
    """Windows of many lengths, some too short, some without growth; scores with and without a positive one."""
    rng = np.random.default_rng(n)
    rows = [0, 1, 2, 19, 20, 21, 40, 63, 63, 63]
    x = np.full((len(rows), 63, n), np.nan)
    for k, t in enumerate(rows):
        at = np.sort(rng.permutation(63)[:t])
        x[k, at] = rng.normal(-0.02 if k == 8 else 0.001, 0.01, (t, n)) * rng.uniform(0.5, 2, n)
    scores = rng.normal(size=(len(rows), n))
    scores[3] = -1.0
    s = opt.OptimizerSettings(max_weight=0.4, iterations=25, cvar_iterations=25)
    windows = stacked.Windows(x, ~np.isnan(x).any(axis=2))
    for method in opt.NIGHTLY:
        w, short = stacked.nightly_weights(windows, scores, method, s, 20)
        for k in range(len(rows)):
            own = x[k][~np.isnan(x[k]).any(axis=1)]
            expected, fell_back = opt.nightly_weights(own, scores[k], method, s, 20)
            assert short[k] == fell_back and np.allclose(w[k], expected, atol=1e-9), (method, k)
    with pytest.raises(ValueError, match="unknown method"):
        stacked.nightly_weights(windows, scores, "none", s, 20)
