"""Quantiles by refined histograms against numpy on whole groups."""

import numpy as np
import pytest

from gapbook.operators import metrics as mx
from gapbook.operators import portfolio as pf
from gapbook.operators.quantiles import exact_quantiles

SHARES = (0.0, 0.02, 1 / 3, 0.5, 0.95, 1.0)


@pytest.mark.parametrize("buffer", [1, 7, 10_000])
def test_quantiles_equal_numpy(spark, buffer):
    """Normal values, one value many times, far outliers, few values, and a null key."""
    rng = np.random.default_rng(1)
    groups = {
        "normal": rng.normal(size=400),
        "alike": np.r_[np.zeros(300), rng.normal(size=20)],
        "wide": np.r_[-1e300, 1e300, 10.0 ** rng.uniform(-200, 200, 60)],
        "two": np.array([1.0, 2.0]),
        "one": np.array([-3.5]),
        None: rng.integers(0, 4, 200).astype(float),
    }
    rows = [(k, float(v)) for k, own in groups.items() for v in own] + [("none", None), ("none", float("nan")), ("two", None)]
    found = exact_quantiles(spark.createDataFrame(rows, "k string, v double").repartition(3), "v", SHARES, ["k"], buffer).collect()
    assert len(found) == len(groups) * len(SHARES)
    for r in found:
        assert r.quantile == pytest.approx(np.quantile(groups[r.k], r.share), rel=1e-12, abs=1e-15), (r.k, r.share)


def test_whole_table_and_empty(spark):
    values = np.random.default_rng(2).exponential(size=1000)
    frame = spark.createDataFrame([(float(v),) for v in values], "v double")
    found = {r.share: r.quantile for r in exact_quantiles(frame, "v", SHARES, buffer=16).collect()}
    assert all(found[s] == pytest.approx(np.quantile(values, s), rel=1e-12) for s in SHARES)
    assert exact_quantiles(frame.limit(0), "v", SHARES).count() == 0


def test_operators_with_a_buffer(spark):
    rng = np.random.default_rng(3)
    rows = [(s, float(v)) for s in "AB" for v in rng.normal(0.001, 0.01, 150)]
    frame = spark.createDataFrame(rows, "symbol string, ret double")
    for method in ("median", "winsorized"):
        plain, held = ({r.symbol: r.mu for r in pf.expected_returns(frame, method, buffer=b).collect()} for b in (None, 20))
        assert plain == pytest.approx(held, rel=1e-12)
    plain, held = ({r.symbol: (r["var"], r.cvar) for r in mx.var_cvar(frame, "ret", 0.9, ["symbol"], buffer=b).collect()} for b in (None, 20))
    assert all(plain[s] == pytest.approx(held[s], rel=1e-12) for s in "AB")
