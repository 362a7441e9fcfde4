"""Limited runs folded in blocks of days against the fold of whole runs."""

import datetime as dt

import numpy as np
import pytest

from gapbook.operators import backtest as bt
from gapbook.operators.costs import CostSettings


@pytest.fixture(scope="module")
def signals(spark):
    """Three runs: one grows into its limits, one loses, one has a single day."""
    rng = np.random.default_rng(9)
    rows = []
    for run, n, drift in (("up", 240, 0.01), ("down", 90, -0.01), ("day", 1, 0.0)):
        for k in range(n):
            day = dt.date(2001, 1, 1) + dt.timedelta(k)
            for j in range(4):
                rows.append((run, day, day + dt.timedelta(1), f"S{j}", j + 1, 0.25, float(rng.normal(drift, 0.02)), float(rng.uniform(1e6, 6e7))))
    return spark.createDataFrame(rows, "run string, signal_date date, exit_date date, symbol string, signal_rank int, weight double, next_overnight_return double, adv_dollars double")


@pytest.mark.parametrize("block", [1, 7, 60, 1000])
@pytest.mark.parametrize("limits", [{"capital_capacity": 1_400_000.0, "cash_rate": 0.05}, {"max_adv_participation": 0.02}, {"capital_capacity": 3e6, "max_adv_participation": 0.01, "cash_rate": 0.02}])
def test_blocks_equal_whole_runs(signals, limits, block):
    s = bt.BacktestSettings(1_000_000.0, CostSettings("historical"), **limits)
    rows = signals if block != 1 else signals.where("signal_date < date'2001-01-15'")
    whole, blocks = (
        {(r.run, r.signal_date): r for r in bt.run_backtest(rows, s, ["run"], block_days=b).collect()} for b in (None, block)
    )
    assert whole.keys() == blocks.keys()
    for k, r in whole.items():
        assert all(x == y if not isinstance(x, float) else x == pytest.approx(y, rel=1e-10, abs=1e-12) for x, y in zip(r, blocks[k], strict=True)), k


def test_slopes_tell_how_ends_move(signals):
    s = bt.BacktestSettings(1_000_000.0, CostSettings("historical"), capital_capacity=1_400_000.0, max_adv_participation=0.02, cash_rate=0.05)
    rows = bt.with_cost_rate(bt.clean_signals(signals.where("run = 'up'"), ["run"]), s.costs).toPandas()
    for start in (200_000.0, 1_000_000.0, 5_000_000.0):
        (a, slope), (b, _) = bt.fold_days(rows, s, start), bt.fold_days(rows, s, start + 1e-3)
        assert (b["ending_equity"].iloc[-1] - a["ending_equity"].iloc[-1]) / 1e-3 == pytest.approx(slope, rel=1e-4)


def test_one_run_without_a_name(signals):
    s = bt.BacktestSettings(1_000_000.0, CostSettings(), capital_capacity=1_400_000.0)
    rows = signals.where("run = 'down'").drop("run")
    whole, blocks = ([tuple(r) for r in bt.run_backtest(rows, s, block_days=b).orderBy("signal_date").collect()] for b in (None, 20))
    assert len(whole) == 90 and all(x == pytest.approx(y) if isinstance(x, float) else x == y for r, t in zip(whole, blocks, strict=True) for x, y in zip(r, t, strict=True))
