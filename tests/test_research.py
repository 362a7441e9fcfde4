"""Exact-number fixtures and invariants of the research operators."""

import datetime as dt
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from gapbook.functions.columns import normalize_symbol, parse_symbols
from gapbook.operators import backtest as bt
from gapbook.operators import benchmarks as bm
from gapbook.operators import costs, eras, membership, signals
from gapbook.operators import features as ft
from gapbook.operators import metrics as mx
from gapbook.operators import optimizers as opt
from gapbook.operators import portfolio as pf
from gapbook.operators import walkforward as wf
from gapbook.sources import bars as sb
from gapbook.sources import reference as ref
from gapbook.sources.synthetic import SyntheticMarket, synthetic_bars

D = dt.date


def bars_of(spark, rows):
    return spark.createDataFrame(rows, sb.BARS)


def signals_of(spark, rows):
    return spark.createDataFrame(rows, "signal_date date, exit_date date, symbol string, weight double, next_overnight_return double, adv_dollars double")


LIMITS = [
    (D(2020, 1, 2), D(2020, 1, 3), "AAA", 0.5, 0.01, 20e6),
    (D(2020, 1, 2), D(2020, 1, 3), "BBB", 0.5, -0.02, 10e6),
    (D(2020, 1, 3), D(2020, 1, 6), "AAA", 1.0, 0.005, 20e6),
]


def test_symbols(spark):
    row = spark.createDataFrame([(" brk.b\t", "aapl, msft\nAAPL brk.b,,")], "s string, l string").select(normalize_symbol("s"), parse_symbols("l")).first()
    assert row[0] == "BRK-B" and row[1] == ["AAPL", "MSFT", "BRK-B"]


def test_features_first_returns(spark):
    rows = [(D(2024, 1, k + 1), "AAA", o, o + 1, o - 1, c, 1000.0) for k, (o, c) in enumerate([(100.0, 101.0), (102.0, 100.0), (101.0, 103.0), (104.0, 105.0)])]
    got = ft.build_features(bars_of(spark, rows), ft.FeatureSettings(2, 1)).orderBy("date").collect()
    assert got[0].overnight_return is None
    assert got[1].overnight_return == pytest.approx(102 / 101 - 1) == got[0].next_overnight_return
    assert got[0].exit_date == D(2024, 1, 2) and got[3].exit_date is None


def test_capped_weights_against_loop(spark):
    rng = np.random.default_rng(3)
    rows, expected = [], {}
    for day in range(60):
        n, cap = int(rng.integers(1, 9)), [0.1, 0.2, 0.35][day % 3]
        s = np.round(rng.exponential(1, n), 1) if day % 5 else np.zeros(n)
        own = np.where(s > 0, s, 0.0) if s.sum() > 0 else np.ones(n)
        w, free, left = np.zeros(n), np.ones(n, bool), min(1.0, cap * n)
        while free.any():
            share = own[free] / own[free].sum() * left if own[free].sum() > 0 else np.full(free.sum(), left / free.sum())
            if not (share > cap + 1e-12).any():
                w[free] = share
                break
            hit = np.flatnonzero(free)[share > cap + 1e-12]
            w[hit], free[hit] = cap, False
            left = min(1.0, cap * n) - w.sum()
        for k in range(n):
            rows.append((D(2024, 1, 1) + dt.timedelta(day), f"S{k}", float(s[k]), cap))
            expected[(rows[-1][0], f"S{k}")] = w[k]
    frame = spark.createDataFrame(rows, "date date, symbol string, overnight_sharpe double, cap double")
    got = signals.capped_weights(frame, signals.score_of("score", ["date"]), F.col("cap"), ["date"]).collect()
    assert max(abs(r.weight - expected[(r.date, r.symbol)]) for r in got) < 1e-9


def test_round_trip_cost_and_compounding(spark):
    rows = [(D(2024, 1, 2), D(2024, 1, 3), "AAA", 1.0, 0.01, None), (D(2024, 1, 3), D(2024, 1, 4), "AAA", 1.0, -0.005, None)]
    s = bt.BacktestSettings(1000.0, costs.CostSettings("flat", 1.0, 1.0))
    got = bt.run_backtest(signals_of(spark, rows), s).orderBy("signal_date").collect()
    assert got[0].net_return == pytest.approx(0.01 - 2 * 2 / 1e4)
    assert got[1].ending_equity == pytest.approx(1000 * (1 + got[0].net_return) * (1 + got[1].net_return))
    trades = bt.trade_blotter(signals_of(spark, rows), bt.run_backtest(signals_of(spark, rows), s), s)
    assert trades.count() == 2


def test_limits(spark):
    free = costs.CostSettings("flat", 0.0, 0.0)
    frame = signals_of(spark, LIMITS)
    plain = bt.run_backtest(frame, bt.BacktestSettings(1e6, free)).orderBy("signal_date").first()
    half = bt.run_backtest(frame, bt.BacktestSettings(1e6, free, capital_capacity=5e5)).orderBy("signal_date").first()
    assert half.net_return == pytest.approx(plain.net_return / 2) and half.cash_weight == pytest.approx(0.5)
    adv = bt.BacktestSettings(1e6, free, max_adv_participation=0.01)
    trades = bt.trade_blotter(frame, bt.run_backtest(frame, adv), adv).orderBy("signal_date", "symbol").collect()
    assert [round(t.notional) for t in trades[:2]] == [200_000, 100_000]
    cash = bt.run_backtest(frame, bt.BacktestSettings(1e6, free, capital_capacity=5e5, cash_rate=0.252)).orderBy("signal_date").first()
    assert cash.net_return * 1e6 == pytest.approx(half.net_return * 1e6 + 500_000 * 0.001)


def test_fold_equals_product_without_binding_limits(spark):
    frame = signals_of(spark, LIMITS).withColumn("run", F.lit("r"))
    one = bt.run_backtest(frame, bt.BacktestSettings(1e6), ["run"]).orderBy("signal_date").collect()
    two = bt.run_backtest(frame, bt.BacktestSettings(1e6, capital_capacity=1e12), ["run"]).orderBy("signal_date").collect()
    for a, b in zip(one, two, strict=True):
        assert a.ending_equity == pytest.approx(b.ending_equity) and a.run == b.run


def test_costs_by_era(spark):
    days = spark.createDataFrame([(D(1990, 6, 1),), (D(2020, 1, 2),), (D(1890, 1, 1),)], "signal_date date")
    got = {r.signal_date: r.cost_rate_bps for r in costs.with_cost_rate(days, costs.CostSettings("historical")).collect()}
    assert got == {D(1990, 6, 1): 33.0, D(2020, 1, 2): 1.5, D(1890, 1, 1): 90.0}
    own = costs.CostSettings("historical", eras=((D(2000, 1, 1), 1.0, 2.0), (D(1980, 1, 1), 10.0, 20.0)))
    assert {r.cost_rate_bps for r in costs.with_cost_rate(days.where("signal_date < '1995-01-01'"), own).collect()} == {30.0}
    with pytest.raises(ValueError):
        costs.CostSettings("monthly")


def test_metrics_core_and_elapsed_growth(spark):
    rows = [(D(2020, 1, 1), D(2020, 7, 1), 0.10, 110.0), (D(2020, 7, 1), D(2021, 1, 1), 0.10, 121.0)]
    daily = spark.createDataFrame(rows, "signal_date date, exit_date date, net_return double, ending_equity double").withColumns(
        {"starting_equity": F.lit(100.0), "gross_return": F.col("net_return"), "cost_return": F.lit(0.0), "gross_exposure": F.lit(1.0), "trade_count": F.lit(1), "round_trip_turnover": F.lit(2.0)}
    )
    m = mx.performance_metrics(daily, 100.0).first()
    assert m.elapsed_years == pytest.approx(366 / 365.25) and m.cagr == pytest.approx(1.21 ** (365.25 / 366) - 1)
    assert m.observations == 2 and m.rolling_sharpe_1y is None and m.max_drawdown == 0 and m.calmar is None
    empty = mx.performance_metrics(daily.withColumn("run", F.lit("a")).where("false"), 100.0, runs=["run"], all_runs=spark.createDataFrame([("a",)], "run string")).first()
    assert empty.observations == 0 and empty.final_equity == 100.0


def test_trailing_ratios_on_shuffled_rows(spark):
    rng = np.random.default_rng(0)
    r = rng.normal(0.001, 0.02, 20)
    equity = 100 * np.cumprod(1 + r)
    days = pd.date_range("2020-01-01", periods=20)
    rows = [(d.date(), d.date(), float(x), float(e), float(e / (1 + x))) for d, x, e in zip(days, r, equity, strict=True)]
    rng.shuffle(rows)
    daily = spark.createDataFrame(rows, "signal_date date, exit_date date, net_return double, ending_equity double, starting_equity double")
    got = mx.trailing_ratios(daily, periods=4).first()
    for label, n in (("1y", 4), ("3y", 12), ("5y", 20)):
        w = r[-n:]
        assert got[f"rolling_sharpe_{label}"] == pytest.approx(w.mean() * 4 / (w.std() * 2))
        path = np.concatenate([[equity[-n] / (1 + w[0])], equity[-n:]])
        worst = (path / np.maximum.accumulate(path) - 1).min()
        growth = (path[-1] / path[0]) ** (4 / n) - 1
        assert got[f"rolling_calmar_{label}"] == pytest.approx(growth / abs(worst))


def test_skewness_and_kurtosis_match_pandas(spark):
    x = np.random.default_rng(5).gamma(2, size=40)
    got = spark.createDataFrame([(float(v),) for v in x], "x double").selectExpr("x")
    from gapbook.functions.columns import sample_kurtosis, sample_skewness

    row = got.agg(sample_skewness("x"), sample_kurtosis("x")).first()
    assert row[0] == pytest.approx(pd.Series(x).skew()) and row[1] == pytest.approx(pd.Series(x).kurtosis())


def test_membership(spark):
    rows = [(D(2000, 1, 3), "OLD"), (D(2010, 1, 4), "AAA"), (D(2020, 1, 2), "AAA"), (D(2018, 6, 1), "NEW")]
    bars = spark.createDataFrame(rows, "date date, symbol string")
    spells = spark.createDataFrame([("AAA", D(2005, 1, 1), None), ("NEW", D(2018, 1, 1), D(2019, 1, 1)), ("AAA", D(2006, 1, 1), None)], "symbol string, start_date date, end_date date")
    assert membership.apply_membership(bars, spells).count() == 3
    assert membership.apply_membership(bars, spells.limit(0)).count() == 4
    report = membership.membership_summary(bars, spells).first()
    assert report.missing_symbols == ["OLD"] and report.point_in_time


def test_repair_merge_and_validation(spark, tmp_path):
    (tmp_path / "bars.csv").write_text(
        "date,symbol,open,high,low,close,volume\n2024-01-02,aapl,100,101,99,100,10\n2024-01-02,AAPL,111,112,99,100,10\n,AAPL,1,1,1,1,1\n7025-03-07,AAPL,1,1,1,1,1\n2024-01-03,AAPL,1,2,3,4,5,6,7\n"
    )
    got = sb.clean_bars(sb.read_csv(spark, str(tmp_path / "bars.csv")), D(2024, 2, 1)).collect()
    assert len(got) == 1 and got[0].open == 111.0 and got[0].symbol == "AAPL"
    old = bars_of(spark, [(D(2024, 1, k), "AAPL", 100.0, 101.0, 99.0, 100.0, 1.0) for k in (2, 3)])
    new = bars_of(spark, [(D(2024, 1, 3), "AAPL", 111.0, 112.0, 99.0, 100.0, 1.0), (D(2024, 1, 4), "MSFT", 1.0, 1.0, 1.0, 1.0, 1.0)])
    merged = {(r.date, r.symbol): r.open for r in sb.merge_history(old, new).collect()}
    assert len(merged) == 3 and merged[(D(2024, 1, 3), "AAPL")] == 111.0
    assert sb.validate_bars(old).count() == 2
    with pytest.raises(sb.InvalidBars, match="duplicate"):
        sb.validate_bars(old.unionByName(old))
    with pytest.raises(sb.InvalidBars, match="price"):
        sb.validate_bars(old.withColumn("low", F.lit(0.0)))


def test_vendor_frames(spark):
    wide = spark.createDataFrame([(D(2024, 1, k), *([float(k)] * 10)) for k in (2, 3, 4)], "date date, " + ", ".join(f"{s}_{f} double" for s in ("AAPL", "MSFT") for f in sb.FIELDS))
    assert sb.from_vendor_wide(wide, ["AAPL", "MSFT", "NVDA"]).count() == 6
    payload = spark.createDataFrame([("2024-01-02T00:00:00.000Z", "AAPL", 200.0, 99.0, 100.0, 98.0, 99.5, 1_100_000.0)], "date string, symbol string, close double, adjOpen double, adjHigh double, adjLow double, adjClose double, adjVolume double")
    row = sb.from_vendor_json(payload).first()
    assert (row.date, row.close, row.volume) == (D(2024, 1, 2), 99.5, 1_100_000.0)
    assert sb.from_vendor_json(payload.drop("adjLow")).count() == 0


def test_fetch_plan(spark):
    rows = [(D(2024, 1, 5), "AAPL"), (D(2024, 1, 3), "MSFT"), (D(2024, 1, 2), "MSFT")]
    have = spark.createDataFrame(rows, "date date, symbol string")
    want = spark.createDataFrame([("aapl",), ("MSFT",), ("NVDA",)], "symbol string")
    got = {r.symbol: (r.status, r.fetch_start) for r in sb.fetch_plan(have, want, D(2015, 1, 1)).collect()}
    assert got == {"NVDA": ("fresh", D(2015, 1, 1)), "AAPL": ("cached", D(2023, 12, 24)), "MSFT": ("cached", D(2023, 12, 24))}


def test_universe_metadata(spark):
    base = spark.createDataFrame([("aaa", "A, Inc.", "Energy"), ("bbb", None, None)], "symbol string, name string, sector string")
    caps = spark.createDataFrame([("AAA", 5.0), ("CCC", 9.0)], "symbol string, market_cap double")
    bars = spark.createDataFrame([("BBB",), ("DDD",)], "symbol string")
    got = {r.symbol: r for r in ref.universe_metadata(base, caps, bars).collect()}
    assert set(got) == {"AAA", "BBB", "CCC", "DDD"}
    assert got["AAA"].sector_code == "XLE" and got["BBB"].sector == "Unclassified" and got["BBB"].in_price_cache and not got["AAA"].in_price_cache


def test_relative_metrics_and_curves(spark):
    rng = np.random.default_rng(1)
    days = [d.date() for d in pd.bdate_range("2020-01-01", periods=100)]
    b = rng.normal(0.0004, 0.01, 100)
    strategy = spark.createDataFrame([(d, float(2 * x)) for d, x in zip(days, b, strict=True)] + [(days[0], float(2 * b[0]))], "date date, ret double")
    bench = spark.createDataFrame([("B", d, float(x)) for d, x in zip(days, b, strict=True)] + [("C", d, 0.001) for d in days[:10]], "key string, date date, ret double")
    got = bm.relative_metrics(strategy, bench).collect()
    assert len(got) == 1 and got[0].observations == 100
    assert got[0].beta == pytest.approx(2) and got[0].correlation == pytest.approx(1) and got[0].up_capture == pytest.approx(2)
    first = bm.growth_curves(strategy.where(F.col("date") >= F.lit(days[20])), bench).where("key = 'B'").orderBy("date").first()
    assert first.date == days[20] and first.growth == pytest.approx(1.0)


def test_eras(spark):
    days = [d.date() for d in pd.bdate_range("1970-01-01", "2020-12-31")]
    daily = spark.createDataFrame([(d, 0.001, -0.002, 10) for d in days], "signal_date date, gross_return double, net_return double, trade_count int")
    windows = eras.era_windows(daily).orderBy("start").collect()
    assert len(windows) == 7 and windows[0].end == D(1975, 4, 30)
    for a, b in zip(windows, windows[1:], strict=False):
        assert b.start == a.end + dt.timedelta(1)
    got = eras.summarize_eras(daily, eras.era_windows(daily)).orderBy("start").first()
    k = next(i for i in range(10_000) if 0.998**i <= 0.5)
    assert got.halved.months == pytest.approx(round((k + 1) / 21, 1)) and got.verdict == "capital bleeds out"
    up = eras.summarize_eras(daily.withColumn("net_return", F.lit(0.0015)), eras.era_windows(daily))
    assert {r.verdict for r in up.collect()} == {"edge survives costs"}
    end = eras.study_conclusion(up).first()
    assert end.eras_tested == 7 and end.ruined_eras == 0 and end.gross_edge_all_eras


def test_projections():
    w = opt.project_capped(np.array([4.0, 1.0, -2.0, 0.5]), 0.45)
    assert w.sum() == pytest.approx(1) and (w >= 0).all() and (w <= 0.45 + 1e-12).all()
    rng = np.random.default_rng(2)
    for _ in range(200):
        v = rng.normal(size=6)
        p = opt.project_simplex(v)
        others = rng.dirichlet(np.ones(6), 50)
        assert p.sum() == pytest.approx(1) and (np.linalg.norm(others - v, axis=1) >= np.linalg.norm(p - v) - 1e-9).all()
    assert opt.project_capped(np.ones(3), 0.2).sum() == pytest.approx(0.6)


def test_optimizers_reach_their_optimum():
    rng = np.random.default_rng(4)
    x = rng.normal(0.0005, 0.01, (400, 5)) * np.array([1, 2, 1, 3, 1.5])
    c = opt.covariance(x)
    w = opt.minimum_variance(c, None, 3000)
    for v in rng.dirichlet(np.ones(5), 300):
        assert w @ c @ w <= v @ c @ v + 1e-9
    for m in opt.SUITE:
        w = opt.suite_weights(x, m, opt.OptimizerSettings(max_weight=0.3))
        assert (w >= -1e-12).all() and (w <= 0.3 + 1e-9).all() and w.sum() <= 1 + 1e-9
    prior = opt.black_litterman(c)
    moved = opt.black_litterman(c, views=[({0: 1.0}, 0.05)])
    assert moved[0] > prior[0]


def _returns(spark, n=320, names="ABCD", seed=7, start="2020-01-01"):
    rng = np.random.default_rng(seed)
    days = [d.date() for d in pd.bdate_range(start, periods=n)]
    return spark.createDataFrame([(d, s, float(rng.normal(0.0005, 0.01))) for d in days for s in names], "date date, symbol string, ret double")


def test_estimation_set(spark):
    rows = _returns(spark, 100, "ABCDEFGH")
    days = [r.date for r in rows.select("date").distinct().orderBy("date").collect()]
    thin = spark.createDataFrame([(d, "THIN1", 0.01) for d in days[-10:]] + [(d, "THIN2", 0.01) for d in days[-8:]], rows.schema)
    complete, meta = pf.estimation_set(rows.unionByName(thin), True)
    assert complete.count() == 800 and meta.first().excluded_symbols == ["THIN1", "THIN2"]
    short = spark.createDataFrame([(d, "B", 0.01) for d in days[20:]], rows.schema)
    both, meta = pf.estimation_set(rows.where("symbol = 'A'").unionByName(short))
    assert both.count() == 160 and meta.first().start_date == days[20]


def test_covariance_forms_agree_with_numpy(spark):
    rows = _returns(spark, 60)
    wide = rows.toPandas().pivot(index="date", columns="symbol", values="ret")
    expected = opt.covariance(wide.to_numpy())
    for form in (pf.covariance_pairs, pf.covariance_blocks):
        for r in form(rows).collect():
            assert r["cov"] == pytest.approx(expected["ABCD".index(r.a), "ABCD".index(r.b)], rel=1e-9)


def test_static_path_bills_drift_at_each_rate(spark):
    days = [d.date() for d in pd.bdate_range("2020-01-01", periods=40)]
    rows = spark.createDataFrame([(d, "CALM", 0.001 * math.sin(k)) for k, d in enumerate(days)] + [(d, "JUMPY", 0.02 * (-1) ** k) for k, d in enumerate(days)], "date date, symbol string, ret double")
    weights = spark.createDataFrame([("p", "CALM", 0.5), ("p", "JUMPY", 0.5)], "portfolio string, symbol string, weight double")
    s = pf.PortfolioSettings(fees_bps=1.0, slippage_bps=5.0)
    got = pf.static_path(weights, rows, s).toPandas().sort_values("exit_date")
    x = rows.toPandas().pivot(index="date", columns="symbol", values="ret")[["CALM", "JUMPY"]].to_numpy()
    vol = x.std(axis=0)
    rates = 1e-4 + 5e-4 * np.clip(vol / vol.mean(), 0.25, 4)
    w = np.array([0.5, 0.5])
    drift = np.abs(w * (1 + x) / (1 + x @ w)[:, None] - w)
    assert got["cost_return"].sum() == pytest.approx((w * rates).sum() + (drift[1:] * rates).sum(), abs=1e-12)


def test_suites(spark):
    rows = _returns(spark)
    s = pf.PortfolioSettings(opt.OptimizerSettings(max_weight=0.4, iterations=100, cvar_iterations=50), fees_bps=1.0, slippage_bps=1.0)
    summary, weights = pf.static_suite(rows, s)
    assert summary.count() == 6 and weights.agg(F.max("weight")).first()[0] <= 0.4 + 1e-9
    best, held = pf.custom_portfolio(rows, s, metric="volatility")
    least = summary.orderBy("volatility").first().portfolio
    assert best.first().portfolio == least and held.select("portfolio").distinct().count() == 1
    summary, weights = pf.rebalanced_suite(rows, "monthly", 63, s)
    first = weights.agg(F.min("rebalance_date"), F.countDistinct("rebalance_date")).first()
    assert first[1] > 5 and first[0] > D(2020, 3, 1) and summary.where("rebalance_count = %d" % first[1]).count() == 6
    with pytest.raises(ValueError):
        pf.custom_portfolio(rows.where("symbol = 'A'"), s)


@pytest.fixture(scope="module")
def market(spark):
    names = spark.createDataFrame([(f"S{k:02d}",) for k in range(6)], "symbol string")
    return synthetic_bars(spark, names, SyntheticMarket(D(2019, 1, 1), D(2020, 6, 30))).cache()


def test_synthetic_bars_are_valid_and_reproducible(spark, market):
    assert sb.validate_bars(market).count() == market.count() > 2000
    assert market.where("high < greatest(open, close) or low > least(open, close)").count() == 0


def test_walk_forward_is_out_of_sample(spark, market):
    s = wf.WalkForwardSettings(150, 40, 40, (21,), (2, 4), max_weight=0.5)
    got = wf.walk_forward(market, s)
    folds = got.folds.orderBy("fold").collect()
    assert len(folds) >= 3 and all(f.test_start > f.train_end and f.top_n in (2, 4) for f in folds)
    daily = got.oos_daily.orderBy("signal_date").toPandas()
    assert daily["signal_date"].is_unique
    assert daily["ending_equity"].to_numpy() == pytest.approx(1e6 * np.cumprod(1 + daily["net_return"].to_numpy()))
    with pytest.raises(ValueError):
        wf.fold_windows(market, wf.WalkForwardSettings(5000))


def test_nightly_suite(spark, market):
    from gapbook.operators import nightly

    s = nightly.NightlySettings(21, 10, top_n=4, estimation_days=40, cash_rate=0.02, optimizer=opt.OptimizerSettings(max_weight=0.5, iterations=20, cvar_iterations=20))
    got = nightly.nightly_suite(market.where("date < '2019-09-01'"), s)
    daily = got.daily.toPandas()
    cash = daily["cash_weight"] * 0.02 / 252
    assert (daily["net_return"] - daily["gross_return"] - cash + daily["cost_return"]).abs().max() < 1e-12
    first = daily.sort_values("signal_date").groupby("method").first()
    assert (first["turnover"] - first["weight_sum"]).abs().max() < 1e-9
    assert daily.groupby("method").size().nunique() == 1 and daily["method"].nunique() == 8
    assert got.metrics.where("optimizer_fallback_days > 0").count() > 0


def test_stream_merge(spark, tmp_path):
    from gapbook.streaming.merge import merge_stream

    first = bars_of(spark, [(D(2024, 1, k), "AAPL", 100.0, 101.0, 99.0, 100.0, 1.0) for k in (2, 3)])
    second = bars_of(spark, [(D(2024, 1, 3), "AAPL", 111.0, 112.0, 99.0, 100.0, 1.0), (D(2024, 2, 1), "MSFT", 1.0, 1.0, 1.0, 1.0, 1.0)])
    for part in (first, second):
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        merge_stream(spark, str(tmp_path / "in"), str(tmp_path / "store"), str(tmp_path / "state")).awaitTermination()
    rows = {(r.date, r.symbol): r.open for r in spark.read.parquet(str(tmp_path / "store")).collect()}
    assert rows == {(D(2024, 1, 2), "AAPL"): 100.0, (D(2024, 1, 3), "AAPL"): 111.0, (D(2024, 2, 1), "MSFT"): 1.0}
