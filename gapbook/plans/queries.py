"""The registered queries of the research operators, all over the given tables."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gapbook.functions.columns import market_cap_label, normalize_symbol, parse_symbols
from gapbook.operators import backtest as bt
from gapbook.operators import benchmarks as bm
from gapbook.operators import blotter, eras, nightly, signals
from gapbook.operators import features as ft
from gapbook.operators import membership as mb
from gapbook.operators import metrics as mx
from gapbook.operators import portfolio as pf
from gapbook.operators import walkforward as wf
from gapbook.operators.costs import CostSettings, cost_eras, with_cost_rate
from gapbook.plans.market import bars, benchmark_closes, spells, table
from gapbook.sources import bars as sb
from gapbook.sources import reference as ref

CAPITAL = 1_000_000.0
HISTORICAL = CostSettings("historical")
SIGNAL = signals.SignalSettings(lookback_days=21, min_history=13, top_n=10, max_weight=0.15)
COSTED = bt.BacktestSettings(CAPITAL, HISTORICAL)
LIMITED = bt.BacktestSettings(CAPITAL, HISTORICAL, capital_capacity=600_011.7, max_adv_participation=1.93719, cash_rate=0.02)
WALK = wf.WalkForwardSettings(504, 126, 126, (21, 42), (5, 10), (0.0,), max_weight=0.2, backtest=COSTED)
PORTFOLIO = pf.PortfolioSettings(fees_bps=1.0, slippage_bps=2.0)
NIGHTLY = nightly.NightlySettings(21, 13, top_n=8, estimation_days=63)


def rounded(frame: DataFrame, digits: int = 8) -> DataFrame:
    """All doubles rounded, for comparison with another engine."""
    return frame.select(*(F.round(c, digits).alias(c) if kind == "double" else F.col(f"`{c}`") for c, kind in frame.dtypes))


#: Columns in money; all other doubles of daily results are shares of it.
MONEY = ("starting_equity", "ending_equity", "deployed_capital")


def by_scale(frame: DataFrame, digits: int = 9, money: int = 3) -> DataFrame:
    """Doubles rounded as far as their size lets two engines agree: money to less than a cent, returns,
    costs and weights to ``digits`` places."""
    return frame.select(
        *(F.round(c, money if c in MONEY else digits).alias(c) if kind == "double" else F.col(f"`{c}`") for c, kind in frame.dtypes)
    )


def _signals(spark: SparkSession, d: str) -> DataFrame:
    return signals.generate_signals(bars(spark, d), SIGNAL)


def _daily(spark: SparkSession, d: str, settings: bt.BacktestSettings = COSTED) -> DataFrame:
    return bt.run_backtest(_signals(spark, d).withColumn("run", F.lit("base")), settings, ["run"])


def _complete(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Common history of the part types' daily overnight returns."""
    return pf.estimation_set(ft.long_returns(bars(spark, d, "p_type")), filter_symbols=True)


# -- sources


def bars_daily(spark, d):
    return rounded(bars(spark, d))


def bars_weekly(spark, d):
    return rounded(bars(spark, d, weekly=True))


def _raw_bars(spark, d):
    """Bars as text with defects by rule: missing dates and keys, words for numbers, far dates, lower
    case and dots in symbols, and each third bar twice with another close."""
    rows = bars(spark, d).withColumn("n", F.dayofyear("date"))
    far = F.when(F.col("n") % 37 == 0, F.lit("7025-03-07")).when(F.col("n") % 41 == 0, F.lit("soon"))
    text = rows.select(
        F.when(F.col("n") % 29 != 0, F.coalesce(far, F.date_format("date", "yyyy-MM-dd"))).alias("date"),
        F.concat(F.lit(" "), F.lower("symbol"), F.lit(".x ")).alias("symbol"),
        F.col("open").cast("string").alias("open"),
        "high",
        "low",
        F.when(F.col("n") % 31 == 0, F.lit("n/a")).otherwise(F.col("close").cast("string")).alias("close"),
        "volume",
        (F.lit(0)).alias("seq"),
        "n",
    )
    again = text.where("n % 3 = 0").withColumn("close", F.lit("99.5")).withColumn("seq", F.lit(1))
    return text.unionByName(again).drop("n")


def bars_cleaned(spark, d):
    return rounded(sb.clean_bars(_raw_bars(spark, d), dt.date(2002, 1, 1), "seq"))


def bars_validation(spark, d):
    raw = _raw_bars(spark, d)
    return sb.validation_report(raw.withColumn("volume", F.when(F.dayofmonth(F.col("date").try_cast("date")) == 5, -1.0).otherwise(F.col("volume"))))


def history_merged(spark, d):
    own = bars(spark, d)
    newer = own.where("year(date) >= 2001").withColumn("close", F.col("close") + 1)
    return rounded(sb.merge_history(own.where("year(date) <= 2001"), newer))


def fetch_planned(spark, d):
    own = bars(spark, d).where("symbol not like '%5' and date <= date'2001-06-30'")
    return sb.fetch_plan(own, table(spark, d, "part").select(F.col("p_brand").alias("symbol")), dt.date(1995, 1, 1))


def symbols_missing(spark, d):
    own = bars(spark, d).where("symbol like '%1' and date < date'1998-01-01'")
    return sb.missing_symbols(own.withColumn("symbol", normalize_symbol("symbol")), table(spark, d, "part").select(F.col("p_brand").alias("symbol")))


def bars_window(spark, d):
    own = bars(spark, d).withColumn("symbol", normalize_symbol("symbol"))
    return rounded(sb.between(own, dt.date(1997, 1, 1), dt.date(1999, 12, 31), ["brand#11", "Brand#23"]))


def bars_sample(spark, d):
    return rounded(sb.bounded_sample(bars(spark, d), 7, 250))


def bars_data_window(spark, d):
    return sb.data_window(bars(spark, d))


def vendor_wide(spark, d):
    """Bars pivoted to one column for each type and field, and back."""
    own = bars(spark, d, "p_type")
    # the columns of a wide frame: one for each type and field, so types are few by nature
    kinds = [r.symbol for r in own.select("symbol").distinct().orderBy("symbol").collect()]
    back = {v: k for k, v in sb.FIELDS.items()}
    wide = own.groupBy("date").pivot("symbol", kinds).agg(*(F.first(c).alias(back[c]) for c in sb.OHLCV))
    return rounded(sb.from_vendor_wide(wide, kinds))


def ticker_lists(spark, d):
    lists = table(spark, d, "part").groupBy("p_brand").agg(F.concat_ws(", ", F.sort_array(F.collect_set("p_type"))).alias("text"))
    return lists.select(F.col("p_brand").alias("brand"), F.concat_ws("|", parse_symbols("text")).alias("symbols"))


def universe_metadata(spark, d):
    parts = table(spark, d, "part").groupBy("p_brand").agg(F.min("p_type").alias("sector"), F.max("p_retailprice").alias("cap"))
    base = parts.where("p_brand not like '%3'").select(F.col("p_brand").alias("symbol"), F.concat(F.lit("Maker of "), "p_brand").alias("name"), F.when(F.col("p_brand").like("%1"), F.lit("Energy")).when(F.col("p_brand").like("%2"), F.lit("Utilities")).otherwise(F.col("sector")).alias("sector"))
    caps = parts.where("p_brand not like '%4'").select(F.col("p_brand").alias("symbol"), (F.round("cap", 0) * 1e8).alias("market_cap"))
    found = ref.universe_metadata(base, caps, bars(spark, d).where("symbol not like '%5'"))
    return rounded(found.withColumn("cap_label", market_cap_label("market_cap")), 2)


# -- features and signals


def overnight_features(spark, d):
    names = ["overnight_return", "intraday_return", "close_to_close_return", "next_overnight_return", "overnight_mean", "overnight_vol", "overnight_sharpe", "overnight_win_rate", "dollar_volume", "adv_dollars"]
    return rounded(ft.build_features(bars(spark, d), ft.FeatureSettings(21, 13)).select("date", "symbol", "exit_date", *names), 7)


def long_returns(spark, d):
    return rounded(ft.long_returns(bars(spark, d), "close_to_close"))


def overnight_signals(spark, d):
    return rounded(_signals(spark, d), 7)


def equal_signals(spark, d):
    s = signals.SignalSettings(42, 20, 5, 0.3, 0.5, "equal")
    return rounded(signals.generate_signals(bars(spark, d), s), 7)


def latest_holdings(spark, d):
    return rounded(signals.latest_book(_signals(spark, d), n=5), 7)


def target_orders(spark, d):
    book = signals.latest_book(_signals(spark, d), n=100)
    return rounded(signals.target_orders(book, F.concat(F.lit("rank "), F.col("signal_rank").cast("string"))), 7)


# -- joins


def member_bars(spark, d):
    return rounded(mb.apply_membership(bars(spark, d), spells(spark, d)))


def membership_report(spark, d):
    found = mb.membership_summary(bars(spark, d), spells(spark, d))
    return found.withColumn("missing_symbols", F.concat_ws(",", "missing_symbols"))


def cost_as_of(spark, d):
    dates = table(spark, d, "orders").select(F.to_date("o_orderdate").alias("signal_date")).distinct()
    return with_cost_rate(dates, HISTORICAL)


# -- backtest


def backtest_daily(spark, d):
    return by_scale(_daily(spark, d))


def backtest_limited(spark, d):
    return by_scale(_daily(spark, d, LIMITED))


def trade_blotter(spark, d):
    own = _signals(spark, d).withColumn("run", F.lit("base"))
    return rounded(bt.trade_blotter(own, bt.run_backtest(own, COSTED, ["run"]), COSTED, ["run"]), 5)


def trade_blotter_limited(spark, d):
    own = _signals(spark, d).withColumn("run", F.lit("base"))
    return rounded(bt.trade_blotter(own, bt.run_backtest(own, LIMITED, ["run"]), LIMITED, ["run"]), 3)


def equity_curve(spark, d):
    return rounded(bt.equity_curve(_daily(spark, d), ["run"]), 6)


def equity_curve_range(spark, d):
    return rounded(bt.curve_range(bt.equity_curve(_daily(spark, d), ["run"]), 3, ["run"]), 6)


def performance(spark, d):
    return rounded(mx.performance_metrics(_daily(spark, d), CAPITAL, 0.01, runs=["run"]), 6)


def performance_sweep(spark, d):
    """Metrics of a sweep of book sizes and caps as one job."""
    features = ft.build_features(bars(spark, d), ft.FeatureSettings(21, 13))
    sweep = spark.createDataFrame([(n, c) for n in (3, 6, 12) for c in (0.1, 0.25)], "top_n int, max_weight double")
    rows = features.join(F.broadcast(sweep))
    runs = ["top_n", "max_weight"]
    best = signals.top_n(signals.candidates(rows, 0.0), F.col("top_n"), runs)
    by = [*runs, "date"]
    weighted = signals.capped_weights(best, signals.score_of("score", by), F.col("max_weight"), by).withColumnRenamed("date", "signal_date")
    return rounded(mx.performance_metrics(bt.run_backtest(weighted, COSTED, runs), CAPITAL, runs=runs), 6)


def var_cvar_by_symbol(spark, d):
    return rounded(mx.var_cvar(ft.long_returns(bars(spark, d)), "ret", 0.9, ["symbol"]))


def close_drawdowns(spark, d):
    return rounded(mx.drawdown_series(bars(spark, d).select("date", "symbol", "close"), "close", "date", ["symbol"]))


def trades_filtered(spark, d):
    own = _signals(spark, d)
    trades = bt.trade_blotter(own, bt.run_backtest(own, COSTED), COSTED)
    return rounded(blotter.last_trades(blotter.filter_trades(trades, dt.date(1998, 1, 1), dt.date(2000, 12, 31), "#2", "wins"), 200), 5)


def trades_summary(spark, d):
    own = _signals(spark, d)
    trades = bt.trade_blotter(own, bt.run_backtest(own, COSTED), COSTED)
    return rounded(blotter.trade_summary(trades, blotter.filter_trades(trades, dt.date(1998, 1, 1), None, "#3"), 200), 4)


# -- benchmarks and eras


def benchmark_returns(spark, d):
    return rounded(bm.benchmark_returns(benchmark_closes(spark, d)))


def _strategy(spark, d):
    return _daily(spark, d).select(F.col("signal_date").alias("date"), F.col("net_return").alias("ret"))


def relative_to_benchmarks(spark, d):
    return rounded(bm.relative_metrics(_strategy(spark, d), bm.benchmark_returns(benchmark_closes(spark, d))), 6)


def benchmark_growth(spark, d):
    return rounded(bm.growth_curves(_strategy(spark, d), bm.benchmark_returns(benchmark_closes(spark, d))), 7)


def benchmark_growth_wide(spark, d):
    curves = bm.growth_curves(_strategy(spark, d), bm.benchmark_returns(benchmark_closes(spark, d)))
    return rounded(bm.aligned_curves(curves, ["strategy", "TYPES", "RATE"]), 7)


def benchmark_growth_common(spark, d):
    curves = bm.growth_curves(_strategy(spark, d), bm.benchmark_returns(benchmark_closes(spark, d)))
    return rounded(bm.common_date_curves(curves, ["strategy", "TYPES", "RATE"]), 7)


def benchmark_refresh(spark, d):
    closes = benchmark_closes(spark, d)
    return rounded(bm.refresh_closes(closes.where("year(date) < 2000"), closes.withColumn("close", F.col("close") + 1)))


def era_windows(spark, d):
    return eras.era_windows(_daily(spark, d))


def _era_summary(spark, d):
    daily = bt.run_backtest(_signals(spark, d).withColumn("run", F.lit("era")), bt.BacktestSettings(eras.STAKE, HISTORICAL), ["run"])
    return eras.summarize_eras(daily, eras.era_windows(daily))


def era_study(spark, d):
    found = _era_summary(spark, d)
    for name in ("halved", "ruined"):
        found = found.withColumn(f"{name}_date", F.col(name)["date"]).withColumn(f"{name}_months", F.col(name)["months"]).drop(name)
    return rounded(found, 6)


def era_conclusion(spark, d):
    return eras.study_conclusion(_era_summary(spark, d))


def walk_forward_windows(spark, d):
    return wf.fold_windows(bars(spark, d), WALK)


def walk_forward_folds(spark, d):
    return rounded(wf.walk_forward(bars(spark, d), WALK).folds, 6)


def walk_forward_oos(spark, d):
    return rounded(wf.walk_forward(bars(spark, d), WALK).oos_metrics, 6)


def walk_forward_decay(spark, d):
    found = wf.walk_forward(bars(spark, d), WALK)
    return rounded(wf.sharpe_decay(found.oos_metrics, found.in_sample), 6)


# -- portfolios


def estimation_rows(spark, d):
    return rounded(_complete(spark, d)[0])


def estimation_report(spark, d):
    found = _complete(spark, d)[1]
    return found.withColumn("excluded_symbols", F.concat_ws(",", "excluded_symbols"))


def expected_returns(spark, d):
    complete, _ = _complete(spark, d)
    by = {m: pf.expected_returns(complete, m).withColumnRenamed("mu", m) for m in ("mean", "median", "winsorized")}
    return rounded(by["mean"].join(by["median"], "symbol").join(by["winsorized"], "symbol"), 9)


def covariance_matrix(spark, d):
    return rounded(pf.covariance_pairs(_complete(spark, d)[0]).select("a", "b", (F.col("cov") * 1e6).alias("cov")), 6)


def covariance_matrix_blocks(spark, d):
    return rounded(pf.covariance_blocks(_complete(spark, d)[0]).select("a", "b", (F.col("cov") * 1e6).alias("cov")), 6)


def symbol_cost_rates(spark, d):
    return rounded(pf.cost_rates(ft.long_returns(bars(spark, d)), 1.0, 2.0), 10)


def _equal_book(complete):
    return complete.select("symbol").distinct().select(F.lit("equal").alias("portfolio"), "symbol", F.lit(0.1).alias("weight"))


def constant_mix_path(spark, d):
    complete, _ = _complete(spark, d)
    return by_scale(pf.static_path(_equal_book(complete), complete, PORTFOLIO), 10)


def constant_mix_statistics(spark, d):
    complete, _ = _complete(spark, d)
    return rounded(pf.portfolio_statistics(_equal_book(complete), complete), 7)


def rebalance_calendar(spark, d):
    complete, _ = _complete(spark, d)
    from pyspark.sql import Window

    calendar = complete.select("date").distinct().withColumn("pos", F.row_number().over(Window.orderBy("date")) - 1)
    return pf.rebalance_dates(calendar, "quarterly", 252)


def static_portfolios(spark, d):
    summary, _ = pf.static_suite(_complete(spark, d)[0], PORTFOLIO)
    return rounded(summary, 6)


def static_portfolio_weights(spark, d):
    return rounded(pf.static_suite(_complete(spark, d)[0], PORTFOLIO)[1], 6)


def rebalanced_portfolios(spark, d):
    return rounded(pf.rebalanced_suite(_complete(spark, d)[0], "annually", 252, PORTFOLIO)[0], 6)


def latest_rebalance_dollars(spark, d):
    _, weights = pf.rebalanced_suite(_complete(spark, d)[0], "annually", 252, PORTFOLIO)
    return rounded(pf.dollar_allocation(pf.latest_snapshot(weights), CAPITAL), 4)


def custom_portfolio(spark, d):
    _, weights = pf.custom_portfolio(ft.long_returns(bars(spark, d, "p_type")), PORTFOLIO, metric="volatility", lookback=500)
    return rounded(weights, 6)


# -- nightly books


def nightly_daily(spark, d):
    return by_scale(nightly.nightly_suite(bars(spark, d), NIGHTLY).daily)


def nightly_metrics(spark, d):
    return rounded(nightly.nightly_suite(bars(spark, d), NIGHTLY).metrics, 6)


def nightly_book(spark, d):
    return rounded(nightly.nightly_suite(bars(spark, d), NIGHTLY).current_book, 6)


def event_bars(spark, d):
    """Hourly bars of the values of each user's events."""
    events = table(spark, d, "events")
    rows = events.select(
        F.concat(F.lit("U"), F.col("user_id").cast("string")).alias("symbol"),
        F.date_trunc("hour", "ts").alias("date"),
        F.col("value").alias("price"),
        F.lit(1.0).alias("size"),
        F.struct("ts", "event_id").alias("order"),
    )
    return rounded(sb.from_ticks(rows))


QUERIES: tuple[Callable[[SparkSession, str], DataFrame], ...] = (
    bars_daily,
    bars_weekly,
    bars_cleaned,
    bars_validation,
    history_merged,
    fetch_planned,
    symbols_missing,
    bars_window,
    bars_sample,
    bars_data_window,
    vendor_wide,
    ticker_lists,
    universe_metadata,
    event_bars,
    overnight_features,
    long_returns,
    overnight_signals,
    equal_signals,
    latest_holdings,
    target_orders,
    member_bars,
    membership_report,
    cost_as_of,
    backtest_daily,
    backtest_limited,
    trade_blotter,
    trade_blotter_limited,
    equity_curve,
    equity_curve_range,
    performance,
    performance_sweep,
    var_cvar_by_symbol,
    close_drawdowns,
    trades_filtered,
    trades_summary,
    benchmark_returns,
    relative_to_benchmarks,
    benchmark_growth,
    benchmark_growth_wide,
    benchmark_growth_common,
    benchmark_refresh,
    era_windows,
    era_study,
    era_conclusion,
    walk_forward_windows,
    walk_forward_folds,
    walk_forward_oos,
    walk_forward_decay,
    estimation_rows,
    estimation_report,
    expected_returns,
    covariance_matrix,
    covariance_matrix_blocks,
    symbol_cost_rates,
    constant_mix_path,
    constant_mix_statistics,
    rebalance_calendar,
    static_portfolios,
    static_portfolio_weights,
    rebalanced_portfolios,
    latest_rebalance_dollars,
    custom_portfolio,
    nightly_daily,
    nightly_metrics,
    nightly_book,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {q.__name__: q for q in QUERIES}
