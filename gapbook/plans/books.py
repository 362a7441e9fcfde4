"""Queries of portfolios whose cap leaves the optimizers a choice, each method's weights and results; and of
quantiles of groups of any size."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gapbook.operators import backtest as bt
from gapbook.operators import features as ft
from gapbook.operators import metrics as mx
from gapbook.operators import nightly
from gapbook.operators import optimizers as opt
from gapbook.operators import portfolio as pf
from gapbook.operators.quantiles import exact_quantiles
from gapbook.plans import queries as q
from gapbook.plans.market import bars

#: A cap of which a few names make a whole portfolio.
FREE = opt.OptimizerSettings(max_weight=0.3)
SHARES = (0.0, 0.001, 0.25, 0.5, 0.9, 1.0)
PORTFOLIO = pf.PortfolioSettings(optimizer=FREE, fees_bps=1.0, slippage_bps=2.0)
NIGHTLY = nightly.NightlySettings(21, 13, top_n=8, estimation_days=63, cash_rate=0.02, optimizer=replace(FREE, iterations=60, cvar_iterations=60))


def capped_static_weights(spark: SparkSession, d: str) -> DataFrame:
    """Weights of all methods over one estimation set."""
    return q.rounded(pf.suite_weights(q._complete(spark, d)[0], FREE), 7)


def capped_static_portfolios(spark: SparkSession, d: str) -> DataFrame:
    """Their results."""
    return q.rounded(pf.static_suite(q._complete(spark, d)[0], PORTFOLIO)[0], 6)


def capped_rebalanced_weights(spark: SparkSession, d: str) -> DataFrame:
    """Weights of all methods at each quarter."""
    return q.rounded(pf.rebalanced_suite(q._complete(spark, d)[0], "quarterly", 252, PORTFOLIO)[1], 7)


def capped_rebalanced_portfolios(spark: SparkSession, d: str) -> DataFrame:
    return q.rounded(pf.rebalanced_suite(q._complete(spark, d)[0], "quarterly", 252, PORTFOLIO)[0], 6)


def capped_nightly_metrics(spark: SparkSession, d: str) -> DataFrame:
    return q.rounded(nightly.nightly_suite(bars(spark, d), NIGHTLY).metrics, 6)


def capped_nightly_book(spark: SparkSession, d: str) -> DataFrame:
    return q.rounded(nightly.nightly_suite(bars(spark, d), NIGHTLY).current_book, 7)


def market_tail_risk(spark: SparkSession, d: str) -> DataFrame:
    """VaR and CVaR of all overnight returns of all brands as one run, and of those of each year, of which
    no task holds all."""
    returns = ft.long_returns(bars(spark, d))
    all_, years = returns.withColumn("run", F.lit("all")), returns.withColumn("run", F.year("date").cast("string"))
    return q.rounded(mx.var_cvar(all_.unionByName(years), "ret", 0.99, ["run"], buffer=500), 9)


def return_quantiles(spark: SparkSession, d: str) -> DataFrame:
    """Exact quantiles of each type's returns, by refined histograms."""
    return q.rounded(exact_quantiles(ft.long_returns(bars(spark, d, "p_type")), "ret", SHARES, ["symbol"], buffer=200), 10)


def overnight_features_in_blocks(spark: SparkSession, d: str) -> DataFrame:
    """Rolling features over blocks of 200 bars of a symbol."""
    found = ft.build_features_in_blocks(bars(spark, d), ft.FeatureSettings(21, 13), rows=200)
    names = ["overnight_return", "next_overnight_return", "overnight_mean", "overnight_vol", "overnight_sharpe", "overnight_win_rate", "adv_dollars"]
    return q.rounded(found.select("date", "symbol", "exit_date", *names), 7)


def backtest_limited_in_blocks(spark: SparkSession, d: str) -> DataFrame:
    """The backtest with limits, blocks of 100 days in tasks of their own."""
    own = q._signals(spark, d).withColumn("run", F.lit("base"))
    return q.by_scale(bt.run_backtest(own, q.LIMITED, ["run"], block_days=100))


QUERIES: tuple[Callable[[SparkSession, str], DataFrame], ...] = (
    capped_static_weights,
    capped_static_portfolios,
    capped_rebalanced_weights,
    capped_rebalanced_portfolios,
    capped_nightly_metrics,
    capped_nightly_book,
    market_tail_risk,
    return_quantiles,
    overnight_features_in_blocks,
    backtest_limited_in_blocks,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {x.__name__: x for x in QUERIES}
