"""Benchmark series and comparisons with a strategy, many benchmarks in one job."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window, WindowSpec
from pyspark.sql import functions as F

from gapbook.functions.columns import finite, ratio
from gapbook.operators.metrics import over

#: Key, ticker, name and kind of each benchmark.
REGISTRY = (
    ("SP500", "^GSPC", "S&P 500", "price"),
    ("SP100", "^OEX", "S&P 100", "price"),
    ("NASDAQ", "^IXIC", "Nasdaq Composite", "price"),
    ("MSCI_WORLD", "URTH", "MSCI World (URTH ETF proxy, from 2012)", "price"),
    ("UST10Y", "^TNX", "US 10Y Treasury (approx. total return from ^TNX)", "yield"),
)
DURATION, LEAST_COMMON = 8.0, 20


def _by_key() -> WindowSpec:
    return Window.partitionBy("key").orderBy("date")


def registry(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(REGISTRY), "key string, ticker string, name string, kind string")


def benchmark_returns(closes: DataFrame) -> DataFrame:
    """``key, date, ret`` of ``key, date, close, kind``: simple returns of prices; of yields (times
    ten) the carry of the day before less duration times the change."""
    y = F.when(F.col("close") > 0, F.col("close") / 1000)
    rows = closes.withColumn("_y", F.last(y, ignorenulls=True).over(_by_key().rowsBetween(Window.unboundedPreceding, 0)))
    before = F.lag("_y").over(_by_key())
    price = F.try_divide(F.col("close"), F.lag("close").over(_by_key())) - 1
    bond = before / 365.25 - DURATION * (F.col("_y") - before)
    return rows.select("key", "date", finite(F.when(F.col("kind") == "yield", bond).otherwise(price)).alias("ret")).where("ret is not null")


def refresh_closes(old: DataFrame, new: DataFrame) -> DataFrame:
    """``key, date, close``: what is kept stays, and later dates are added; the last of a date wins."""
    last = old.groupBy("key").agg(F.max("date").alias("_last"))
    added = new.select("key", "date", "close").join(last, "key", "left").where("_last is null or date > _last").drop("_last")
    both = old.select("key", "date", "close", F.lit(0).alias("_from")).unionByName(added.withColumn("_from", F.lit(1)))
    pick = Window.partitionBy("key", "date").orderBy(F.col("_from").desc(), F.col("close").desc_nulls_last())
    return both.withColumn("_nth", F.row_number().over(pick)).where("_nth = 1").drop("_nth", "_from")


def one_per_date(series: DataFrame, keys: Sequence[str] = (), order: str | None = None) -> DataFrame:
    """Non-null returns, the last of each date by ``order`` (by value where there is none)."""
    last = Window.partitionBy(*keys, "date").orderBy(F.col(order or "ret").desc_nulls_last())
    rows = series.where("ret is not null").withColumn("_nth", F.row_number().over(last))
    return rows.where("_nth = 1").select(*keys, "date", "ret")


def relative_metrics(strategy: DataFrame, benchmarks: DataFrame, risk_free: float = 0.0, periods: int = 252) -> DataFrame:
    """One row for each key of ``benchmarks`` (``key, date, ret``) that shares LEAST_COMMON dates with
    ``strategy`` (``date, ret``)."""
    s = one_per_date(strategy).select("date", F.col("ret").alias("s"))
    rows = one_per_date(benchmarks, ["key"]).select("key", "date", F.col("ret").alias("b")).join(s, "date")
    path = _by_key().rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("_equity", F.product(1 + F.col("b")).over(path))
    rows = rows.withColumn("_dd", F.try_divide(F.col("_equity"), F.max("_equity").over(path)) - 1).withColumn("_d", F.col("s") - F.col("b"))
    root = F.sqrt(F.lit(float(periods)))
    n = F.count(F.lit(1))
    up, down = F.col("b") > 0, F.col("b") < 0

    def capture(side):
        return ratio(F.avg(F.when(side, F.col("s"))), F.avg(F.when(side, F.col("b"))))

    found = rows.groupBy("key").agg(
        n.alias("observations"),
        (F.product(1 + F.col("s")) - 1).alias("strategy_total_return"),
        (F.product(1 + F.col("b")) - 1).alias("benchmark_total_return"),
        (F.stddev_pop("b") * root).alias("benchmark_volatility"),
        over(F.avg("b") * periods - risk_free, F.stddev_pop("b") * root).alias("benchmark_sharpe"),
        F.min("_dd").alias("benchmark_max_drawdown"),
        # corr() fails on a constant series under ANSI arithmetic
        ratio(F.covar_pop("s", "b"), F.stddev_pop("s") * F.stddev_pop("b")).alias("correlation"),
        over(F.covar_pop("s", "b"), F.var_pop("b")).alias("beta"),
        (F.avg("s") * periods).alias("_s"),
        (F.avg("b") * periods).alias("_b"),
        (F.stddev_pop("_d") * root).alias("tracking_error"),
        over(F.avg("_d") * periods, F.stddev_pop("_d") * root).alias("information_ratio"),
        capture(up).alias("up_capture"),
        capture(down).alias("down_capture"),
    ).where(F.col("observations") >= LEAST_COMMON)
    def cagr(c: str):
        return F.when(F.col(c) > -1, F.pow(1 + F.col(c), periods / F.col("observations")) - 1)

    return found.select(
        "key",
        "observations",
        "strategy_total_return",
        "benchmark_total_return",
        cagr("strategy_total_return").alias("strategy_cagr"),
        cagr("benchmark_total_return").alias("benchmark_cagr"),
        "benchmark_volatility",
        "benchmark_sharpe",
        "benchmark_max_drawdown",
        finite(F.col("correlation")).alias("correlation"),
        "beta",
        (F.col("_s") - F.coalesce("beta", F.lit(0.0)) * F.col("_b")).alias("alpha_annualized"),
        "tracking_error",
        "information_ratio",
        "up_capture",
        "down_capture",
    )


def growth_curves(strategy: DataFrame, benchmarks: DataFrame) -> DataFrame:
    """``key, date, growth`` of the strategy and each benchmark inside the strategy's dates, each
    rebased to 1 at its first date there."""
    s = one_per_date(strategy).withColumn("key", F.lit("strategy"))
    span = s.agg(F.min("date").alias("_a"), F.max("date").alias("_b"))
    every = one_per_date(benchmarks, ["key"]).unionByName(s.select("key", "date", "ret"))
    grown = every.withColumn("_g", F.product(1 + F.col("ret")).over(_by_key().rowsBetween(Window.unboundedPreceding, 0)))
    inside = grown.join(F.broadcast(span)).where(F.col("date").between(F.col("_a"), F.col("_b")))
    first = F.first("_g").over(_by_key().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return inside.select("key", "date", F.try_divide(F.col("_g"), first).alias("growth"))


def aligned_curves(curves: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One column for each key by date; a date without a value stays null."""
    return curves.groupBy("date").pivot("key", list(keys)).agg(F.first("growth")).where(" or ".join(f"`{k}` is not null" for k in keys))


def common_date_curves(curves: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``key, date, growth`` on dates that all keys share, rebased to 1 at the first of them."""
    own = curves.where(F.col("key").isin(list(keys)))
    shared = own.groupBy("date").agg(F.countDistinct("key").alias("n")).where(F.col("n") == len(keys)).select("date")
    rows = own.join(shared, "date", "left_semi")
    first = F.first("growth").over(_by_key().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return rows.select("key", "date", F.try_divide(F.col("growth"), first).alias("growth"))


def benchmark_comparison(strategy: DataFrame, benchmarks: DataFrame, names: DataFrame | None = None, risk_free: float = 0.0) -> tuple[DataFrame, DataFrame]:
    """The summary of each benchmark and the curves of those that have one."""
    summary = relative_metrics(strategy, benchmarks, risk_free)
    kept = benchmarks.join(summary.select("key"), "key", "left_semi")
    if names is not None:
        summary = summary.join(names.select("key", F.col("name").alias("benchmark")), "key", "left")
    return summary, growth_curves(strategy, kept)
