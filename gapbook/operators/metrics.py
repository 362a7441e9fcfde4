"""Performance metrics of daily results, one row for each run."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gapbook.operators.quantiles import exact_quantiles

from gapbook.functions.columns import finite, ratio, sample_kurtosis, sample_skewness
from gapbook.operators.backtest import drawdown

HORIZONS = {"1y": 1, "3y": 3, "5y": 5}
_RATIOS = ("sharpe", "sortino", "calmar")


def annual_return(r: str, periods: int) -> Column:
    return F.avg(r) * periods


def annual_volatility(r: str, periods: int) -> Column:
    return F.stddev_pop(r) * F.sqrt(F.lit(float(periods)))


def downside_deviation(r: str, risk_free: float, periods: int) -> Column:
    """Root mean square of what falls short of the rate, over all rows."""
    short = F.least(F.col(r) - risk_free / periods, F.lit(0.0))
    return F.sqrt(F.avg(short * short)) * F.sqrt(F.lit(float(periods)))


def over(top: Column, bottom: Column) -> Column:
    """A ratio, null unless the bottom is positive."""
    return F.when(bottom > 0, top / bottom)


def var_cvar(returns: DataFrame, r: str = "ret", alpha: float = 0.95, runs: Sequence[str] = (), buffer: int | None = None) -> DataFrame:
    """``var, cvar`` of each run: the (1 - alpha) quantile by linear interpolation and the mean of
    what is at it or below. Nothing gives 0 and 0. With a ``buffer`` runs may be of any length: no more
    than so many values are held for one."""
    rows = returns.where(F.col(r).isNotNull())
    if buffer is None:
        quantile = rows.groupBy(*runs).agg(F.percentile(r, F.lit(1 - alpha)).alias("var"))
    else:
        quantile = exact_quantiles(rows, r, [1 - alpha], runs, buffer).select(*runs, F.col("quantile").alias("var"))
    joined = rows.join(quantile, list(runs)) if runs else rows.join(F.broadcast(quantile))
    found = joined.groupBy(*runs).agg(F.first("var").alias("var"), F.avg(F.when(F.col(r) <= F.col("var"), F.col(r))).alias("cvar"))
    return found.select(*runs, F.coalesce("var", F.lit(0.0)).alias("var"), F.coalesce("cvar", "var", F.lit(0.0)).alias("cvar"))


def drawdown_series(path: DataFrame, value: str, order: str, runs: Sequence[str] = ()) -> DataFrame:
    """``path`` with ``drawdown`` from its own running peak."""
    return path.withColumn("drawdown", drawdown(value, runs, order))


def trailing_ratios(daily: DataFrame, risk_free: float = 0.0, periods: int = 252, runs: Sequence[str] = ()) -> DataFrame:
    """Sharpe, Sortino and Calmar ratios of the last ``periods * k`` rows of each run by exit date,
    null where a run is shorter."""
    keys = list(runs)
    rows = daily.where("net_return is not null and ending_equity is not null")
    back = Window.partitionBy(*keys or [F.lit(1)]).orderBy(F.col("exit_date").desc(), F.col("signal_date").desc())
    rows = rows.withColumn("_back", F.row_number().over(back)).where(F.col("_back") <= periods * max(HORIZONS.values()))
    spans = F.array(*(F.struct(F.lit(k).alias("horizon"), F.lit(int(periods * y)).alias("size")) for k, y in HORIZONS.items()))
    rows = rows.select("*", F.inline(spans)).where(F.col("_back") <= F.col("size"))
    by = [*keys, "horizon", "size"]
    first = F.max_by(F.struct("starting_equity", "net_return", "ending_equity"), "_back").over(Window.partitionBy(*by))
    rows = rows.withColumn("_first", first)
    implied = F.when(1 + F.col("_first.net_return") > 0, F.col("_first.ending_equity") / (1 + F.col("_first.net_return")))
    rows = rows.withColumn("_start", F.when(F.col("_first.starting_equity") > 0, F.col("_first.starting_equity")).otherwise(implied))
    forward = Window.partitionBy(*by).orderBy(F.col("_back").desc()).rowsBetween(Window.unboundedPreceding, 0)
    peak = F.greatest(F.max("ending_equity").over(forward), F.col("_start"))
    rows = rows.withColumn("_dd", F.try_divide(F.col("ending_equity"), peak) - 1)
    excess = annual_return("net_return", periods) - risk_free
    end = F.min_by("ending_equity", "_back")
    start = F.first("_start")
    cagr = F.when((start > 0) & (end > 0), F.pow(end / start, periods / F.count(F.lit(1))) - 1)
    worst = F.least(F.min("_dd"), F.lit(0.0))
    found = rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("_n"),
        over(excess, annual_volatility("net_return", periods)).alias("sharpe"),
        over(excess, downside_deviation("net_return", risk_free, periods)).alias("sortino"),
        F.when(worst < 0, cagr / F.abs(worst)).alias("calmar"),
    ).where((F.col("_n") >= F.col("size")) & (F.col("size") >= 2))
    wide = [F.max(F.when(F.col("horizon") == h, F.col(m))).alias(f"rolling_{m}_{h}") for m in _RATIOS for h in HORIZONS]
    return found.groupBy(*keys).agg(*wide)


def performance_metrics(
    daily: DataFrame,
    capital: float,
    risk_free: float = 0.0,
    periods: int = 252,
    runs: Sequence[str] = (),
    all_runs: DataFrame | None = None,
) -> DataFrame:
    """All metrics of each run, NaN and infinities as null.

    ``daily`` has signal_date, exit_date, net_return, ending_equity, gross_return, cost_return,
    gross_exposure, trade_count and round_trip_turnover. Runs of ``all_runs`` without a day keep
    their capital and 0 observations.
    """
    keys, capital = list(runs), float(capital)
    rows = daily.withColumn("_dd", drawdown("ending_equity", keys, "signal_date", floor=capital))
    r = "net_return"
    quantile = rows.groupBy(*keys).agg(F.percentile(r, 0.05).alias("_q"))
    rows = rows.join(quantile, keys) if keys else rows.join(F.broadcast(quantile))
    start, end, n = F.min("signal_date"), F.max("exit_date"), F.count(r)
    days = F.datediff(end, start)
    years = F.when(days > 0, F.greatest(days / 365.25, F.lit(1.0 / periods))).otherwise(n / periods)
    final = F.max_by("ending_equity", "signal_date")
    excess, worst = annual_return(r, periods) - risk_free, F.least(F.min("_dd"), F.lit(0.0))
    gains, losses = F.sum(F.when(F.col(r) > 0, F.col(r))), F.sum(F.when(F.col(r) < 0, F.col(r)))
    found = rows.groupBy(*keys).agg(
        final.alias("final_equity"),
        (final / capital - 1).alias("total_return"),
        F.when(years > 0, F.pow(final / capital, ratio(F.lit(1.0), years)) - 1).otherwise(0.0).alias("cagr"),
        annual_return(r, periods).alias("annualized_return"),
        annual_volatility(r, periods).alias("annualized_volatility"),
        over(excess, annual_volatility(r, periods)).alias("sharpe"),
        over(excess, downside_deviation(r, risk_free, periods)).alias("sortino"),
        worst.alias("max_drawdown"),
        F.avg(F.when(F.col(r) > 0, 1.0).otherwise(0.0)).alias("win_rate"),
        F.avg(r).alias("average_daily_return"),
        F.max(r).alias("best_day"),
        F.min(r).alias("worst_day"),
        F.first("_q").alias("var_95"),
        F.coalesce(F.avg(F.when(F.col(r) <= F.col("_q"), F.col(r))), F.first("_q")).alias("cvar_95"),
        sample_skewness(r).alias("skew"),
        sample_kurtosis(r).alias("kurtosis"),
        F.when(F.abs(losses) > 0, F.coalesce(gains, F.lit(0.0)) / F.abs(losses)).alias("profit_factor"),
        F.coalesce(F.avg(F.when(F.col(r) > 0, F.col(r))), F.lit(0.0)).alias("average_gain"),
        F.coalesce(F.avg(F.when(F.col(r) < 0, F.col(r))), F.lit(0.0)).alias("average_loss"),
        F.avg("gross_exposure").alias("exposure"),
        F.avg("trade_count").alias("average_trade_count"),
        F.avg("round_trip_turnover").alias("average_round_trip_turnover"),
        F.coalesce(F.sum("gross_return"), F.lit(0.0)).alias("gross_return_before_costs"),
        F.coalesce(F.sum("cost_return"), F.lit(0.0)).alias("total_cost_return"),
        n.alias("observations"),
        years.alias("elapsed_years"),
        F.when(days > 0, start).alias("start_date"),
        F.when(days > 0, end).alias("end_date"),
    )
    found = found.withColumn("calmar", F.when(F.col("max_drawdown") < 0, F.col("cagr") / F.abs("max_drawdown")))
    trailing = trailing_ratios(daily, risk_free, periods, keys)
    found = found.join(trailing, keys, "left") if keys else found.join(F.broadcast(trailing), how="left")
    if all_runs is not None:
        found = all_runs.select(*keys).distinct().join(found, keys, "left")
    numbers = [c for c, kind in found.dtypes if kind == "double" and c not in keys]
    found = found.withColumns({c: finite(F.col(c)) for c in numbers})
    return found.withColumns(
        {
            "initial_capital": F.lit(capital),
            "final_equity": F.coalesce("final_equity", F.when(F.coalesce("observations", F.lit(0)) == 0, F.lit(capital))),
            "observations": F.coalesce("observations", F.lit(0)),
            "elapsed_years": F.coalesce("elapsed_years", F.lit(0.0)),
        }
    )
