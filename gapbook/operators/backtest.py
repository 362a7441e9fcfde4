"""The overnight backtest: daily results, blotter and equity curve of each run.

Without limits equity is a running product. Limits on capital or on a share of the traded volume
make each day depend on the equity before, so a run is then folded day by day: one group for each
run, of days times names in a book at most, or one for each block of a run's days.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gapbook.operators.costs import CostSettings, with_cost_rate
from gapbook.sources.scratch import discard, materialise


@dataclass(frozen=True)
class BacktestSettings:
    initial_capital: float = 1_000_000.0
    costs: CostSettings = field(default_factory=CostSettings)
    capital_capacity: float | None = None
    max_adv_participation: float | None = None
    cash_rate: float = 0.0

    @property
    def limited(self) -> bool:
        return bool((self.capital_capacity and self.capital_capacity > 0) or self.max_adv_participation)


def clean_signals(signals: DataFrame, runs: Sequence[str] = ()) -> DataFrame:
    """Missing weights, returns and volumes count as 0."""
    missing = [c for c in ("signal_date", "exit_date", "symbol", "weight", "next_overnight_return") if c not in signals.columns]
    if missing:
        raise ValueError(f"signals: missing columns {', '.join(missing)}")

    def number(name: str, default: float = 0.0):
        return F.coalesce(F.col(name).cast("double"), F.lit(default)) if name in signals.columns else F.lit(default)

    return signals.select(
        *runs,
        F.to_date("signal_date").alias("signal_date"),
        F.to_date("exit_date").alias("exit_date"),
        "symbol",
        number("weight").alias("weight"),
        number("next_overnight_return").alias("overnight_return"),
        number("adv_dollars").alias("adv_dollars"),
        number("signal_rank").cast("int").alias("signal_rank"),
        number("overnight_sharpe").alias("overnight_sharpe"),
    )


def _roll_up(clean: DataFrame, settings: BacktestSettings, runs: Sequence[str]) -> DataFrame:
    day = clean.groupBy(*runs, "signal_date").agg(
        F.max("exit_date").alias("exit_date"),
        F.sum(F.abs("weight")).alias("gross_exposure"),
        F.sum(F.col("weight") * F.col("overnight_return")).alias("gross_return"),
        F.count(F.lit(1)).alias("trade_count"),
    )
    return with_cost_rate(day, settings.costs).withColumn("cost_return", 2 * F.col("gross_exposure") * F.col("cost_rate_bps") / 10_000)


def compound(daily: DataFrame, capital: float, runs: Sequence[str] = (), order: Sequence[str] = ("signal_date",)) -> DataFrame:
    """Adds starting and ending equity of ``net_return`` along each run."""
    path = Window.partitionBy(*runs or [F.lit(1)]).orderBy(*order)
    grown = F.lit(float(capital)) * F.product(1 + F.col("net_return")).over(path.rowsBetween(Window.unboundedPreceding, 0))
    rows = daily.withColumn("ending_equity", grown)
    return rows.withColumn("starting_equity", F.coalesce(F.lag("ending_equity").over(path), F.lit(float(capital))))


def fold_days(rows: pd.DataFrame, settings: BacktestSettings, start: float) -> tuple[pd.DataFrame, float]:
    """The days of one run in order from an equity on: what is deployed, capped weights rolled up, and
    equity; and how the last equity changes with the first (the slope of a line between the places where a
    limit begins to bind)."""
    rows = rows.sort_values(["signal_date", "symbol"])
    equity, slope, out = float(start), 1.0, []
    part, capacity = settings.max_adv_participation, settings.capital_capacity
    for date, day in rows.groupby("signal_date", sort=True):
        start = equity
        bound = bool(capacity and 0 < capacity < start)
        deployed = min(start, capacity) if capacity and capacity > 0 else start
        w, r, rate = day["weight"].to_numpy(float), day["overnight_return"].to_numpy(float), day["cost_rate_bps"].iloc[0]
        free = np.ones(len(w), bool)
        if part and deployed > 0:
            most = day["adv_dollars"].to_numpy(float) * part / deployed
            free, w = w <= most, np.minimum(w, most)
        exposure, gross = np.abs(w).sum(), float(w @ r)
        cost = 2 * exposure * rate / 10_000
        gain = deployed * (gross - cost) + (start - deployed) * settings.cash_rate / 252
        equity = start + gain
        # what names below their caps add for each further dollar; all cash earns the cash rate
        slope *= 1 + (settings.cash_rate / 252 if bound else float(w[free] @ r[free]) - 2 * np.abs(w[free]).sum() * rate / 10_000)
        out.append((date, max(day["exit_date"]), exposure, gross, len(day), rate, cost, start, equity, deployed, gain / start if start > 0 else 0.0))
    names = ["signal_date", "exit_date", "gross_exposure", "gross_return", "trade_count", "cost_rate_bps", "cost_return", "starting_equity", "ending_equity", "deployed_capital", "net_return"]
    return pd.DataFrame(out, columns=names), slope


def fold_limits(rows: pd.DataFrame, settings: BacktestSettings) -> pd.DataFrame:
    """The days of one whole run."""
    return fold_days(rows, settings, settings.initial_capital)[0]


def _fold_in_blocks(rated: DataFrame, s: BacktestSettings, keys: list[str], days: int) -> DataFrame:
    """The days of runs of any length, each block of ``days`` days in a task of its own.

    Equity after a block is a line in the equity before it, between the places where limits begin to bind.
    All blocks are folded from a guess; along each run, ends and slopes then tell better guesses, and the
    true ones where no such place lies between. Blocks are folded again until no guess moves.
    """
    names = ", ".join(f"{k} {t}" for k, t in rated.select(*keys).dtypes)
    calendar = rated.select(*keys, "signal_date").distinct()
    nth = F.row_number().over(Window.partitionBy(*keys).orderBy("signal_date")) - 1  # a row a day
    calendar = calendar.withColumn("_block", F.floor(nth / days).cast("int"))
    rows = materialise(rated.join(calendar, [*keys, "signal_date"]), "fold-blocks")
    starts = materialise(rows.select(*keys, "_block").distinct().withColumn("_start", F.lit(float(s.initial_capital))), "fold-starts")
    by = [*keys, "_block"]

    def ends(key: tuple, own: pd.DataFrame) -> pd.DataFrame:
        start = float(own["_start"].iloc[0])
        found, slope = fold_days(own, s, start)
        return pd.DataFrame([[*key, start, found["ending_equity"].iloc[-1], slope]], columns=[*by, "_start", "_end", "_slope"])

    def chained(key: tuple, blocks: pd.DataFrame) -> pd.DataFrame:
        blocks = blocks.sort_values("_block")
        out, here = [], float(s.initial_capital)
        for b, start, end, slope in zip(blocks["_block"], blocks["_start"], blocks["_end"], blocks["_slope"], strict=True):
            out.append([*key, b, here, abs(here - start) > 1e-13 * max(abs(here), 1.0)])
            here = end + slope * (here - start)
        return pd.DataFrame(out, columns=[*by, "_start", "_moved"])

    while True:
        told = rows.join(starts.select(*by, "_start"), by).groupBy(*by).applyInPandas(ends, f"{names}, _block int, _start double, _end double, _slope double")
        # a row a block
        after = materialise(told.groupBy(*keys).applyInPandas(chained, f"{names}, _block int, _start double, _moved boolean"), "fold-starts")
        discard(starts)
        starts = after
        if starts.where("_moved").isEmpty():
            break

    def fold(key: tuple, own: pd.DataFrame) -> pd.DataFrame:
        found = fold_days(own, s, float(own["_start"].iloc[0]))[0]
        for name, value in zip(keys, key, strict=False):
            found.insert(0, name, value)
        return found

    backward = ", ".join(f"{k} {t}" for k, t in reversed(rated.select(*keys).dtypes))
    return rows.join(starts.select(*by, "_start"), by).groupBy(*by).applyInPandas(fold, f"{backward}, {_FOLD}")


_FOLD = "signal_date date, exit_date date, gross_exposure double, gross_return double, trade_count long, cost_rate_bps double, cost_return double, starting_equity double, ending_equity double, deployed_capital double, net_return double"
DAILY = (
    "signal_date",
    "exit_date",
    "starting_equity",
    "ending_equity",
    "gross_return",
    "cost_return",
    "net_return",
    "gross_exposure",
    "round_trip_turnover",
    "trade_count",
    "cost_rate_bps",
    "deployed_capital",
    "cash_weight",
)


def run_backtest(signals: DataFrame, settings: BacktestSettings | None = None, runs: Sequence[str] = (), block_days: int | None = None) -> DataFrame:
    """DAILY for each run and signal date. Days of a run with limits follow one another, in one task; with
    ``block_days``, blocks of so many days are tasks of their own."""
    s = settings or BacktestSettings()
    clean = clean_signals(signals, runs)
    if s.limited:
        rated = with_cost_rate(clean, s.costs)
        keys = list(runs)
        if block_days is not None:
            rated, keys = (rated, keys) if keys else (rated.withColumn("_all", F.lit(1)), ["_all"])
            return _told(_fold_in_blocks(rated, s, keys, block_days), runs)

        def fold(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
            days = fold_limits(rows, s)
            for name, value in zip(keys or ["_all"], key, strict=True):
                days.insert(0, name, value)
            return days

        kinds = {f.name: f.dataType.simpleString() for f in rated.schema}
        if keys:
            schema = ", ".join([*(f"{k} {kinds[k]}" for k in reversed(keys)), _FOLD])
            daily = rated.groupBy(*keys).applyInPandas(fold, schema)
        else:
            daily = rated.withColumn("_all", F.lit(1)).groupBy("_all").applyInPandas(fold, f"_all int, {_FOLD}")
    else:
        daily = _roll_up(clean, s, runs).withColumn("net_return", F.col("gross_return") - F.col("cost_return"))
        daily = compound(daily, s.initial_capital, runs).withColumn("deployed_capital", F.col("starting_equity"))
    return _told(daily, runs)


def _told(daily: DataFrame, runs: Sequence[str]) -> DataFrame:
    """DAILY, with turnover and cash."""
    start = F.col("starting_equity")
    return daily.withColumn("round_trip_turnover", 2 * F.col("gross_exposure")).withColumn(
        "cash_weight", F.when(start > 0, (start - F.col("deployed_capital")) / start).otherwise(0.0)
    ).select(*runs, *DAILY)


def trade_blotter(signals: DataFrame, daily: DataFrame, settings: BacktestSettings | None = None, runs: Sequence[str] = ()) -> DataFrame:
    """Every trade with its notional, profit and share of the day's cost."""
    s = settings or BacktestSettings()
    days = daily.select(*runs, "signal_date", "deployed_capital", "gross_exposure", "cost_return")
    rows = clean_signals(signals, runs).join(days, [*runs, "signal_date"])
    if s.max_adv_participation:
        allowed = F.try_divide(F.col("adv_dollars") * s.max_adv_participation, "deployed_capital")
        rows = rows.withColumn("weight", F.when(F.col("deployed_capital") > 0, F.least("weight", allowed)).otherwise(F.col("weight")))
    notional = F.col("deployed_capital") * F.col("weight")
    share = F.coalesce(F.try_divide(F.abs("weight"), "gross_exposure"), F.lit(0.0))
    return rows.select(
        *runs,
        "signal_date",
        "exit_date",
        "symbol",
        "weight",
        "overnight_return",
        notional.alias("notional"),
        (notional * F.col("overnight_return")).alias("gross_pnl"),
        (share * F.col("deployed_capital") * F.col("cost_return")).alias("cost"),
        (notional * F.col("overnight_return") - share * F.col("deployed_capital") * F.col("cost_return")).alias("net_pnl"),
        "signal_rank",
        "overnight_sharpe",
    )


def drawdown(value: str, partition: Sequence[str], order: str, floor: float | None = None):
    """Distance of a path from its running peak; ``floor`` counts as a point before the first."""
    path = Window.partitionBy(*partition or [F.lit(1)]).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    peak = F.max(value).over(path)
    peak = peak if floor is None else F.greatest(peak, F.lit(float(floor)))
    return F.try_divide(F.col(value), peak) - 1


def equity_curve(daily: DataFrame, runs: Sequence[str] = ()) -> DataFrame:
    """``date, equity, drawdown`` by exit date; the peak begins with the first ending equity."""
    return daily.withColumn("drawdown", drawdown("ending_equity", runs, "signal_date")).select(
        *runs, F.col("exit_date").alias("date"), F.col("ending_equity").alias("equity"), "drawdown"
    )


def curve_range(curve: DataFrame, years: int, runs: Sequence[str] = ()) -> DataFrame:
    """The last ``years`` of 365 days of each curve."""
    last = F.max("date").over(Window.partitionBy(*runs)) if runs else None
    if last is not None:
        return curve.withColumn("_last", last).where(F.col("date") >= F.date_sub("_last", 365 * years)).drop("_last")
    end = curve.agg(F.max("date").alias("_last"))
    return curve.join(F.broadcast(end)).where(F.col("date") >= F.date_sub("_last", 365 * years)).drop("_last")
