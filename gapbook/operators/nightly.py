"""Nightly optimized books: the signal's candidates weighted each night by an optimizer, billed for
the changes from last night's drifted book."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gapbook.operators import optimizers as opt
from gapbook.operators import stacked
from gapbook.operators.backtest import compound
from gapbook.operators.features import FeatureSettings, build_features
from gapbook.operators.metrics import performance_metrics
from gapbook.operators.portfolio import cost_rates
from gapbook.operators.signals import candidates, top_n
from gapbook.sources.scratch import materialise

LEAST_ITERATIONS = 20
#: Days of the calendar whose books are weighted together.
NIGHTS = 64


@dataclass(frozen=True)
class NightlySettings:
    lookback_days: int = 63
    min_history: int = 40
    top_n: int = 25
    min_signal: float = 0.0
    estimation_days: int = 126
    initial_capital: float = 1_000_000.0
    fees_bps: float = 0.5
    slippage_bps: float = 1.0
    cash_rate: float = 0.0
    optimizer: opt.OptimizerSettings = field(default_factory=lambda: opt.OptimizerSettings(iterations=60, cvar_iterations=60))

    def __post_init__(self) -> None:
        """A night's optimizers take LEAST_ITERATIONS at least."""
        o = self.optimizer
        if min(o.iterations, o.cvar_iterations) < LEAST_ITERATIONS:
            more = replace(o, iterations=max(o.iterations, LEAST_ITERATIONS), cvar_iterations=max(o.cvar_iterations, LEAST_ITERATIONS))
            object.__setattr__(self, "optimizer", more)


def nightly_features(bars: DataFrame, s: NightlySettings) -> DataFrame:
    """The features that candidates and symbol costs rest on, with ``nth``, the number of the symbol's
    overnight returns up to each date."""
    so_far = F.count("overnight_return").over(Window.partitionBy("symbol").orderBy("date"))
    names = ("date", "symbol", "exit_date", "overnight_return", "next_overnight_return", "overnight_sharpe")
    return build_features(bars, FeatureSettings(s.lookback_days, s.min_history)).select(*names, so_far.alias("nth"))


def nightly_books(features: DataFrame, s: NightlySettings) -> DataFrame:
    """Each night's candidates with ``history``, their overnight returns of the last
    ``estimation_days`` calendar positions up to that night as ``array<struct<pos,ret>>``. The
    calendar leaves out dates on which no symbol has a return.

    Candidates are chosen first; each takes a slice of its symbol's one array of returns.
    """
    returns = features.where("overnight_return is not null")
    calendar = returns.select("date").distinct().withColumn("pos", F.row_number().over(Window.orderBy("date")))
    own = returns.join(calendar, "date").select("symbol", F.struct("pos", F.col("overnight_return").alias("ret")).alias("v"))
    arrays = own.groupBy("symbol").agg(F.sort_array(F.collect_list("v")).alias("v"))
    chosen = top_n(candidates(features, s.min_signal), s.top_n).join(calendar, "date", "left").join(arrays, "symbol", "left")
    n = F.lit(s.estimation_days)
    last = F.slice("v", F.greatest(F.lit(1), F.col("nth") - n + 1).cast("int"), F.least(F.col("nth"), n).cast("int"))
    history = F.filter(last, lambda x: x["pos"] > F.col("pos") - n)
    return chosen.select("date", "exit_date", "symbol", "overnight_sharpe", "next_overnight_return", "signal_rank", "pos", history.alias("history"))


def nightly_weights(books: DataFrame, s: NightlySettings, methods: Sequence[str] = opt.NIGHTLY) -> DataFrame:
    """``method, date, symbol, weight, fallback``: all methods of a night share its window, of at most
    ``top_n`` times ``estimation_days`` returns, and its moments; NIGHTS of them are a group, and take each
    step of a method together."""
    unknown = [m for m in methods if m not in opt.NIGHTLY]
    if unknown:
        raise ValueError(f"unknown methods: {', '.join(unknown)}")
    least, days = max(20, s.min_history), s.estimation_days

    def weigh(group: pa.Table) -> pa.Table:
        group = group.sort_by([("date", "ascending"), ("signal_rank", "ascending")]).combine_chunks()
        date, symbol = group.column("date"), group.column("symbol")
        night = np.unique(date.to_numpy().astype("datetime64[D]").astype(np.int64), return_inverse=True)[1]
        rank = np.arange(len(night)) - np.searchsorted(night, night)
        scores, pos = group.column("overnight_sharpe").to_numpy(), group.column("pos").to_pandas().fillna(0).to_numpy(np.int64)
        history = group.column("history").combine_chunks()
        many = pc.fill_null(pc.list_value_length(history), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        past = history.flatten()
        row = np.repeat(np.arange(len(night)), many)
        place = past.field("pos").to_numpy().astype(np.int64) - pos[row] + days - 1
        ret = past.field("ret").to_numpy()
        sizes = np.bincount(night)
        columns: dict[str, list] = {"method": [], "row": [], "weight": [], "fallback": []}
        for n in np.unique(sizes).tolist():
            # all nights of as many names in one stack
            nth = np.full(len(sizes), -1)
            nth[sizes == n] = np.arange(np.count_nonzero(sizes == n))
            own = np.flatnonzero(nth[night] >= 0)
            x = np.full((int((sizes == n).sum()), days, n), np.nan)
            mine = nth[night[row]] >= 0
            x[nth[night[row[mine]]], place[mine], rank[row[mine]]] = ret[mine]
            windows = stacked.Windows(x, ~np.isnan(x).any(axis=2))
            for m in methods:
                w, short = stacked.nightly_weights(windows, scores[own].reshape(-1, n), m, s.optimizer, least)
                columns["method"].append(np.repeat(np.array([m], object), len(own)))
                columns["row"].append(own)
                columns["weight"].append(w.ravel())
                columns["fallback"].append(np.repeat(short, n))
        found = {c: np.concatenate(v) for c, v in columns.items()}
        rows = pa.array(found["row"])
        return pa.table({"method": pa.array(found["method"], pa.string()), "date": date.take(rows), "symbol": symbol.take(rows), "weight": pa.array(found["weight"]), "fallback": pa.array(found["fallback"])})

    # nights come together by NIGHTS, whose steps are taken at once
    own = books.select("date", "symbol", "overnight_sharpe", "signal_rank", "pos", "history").withColumn("_nights", F.floor(F.unix_date("date") / NIGHTS))
    return own.groupBy("_nights").applyInArrow(weigh, "method string, date date, symbol string, weight double, fallback boolean")


@dataclass(frozen=True)
class NightlyResult:
    """daily results, metrics and the last night's book of each method."""

    daily: DataFrame
    metrics: DataFrame
    current_book: DataFrame


def nightly_daily(books: DataFrame, weights: DataFrame, rates: DataFrame, s: NightlySettings) -> DataFrame:
    """Daily results of each method. Changes are measured from last night's weights after their
    returns; names that leave are billed in full."""
    nights = books.select("date", "exit_date").groupBy("date").agg(F.max("exit_date").alias("exit_date"))
    nights = nights.withColumn("night", F.row_number().over(Window.orderBy("date")))
    held = weights.join(books.select("date", "symbol", F.col("next_overnight_return").alias("r")), ["date", "symbol"]).join(nights, "date")
    grown = 1 + F.sum(F.col("weight") * F.col("r")).over(Window.partitionBy("method", "night"))
    grown = F.when(F.abs(grown) < 1e-12, F.lit(1e-12)).otherwise(grown)
    drifted = held.select("method", (F.col("night") + 1).alias("night"), "symbol", (F.col("weight") * (1 + F.col("r")) / grown).alias("_old"))
    both = held.select("method", "night", "symbol", "weight", "r", "fallback").join(drifted, ["method", "night", "symbol"], "full_outer")
    change = F.abs(F.coalesce("weight", F.lit(0.0)) - F.coalesce("_old", F.lit(0.0)))
    rows = both.withColumn("_change", change).join(rates, "symbol", "left")
    days = rows.groupBy("method", "night").agg(
        F.sum(F.col("weight") * F.col("r")).alias("gross_return"),
        F.sum("_change").alias("turnover"),
        F.sum(F.col("_change") * F.coalesce("rate", F.lit(0.0))).alias("cost_return"),
        F.count_if(F.col("_change") > 1e-9).alias("trade_count"),
        F.count_if(F.abs("weight") > 1e-6).alias("positions"),
        F.sum("weight").alias("weight_sum"),
        F.coalesce(F.bool_or("fallback"), F.lit(False)).alias("optimizer_fallback"),
    )
    cash = F.greatest(F.lit(0.0), 1 - F.col("weight_sum"))
    # the night after the last holds nothing and is no day
    days = days.join(nights.withColumnRenamed("date", "signal_date"), "night").withColumn("cash_weight", cash)
    days = days.withColumn("net_return", F.col("gross_return") + F.col("cash_weight") * (s.cash_rate / 252) - F.col("cost_return"))
    days = days.withColumn("gross_exposure", F.col("weight_sum")).withColumn("round_trip_turnover", F.col("turnover"))
    return compound(days, s.initial_capital, ["method"])


def nightly_suite(bars: DataFrame, settings: NightlySettings | None = None, methods: Sequence[str] = opt.NIGHTLY) -> NightlyResult:
    """All methods over the same books. Symbol costs rest on the volatility of the whole history, as
    the books themselves do not."""
    s = settings or NightlySettings()
    features = materialise(nightly_features(bars, s), "nightly-features")
    books = materialise(nightly_books(features, s), "books")
    weights = materialise(nightly_weights(books, s, methods), "book-weights")
    books = books.drop("history")
    returns = features.select("symbol", F.col("overnight_return").alias("ret")).where("ret is not null")
    daily = materialise(nightly_daily(books, weights, cost_rates(returns, s.fees_bps, s.slippage_bps), s), "nightly-days")
    extra = daily.groupBy("method").agg(
        F.sum("cost_return").alias("cost_return_total"),
        F.avg("turnover").alias("average_turnover"),
        F.avg("positions").alias("average_positions"),
        F.count_if("optimizer_fallback").alias("optimizer_fallback_days"),
        F.avg(F.col("optimizer_fallback").cast("int")).alias("optimizer_fallback_share"),
    )
    metrics = performance_metrics(daily, s.initial_capital, runs=["method"]).join(extra, "method")
    last = books.agg(F.max("date").alias("date"))
    book = books.join(F.broadcast(last), "date", "left_semi").select("date", "symbol", "overnight_sharpe", "signal_rank")
    current = weights.join(book, ["date", "symbol"]).select("method", "symbol", F.col("weight").alias("optimizer_weight"), "overnight_sharpe", "signal_rank")
    return NightlyResult(daily, metrics, current.orderBy("method", F.col("optimizer_weight").desc(), "symbol"))


def method_curves(daily: DataFrame) -> DataFrame:
    """``method, date, equity``."""
    return daily.select("method", F.col("exit_date").alias("date"), F.col("ending_equity").alias("equity"))
