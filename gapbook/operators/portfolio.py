"""Estimation sets, moments, costs and portfolio suites on long returns ``date, symbol, ret``."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field, replace

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gapbook.operators import optimizers as opt
from gapbook.operators.backtest import compound
from gapbook.operators.metrics import performance_metrics
from gapbook.operators.quantiles import exact_quantiles
from gapbook.operators.solver import Blocks
from gapbook.operators.solver import suite_weights as solver_weights
from gapbook.sources.scratch import materialise

# Fixed values of the estimation set: rungs of coverage, recent dates, least and most observations.
LADDER = (0.98, 0.95, 0.90, 0.80, 0.70, 0.60)
RECENT, FLOOR, CEILING = 10, 20, 252
#: Symbols up to which a covariance goes by pairs; symbols in a block beyond, and pairs of blocks whose
#: sums a task holds.
PAIR_SYMBOLS, BLOCK_SYMBOLS, HELD_BLOCKS = 100, 128, 64
#: Numbers of returns, and of covariances, up to which one task weights a whole set (32 MB each).
TASK_CELLS = 1 << 22
#: A rebalance that moves no more than this has not turned the book over: what rounding moves counts as nothing.
NO_TURN = 1e-9
PERIODS = {"monthly": "month", "quarterly": "quarter", "annually": "year"}
LOWER_IS_BETTER = ("volatility", "var_95", "cvar_95", "max_weight")


@dataclass(frozen=True)
class PortfolioSettings:
    optimizer: opt.OptimizerSettings = field(default_factory=opt.OptimizerSettings)
    initial_capital: float = 1_000_000.0
    fees_bps: float = 0.0
    slippage_bps: float = 0.0
    risk_free: float = 0.0


# -- estimation sets


def estimation_set(returns: DataFrame, filter_symbols: bool = False, row_coverage: float = 0.75) -> tuple[DataFrame, DataFrame]:
    """Returns on dates where every kept symbol has one, and a row of metadata.

    With ``filter_symbols`` and more than two symbols the set starts at the first date that
    ``row_coverage`` of the symbols share, and keeps the symbols that cover enough of it, have enough
    returns and are present lately: by the highest rung of LADDER that leaves two.
    """
    rows = materialise(returns.where("ret is not null").select("date", "symbol", "ret"), "returns")
    names = rows.select("symbol").distinct()
    size = names.agg(F.count(F.lit(1)).alias("input_symbols"))
    per_date = rows.groupBy("date").agg(F.count(F.lit(1)).alias("n")).join(F.broadcast(size))
    totals = per_date.agg(
        F.count(F.lit(1)).alias("input_observations"),
        F.coalesce(F.first("input_symbols"), F.lit(0)).alias("input_symbols"),
        F.min(F.when(F.col("n") >= row_coverage * F.col("input_symbols"), F.col("date"))).alias("coverage_start_date"),
    )
    kept, rung = names, None
    if filter_symbols:
        active = F.col("input_symbols") > 2
        begin = F.coalesce(F.when(active, F.col("coverage_start_date")), F.to_date(F.lit("0001-01-01")))
        work = rows.join(F.broadcast(totals)).where(F.col("date") >= begin)
        dates = work.select("date").distinct().withColumn("_back", F.row_number().over(Window.orderBy(F.col("date").desc())))
        length = dates.agg(F.count(F.lit(1)).alias("length"))
        needed = F.least(F.lit(CEILING), F.greatest(F.lit(FLOOR), F.floor(F.col("length") * 0.05)))
        per_symbol = (
            work.join(F.broadcast(dates), "date")
            .groupBy("symbol")
            .agg(F.count(F.lit(1)).alias("n"), F.min("_back").alias("_back"), F.first("input_symbols").alias("input_symbols"))
            .join(F.broadcast(length))
            .where((F.col("n") >= needed) & (F.col("_back") <= RECENT))
        )
        rungs = F.filter(F.array(*map(F.lit, LADDER)), lambda t: F.col("n") / F.col("length") >= t)
        fits = per_symbol.select("symbol", "input_symbols", F.explode(rungs).alias("rung"))
        chosen = fits.groupBy("rung").agg(F.count(F.lit(1)).alias("_n")).where("_n >= 2").agg(F.max("rung").alias("_rung"))
        own = fits.join(F.broadcast(chosen), F.col("rung") == F.col("_rung")).where(active).select("symbol")
        none = own.agg(F.count(F.lit(1)).alias("_kept"))
        kept = names.join(own.withColumn("_own", F.lit(1)), "symbol", "left").join(F.broadcast(none)).where("_own = 1 or _kept = 0").select("symbol")
        rows = work.select("date", "symbol", "ret")
        rung = chosen
    number = kept.agg(F.count(F.lit(1)).alias("_symbols"))
    own = rows.join(F.broadcast(kept), "symbol", "left_semi")
    whole = own.groupBy("date").agg(F.count(F.lit(1)).alias("_n")).join(F.broadcast(number)).where("_n = _symbols").select("date")
    complete = materialise(own.join(F.broadcast(whole), "date", "left_semi").select("date", "symbol", "ret"), "complete")
    excluded = names.join(kept, "symbol", "left_anti").agg(F.sort_array(F.collect_list("symbol")).alias("excluded_symbols"))
    span = complete.groupBy("date").agg(F.count(F.lit(1)).alias("n")).agg(
        F.count(F.lit(1)).alias("output_observations"), F.coalesce(F.max("n"), F.lit(0)).alias("output_symbols"), F.min("date").alias("start_date"), F.max("date").alias("end_date")
    )
    meta = totals.join(excluded).join(span)
    if rung is not None:
        meta = meta.join(rung.select(F.col("_rung").alias("symbol_coverage_threshold")))
    else:
        meta = meta.withColumn("coverage_start_date", F.lit(None).cast("date"))
    return complete, meta


def last_dates(returns: DataFrame, n: int) -> DataFrame:
    """The last ``n`` dates."""
    last = returns.select("date").distinct().orderBy(F.col("date").desc()).limit(n)
    return returns.join(F.broadcast(last), "date", "left_semi").select("date", "symbol", "ret")


# -- moments


def expected_returns(complete: DataFrame, method: str = "mean", buffer: int | None = None) -> DataFrame:
    """``symbol, mu``: mean, median, or mean of returns clipped to their 2 % and 98 % quantiles. With a
    ``buffer`` no more than so many of a symbol's returns are held for a quantile."""
    by = complete.groupBy("symbol")
    if method == "mean":
        return by.agg(F.avg("ret").alias("mu"))
    if method == "median":
        if buffer is not None:
            return exact_quantiles(complete, "ret", [0.5], ["symbol"], buffer).select("symbol", F.col("quantile").alias("mu"))
        return by.agg(F.percentile("ret", 0.5).alias("mu"))
    if method != "winsorized":
        raise ValueError("method must be mean, median or winsorized")
    if buffer is None:
        ends = by.agg(F.percentile("ret", F.array(F.lit(0.02), F.lit(0.98))).alias("q"))
    else:
        ends = exact_quantiles(complete, "ret", [0.02, 0.98], ["symbol"], buffer).groupBy("symbol").agg(F.array(F.min("quantile"), F.max("quantile")).alias("q"))
    clipped = F.least(F.greatest("ret", F.col("q")[0]), F.col("q")[1])
    return complete.join(ends, "symbol").groupBy("symbol").agg(F.avg(clipped).alias("mu"))


def _with_jitter(pairs: DataFrame) -> DataFrame:
    diagonal = pairs.where("a = b").agg(F.greatest(F.avg("cov") * 1e-8, F.lit(1e-10)).alias("_j"))
    return pairs.join(F.broadcast(diagonal)).select("a", "b", F.when(F.col("a") == F.col("b"), F.col("cov") + F.col("_j")).otherwise(F.col("cov")).alias("cov"))


def covariance(complete: DataFrame) -> DataFrame:
    """``a, b, cov`` with a <= b: by pairs up to PAIR_SYMBOLS symbols, by blocks beyond."""
    few = complete.select("symbol").distinct().limit(PAIR_SYMBOLS + 1).count() <= PAIR_SYMBOLS
    return covariance_pairs(complete) if few else covariance_blocks(complete)


def covariance_pairs(complete: DataFrame) -> DataFrame:
    """``a, b, cov`` with a <= b, by joining dates to themselves: for up to about a hundred symbols."""
    left = complete.select("date", F.col("symbol").alias("a"), F.col("ret").alias("x"))
    right = complete.select("date", F.col("symbol").alias("b"), F.col("ret").alias("y"))
    pairs = left.join(right, "date").where("a <= b").groupBy("a", "b").agg(F.covar_samp("x", "y").alias("cov"))
    return _with_jitter(pairs)


def covariance_blocks(complete: DataFrame, block: int = BLOCK_SYMBOLS) -> DataFrame:
    """The same for wide universes: symbols are numbered and dealt into blocks, each date is one vector
    for each block, and tasks add up the products of their pairs of vectors. A task holds the sums of
    HELD_BLOCKS pairs of blocks at most; partial sums meet by pair of symbols."""
    numbers = complete.select("symbol").distinct().withColumn("i", F.row_number().over(Window.orderBy("symbol")) - 1)
    numbers = materialise(numbers, "symbol-numbers")
    mean = complete.groupBy("symbol").agg(F.avg("ret").alias("_m")).join(numbers, "symbol")
    centred = complete.join(mean, "symbol").select("date", "i", (F.col("ret") - F.col("_m")).alias("c"))
    vectors = centred.groupBy("date", F.floor(F.col("i") / block).cast("int").alias("part")).agg(F.sort_array(F.collect_list(F.struct("i", "c"))).alias("v"))
    vectors = vectors.select("date", "part", F.transform("v", lambda s: s["c"]).alias("v"))
    other = vectors.select("date", F.col("part").alias("other"), F.col("v").alias("w"))
    pairs = vectors.join(other, "date").where("part <= other").select("part", "other", "v", "w")

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[tuple[int, int], list] = {}

        def table() -> pd.DataFrame:
            out = []
            for (p, q), (gram, rows) in sums.items():
                i, j = np.indices(gram.shape).reshape(2, -1)
                i, j = i + p * block, j + q * block
                upper = i <= j
                out.append(pd.DataFrame({"i": i[upper], "j": j[upper], "s": gram.ravel()[upper], "n": rows}))
            sums.clear()
            return pd.concat(out)

        for batch in batches:
            for (p, q), rows in batch.groupby(["part", "other"]):
                x, y = np.array(rows["v"].tolist(), float), np.array(rows["w"].tolist(), float)
                held = sums.setdefault((p, q), [0.0, 0])
                held[0], held[1] = held[0] + x.T @ y, held[1] + len(rows)
                if len(sums) > HELD_BLOCKS:
                    yield table()
        if sums:
            yield table()

    sums = pairs.mapInPandas(partial, "i long, j long, s double, n long").groupBy("i", "j").agg((F.sum("s") / (F.sum("n") - 1)).alias("cov"))
    named = sums.join(numbers.select(F.col("i"), F.col("symbol").alias("a")), "i").join(numbers.select(F.col("i").alias("j"), F.col("symbol").alias("b")), "j")
    return _with_jitter(named.select("a", "b", "cov"))


# -- costs and paths


def cost_rates(returns: DataFrame, fees_bps: float, slippage_bps: float, by: Sequence[str] = ()) -> DataFrame:
    """``symbol, rate``: fees, and slippage scaled by the symbol's volatility over the mean positive
    volatility, between a quarter and four times."""
    fees, slip = max(fees_bps, 0.0) / 10_000, max(slippage_bps, 0.0) / 10_000
    vols = returns.groupBy(*by, "symbol").agg(F.stddev_pop("ret").alias("_v"))
    mean = vols.groupBy(*by).agg(F.avg(F.when(F.col("_v") > 0, F.col("_v"))).alias("_m"))
    vols = vols.join(mean, list(by)) if by else vols.join(F.broadcast(mean))
    scale = F.greatest(F.lit(0.25), F.least(F.lit(4.0), F.try_divide("_v", "_m")))
    scale = F.when(F.col("_v").isNull() | F.col("_m").isNull(), 1.0).otherwise(scale)
    return vols.select(*by, "symbol", (F.lit(fees) + F.lit(slip) * scale).alias("rate"))


def daily_drift(held: DataFrame, by: Sequence[str] = ("portfolio",)) -> DataFrame:
    """Adds ``port_ret`` and ``drift``, the change of weight that restores each target after a day:
    of ``*by, date, symbol, weight, ret``. The first day of each ``by`` has none."""
    day = Window.partitionBy(*by, "date")
    rows = held.withColumn("port_ret", F.sum(F.col("weight") * F.col("ret")).over(day))
    grown = 1 + F.col("port_ret")
    grown = F.when(F.abs(grown) > 1e-12, grown).otherwise(F.lit(1e-12))
    first = F.min("date").over(Window.partitionBy(*by))
    moved = F.abs(F.col("weight") * (1 + F.col("ret")) / grown - F.col("weight"))
    return rows.withColumn("drift", F.when(F.col("date") == first, 0.0).otherwise(moved))


def _as_daily(days: DataFrame, capital: float, runs: Sequence[str]) -> DataFrame:
    rows = days.withColumn("net_return", F.col("gross_return") - F.col("cost_return")).withColumn("signal_date", F.col("date")).withColumnRenamed("date", "exit_date")
    return compound(rows, capital, runs)


def static_path(weights: DataFrame, complete: DataFrame, s: PortfolioSettings) -> DataFrame:
    """Daily results of each portfolio of ``portfolio, symbol, weight`` held at constant weights: the
    first day bills the allocation, later days the drift, each symbol at its own rate."""
    rates = cost_rates(complete, s.fees_bps, s.slippage_bps)
    held = weights.join(complete, "symbol")
    rows = daily_drift(held).join(rates, "symbol")
    first = F.min("date").over(Window.partitionBy("portfolio"))
    rows = rows.withColumn("_trade", F.when(F.col("date") == first, F.abs("weight")).otherwise(F.col("drift")))
    days = rows.groupBy("portfolio", "date").agg(
        F.first("port_ret").alias("gross_return"),
        F.sum(F.col("_trade") * F.col("rate")).alias("cost_return"),
        F.sum(F.abs("weight")).alias("gross_exposure"),
        F.count_if(F.abs("weight") > 1e-6).alias("trade_count"),
        F.sum("_trade").alias("round_trip_turnover"),
    )
    return _as_daily(days, s.initial_capital, ["portfolio"])


def portfolio_metrics(daily: DataFrame, s: PortfolioSettings) -> DataFrame:
    """Metrics of each portfolio; annual growth and what rests on it are blank below a year of rows."""
    found = performance_metrics(materialise(daily, "portfolio-days"), s.initial_capital, s.risk_free, runs=["portfolio"])
    long = F.col("observations") >= 252
    return found.withColumns(
        {
            "cagr": F.when(long, F.col("cagr")),
            "calmar": F.when(long, F.col("calmar")),
            "expected_return": F.col("annualized_return"),
            "volatility": F.col("annualized_volatility"),
        }
    )


def exposure(weights: DataFrame) -> DataFrame:
    """Sum, gross sum, largest weight, cash and positions of each portfolio."""
    return weights.groupBy("portfolio").agg(
        F.sum("weight").alias("weight_sum"),
        F.sum(F.abs("weight")).alias("gross_exposure"),
        F.max("weight").alias("max_weight"),
        F.greatest(F.lit(0.0), 1 - F.sum("weight")).alias("cash_weight"),
        F.count_if(F.abs("weight") > 1e-6).alias("positions"),
    )


def enriched_summary(summary: DataFrame, weights: DataFrame) -> DataFrame:
    """The summary with sums from the weights where it has none of its own."""
    added = exposure(weights).select("portfolio", *(F.col(c).alias(f"_{c}") for c in ("weight_sum", "gross_exposure", "cash_weight", "max_weight")))
    rows = summary.join(added, "portfolio", "left")
    for c in ("weight_sum", "gross_exposure", "cash_weight", "max_weight"):
        rows = rows.withColumn(c, F.coalesce(c, f"_{c}") if c in summary.columns else F.col(f"_{c}"))
    return rows.drop(*(f"_{c}" for c in ("weight_sum", "gross_exposure", "cash_weight", "max_weight")))


def portfolio_statistics(weights: DataFrame, complete: DataFrame, risk_free: float = 0.0) -> DataFrame:
    """Annual return, volatility, Sharpe ratio, VaR and CVaR of constant weights before costs."""
    days = weights.join(complete, "symbol").groupBy("portfolio", "date").agg(F.sum(F.col("weight") * F.col("ret")).alias("r"))
    q = days.groupBy("portfolio").agg(F.percentile("r", 0.05).alias("q"))
    vol = F.stddev_pop("r") * F.sqrt(F.lit(252.0))
    return days.join(F.broadcast(q), "portfolio").groupBy("portfolio").agg(
        (F.avg("r") * 252).alias("expected_return"),
        vol.alias("volatility"),
        F.when(vol > 0, (F.avg("r") * 252 - risk_free) / vol).alias("sharpe"),
        F.first("q").alias("var_95"),
        F.avg(F.when(F.col("r") <= F.col("q"), F.col("r"))).alias("cvar_95"),
    )


# -- suites


def suite_weights(complete: DataFrame, settings: opt.OptimizerSettings, methods: Sequence[str] = opt.SUITE, task_cells: int = TASK_CELLS) -> DataFrame:
    """``portfolio, symbol, weight`` for all symbols. A set of which returns and covariances both have
    ``task_cells`` numbers at most is weighted in one task, where the methods share its moments; a larger
    one by steps over blocks of its moments, to the same weights."""
    size = complete.agg(F.count_distinct("symbol").alias("symbols"), F.count(F.lit(1)).alias("cells")).first()
    if max(size.symbols**2, size.cells) > task_cells:
        blocks = Blocks(complete, covariance(complete), expected_returns(complete, "winsorized"))
        found = solver_weights(blocks, settings, methods)
        blocks.close()
        frames = [pd.DataFrame({"portfolio": m, "i": np.arange(blocks.n), "weight": found[m]}) for m in methods]
        # a row a symbol and method
        rows = complete.sparkSession.createDataFrame(pd.concat(frames), "portfolio string, i int, weight double")
        return rows.join(blocks.numbers, "i").select("portfolio", "symbol", "weight")
    arrays = complete.groupBy("symbol").agg(F.sort_array(F.collect_list(F.struct("date", "ret"))).alias("v")).select("symbol", F.transform("v", lambda x: x["ret"]).alias("x"))

    def weigh(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("symbol")
        window = opt.Estimates(np.array(rows["x"].tolist(), float).T)
        return pd.concat([pd.DataFrame({"portfolio": m, "symbol": rows["symbol"], "weight": opt.suite_weights(window, m, settings)}) for m in methods])

    return arrays.groupBy(F.lit(1).alias("_window")).applyInPandas(weigh, "portfolio string, symbol string, weight double")


def held_weights(weights: DataFrame) -> DataFrame:
    return weights.where(F.abs("weight") > 1e-6)


def with_settings(summary: DataFrame, s: opt.OptimizerSettings) -> DataFrame:
    """Adds ``max_weight_limit`` and ``optimizer_parameters``, a row's cap and parameters in words."""
    each = [(F.col("portfolio") == m, s.cap(m), s.parameters(m)) for m in opt.SUITE]
    limit, said = F.lit(None).cast("double"), F.lit(None).cast("string")
    for is_it, cap, words in each:
        limit, said = F.when(is_it, F.lit(cap).cast("double")).otherwise(limit), F.when(is_it, F.lit(words)).otherwise(said)
    return summary.withColumns({"max_weight_limit": limit, "optimizer_parameters": said})


def static_suite(complete: DataFrame, s: PortfolioSettings) -> tuple[DataFrame, DataFrame]:
    """Summary and weights of all methods over one estimation set. Without rebalances the summary's
    average turnover is 0 and the last rebalance is null."""
    weights = materialise(suite_weights(complete, s.optimizer), "suite-weights")
    summary = portfolio_metrics(static_path(weights, complete, s), s)
    none = {"rebalance_frequency": F.lit("none"), "rebalance_count": F.lit(0), "average_turnover": F.lit(0.0), "last_rebalance_date": F.lit(None).cast("date")}
    return with_settings(summary.join(exposure(weights), "portfolio").withColumns(none), s.optimizer), held_weights(weights)


def rebalance_dates(calendar: DataFrame, frequency: str, lookback: int | None) -> DataFrame:
    """``rebalance, date, pos`` of ``date, pos``: the first date of each period once there is enough
    history, numbered from 1."""
    if frequency not in PERIODS:
        raise ValueError("frequency must be monthly, quarterly or annually")
    n = calendar.agg(F.count(F.lit(1)).alias("_n"))
    if lookback and lookback > 0:
        least = F.lit(max(FLOOR, int(lookback)))
    else:
        least = F.least(F.lit(CEILING), F.greatest(F.lit(FLOOR), F.floor(F.col("_n") * 0.25)))
    later = calendar.join(F.broadcast(n)).where(F.col("pos") >= least)
    firsts = later.groupBy(F.date_trunc(PERIODS[frequency], "date").alias("_p")).agg(F.min_by(F.struct("date", "pos"), "date").alias("v"))
    return firsts.select("v.*").withColumn("rebalance", F.row_number().over(Window.orderBy("date")))


def rebalanced_weights(complete: DataFrame, rebalances: DataFrame, lookback: int | None, s: PortfolioSettings) -> DataFrame:
    """``rebalance, portfolio, symbol, weight, rate`` from the history before each date: each symbol's
    returns are one array, and a rebalance takes a slice of it."""
    settings = replace(s.optimizer, iterations=220, cvar_iterations=160)
    arrays = complete.groupBy("symbol").agg(F.sort_array(F.collect_list(F.struct("date", "ret"))).alias("v")).select("symbol", F.transform("v", lambda x: x["ret"]).alias("v"))
    length = F.least(F.col("pos"), F.lit(int(lookback))) if lookback and lookback > 0 else F.col("pos")
    # a rebalance needs a slice of each symbol's array: rebalances are dates of a calendar, one a month at
    # most, and each pair is an array of the lookback
    windows = arrays.join(F.broadcast(rebalances)).select("rebalance", "symbol", F.slice("v", (F.col("pos") - length + 1).cast("int"), length.cast("int")).alias("x"))
    fees, slip = max(s.fees_bps, 0.0) / 10_000, max(s.slippage_bps, 0.0) / 10_000

    def weigh(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("symbol")
        x = np.array(rows["x"].tolist(), float).T
        if len(x) < FLOOR:
            return pd.DataFrame(columns=["rebalance", "portfolio", "symbol", "weight", "rate"])
        vol = x.std(axis=0)
        scale = np.clip(vol / vol[vol > 0].mean(), 0.25, 4.0) if (vol > 0).any() else np.ones(x.shape[1])
        window = opt.Estimates(x)
        return pd.concat(
            [
                pd.DataFrame({"rebalance": key[0], "portfolio": m, "symbol": rows["symbol"], "weight": opt.suite_weights(window, m, settings), "rate": fees + slip * scale})
                for m in opt.SUITE
            ]
        )

    return windows.groupBy("rebalance").applyInPandas(weigh, "rebalance int, portfolio string, symbol string, weight double, rate double")


def rebalanced_suite(complete: DataFrame, frequency: str, lookback: int | None, s: PortfolioSettings) -> tuple[DataFrame, DataFrame]:
    """Summary and weights of all methods, estimated anew at each rebalance and held to the next. The
    first day of a holding period bills the change from the last weights, later days the drift."""
    if frequency == "none":
        return static_suite(complete, s)
    calendar = complete.select("date").distinct().withColumn("pos", F.row_number().over(Window.orderBy("date")) - 1)
    dates = materialise(rebalance_dates(calendar, frequency, lookback), "rebalances")
    weights = materialise(rebalanced_weights(complete, dates, lookback, s), "rebalanced-weights")
    prior = F.lag("weight", 1, 0.0).over(Window.partitionBy("portfolio", "symbol").orderBy("rebalance"))
    weights = weights.withColumn("_change", F.abs(F.col("weight") - prior))
    spans = dates.select("rebalance", F.col("date").alias("_from"), F.lead("date").over(Window.orderBy("rebalance")).alias("_to"))
    inside = (F.col("date") >= F.col("_from")) & (F.col("_to").isNull() | (F.col("date") < F.col("_to")))
    period = complete.join(F.broadcast(spans), inside).select("rebalance", "date", "symbol", "ret")
    held = daily_drift(period.join(weights, ["rebalance", "symbol"]), ["portfolio", "rebalance"])
    first = F.min("date").over(Window.partitionBy("portfolio", "rebalance"))
    held = held.withColumn("_trade", F.when(F.col("date") == first, F.col("_change")).otherwise(F.col("drift")))
    days = held.groupBy("portfolio", "date").agg(
        F.first("port_ret").alias("gross_return"),
        F.sum(F.col("_trade") * F.col("rate")).alias("cost_return"),
        F.sum(F.abs("weight")).alias("gross_exposure"),
        F.count_if(F.abs("weight") > 1e-6).alias("trade_count"),
        F.sum("_trade").alias("round_trip_turnover"),
    )
    summary = portfolio_metrics(_as_daily(days, s.initial_capital, ["portfolio"]), s)
    turns = weights.groupBy("portfolio", "rebalance").agg(F.sum("_change").alias("_t"))
    turns = turns.groupBy("portfolio").agg(
        F.count(F.lit(1)).alias("rebalance_count"), F.coalesce(F.avg(F.when(F.col("_t") > NO_TURN, F.col("_t"))), F.lit(0.0)).alias("average_turnover"), F.max("rebalance").alias("_last")
    )
    dated = weights.join(F.broadcast(dates.select("rebalance", F.col("date").alias("rebalance_date"))), "rebalance")
    latest = latest_snapshot(dated)
    last = dates.select(F.col("rebalance").alias("_last"), F.col("date").alias("last_rebalance_date"))
    summary = summary.join(turns, "portfolio").join(F.broadcast(last), "_last").drop("_last").join(exposure(latest), "portfolio").withColumn("rebalance_frequency", F.lit(frequency))
    summary = with_settings(summary, s.optimizer)
    return summary, held_weights(dated.select("portfolio", "rebalance_date", "symbol", "weight"))


def latest_snapshot(weights: DataFrame) -> DataFrame:
    """The weights of each portfolio's last rebalance."""
    last = F.max("rebalance_date").over(Window.partitionBy("portfolio"))
    return weights.withColumn("_last", last).where("rebalance_date = _last").drop("_last")


def select_best(summary: DataFrame, metric: str = "sharpe") -> DataFrame:
    """The one portfolio that is best by a metric; an unknown metric means the Sharpe ratio."""
    metric = metric if metric in summary.columns else "sharpe"
    order = F.col(metric).asc_nulls_last() if metric in LOWER_IS_BETTER else F.col(metric).desc_nulls_last()
    return summary.orderBy(order, "portfolio").limit(1)


def custom_portfolio(
    returns: DataFrame,
    s: PortfolioSettings,
    symbols: Sequence[str] = (),
    method: str = "best",
    metric: str = "sharpe",
    frequency: str = "none",
    lookback: int | None = None,
    filter_symbols: bool = False,
) -> tuple[DataFrame, DataFrame]:
    """The chosen portfolio's summary and weights from a set of symbols. Two symbols and FLOOR common
    dates are needed; a lookback shortens a static estimation set and the history of a rebalance."""
    rows = returns.where(F.col("symbol").isin(list(symbols))) if symbols else returns
    if frequency == "none" and lookback and lookback > 0:
        rows = last_dates(rows, lookback)
    complete, meta = estimation_set(rows, filter_symbols)
    size = meta.select("output_symbols", "output_observations").first()
    if size.output_symbols < 2:
        raise ValueError("a portfolio needs two symbols with common history")
    if size.output_observations < FLOOR:
        raise ValueError(f"only {size.output_observations} common return rows")
    summary, weights = rebalanced_suite(complete, frequency, lookback, s)
    chosen = select_best(summary, metric) if method == "best" else summary.where(F.col("portfolio") == method)
    return chosen, weights.join(F.broadcast(chosen.select("portfolio")), "portfolio", "left_semi").orderBy(F.col("weight").desc(), "symbol")


def dollar_allocation(weights: DataFrame, capital: Column | float) -> DataFrame:
    """Dollars in each holding, the largest first."""
    money = capital if isinstance(capital, Column) else F.lit(float(capital))
    return weights.withColumn("dollars", F.col("weight") * money).orderBy(F.col("weight").desc(), "symbol")
