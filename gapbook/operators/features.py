"""Rolling features of each symbol; all windows share one partitioning and one sort."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from gapbook.operators.time_blocks import in_blocks

TRADING_DAYS = 252
ADV_DAYS, ADV_LEAST = 20, 5
#: Bars of a symbol in a block of time.
BLOCK_ROWS = 1 << 16


@dataclass(frozen=True)
class FeatureSettings:
    lookback_days: int = 63
    min_history: int = 40


def _by_symbol() -> WindowSpec:
    return Window.partitionBy("symbol").orderBy("date")


def with_returns(bars: DataFrame) -> DataFrame:
    """Overnight, intraday and close-to-close returns, the next overnight return and its date."""
    before = F.lag("close").over(_by_symbol())
    night = F.try_divide(F.col("open"), before) - 1
    return (
        bars.withColumn("overnight_return", night)
        .withColumn("intraday_return", F.try_divide("close", "open") - 1)
        .withColumn("close_to_close_return", F.try_divide(F.col("close"), before) - 1)
        .withColumn("next_overnight_return", F.lead("overnight_return").over(_by_symbol()))
        .withColumn("exit_date", F.lead("date").over(_by_symbol()))
    )


def _rolling(lookback: int, min_history: int) -> dict[str, Column]:
    rows = _by_symbol().rowsBetween(-(lookback - 1), 0)
    r = F.col("overnight_return")
    enough = F.count(r).over(rows) >= min_history
    mean, vol = F.when(enough, F.avg(r).over(rows)), F.when(enough, F.stddev_pop(r).over(rows))
    seen = F.count(F.lit(1)).over(rows)
    wins = F.sum(F.when(r > 0, 1.0).otherwise(0.0)).over(rows)
    return {
        "overnight_mean": mean,
        "overnight_vol": vol,
        "overnight_sharpe": F.when(vol > 0, mean / vol * F.sqrt(F.lit(float(TRADING_DAYS)))),
        # gated by rows, not by returns: a row without a return is no win
        "overnight_win_rate": F.when(seen >= min_history, wins / seen),
    }


def with_liquidity(rows: DataFrame) -> DataFrame:
    """Dollar volume, and its median over the last ADV_DAYS rows once there are ADV_LEAST."""
    last = _by_symbol().rowsBetween(-(ADV_DAYS - 1), 0)
    return rows.withColumn("dollar_volume", F.col("close") * F.col("volume")).withColumn(
        "adv_dollars", F.when(F.count("dollar_volume").over(last) >= ADV_LEAST, F.percentile("dollar_volume", 0.5).over(last))
    )


def build_features(bars: DataFrame, settings: FeatureSettings | None = None) -> DataFrame:
    """Bars with returns, rolling mean, volatility, Sharpe ratio and win rate of the overnight return,
    and liquidity. Missing values are null."""
    s = settings or FeatureSettings()
    return with_liquidity(with_returns(bars).withColumns(_rolling(s.lookback_days, s.min_history)))


def build_features_in_blocks(bars: DataFrame, settings: FeatureSettings | None = None, rows: int = BLOCK_ROWS) -> DataFrame:
    """The same for symbols with more bars than a task should sort: windows run over blocks of ``rows`` bars
    of a symbol, which see the bars around them that they need."""
    s = settings or FeatureSettings()
    before = max(s.lookback_days, ADV_DAYS)
    cut = in_blocks(bars, "symbol", "date", max(rows, before), before, 1)
    # a block of a symbol takes the symbol's part in all windows
    cut = cut.withColumn("symbol", F.struct("symbol", "_block")).drop("_block")
    return build_features(cut, s).where("not _halo").drop("_halo").withColumn("symbol", F.col("symbol.symbol"))


def build_feature_grid(bars: DataFrame, settings: Sequence[FeatureSettings]) -> DataFrame:
    """The same for several settings at once, long: ``lookback_days, min_history`` and the features.
    All windows run over one sort of the bars."""
    rows = with_liquidity(with_returns(bars))
    names = ("overnight_mean", "overnight_vol", "overnight_sharpe", "overnight_win_rate")
    packed = [
        F.struct(F.lit(s.lookback_days).alias("lookback_days"), F.lit(s.min_history).alias("min_history"), *(_rolling(s.lookback_days, s.min_history)[n].alias(n) for n in names))
        for s in settings
    ]
    rows = rows.withColumns({f"_f{k}": c for k, c in enumerate(packed)})
    kept = [c for c in rows.columns if not c.startswith("_f")]
    return rows.select(*kept, F.inline(F.array(*(F.col(f"_f{k}") for k in range(len(packed))))))


def long_returns(bars: DataFrame, model: str = "overnight") -> DataFrame:
    """``date, symbol, ret``: overnight or close-to-close returns, where there is one."""
    column = {"overnight": "overnight_return", "close_to_close": "close_to_close_return"}[model]
    return with_returns(bars).select("date", "symbol", F.col(column).alias("ret")).where("ret is not null")
