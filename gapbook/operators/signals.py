"""Ranking, top-N selection and weights, one book for each date (and run)."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gapbook.operators.features import FeatureSettings, build_features

# The columns of a signal table, as it is stored.
SIGNALS = (
    "signal_date",
    "exit_date",
    "symbol",
    "weight",
    "overnight_sharpe",
    "overnight_mean",
    "overnight_vol",
    "overnight_win_rate",
    "adv_dollars",
    "next_overnight_return",
    "signal_rank",
)


@dataclass(frozen=True)
class SignalSettings:
    lookback_days: int = 63
    min_history: int = 40
    top_n: int = 25
    max_weight: float = 0.07
    min_signal: float = 0.0
    allocation: str = "score"


def candidates(features: DataFrame, min_signal: Column | float) -> DataFrame:
    """Rows with a score, a next return and an exit, and the score at ``min_signal`` or more."""
    least = min_signal if isinstance(min_signal, Column) else F.lit(float(min_signal))
    return features.where("overnight_sharpe is not null and next_overnight_return is not null and exit_date is not null").where(
        F.col("overnight_sharpe") >= least
    )


def top_n(rows: DataFrame, n: Column | int, runs: Sequence[str] = ()) -> DataFrame:
    """The best of each date by score, ties by symbol, numbered in ``signal_rank``."""
    best = Window.partitionBy(*runs, "date").orderBy(F.col("overnight_sharpe").desc(), "symbol")
    return rows.withColumn("signal_rank", F.row_number().over(best)).where(F.col("signal_rank") <= n)


def capped_weights(rows: DataFrame, score: Column, cap: Column | float, by: Sequence[str], tie: str = "symbol") -> DataFrame:
    """Adds ``weight``: scores scaled to min(1, cap * n), with names above the cap fixed there and the
    rest scaled again until stable.

    The capped names are a prefix of the scores in falling order, so the stable point is the
    smallest k for which the next name stays under the cap when the first k are fixed; running sums
    of what remains give it without a loop.
    """
    most = cap if isinstance(cap, Column) else F.lit(float(cap))
    whole = Window.partitionBy(*by)
    order = whole.orderBy(F.col("_score").desc(), F.col(tie))
    rows = rows.withColumn("_cap", most).withColumn("_score", score)
    rows = rows.withColumn("_k", F.row_number().over(order) - 1).withColumn(
        "_rest", F.sum("_score").over(order.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    )
    rows = rows.withColumn("_n", F.count(F.lit(1)).over(whole))
    rows = rows.withColumn("_left", F.least(F.lit(1.0), F.col("_cap") * F.col("_n")) - F.col("_k") * F.col("_cap"))
    stable = (F.col("_score") * F.col("_left") <= (F.col("_cap") + 1e-12) * F.col("_rest")) | (F.col("_rest") == 0)
    at = F.when(stable, F.struct("_k", "_rest", "_left"))
    rows = rows.withColumn("_at", F.min(at).over(whole))
    share = F.when(F.col("_at._rest") > 0, F.try_divide(F.col("_score") * F.col("_at._left"), F.col("_at._rest"))).otherwise(
        F.try_divide(F.col("_at._left"), F.col("_n") - F.col("_at._k"))
    )
    weight = F.when(F.col("_at").isNull() | (F.col("_k") < F.col("_at._k")), F.col("_cap")).otherwise(share)
    return rows.withColumn("weight", weight).drop("_cap", "_score", "_k", "_rest", "_n", "_left", "_at")


def score_of(allocation: str, by: Sequence[str]) -> Column:
    """Positive scores; all 1 where a book has none, or for equal allocation."""
    if allocation == "equal":
        return F.lit(1.0)
    if allocation != "score":
        raise ValueError("allocation must be score or equal")
    positive = F.greatest(F.col("overnight_sharpe"), F.lit(0.0))
    return F.when(F.sum(positive).over(Window.partitionBy(*by)) > 0, positive).otherwise(1.0)


def signals_from_features(features: DataFrame, settings: SignalSettings, runs: Sequence[str] = ()) -> DataFrame:
    """The weighted books of all dates: SIGNALS, with ``runs`` in front."""
    by = [*runs, "date"]
    chosen = top_n(candidates(features, settings.min_signal), settings.top_n, runs)
    weighted = capped_weights(chosen, score_of(settings.allocation, by), settings.max_weight, by)
    return weighted.withColumnRenamed("date", "signal_date").select(*runs, *SIGNALS)


def generate_signals(bars: DataFrame, settings: SignalSettings | None = None) -> DataFrame:
    s = settings or SignalSettings()
    return signals_from_features(build_features(bars, FeatureSettings(s.lookback_days, s.min_history)), s)


def latest_book(signals: DataFrame, metadata: DataFrame | None = None, n: int = 25) -> DataFrame:
    """The last date's names by weight, with what is known of them."""
    last = signals.agg(F.max("signal_date").alias("signal_date"))
    book = signals.join(F.broadcast(last), "signal_date", "left_semi")
    if metadata is not None:
        book = book.join(metadata.select("symbol", "name", "sector", "sector_code", "market_cap"), "symbol", "left")
    return book.orderBy(F.col("weight").desc(), "symbol").limit(n)


def target_orders(weights: DataFrame, reason: Column | str) -> DataFrame:
    """``symbol, target_weight, reason, report`` of the names that matter."""
    why = F.lit(reason) if isinstance(reason, str) else reason
    kept = weights.where(F.abs("weight") > 1e-6).select("symbol", F.col("weight").alias("target_weight"), why.alias("reason"))
    return kept.withColumn("report", F.format_string("Would target %.2f%%: %s", F.col("target_weight") * 100, F.col("reason")))
