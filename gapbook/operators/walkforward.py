"""Walk-forward evaluation: choose parameters on a training window, hold them on the next test
window. Signals are ranked once for each candidate over all dates; folds meet them at the level of
daily results."""

from __future__ import annotations

import datetime as dt
import itertools
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gapbook.operators.backtest import BacktestSettings, compound, run_backtest
from gapbook.operators.features import FeatureSettings, build_feature_grid
from gapbook.operators.metrics import performance_metrics
from gapbook.operators.signals import candidates, capped_weights, score_of, top_n
from gapbook.sources.scratch import materialise

# The metrics a fold may be chosen by; and below, the settings that runs have by default.
METRICS = ("sharpe", "sortino", "calmar", "cagr")


@dataclass(frozen=True)
class WalkForwardSettings:
    train_days: int = 756
    test_days: int = 63
    step_days: int = 63
    lookbacks: tuple[int, ...] = (42, 63, 126)
    top_ns: tuple[int, ...] = (15, 25, 40)
    min_signals: tuple[float, ...] = (0.0,)
    metric: str = "sharpe"
    start_date: dt.date | None = None
    max_folds: int | None = None
    max_weight: float = 0.07
    history_ratio: float = 0.63
    backtest: BacktestSettings = field(default_factory=BacktestSettings)

    def __post_init__(self) -> None:
        if self.metric not in METRICS:
            raise ValueError(f"metric must be one of {METRICS}")

    def features(self) -> list[FeatureSettings]:
        return [FeatureSettings(int(n), max(5, int(n * self.history_ratio))) for n in dict.fromkeys(self.lookbacks)]


def parameter_grid(spark: SparkSession, s: WalkForwardSettings) -> DataFrame:
    """``candidate, lookback_days, min_history, top_n, min_signal`` in grid order."""
    rows = [
        (k, int(n), max(5, int(n * s.history_ratio)), int(top), float(least))
        for k, (n, top, least) in enumerate(itertools.product(s.lookbacks, s.top_ns, s.min_signals))
    ]
    return spark.createDataFrame(rows, "candidate int, lookback_days int, min_history int, top_n int, min_signal double")


def fold_windows(dates: DataFrame, s: WalkForwardSettings) -> DataFrame:
    """``fold`` and its training and test bounds from the distinct dates; the last test window may be
    short. A calendar is small: one row for each date."""
    calendar = dates.select("date").distinct().withColumn("_p", F.row_number().over(Window.orderBy("date")) - 1)
    n = calendar.count()
    if n <= s.train_days:
        raise ValueError("not enough price history for the walk-forward windows")
    starts = dates.sparkSession.range(0, n - s.train_days, s.step_days).select(F.col("id").alias("_s"))
    starts = starts.withColumn("fold", F.floor(F.col("_s") / s.step_days) + 1)
    spots = F.array(
        *(
            F.struct(F.lit(name).alias("what"), at.alias("_p"))
            for name, at in (
                ("train_start", F.col("_s")),
                ("train_end", F.col("_s") + s.train_days - 1),
                ("test_start", F.col("_s") + s.train_days),
                ("test_end", F.least(F.col("_s") + s.train_days + s.test_days, F.lit(n)) - 1),
            )
        )
    )
    bounds = starts.select("fold", F.inline(spots)).join(F.broadcast(calendar), "_p")
    names = ("train_start", "train_end", "test_start", "test_end")
    folds = bounds.groupBy("fold").agg(*(F.max(F.when(F.col("what") == x, F.col("date"))).alias(x) for x in names))
    if s.start_date:
        folds = folds.where(F.col("test_end") >= F.lit(s.start_date))
    folds = folds.withColumn("fold", F.row_number().over(Window.orderBy("test_start")))
    if s.max_folds:
        folds = folds.withColumn("_back", F.row_number().over(Window.orderBy(F.col("test_start").desc())))
        folds = folds.where(F.col("_back") <= s.max_folds).drop("_back")
        folds = folds.withColumn("fold", F.row_number().over(Window.orderBy("test_start")))
    if folds.isEmpty():
        raise ValueError("no walk-forward window is left after start_date and max_folds")
    return folds


def candidate_signals(bars: DataFrame, s: WalkForwardSettings) -> DataFrame:
    """The books of every candidate on every date. Candidates that differ in the number of names alone
    are prefixes of one ranking: each lookback and threshold is ranked once, to the largest number, and
    only the ranked rows meet the grid."""
    grid = parameter_grid(bars.sparkSession, s)
    features = build_feature_grid(bars, s.features())
    least = F.explode(F.array(*(F.lit(float(x)) for x in dict.fromkeys(s.min_signals))))
    ranked = top_n(candidates(features.withColumn("min_signal", least), F.col("min_signal")), max(s.top_ns), ["lookback_days", "min_signal"])
    chosen = ranked.join(F.broadcast(grid), ["lookback_days", "min_history", "min_signal"]).where(F.col("signal_rank") <= F.col("top_n"))
    by = ["candidate", "date"]
    return capped_weights(chosen, score_of("score", by), s.max_weight, by).withColumnRenamed("date", "signal_date")


@dataclass(frozen=True)
class WalkForward:
    """folds (chosen parameters and out-of-sample metrics), oos_daily, oos_metrics, in_sample."""

    folds: DataFrame
    oos_daily: DataFrame
    oos_metrics: DataFrame
    in_sample: DataFrame


def _in_folds(rows: DataFrame, folds: DataFrame, which: str) -> DataFrame:
    f = folds.select("fold", F.col(f"{which}_start").alias("_a"), F.col(f"{which}_end").alias("_b"))
    return rows.join(F.broadcast(f), F.col("signal_date").between(F.col("_a"), F.col("_b"))).drop("_a", "_b")


def _per_fold(signals: DataFrame, folds: DataFrame, which: str, s: WalkForwardSettings) -> DataFrame:
    """Daily results of each fold and candidate, each fold from fresh capital."""
    b, keys = s.backtest, ["fold", "candidate"]
    if b.limited:
        return run_backtest(_in_folds(signals, folds, which), b, keys)
    # a day's return does not depend on equity: one result for each candidate, dealt out to folds
    daily = _in_folds(run_backtest(signals, b, ["candidate"]), folds, which)
    return compound(daily.drop("starting_equity", "ending_equity"), b.initial_capital, keys)


def walk_forward(bars: DataFrame, settings: WalkForwardSettings | None = None, risk_free: float = 0.0) -> WalkForward:
    """Training metrics of each fold and candidate, the best (the first of equals in grid order), its
    test window, and the stitched test windows compounded from the initial capital."""
    s = settings or WalkForwardSettings()
    capital = s.backtest.initial_capital
    folds = materialise(fold_windows(bars, s), "folds")
    signals = materialise(candidate_signals(bars, s), "candidate-signals")
    keys = ["fold", "candidate"]
    trained = performance_metrics(materialise(_per_fold(signals, folds, "train", s), "trained"), capital, risk_free, runs=keys)
    best = Window.partitionBy("fold").orderBy(F.col(s.metric).desc_nulls_last(), "candidate")
    winners = trained.withColumn("_nth", F.row_number().over(best)).where("_nth = 1").select("fold", "candidate", F.col(s.metric).alias("train_metric"))
    winners = materialise(winners, "winners")
    tested = materialise(_per_fold(signals, folds, "test", s).join(F.broadcast(winners.select(*keys)), keys, "left_semi"), "tested")
    oos = performance_metrics(tested, capital, risk_free, runs=["fold"])
    chosen = winners.join(F.broadcast(parameter_grid(bars.sparkSession, s)), "candidate")
    rows = folds.join(chosen, "fold").join(oos, "fold").select(
        "fold",
        "train_start",
        "train_end",
        "test_start",
        "test_end",
        "lookback_days",
        "top_n",
        "min_signal",
        "train_metric",
        F.col("sharpe").alias("oos_sharpe"),
        F.col("cagr").alias("oos_cagr"),
        F.col("max_drawdown").alias("oos_max_drawdown"),
        F.col("observations").alias("oos_days"),
    )
    stitched = compound(tested.drop("starting_equity", "ending_equity").withColumn("run", F.lit("oos")), capital, ["run"], ["signal_date", "fold"])
    metrics = performance_metrics(stitched, capital, risk_free, runs=["run"])
    return WalkForward(rows, stitched, metrics, rows.agg(F.avg("train_metric").alias("in_sample_average")))


def sharpe_decay(oos_metrics: DataFrame, in_sample: DataFrame) -> DataFrame:
    """1 - out-of-sample Sharpe ratio / in-sample mean; null without a mean."""
    return oos_metrics.select("sharpe").join(F.broadcast(in_sample)).select(
        "sharpe", "in_sample_average", (1 - F.try_divide("sharpe", "in_sample_average")).alias("sharpe_decay")
    )


