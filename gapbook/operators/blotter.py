"""Views of a trade blotter: filtering, summary and export order."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gapbook.sources.scratch import materialise

EXPORT_ORDER = ("exit_date", "signal_date", "symbol", "signal_rank")


def trade_date(trades: DataFrame) -> str | None:
    return next((c for c in ("exit_date", "signal_date", "date") if c in trades.columns), None)


def filter_trades(trades: DataFrame, start: dt.date | None = None, end: dt.date | None = None, symbol: str | None = None, pnl: str = "all") -> DataFrame:
    """Trades of a time, a part of a symbol in any case, and wins or losses only."""
    date = trade_date(trades)
    if date and start:
        trades = trades.where(F.col(date) >= F.lit(start))
    if date and end:
        trades = trades.where(F.col(date) <= F.lit(end))
    if symbol and symbol.strip():
        trades = trades.where(F.contains(F.upper("symbol"), F.lit(symbol.strip().upper())))
    if pnl == "wins":
        trades = trades.where("net_pnl > 0")
    if pnl == "losses":
        trades = trades.where("net_pnl < 0")
    return trades


def last_trades(trades: DataFrame, n: int) -> DataFrame:
    return trades.orderBy(*(F.col(c).desc() for c in EXPORT_ORDER)).limit(n)


def export_order(trades: DataFrame) -> DataFrame:
    """Sorted across partitions, for writing."""
    return trades.repartitionByRange(*EXPORT_ORDER).sortWithinPartitions(*EXPORT_ORDER)


def export_ranked(trades: DataFrame) -> DataFrame:
    """``export_rank``, from 1 on, in the order of an export: places within ranges of rows, and the rows of
    the ranges before, so that no task orders all trades."""
    ranged = materialise(trades.repartitionByRange(*EXPORT_ORDER).withColumn("_range", F.spark_partition_id()), "export-ranges")
    # a row a partition
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    counts = ranged.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))
    offsets = counts.select("_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inside = F.row_number().over(Window.partitionBy("_range").orderBy(*EXPORT_ORDER))
    ranked = ranged.withColumn("_inside", inside).join(F.broadcast(offsets), "_range")
    return ranked.withColumn("export_rank", F.col("_before") + F.col("_inside")).drop("_range", "_inside", "_before")


def trade_summary(source: DataFrame, filtered: DataFrame, returned: int | None = None) -> DataFrame:
    """One row about all trades and the filtered ones; ``returned`` is how many of these are shown."""
    whole = source.agg(
        F.count(F.lit(1)).alias("source_total_trades"),
        F.countDistinct("symbol").alias("source_symbols"),
        F.min("exit_date").alias("source_start_date"),
        F.max("exit_date").alias("source_end_date"),
    )
    # per exit date first: the trades of the last one are then a row of their own
    daily = filtered.groupBy("exit_date").agg(
        F.count(F.lit(1)).alias("n"),
        F.max("signal_date").alias("entry"),
        *(F.sum(c).alias(c) for c in ("net_pnl", "gross_pnl", "cost", "notional", "weight")),
        F.count("weight").alias("weights"),
        F.count("net_pnl").alias("pnls"),
        F.count_if(F.col("net_pnl") > 0).alias("wins"),
        F.max("net_pnl").alias("best"),
        F.min("net_pnl").alias("worst"),
    )
    def total(c: str):
        return F.coalesce(F.sum(c), F.lit(0.0))

    part = daily.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("filtered_trades"),
        F.min("exit_date").alias("filtered_start_date"),
        F.max("exit_date").alias("filtered_end_date"),
        F.max("entry").alias("latest_entry_date"),
        F.max("exit_date").alias("latest_exit_date"),
        F.coalesce(F.max_by("n", "exit_date"), F.lit(0)).alias("latest_trade_count"),
        total("net_pnl").alias("total_net_pnl"),
        total("gross_pnl").alias("total_gross_pnl"),
        total("cost").alias("total_cost"),
        total("notional").alias("total_notional"),
        F.try_divide(F.sum("weight"), F.sum("weights")).alias("average_weight"),
        F.try_divide(F.sum("wins"), F.sum("pnls")).alias("win_rate"),
        F.try_divide(F.sum("net_pnl"), F.sum("pnls")).alias("average_trade_pnl"),
        F.max("best").alias("best_trade_pnl"),
        F.min("worst").alias("worst_trade_pnl"),
    )
    symbols = filtered.agg(F.countDistinct("symbol").alias("filtered_symbols"))
    shown = F.col("filtered_trades") if returned is None else F.least(F.col("filtered_trades"), F.lit(returned))
    return whole.join(part).join(symbols).withColumn("returned_trades", shown)
