"""Survival of a strategy in each cost era."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gapbook.operators.costs import cost_eras
from gapbook.operators.metrics import over

DAYS, MONTH = 252, 21
STAKE = 10_000.0


def era_windows(daily: DataFrame, eras: Sequence[tuple] = ()) -> DataFrame:
    """Each cost era clipped to the dates of ``daily``, both ends inclusive; eras without a day of
    that span go."""
    span = daily.agg(F.min("signal_date").alias("_a"), F.max("signal_date").alias("_b"))
    rows = cost_eras(daily.sparkSession, eras).join(F.broadcast(span))
    return rows.select(
        F.date_format("start", "yyyy-MM-dd").alias("key"),
        "name",
        "fees_bps",
        "slippage_bps",
        F.col("rate_bps").alias("cost_bps_per_side"),
        F.greatest("start", "_a").alias("start"),
        F.least(F.coalesce(F.date_sub("next_start", 1), F.col("_b")), F.col("_b")).alias("end"),
    ).where(F.col("start") <= F.col("end"))


def summarize_eras(daily: DataFrame, windows: DataFrame, stake: float = STAKE) -> DataFrame:
    """One row for each window: a fresh stake compounded over its days, before and after costs, and
    when half and nine tenths of it were lost. Windows without a day have ``days`` 0."""
    w = windows.select("key", F.col("start").alias("_start"), F.col("end").alias("_end"))
    rows = daily.join(F.broadcast(w), F.col("signal_date").between(F.col("_start"), F.col("_end")))
    order = Window.partitionBy("key").orderBy("signal_date")
    path = order.rowsBetween(Window.unboundedPreceding, 0)
    rows = (
        rows.withColumn("_nth", F.row_number().over(order))
        .withColumn("_gross", stake * F.product(1 + F.col("gross_return")).over(path))
        .withColumn("_net", stake * F.product(1 + F.col("net_return")).over(path))
        .withColumn("_first", F.first("_net").over(path))
    )
    rows = rows.withColumn("_dd", F.try_divide(F.col("_net"), F.max("_net").over(path)) - 1)
    at = F.struct(F.col("signal_date").alias("date"), F.bround(F.col("_nth") / float(MONTH), 1).alias("months"))

    def milestone(fraction: float):
        hit = F.when(F.col("_net") <= F.col("_first") * fraction, F.col("_nth"))
        return F.min_by(F.when(hit.isNotNull(), at), hit)

    found = rows.groupBy("key").agg(
        F.min("signal_date").alias("first_day"),
        F.max("signal_date").alias("last_day"),
        F.count(F.lit(1)).alias("days"),
        F.sum("trade_count").alias("trades"),
        (F.max_by("_gross", "_nth") / stake - 1).alias("gross_total_return"),
        (F.max_by("_net", "_nth") / stake - 1).alias("net_total_return"),
        F.max_by("_net", "_nth").alias("net_final_equity"),
        (over(F.avg("net_return"), F.stddev_samp("net_return")) * F.sqrt(F.lit(float(DAYS)))).alias("net_sharpe"),
        F.min("_dd").alias("net_max_drawdown"),
        milestone(0.5).alias("halved"),
        milestone(0.1).alias("ruined"),
    )
    years = F.col("days") / float(DAYS)
    def cagr(c: str):
        return F.when(F.col(c) > -1, F.pow(1 + F.col(c), 1 / years) - 1)

    verdict = (
        F.when(F.col("ruined.months") <= 12, "wipeout within a year")
        .when(F.col("halved.months") <= 36, "capital bleeds out")
        .when(F.col("net_total_return") > 0, "edge survives costs")
        .otherwise("slow bleed")
    )
    found = found.withColumns(
        {"years": F.bround(years, 1), "gross_cagr": cagr("gross_total_return"), "net_cagr": cagr("net_total_return"), "verdict": verdict}
    )
    return windows.join(F.broadcast(found), "key", "left").select(
        "key",
        "name",
        F.coalesce("first_day", "start").alias("start"),
        F.coalesce("last_day", "end").alias("end"),
        F.coalesce("days", F.lit(0)).alias("days"),
        "years",
        "trades",
        "fees_bps",
        "slippage_bps",
        "cost_bps_per_side",
        "gross_total_return",
        "gross_cagr",
        "net_total_return",
        "net_cagr",
        "net_final_equity",
        "net_sharpe",
        "net_max_drawdown",
        "halved",
        "ruined",
        "verdict",
        F.col("days").isNull().alias("empty"),
    )


def study_conclusion(summary: DataFrame) -> DataFrame:
    """One row: the first era with a profit, eras tested, whether there was an edge before costs in
    all, how many ruined the stake or were survived, and the fastest ruin."""
    rows = summary.where("not empty")
    profit = F.when(F.col("net_total_return") > 0, F.col("start"))
    return rows.agg(
        F.min_by(F.when(profit.isNotNull(), F.col("name")), profit).alias("first_profitable_era"),
        F.min(profit).alias("first_profitable_start"),
        F.count(F.lit(1)).alias("eras_tested"),
        F.coalesce(F.bool_and(F.col("gross_total_return") > 0), F.lit(True)).alias("gross_edge_all_eras"),
        F.count("ruined").alias("ruined_eras"),
        F.count_if(F.col("net_total_return") > 0).alias("survivors"),
        F.min("ruined.months").alias("fastest_ruin_months"),
    )
