"""Trading costs: a flat rate, or the rate of the cost era a date falls in."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Start of each era, fees and slippage on one side in basis points, and its name.
ERAS = (
    (dt.date(1900, 1, 1), 30.0, 60.0, "Fixed commissions & wide spreads"),
    (dt.date(1975, 5, 1), 15.0, 40.0, "May Day: negotiated commissions"),
    (dt.date(1990, 1, 1), 8.0, 25.0, "Discount brokers"),
    (dt.date(1997, 1, 1), 5.0, 15.0, "Order-handling rules"),
    (dt.date(2001, 4, 9), 2.0, 8.0, "Decimalization"),
    (dt.date(2007, 1, 1), 1.0, 3.0, "Reg NMS / ECN fragmentation"),
    (dt.date(2015, 1, 1), 0.5, 1.0, "Near-zero commissions"),
)
MODES = ("flat", "historical")
_SCHEMA = "start date, fees_bps double, slippage_bps double, name string"


@dataclass(frozen=True)
class CostSettings:
    mode: str = "flat"
    fees_bps: float = 0.5
    slippage_bps: float = 1.0
    eras: tuple[tuple, ...] = ()

    def __post_init__(self) -> None:
        if self.mode not in MODES:
            raise ValueError(f"cost mode must be one of {MODES}")


def cost_eras(spark: SparkSession, rows: Sequence[tuple] = ()) -> DataFrame:
    """``start, fees_bps, slippage_bps, name, rate_bps, next_start``; the fixed eras if none are
    given. A handful of rows."""
    given = [(*r, "Era")[:4] if len(r) < 4 else r for r in rows] or list(ERAS)
    order = Window.partitionBy(F.lit(1)).orderBy("start")
    return spark.createDataFrame(given, _SCHEMA).select(
        "*", (F.col("fees_bps") + F.col("slippage_bps")).alias("rate_bps"), F.lead("start").over(order).alias("next_start"), F.row_number().over(order).alias("nth")
    )


def with_cost_rate(rows: DataFrame, settings: CostSettings, date: str = "signal_date") -> DataFrame:
    """Adds ``cost_rate_bps``: the last era that began by the date, before the first era the first."""
    if settings.mode == "flat":
        return rows.withColumn("cost_rate_bps", F.lit(settings.fees_bps + settings.slippage_bps))
    eras = cost_eras(rows.sparkSession, settings.eras)
    e = eras.select(F.when(F.col("nth") > 1, F.col("start")).alias("_from"), F.col("next_start").alias("_to"), F.col("rate_bps").alias("cost_rate_bps"))
    within = (F.col("_from").isNull() | (F.col(date) >= F.col("_from"))) & (F.col("_to").isNull() | (F.col(date) < F.col("_to")))
    return rows.join(F.broadcast(e), within, "left").drop("_from", "_to")


def describe_costs(spark: SparkSession, settings: CostSettings) -> DataFrame:
    """The cost model as a table: one row for each era, or the flat rate."""
    if settings.mode == "flat":
        return spark.createDataFrame([("flat", None, settings.fees_bps, settings.slippage_bps)], "mode string, start date, fees_bps double, slippage_bps double")
    return cost_eras(spark, settings.eras).select(F.lit("historical").alias("mode"), "start", "fees_bps", "slippage_bps")
