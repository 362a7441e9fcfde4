"""Synthetic bars: log-normal overnight and intraday moves around a common market move."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gapbook.sources.bars import COLUMNS


@dataclass(frozen=True)
class SyntheticMarket:
    start: dt.date = dt.date(2018, 1, 1)
    end: dt.date = dt.date(2025, 12, 31)
    seed: int = 42
    price_min: float = 35.0
    price_max: float = 350.0
    volume_min: int = 850_000
    volume_max: int = 12_000_000


def _uniform(seed: int, what: str, *keys: str) -> Column:
    """In (0, 1), from the first 52 bits of the MD5 of the seed, a name and the keys, so that every bar is
    reproducible, by other engines too."""
    digest = F.md5(F.concat_ws("|", F.lit(str(seed)), F.lit(what), *(F.col(k).cast("string") for k in keys)).cast("binary"))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)


def _normal(seed: int, what: str, *keys: str) -> Column:
    """Box-Muller of two such numbers."""
    return F.sqrt(-2 * F.log(_uniform(seed, what + "/r", *keys))) * F.cos(2 * F.pi() * _uniform(seed, what + "/a", *keys))


def synthetic_bars(spark: SparkSession, symbols: DataFrame, market: SyntheticMarket | None = None) -> DataFrame:
    """Bars of ``symbols`` (``symbol``) on each weekday: a random start price, volume, drift, spread
    and beta for each symbol, and shocks for each day; prices are rounded to 4 places."""
    m = market or SyntheticMarket()
    days = spark.range(1).select(F.explode(F.sequence(F.lit(m.start), F.lit(m.end))).alias("date")).where(F.weekday("date") < 5)
    days = days.withColumn("m_night", 0.00005 + 0.0045 * _normal(m.seed, "market night", "date")).withColumn("m_day", 0.006 * _normal(m.seed, "market day", "date"))
    def between(what: str, low: float, high: float) -> Column:
        return low + (high - low) * _uniform(m.seed, what, "symbol")

    own = symbols.select("symbol").distinct().select(
        "symbol",
        between("price", m.price_min, m.price_max).alias("p0"),
        between("volume", m.volume_min, m.volume_max).alias("v0"),
        (0.0001 + 0.0001 * _normal(m.seed, "mu night", "symbol")).alias("mu_n"),
        (-0.00001 + 0.00007 * _normal(m.seed, "mu day", "symbol")).alias("mu_d"),
        between("vol night", 0.0045, 0.0110).alias("vol_n"),
        between("vol day", 0.0075, 0.0175).alias("vol_d"),
        between("beta", 0.65, 1.35).alias("beta"),
    )
    key = ("symbol", "date")
    moves = own.join(F.broadcast(days)).select(
        *key,
        "p0",
        "v0",
        (F.col("beta") * F.col("m_night") + F.col("mu_n") + F.col("vol_n") * _normal(m.seed, "night", *key)).alias("night"),
        (F.col("beta") * F.col("m_day") + F.col("mu_d") + F.col("vol_d") * _normal(m.seed, "day", *key)).alias("day"),
        F.abs(0.006 + 0.004 * _normal(m.seed, "spread", *key)).alias("spread"),
        F.exp(0.35 * _normal(m.seed, "noise", *key)).alias("noise"),
    )
    so_far = F.sum(F.col("night") + F.col("day")).over(Window.partitionBy("symbol").orderBy("date"))
    close = F.col("p0") * F.exp(so_far)
    priced = moves.withColumn("close", close).withColumn("open", F.col("close") * F.exp(-F.col("day")))
    return priced.select(
        "date",
        "symbol",
        F.round("open", 4).alias("open"),
        F.round(F.greatest("open", "close") * (1 + F.col("spread")), 4).alias("high"),
        F.round(F.least("open", "close") * F.greatest(F.lit(0.01), 1 - F.col("spread")), 4).alias("low"),
        F.round("close", 4).alias("close"),
        F.greatest(F.lit(1.0), F.floor(F.col("v0") * F.col("noise")).cast("double")).alias("volume"),
    ).select(*COLUMNS)
