"""Bars, membership spells and benchmarks derived from the given order tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gapbook.sources.bars import from_ticks


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ticks(spark: SparkSession, sf_dir: str, symbol: str = "p_brand", weekly: bool = False) -> DataFrame:
    """Each order line as a tick of its part's brand (or type): a price near 100, so that returns stay
    small, and a unique order inside a day."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "l_quantity", "l_shipdate")
    parts = table(spark, sf_dir, "part").select("p_partkey", F.col(symbol).alias("symbol"))
    day = F.to_date("l_shipdate")
    return lines.join(parts, F.col("l_partkey") == F.col("p_partkey")).select(
        "symbol",
        (F.to_date(F.date_trunc("week", day)) if weekly else day).alias("date"),
        (100 + F.floor(F.col("l_extendedprice") / 10) / F.lit(10000.0)).alias("price"),
        F.col("l_quantity").cast("double").alias("size"),
        F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "l_quantity").alias("order"),
    )


def bars(spark: SparkSession, sf_dir: str, symbol: str = "p_brand", weekly: bool = False) -> DataFrame:
    return from_ticks(ticks(spark, sf_dir, symbol, weekly))


def spells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Membership by rule: a brand joins on the first day of 1995 plus its number modulo 4 years; odd
    ones leave three years later and come back after one."""
    brands = table(spark, sf_dir, "part").select(F.col("p_brand").alias("symbol")).distinct()
    number = F.regexp_extract("symbol", "([0-9]+)$", 1).cast("int")
    brands = brands.withColumn("n", number).where("n % 5 <> 0")
    first = F.make_date(1995 + F.col("n") % 4, F.lit(1), F.lit(1))
    open_ = brands.where("n % 2 = 0").select("symbol", first.alias("start_date"), F.lit(None).cast("date").alias("end_date"))
    closed = brands.where("n % 2 = 1").select("symbol", first.alias("start_date"), F.make_date(1998 + F.col("n") % 4, F.lit(1), F.lit(1)).alias("end_date"))
    again = brands.where("n % 2 = 1").select("symbol", F.make_date(1999 + F.col("n") % 4, F.lit(1), F.lit(1)).alias("start_date"), F.lit(None).cast("date").alias("end_date"))
    return open_.unionByName(closed).unionByName(again)


def benchmark_closes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``key, date, close, kind``: the mean close of all part types, and a yield made of the day's
    mean discount."""
    types = bars(spark, sf_dir, "p_type").groupBy("date").agg(F.avg("close").alias("close"))
    lines = table(spark, sf_dir, "lineitem")
    rate = lines.groupBy(F.to_date("l_shipdate").alias("date")).agg((F.avg("l_discount") * 1000).alias("close"))
    return types.select(F.lit("TYPES").alias("key"), "date", "close", F.lit("price").alias("kind")).unionByName(
        rate.select(F.lit("RATE").alias("key"), "date", "close", F.lit("yield").alias("kind"))
    )
