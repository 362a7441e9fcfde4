"""Reference tables: the universe, membership spells and universe metadata."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gapbook.functions.columns import clean_double, normalize_symbol

#: The fund code of each sector.
SECTOR_CODES = {
    "Communication Services": "XLC",
    "Consumer Discretionary": "XLY",
    "Consumer Staples": "XLP",
    "Energy": "XLE",
    "Financials": "XLF",
    "Health Care": "XLV",
    "Industrials": "XLI",
    "Information Technology": "XLK",
    "Materials": "XLB",
    "Real Estate": "XLRE",
    "Utilities": "XLU",
}


def read_universe(spark: SparkSession, path: str, sequence: str | None = None) -> DataFrame:
    """``symbol, name, sector`` of a CSV whose names may hold quoted commas."""
    return universe(spark.read.option("header", True).option("quote", '"').option("escape", '"').csv(path), sequence)


def universe(raw: DataFrame, sequence: str | None = None) -> DataFrame:
    """Normalised symbols, the first row of each by the number in ``sequence``. The order in which files
    are read is none that holds, so without a sequence the least row by its columns is the first."""
    if "symbol" not in raw.columns:
        raise ValueError("universe: missing column symbol")
    others = sorted(c for c in raw.columns if c != "symbol")
    order = [F.col(sequence).try_cast("double").asc_nulls_last()] if sequence else []
    first = Window.partitionBy("symbol").orderBy(*order, *(F.col(c).asc_nulls_last() for c in others))
    return (
        raw.withColumn("symbol", normalize_symbol("symbol"))
        .where("symbol is not null")
        .withColumn("_nth", F.row_number().over(first))
        .where("_nth = 1")
        .drop("_nth")
    )


def membership(raw: DataFrame) -> DataFrame:
    """``symbol, start_date, end_date`` spells: bad dates are null, and without a symbol or a start
    there is no spell."""
    missing = [c for c in ("symbol", "start_date", "end_date") if c not in raw.columns]
    if missing:
        raise ValueError(f"membership: missing columns {', '.join(missing)}")
    return raw.select(
        normalize_symbol("symbol").alias("symbol"),
        F.col("start_date").try_cast("date").alias("start_date"),
        F.col("end_date").try_cast("date").alias("end_date"),
    ).where("symbol is not null and start_date is not null")


def universe_metadata(base: DataFrame, caps: DataFrame, bars: DataFrame) -> DataFrame:
    """``symbol, name, sector, sector_code, market_cap, in_price_cache`` of the universe
    (``symbol, name, sector``; of several rows of a symbol the least by name), of stored market caps (``symbol, market_cap``) and of all symbols
    that have bars; sorted by sector code, larger caps first, then symbol."""
    own = base.select(normalize_symbol("symbol").alias("symbol"), "name", "sector")
    known = caps.select(normalize_symbol("symbol").alias("symbol"), clean_double("market_cap").alias("market_cap"))
    priced = bars.select(normalize_symbol("symbol").alias("symbol")).distinct()
    known = known.where("symbol is not null").groupBy("symbol").agg(F.max("market_cap").alias("market_cap"))
    own = own.where("symbol is not null").groupBy("symbol").agg(F.min_by(F.struct("name", "sector"), F.coalesce("name", "symbol")).alias("v")).select("symbol", "v.*")
    everything = own.join(known, "symbol", "full_outer").join(priced.withColumn("in_price_cache", F.lit(True)), "symbol", "full_outer")
    sector = F.coalesce("sector", F.lit("Unclassified"))
    codes = F.create_map(*(F.lit(x) for pair in SECTOR_CODES.items() for x in pair))
    return everything.select(
        "symbol",
        F.coalesce("name", "symbol").alias("name"),
        sector.alias("sector"),
        F.coalesce(F.try_element_at(codes, sector), F.lit("OTHER")).alias("sector_code"),
        "market_cap",
        F.coalesce("in_price_cache", F.lit(False)).alias("in_price_cache"),
    ).orderBy("sector_code", F.col("market_cap").desc_nulls_last(), "symbol")


def universe_listing(metadata: DataFrame, priced_only: bool = False) -> DataFrame:
    """The universe, or what of it has prices."""
    return metadata.where("in_price_cache") if priced_only else metadata


def sector_codes(metadata: DataFrame) -> DataFrame:
    return metadata.select("sector_code").distinct().orderBy("sector_code")
