"""Queries of the sources, sinks and reports that read what they write: each makes files of the given
tables in the shared folder, in the form a vendor or a report has, and reads them with the library."""

from __future__ import annotations

import datetime as dt
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gapbook.operators import backtest as bt
from gapbook.operators import blotter, nightly
from gapbook.operators import features as ft
from gapbook.operators import metrics as mx
from gapbook.operators import optimizers as opt
from gapbook.operators import portfolio as pf
from gapbook.operators.costs import CostSettings, cost_eras, describe_costs, with_cost_rate
from gapbook.plans import queries as q
from gapbook.plans.market import bars, spells, table
from gapbook.sources import bars as sb
from gapbook.sources import reference as ref
from gapbook.sources.scratch import materialise, run_folder
from gapbook.sources.sinks import write_report
from gapbook.sources.synthetic import SyntheticMarket, synthetic_bars

FILES = 8
OWN_ERAS = ((dt.date(1999, 1, 1), 3.0, 4.0), (dt.date(1996, 6, 1), 10.0, 20.0))
MARKET = SyntheticMarket(dt.date(2019, 1, 1), dt.date(2021, 12, 31))
CLOSED_FORM = ("score_weighted", "equal_weight", "inverse_volatility")
#: A cap that binds on some names of a book, so that projections have work to do.
CAPPED = opt.OptimizerSettings(max_weight=0.3, iterations=60, cvar_iterations=60)


def _folder(spark: SparkSession, tag: str) -> str:
    return f"{run_folder(spark)}/{tag}-{uuid.uuid4().hex}"


def _write_lines(rows: DataFrame, header: str, path: str) -> None:
    """Lines (``line``, with ``part`` below FILES) as text files that all begin with the header."""
    heads = rows.sparkSession.range(FILES).select(F.lit(header).alias("line"), F.col("id").cast("int").alias("part"), F.lit(0).alias("after"))
    both = heads.unionByName(rows.select("line", "part", F.lit(1).alias("after")))
    both.repartitionById(FILES, F.col("part")).sortWithinPartitions("after", "line").select("line").write.text(path)


def bars_from_parquet(spark, d):
    path = _folder(spark, "bars")
    bars(spark, d).withColumn("source", F.lit("vendor")).write.parquet(path)
    return q.rounded(sb.read_parquet(spark, path))


def bars_from_csv(spark, d):
    """Bars as CSV; each line of the 13th of a month has two fields too many."""
    path = _folder(spark, "bars-csv")
    extra = F.when(F.dayofmonth("date") == 13, F.lit(",x,y")).otherwise(F.lit(""))
    line = F.concat(F.concat_ws(",", F.date_format("date", "yyyy-MM-dd"), "symbol", *(F.col(c).cast("string") for c in sb.OHLCV)), extra)
    part = F.pmod(F.xxhash64("symbol", "date"), F.lit(FILES)).cast("int")
    _write_lines(bars(spark, d).select(line.alias("line"), part.alias("part")), ",".join(sb.COLUMNS), path)
    return q.rounded(sb.clean_bars(sb.read_csv(spark, path), dt.date(2002, 1, 1)))


def bars_quarantined(spark, d):
    """How many of those lines are set aside, and how many are not."""
    path = _folder(spark, "bars-csv")
    extra = F.when(F.dayofmonth("date") == 13, F.lit(",x,y")).otherwise(F.lit(""))
    line = F.concat(F.concat_ws(",", F.date_format("date", "yyyy-MM-dd"), "symbol", *(F.col(c).cast("string") for c in sb.OHLCV)), extra)
    _write_lines(bars(spark, d).select(line.alias("line"), F.pmod(F.xxhash64("symbol"), F.lit(FILES)).cast("int").alias("part")), ",".join(sb.COLUMNS), path)
    # what is set aside is kept with what is not: Spark reads no corrupt lines alone
    rows = materialise(sb.read_csv(spark, path, quarantine=True), "quarantined")
    return rows.groupBy(F.col("_corrupt").isNotNull().alias("quarantined")).agg(F.count(F.lit(1)).alias("lines"))


def bars_from_vendor_json(spark, d):
    """Raw and adjusted prices under UTC time stamps; the adjusted ones count."""
    path = _folder(spark, "bars-json")
    adjusted = {f"adj{c.capitalize()}": F.col(c) * (2.0 if c == "volume" else 0.5) for c in sb.OHLCV}
    stamp = F.concat(F.date_format("date", "yyyy-MM-dd"), F.lit("T00:00:00.000Z"))
    bars(spark, d).select(stamp.alias("date"), "symbol", *sb.OHLCV, *(v.alias(k) for k, v in adjusted.items())).write.json(path)
    return q.rounded(sb.from_vendor_json(spark.read.json(path)))


def bars_from_vendor_csv(spark, d):
    """One file for each part type, with capitalised columns, under the vendor's symbol."""
    own = bars(spark, d, "p_type")
    path = _folder(spark, "vendor-csv")
    named = own.select("symbol", F.col("date").alias("Date"), *(F.col(c).alias(f) for f, c in sb.FIELDS.items()))
    write_report(named, path, "csv", ["symbol"])
    whole = spark.read.option("header", True).csv(path)
    return q.rounded(sb.from_vendor_csv(whole.select("Date", *sb.FIELDS, "symbol"), sb.vendor_symbol("symbol")))


def universe_from_csv(spark, d):
    """Names with commas in quotes; brands stand twice, and the first by its sequence stays."""
    path = _folder(spark, "universe")
    parts = table(spark, d, "part").groupBy("p_brand", "p_type").agg(F.min("p_partkey").alias("seq"))
    rows = parts.select(F.concat(F.lower("p_brand"), F.lit(".a ")).alias("symbol"), F.concat(F.lit("Maker, of "), "p_type").alias("name"), F.col("p_type").alias("sector"), "seq")
    write_report(rows, path, "csv")
    return ref.read_universe(spark, path, "seq").drop("seq")


def membership_from_csv(spark, d):
    """Spells with words for some dates."""
    path = _folder(spark, "membership")
    n = F.regexp_extract("symbol", "([0-9]+)$", 1).cast("int")
    own = spells(spark, d).select(
        "symbol",
        F.when(n % 7 == 0, F.lit("soon")).otherwise(F.col("start_date").cast("string")).alias("start_date"),
        F.when(n % 3 == 0, F.lit("never")).otherwise(F.col("end_date").cast("string")).alias("end_date"),
    )
    write_report(own, path, "csv")
    return ref.membership(spark.read.option("header", True).csv(path))


def synthetic_market(spark, d):
    """Generated bars of the given brands."""
    brands = table(spark, d, "part").select(F.col("p_brand").alias("symbol"))
    return synthetic_bars(spark, brands, MARKET)


def _trades(spark, d):
    own = q._signals(spark, d).withColumn("run", F.lit("base"))
    return bt.trade_blotter(own, bt.run_backtest(own, q.COSTED, ["run"]), q.COSTED, ["run"])


def trades_reported(spark, d):
    """The blotter as a report, a folder a year of exit, read back."""
    path = _folder(spark, "trades")
    write_report(_trades(spark, d).withColumn("year", F.year("exit_date")), path, "parquet", ["year"])
    return q.rounded(spark.read.parquet(path), 5)


def trades_exported(spark, d):
    """The blotter with each trade's place in export order."""
    return q.rounded(blotter.export_ranked(_trades(spark, d)), 5)


def cost_own_eras(spark, d):
    dates = table(spark, d, "orders").select(F.to_date("o_orderdate").alias("signal_date")).distinct()
    return with_cost_rate(dates, CostSettings("historical", eras=OWN_ERAS))


def cost_model(spark, d):
    """The described cost model, with the order dates that fall into each era."""
    dates = table(spark, d, "orders").select(F.to_date("o_orderdate").alias("date")).distinct()
    ends = cost_eras(spark).select(F.col("start").alias("_start"), "next_start")
    told = describe_costs(spark, q.HISTORICAL).join(ends, F.col("start") == F.col("_start"))
    met = told.join(dates, (F.col("date") >= F.col("start")) & (F.col("next_start").isNull() | (F.col("date") < F.col("next_start"))), "left")
    return met.groupBy("mode", "start", "fees_bps", "slippage_bps").agg(F.count("date").alias("dates"))


def performance_with_empty_runs(spark, d):
    """Metrics of a run that traded and of one that never did."""
    runs = table(spark, d, "part").select(F.when(F.col("p_partkey") % 2 == 0, "base").otherwise("idle").alias("run")).distinct()
    found = mx.performance_metrics(q._daily(spark, d), q.CAPITAL, runs=["run"], all_runs=runs)
    return q.rounded(found.select("run", "observations", "initial_capital", "final_equity", "total_return", "sharpe", "elapsed_years"), 6)


def sector_listing(spark, d):
    """Sector codes of the universe, and the symbols of each that have prices."""
    found = _metadata(spark, d)
    priced = ref.universe_listing(found, priced_only=True).groupBy("sector_code").agg(F.count(F.lit(1)).alias("priced"))
    return ref.sector_codes(found).join(priced, "sector_code", "left").fillna(0, ["priced"])


def _metadata(spark, d):
    parts = table(spark, d, "part").groupBy("p_brand").agg(F.max("p_retailprice").alias("cap"))
    sector = F.when(F.col("p_brand").like("%1"), F.lit("Energy")).when(F.col("p_brand").like("%2"), F.lit("Utilities")).otherwise(F.lit("Toys"))
    base = parts.select(F.col("p_brand").alias("symbol"), F.col("p_brand").alias("name"), sector.alias("sector"))
    return ref.universe_metadata(base, parts.select(F.col("p_brand").alias("symbol"), F.col("cap").alias("market_cap")), bars(spark, d).where("symbol not like '%5'"))


def portfolio_enriched(spark, d):
    """Sums of the weights fill what a summary lacks and leave what it has."""
    book = q._complete(spark, d)[0].groupBy("symbol").agg(F.count(F.lit(1)).alias("n"))
    weights = book.select(F.explode(F.array(F.lit("a"), F.lit("b"))).alias("portfolio"), "symbol", (F.length("symbol") / 100.0).alias("weight"))
    summary = weights.select("portfolio").distinct().withColumn("max_weight", F.when(F.col("portfolio") == "a", F.lit(0.5)))
    return q.rounded(pf.enriched_summary(summary, weights))


def inverse_volatility_portfolio(spark, d):
    """The custom portfolio job with a method that has a closed form: weights in dollars."""
    settings = pf.PortfolioSettings(optimizer=CAPPED, fees_bps=1.0, slippage_bps=2.0)
    _, weights = pf.custom_portfolio(ft.long_returns(bars(spark, d, "p_type")), settings, method="Inverse Volatility", lookback=500, filter_symbols=True)
    return q.rounded(pf.dollar_allocation(weights, q.CAPITAL), 4)


def inverse_volatility_summary(spark, d):
    """The static suite's row of that method."""
    settings = pf.PortfolioSettings(optimizer=CAPPED, fees_bps=1.0, slippage_bps=2.0)
    summary, _ = pf.static_suite(q._complete(spark, d)[0], settings)
    own = summary.where("portfolio = 'Inverse Volatility'")
    names = ("total_return", "expected_return", "volatility", "total_cost_return", "weight_sum", "max_weight", "cash_weight", "average_turnover", "max_weight_limit")
    return q.rounded(own.select("portfolio", "observations", "positions", "rebalance_count", "rebalance_frequency", "last_rebalance_date", "optimizer_parameters", *names), 6)


def nightly_closed_form(spark, d):
    """Nightly results of the methods that have a closed form."""
    settings = nightly.NightlySettings(21, 13, top_n=8, estimation_days=63, cash_rate=0.02, optimizer=CAPPED)
    daily = nightly.nightly_suite(bars(spark, d), settings, CLOSED_FORM).daily
    return q.rounded(daily.drop("starting_equity", "night"), 6)


QUERIES: tuple[Callable[[SparkSession, str], DataFrame], ...] = (
    bars_from_parquet,
    bars_from_csv,
    bars_quarantined,
    bars_from_vendor_json,
    bars_from_vendor_csv,
    universe_from_csv,
    membership_from_csv,
    synthetic_market,
    trades_reported,
    trades_exported,
    cost_own_eras,
    cost_model,
    performance_with_empty_runs,
    sector_listing,
    portfolio_enriched,
    inverse_volatility_portfolio,
    inverse_volatility_summary,
    nightly_closed_form,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {x.__name__: x for x in QUERIES}
