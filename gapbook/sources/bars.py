"""Daily bars: reading, cleaning, validating, merging and windowing."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gapbook.functions.columns import as_column, clean_double, normal_symbol, normalize_symbol

OHLCV = ("open", "high", "low", "close", "volume")
COLUMNS = ("date", "symbol", *OHLCV)
BARS = T.StructType(
    [T.StructField("date", T.DateType()), T.StructField("symbol", T.StringType())]
    + [T.StructField(c, T.DoubleType()) for c in OHLCV]
)
#: Days after ``as_of`` that a bar's date may lie; days that a refresh re-reads.
FUTURE_DAYS, OVERLAP_DAYS = 5, 10
FIELDS = {"Open": "open", "High": "high", "Low": "low", "Close": "close", "Volume": "volume"}


class InvalidBars(ValueError):
    """Bars break a rule that must hold."""


# -- reading


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    """Bars kept as Parquet; only the seven known columns are read."""
    raw = spark.read.parquet(path)
    return raw.select(*(c for c in COLUMNS if c in raw.columns))


def read_csv(spark: SparkSession, path: str, quarantine: bool = False) -> DataFrame:
    """Bars kept as CSV, all columns as strings so that ``clean_bars`` decides; lines with too many
    or too few fields go, or with ``quarantine`` stay alone in ``_corrupt``."""
    # the header gives the order of the columns; every one is read, since pruning hides bad lines
    names = spark.read.option("header", True).csv(path).columns
    schema = T.StructType([T.StructField(n, T.StringType()) for n in names])
    reader = spark.read.option("header", True).option("enforceSchema", True)
    if quarantine:
        schema = schema.add("_corrupt", T.StringType())
        return reader.schema(schema).option("columnNameOfCorruptRecord", "_corrupt").csv(path)
    rows = reader.schema(schema).option("mode", "DROPMALFORMED").option("columnPruning", "false").csv(path)
    return rows.select(*(c for c in COLUMNS if c in names))


def from_vendor_wide(wide: DataFrame, symbols: Sequence[str], separator: str = "_") -> DataFrame:
    """Bars of a frame with a ``date`` column and one column for each ticker and field, named in
    either order; a ticker that lacks a field is left out."""
    named = {}
    for s in symbols:
        own = {f: next((c for c in (f"{s}{separator}{f}", f"{f}{separator}{s}") if c in wide.columns), None) for f in FIELDS}
        if all(own.values()):
            named[s] = own
    if not named:
        return wide.sparkSession.createDataFrame([], BARS)
    rows = F.array(
        *(F.struct(F.lit(s).alias("symbol"), *(F.col(f"`{c}`").cast("double").alias(FIELDS[f]) for f, c in own.items())) for s, own in named.items())
    )
    return wide.select(F.to_date("date").alias("date"), F.inline(rows)).where(" or ".join(f"{c} is not null" for c in OHLCV))


def from_vendor_json(payload: DataFrame, symbol: Column | str = "symbol") -> DataFrame:
    """Bars of JSON records with UTC time stamps; the adjusted fields are taken, never the raw ones,
    and without all of them there are no rows."""
    wanted = {f"adj{f}": c for f, c in FIELDS.items()}
    if not set(wanted) <= set(payload.columns):
        return payload.sparkSession.createDataFrame([], BARS)
    day = F.to_date(F.substring(F.col("date").cast("string"), 1, 10))
    return payload.select(day.alias("date"), as_column(symbol).alias("symbol"), *(F.col(f).cast("double").alias(c) for f, c in wanted.items()))


def from_vendor_csv(frame: DataFrame, symbol: Column | str) -> DataFrame:
    """Bars of files with capitalised columns: of one symbol, named by a string, or of many, by a column."""
    date = "Date" if "Date" in frame.columns else frame.columns[0]
    return frame.select(F.to_date(date).alias("date"), (symbol if isinstance(symbol, Column) else F.lit(symbol)).alias("symbol"), *(F.col(f).cast("double").alias(c) for f, c in FIELDS.items()))


def vendor_symbol(symbol: Column | str) -> Column:
    return F.concat(normalize_symbol(symbol), F.lit(".US"))


# -- cleaning


def keep_last(rows: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The last row of each key in a total order."""
    last = Window.partitionBy(*keys).orderBy(*(c.desc_nulls_last() for c in order))
    return rows.withColumn("_nth", F.row_number().over(last)).where("_nth = 1").drop("_nth")


def clean_bars(raw: DataFrame, as_of: dt.date, sequence: str | None = None) -> DataFrame:
    """Bars with all defects removed: rows without keys, dates or numbers, dates beyond ``as_of``,
    and all but the last of each date and symbol. ``sequence`` orders the rows: the order in which files
    are read is none that holds. Without it the largest by its numbers is the last."""
    order = F.col(sequence) if sequence else F.lit(0)
    parsed = raw.where("date is not null and symbol is not null").select(
        F.col("date").try_cast("date").alias("date"),
        normalize_symbol("symbol").alias("symbol"),
        *(clean_double(c).alias(c) for c in OHLCV),
        order.alias("_order"),
    )
    latest = as_of + dt.timedelta(days=FUTURE_DAYS)
    whole = parsed.where(F.col("date").isNotNull() & (F.col("date") <= F.lit(latest))).dropna(subset=list(OHLCV))
    return keep_last(whole, ["date", "symbol"], [F.col("_order"), *map(F.col, OHLCV)]).drop("_order").select(*COLUMNS)


def validation_report(bars: DataFrame) -> DataFrame:
    """One row: how many rows break each rule, in the order in which the rules are checked."""
    rows = bars.select(
        F.col("date").try_cast("date").alias("date"), F.col("symbol"), *(clean_double(c).alias(c) for c in OHLCV)
    )
    per_key = rows.groupBy("date", "symbol").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col("date").isNull() | F.col("symbol").isNull()).alias("null_keys"),
        F.count_if(F.array_contains(F.array(*(F.col(c).isNull() for c in OHLCV)), True)).alias("non_numeric"),
        F.count_if(F.array_contains(F.array(*(F.coalesce(F.col(c) <= 0, F.lit(False)) for c in OHLCV[:4])), True)).alias("non_positive_price"),
        F.count_if(F.col("volume") < 0).alias("negative_volume"),
    )
    names = ("null_keys", "non_numeric", "non_positive_price", "negative_volume")
    return per_key.agg(
        *(F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c) for c in names),
        F.coalesce(F.sum(F.when(F.col("n") > 1, F.col("n") - 1).otherwise(0)), F.lit(0)).cast("long").alias("duplicate_keys"),
        F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("rows"),
    )


def validate_bars(bars: DataFrame) -> DataFrame:
    """The bars with dates and numbers typed, or InvalidBars for the first rule that does not hold."""
    missing = [c for c in COLUMNS if c not in bars.columns]
    if missing:
        raise InvalidBars(f"missing columns: {', '.join(missing)}")
    report = validation_report(bars).first().asDict()
    for rule, n in report.items():
        if rule != "rows" and n:
            raise InvalidBars(f"{rule.replace('_', ' ')}: {n} rows")
    return bars.select(F.col("date").cast("date").alias("date"), "symbol", *(F.col(c).cast("double").alias(c) for c in OHLCV))


# -- merging and planning


def merge_history(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """Both histories with one bar for each date and symbol; the incoming one wins."""
    both = existing.select(*COLUMNS, F.lit(0).alias("_from")).unionByName(incoming.select(*COLUMNS, F.lit(1).alias("_from")))
    both = both.withColumn("date", F.to_date("date")).withColumn("symbol", normalize_symbol("symbol"))
    return keep_last(both, ["date", "symbol"], [F.col("_from"), *map(F.col, OHLCV)]).select(*COLUMNS)


def fetch_plan(existing: DataFrame, requested: DataFrame, start: dt.date, overlap: int = OVERLAP_DAYS) -> DataFrame:
    """``symbol, status, fetch_start``: unknown symbols are fresh and fetched from ``start``; known
    ones from the earliest of their last dates less the overlap, but not before ``start``."""
    last = existing.groupBy("symbol").agg(F.max("date").alias("last"))
    wanted = requested.select(normalize_symbol("symbol").alias("symbol")).distinct().join(last, "symbol", "left")
    earliest = wanted.agg(F.date_sub(F.min("last"), overlap).alias("earliest"))
    return wanted.join(F.broadcast(earliest)).select(
        "symbol",
        F.when(F.col("last").isNull(), "fresh").otherwise("cached").alias("status"),
        F.when(F.col("last").isNull(), F.lit(start)).otherwise(F.greatest(F.lit(start), F.col("earliest"))).alias("fetch_start"),
    )


def missing_symbols(bars: DataFrame, requested: DataFrame) -> DataFrame:
    """Requested symbols that have no bar."""
    wanted = requested.select(normalize_symbol("symbol").alias("symbol")).distinct()
    return wanted.join(bars.select("symbol").distinct(), "symbol", "left_anti")


def between(bars: DataFrame, start: dt.date | None = None, end: dt.date | None = None, symbols: Sequence[str] | DataFrame | None = None) -> DataFrame:
    """Bars of a window; a list of symbols is a filter, a table of them a semi-join."""
    if start:
        bars = bars.where(F.col("date") >= F.lit(start))
    if end:
        bars = bars.where(F.col("date") <= F.lit(end))
    if isinstance(symbols, DataFrame):
        return bars.join(symbols.select(normalize_symbol("symbol").alias("symbol")).distinct(), "symbol", "left_semi").select(*bars.columns)
    if symbols:
        bars = bars.where(F.col("symbol").isin([normal_symbol(s) for s in symbols]))
    return bars


def bounded_sample(bars: DataFrame, max_symbols: int, max_days: int) -> DataFrame:
    """Bars of the first symbols by name, on their last dates only."""
    first = bars.select("symbol").distinct().orderBy("symbol").limit(max_symbols)
    own = bars.join(F.broadcast(first), "symbol", "left_semi")
    last = own.select("date").distinct().orderBy(F.col("date").desc()).limit(max_days)
    return own.join(F.broadcast(last), "date", "left_semi").select(*bars.columns)


def data_window(bars: DataFrame) -> DataFrame:
    """One row: first and last date, symbols and rows."""
    per_symbol = bars.groupBy("symbol").agg(F.min("date").alias("first"), F.max("date").alias("last"), F.count(F.lit(1)).alias("n"))
    return per_symbol.agg(
        F.min("first").alias("start_date"), F.max("last").alias("end_date"), F.count(F.lit(1)).alias("symbols"), F.coalesce(F.sum("n"), F.lit(0)).alias("rows")
    )


# -- building


def from_ticks(ticks: DataFrame) -> DataFrame:
    """Bars of ``symbol, date, price, size, order``: open and close are the prices of the first and
    last tick by ``order``, which is unique in a symbol's day."""
    return ticks.groupBy("date", "symbol").agg(
        F.min_by("price", "order").alias("open"),
        F.max("price").alias("high"),
        F.min("price").alias("low"),
        F.max_by("price", "order").alias("close"),
        F.sum("size").alias("volume"),
    ).select(*COLUMNS)
