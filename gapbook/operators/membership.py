"""Point-in-time membership: bars of symbols that belonged to the index on their date."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MISSING_SHOWN = 50


def apply_membership(bars: DataFrame, spells: DataFrame) -> DataFrame:
    """Bars that a spell covers, each once; without any spell all bars stay."""
    if spells.isEmpty():
        return bars
    s = spells.select(F.col("symbol").alias("_symbol"), "start_date", "end_date")
    covered = (
        (bars["symbol"] == s["_symbol"])
        & (bars["date"] >= s["start_date"])
        & (s["end_date"].isNull() | (bars["date"] <= s["end_date"]))
    )
    return bars.join(s, covered, "left_semi")


def membership_summary(bars: DataFrame, spells: DataFrame) -> DataFrame:
    """One row: whether membership is point in time, how many symbols it and the bars hold, and which
    of the bars' symbols have no spell (the first MISSING_SHOWN by name)."""
    priced = bars.select("symbol").distinct()
    members = spells.select("symbol").distinct()
    absent = priced.join(members, "symbol", "left_anti")
    shown = absent.orderBy("symbol").limit(MISSING_SHOWN).agg(F.sort_array(F.collect_list("symbol")).alias("missing_symbols"))
    counts = (
        members.agg(F.count(F.lit(1)).alias("member_symbols"))
        .join(priced.agg(F.count(F.lit(1)).alias("price_symbols")))
        .join(absent.agg(F.count(F.lit(1)).alias("missing_count")))
        .join(shown)
    )
    warning = F.when(F.col("member_symbols") == 0, F.lit("No membership history: results carry survivorship bias.")).when(
        F.col("missing_count") > 0, F.format_string("%d price symbols have no membership spell and are excluded.", "missing_count")
    )
    return counts.withColumn("point_in_time", F.col("member_symbols") > 0).withColumn("warning", warning)
