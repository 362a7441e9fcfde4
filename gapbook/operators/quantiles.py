"""Exact quantiles of groups of any size, without a buffer of all their values.

A histogram of each group between its least and greatest value says in which bucket a rank lies; the
next one divides that bucket alone, between the values that it really has. Once a bucket holds few
values, or one value many times, the rank is read off. Buckets are counted by all tasks, so a group may
be the whole table.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gapbook.sources.scratch import discard, materialise

#: Buckets of a histogram, and values that are collected at once for a rank.
BUCKETS, BUFFER = 1024, 10_000


def exact_quantiles(frame: DataFrame, value: str, shares: Sequence[float], by: Sequence[str] = (), buffer: int = BUFFER) -> DataFrame:
    """``*by, share, quantile``, by linear interpolation between ranks, for each group with a value.

    Nulls and NaN are no values; values are finite. Keys may be null. ``buffer`` bounds what a group
    collects for a rank; the number of histograms grows with the logarithm of the range of the values
    over their distances, not with their number.
    """
    keys = [f"_k{i}" for i in range(len(by))]
    own = [F.col(c).alias(k) for c, k in zip(by, keys, strict=True)]
    rows = frame.select(*own, F.col(value).cast("double").alias("_v")).where("_v is not null and not isnan(_v)")
    rows = materialise(rows, "quantile-values")
    group = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi")).where("_n > 0")
    wanted = F.array(*(F.lit(float(s)) for s in shares))
    place = F.col("_share") * (F.col("_n") - 1)
    sides = F.array(F.floor(place), F.ceil(place))
    ranks = group.withColumn("_share", F.explode(wanted)).withColumn("_part", place - F.floor(place)).select("*", F.posexplode(sides).alias("_side", "_rank"))
    ranks = materialise(ranks, "quantile-ranks")
    while not ranks.where((F.col("_n") > buffer) & (F.col("_lo") < F.col("_hi"))).isEmpty():
        after = materialise(_narrowed(rows, ranks, keys, buffer), "quantile-ranks")
        discard(ranks)
        ranks = after
    ends = [*keys, "_lo", "_hi"]
    few = _within(rows, ranks.where("_lo < _hi"), keys).groupBy(*ends).agg(F.sort_array(F.collect_list("_v")).alias("_values"))
    at = F.coalesce(F.get("_values", F.col("_rank").cast("int")), F.col("_lo"))
    found = ranks.join(_right(few, ends), _same(ends), "left").select(*keys, "_share", "_part", "_side", at.alias("_value"))
    pairs = found.groupBy(*keys, "_share", "_part").agg(F.min_by("_value", "_side").alias("_low"), F.max_by("_value", "_side").alias("_high"))
    quantile = F.when(F.col("_part") > 0, F.col("_low") + F.col("_part") * (F.col("_high") - F.col("_low"))).otherwise(F.col("_low"))
    return pairs.select(*(F.col(k).alias(c) for c, k in zip(by, keys, strict=True)), F.col("_share").alias("share"), quantile.alias("quantile"))


def _right(frame: DataFrame, names: Sequence[str]) -> DataFrame:
    """The right side of a join: its names begin with an ``r``."""
    return frame.withColumnsRenamed({c: f"r{c}" for c in names})


def _same(names: Sequence[str]) -> Column:
    on = F.lit(True)
    for c in names:
        on = on & F.col(c).eqNullSafe(F.col(f"r{c}"))
    return on


def _within(rows: DataFrame, ranks: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``*keys, _lo, _hi, _v`` of the values in each range of ``ranks``: a few ranges a group."""
    ranges = _right(ranks.select(*keys, "_lo", "_hi").distinct(), keys)
    return rows.join(ranges, _same(keys) & F.col("_v").between(F.col("_lo"), F.col("_hi"))).select(*keys, "_lo", "_hi", "_v")


def _narrowed(rows: DataFrame, ranks: DataFrame, keys: Sequence[str], buffer: int) -> DataFrame:
    """The ranks, those of wide ranges within the bucket in which they lie."""
    wide = (F.col("_n") > buffer) & (F.col("_lo") < F.col("_hi"))
    span = F.col("_hi") / 2 - F.col("_lo") / 2
    bucket = F.least(F.lit(BUCKETS - 1), F.floor((F.col("_v") / 2 - F.col("_lo") / 2) / span * BUCKETS))
    own = [*keys, "_lo", "_hi"]
    counts = _within(rows, ranks.where(wide), keys).groupBy(*own, bucket.alias("_bucket")).agg(F.count(F.lit(1)).alias("_m"), F.min("_v").alias("_from"), F.max("_v").alias("_to"))
    # a row a bucket
    before = F.sum("_m").over(Window.partitionBy(*own).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1))
    counts = _right(counts.withColumn("_before", F.coalesce(before, F.lit(0))), own)
    inside = (F.col("_rank") >= F.col("_before")) & (F.col("_rank") < F.col("_before") + F.col("_m"))
    closer = ranks.where(wide).join(counts, _same(own) & inside).select(
        *keys, F.col("_m").alias("_n"), F.col("_from").alias("_lo"), F.col("_to").alias("_hi"), "_share", "_part", "_side", (F.col("_rank") - F.col("_before")).alias("_rank")
    )
    return ranks.where(~wide).select(closer.columns).unionByName(closer)
