"""Series cut into blocks of time, with the rows around that windows reach into.

Rows of each series are numbered from counts by ranges, so no task orders a whole series; a block takes
its own rows and, as a halo, those just before and after it. Windows over blocks are then those over
series, for every row that is not of the halo.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gapbook.sources.scratch import materialise


def placed(frame: DataFrame, series: str, order: str) -> DataFrame:
    """``frame`` with ``_pos``, each row's place in its series, from 0 on; equal places in the order go
    in any order."""
    ranged = materialise(frame.repartitionByRange(series, order).withColumn("_range", F.spark_partition_id()), "time-ranges")
    counts = ranged.groupBy(F.col(series).alias("_s"), F.col("_range").alias("_r")).agg(F.count(F.lit(1)).alias("_n"))
    # a row for each range of a series
    before = Window.partitionBy("_s").orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_s", "_r", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inside = F.row_number().over(Window.partitionBy(series, "_range").orderBy(order)) - 1
    rows = ranged.withColumn("_inside", inside)
    joined = rows.join(offsets, F.col(series).eqNullSafe(F.col("_s")) & (F.col("_range") == F.col("_r")))
    return joined.withColumn("_pos", F.col("_before") + F.col("_inside")).drop("_s", "_r", "_range", "_before", "_inside")


def in_blocks(frame: DataFrame, series: str, order: str, rows: int, before: int, after: int) -> DataFrame:
    """``frame`` with ``_block`` of ``rows`` rows of a series, and again, with ``_halo`` true, the ``before``
    rows before each block and the ``after`` rows after it."""
    if rows < max(before, after, 1):
        raise ValueError("a block holds as many rows as its halo at least")
    block, place = F.floor(F.col("_pos") / rows), F.col("_pos") % rows
    copies = F.array(
        F.struct(block.alias("_block"), F.lit(False).alias("_halo")),
        F.when(place >= rows - before, F.struct((block + 1).alias("_block"), F.lit(True).alias("_halo"))),
        F.when((place < after) & (block > 0), F.struct((block - 1).alias("_block"), F.lit(True).alias("_halo"))),
    )
    return placed(frame, series, order).select("*", F.inline(F.array_compact(copies))).drop("_pos")
