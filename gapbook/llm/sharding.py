"""Sharding by jump consistent hashing.

A document's shard follows from its key and the number of shards alone: there is no ring table, and
going from n to n + 1 shards moves rows only into the new shard, about 1/(n + 1) of them. Slots
number the rows of a shard without gaps; they come from counts by ranges of rows, as many as there are
partitions, so no task ever holds a whole shard, however sparse or alike the ids are.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gapbook.llm.common import materialise, text_or_empty

SHARDS = 24


def jump_hash(keys: np.ndarray, shards: int) -> np.ndarray:
    """Jump consistent hash (Lamping and Veach, 2014) of unsigned 64-bit keys, for all keys at once."""
    key = keys.astype(np.uint64)
    bucket = np.full(len(key), -1, np.int64)
    ahead = np.zeros(len(key), np.int64)
    with np.errstate(over="ignore"):
        while (live := np.flatnonzero(ahead < shards)).size:
            bucket[live] = ahead[live]
            key[live] = key[live] * np.uint64(2862933555777941757) + np.uint64(1)
            odds = float(1 << 31) / ((key[live] >> np.uint64(33)).astype(np.float64) + 1.0)
            ahead[live] = ((bucket[live] + 1) * odds).astype(np.int64)
    return bucket


def shard_of(key: Column, shards: int) -> Column:
    """The shard of a stable 64-bit key."""

    @F.pandas_udf("int")
    def jump(keys: pd.Series) -> pd.Series:
        return pd.Series(jump_hash(keys.to_numpy(np.int64).view(np.uint64), shards), dtype="int32")

    return jump(key)


def shard(docs: DataFrame, shards: int = SHARDS, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """Each document's shard and place in it.

    Returns ``id_col, size, text_crc32, law, shard, slot, grown_shard``: ``size`` is the UTF-8 bytes
    of the text (none for null) plus 8; ``law`` is ``key``; ``slot`` runs from 0 in each shard by id,
    then crc, then size (rows equal in all three are alike, so their order is immaterial);
    ``grown_shard`` is the shard if there were one more. The crc of a null text is that of an empty
    one. All null ids share a key and a shard, where they stand first. Ids may be sparse or negative.
    Texts of any length are read whole and stay where they are; only ids and numbers move. Other columns
    are ignored.
    """
    data = text_or_empty(text_col).cast("binary")
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        (F.length(data) + 8).cast("long").alias("size"),
        F.crc32(data).alias("text_crc32"),
    ).withColumn("key", F.xxhash64("doc_id"))
    rows = rows.select(
        "doc_id",
        "size",
        "text_crc32",
        shard_of(F.col("key"), shards).alias("shard"),
        shard_of(F.col("key"), shards + 1).alias("grown_shard"),
        # rows alike in all else may be a large part of a table, and still fall into several ranges
        F.monotonically_increasing_id().alias("tie"),
    )
    order = ["doc_id", "text_crc32", "size", "tie"]
    rows = materialise(rows, "shard")
    ranged = materialise(rows.repartitionByRange(*order).withColumn("range", F.spark_partition_id()), "shard-ranges")
    # a row for each range and shard
    before = Window.partitionBy("shard").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    counts = ranged.groupBy("shard", "range").agg(F.count(F.lit(1)).alias("n"))
    offsets = counts.select("shard", "range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    inside = Window.partitionBy("shard", "range").orderBy(*order)
    return (
        ranged.withColumn("rank", F.row_number().over(inside) - 1)
        .join(offsets, ["shard", "range"])
        .select(
            F.col("doc_id").alias(id_col),
            "size",
            "text_crc32",
            F.lit("key").alias("law"),
            "shard",
            (F.col("offset") + F.col("rank")).cast("long").alias("slot"),
            "grown_shard",
        )
    )
