"""The merge of late bars as a stream: each micro-batch replaces the days it touches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from gapbook.sources.bars import BARS, COLUMNS, keep_last, merge_history


def merge_batch(incoming: DataFrame, store: str, staging: str) -> None:
    """Merge one batch into the bars at ``store``, kept as Parquet by month; the incoming bar wins,
    and only the months the batch touches are read and written again."""
    spark = incoming.sparkSession
    unique = keep_last(incoming.select(*COLUMNS), ["date", "symbol"], [F.col(c) for c in COLUMNS[2:]])
    months = [r.month for r in unique.select(F.date_format("date", "yyyy-MM").alias("month")).distinct().collect()]
    if not months:
        return
    path = spark._jvm.org.apache.hadoop.fs.Path(store)
    exists = path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)
    merged = unique
    if exists:
        old = spark.read.parquet(store).where(F.col("month").isin(months)).select(*COLUMNS)
        merged = merge_history(old, unique)
    # what is read is also replaced, so the result is written aside first
    merged.write.mode("overwrite").parquet(staging)
    done = spark.read.schema(BARS).parquet(staging).withColumn("month", F.date_format("date", "yyyy-MM"))
    done.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("month").parquet(store)


def merge_stream(spark: SparkSession, source: str, store: str, checkpoint: str) -> StreamingQuery:
    """Merge every Parquet file that arrives at ``source``; available files are taken at once."""
    stream = spark.readStream.schema(BARS).parquet(source)
    sink = stream.writeStream.foreachBatch(lambda batch, _: merge_batch(batch, store, f"{checkpoint}/staging"))
    return sink.option("checkpointLocation", f"{checkpoint}/state").trigger(availableNow=True).start()
