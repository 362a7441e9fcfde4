"""Report sinks: each table in its format, partitioned by its run or method."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

FORMATS = ("parquet", "csv", "json")


def write_report(frame: DataFrame, path: str, fmt: str = "parquet", by: Sequence[str] = (), mode: str = "overwrite") -> None:
    """Write ``frame``; with ``by``, only the partitions that it holds are replaced."""
    if fmt not in FORMATS:
        raise ValueError(f"format must be one of {FORMATS}")
    writer = frame.write.mode(mode).format(fmt)
    if fmt == "csv":
        writer = writer.option("header", True)
    if by:
        writer = writer.partitionBy(*by).option("partitionOverwriteMode", "dynamic")
    writer.save(path)
