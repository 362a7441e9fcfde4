"""Small helpers shared by the text operators."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gapbook.sources.scratch import materialise

__all__ = ["SLICE_BYTES", "materialise", "sliced", "table", "text_or_empty"]

#: Text bytes handled at once inside a Python task; bounds the memory of vectorised steps.
SLICE_BYTES = 2 << 20


def text_or_empty(text_col: str) -> Column:
    return F.coalesce(F.col(text_col), F.lit(""))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sliced(batches: Iterator[pa.RecordBatch], column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut record batches so that ``column`` (a string or binary column) holds about ``limit``
    bytes in each; a longer value stands alone."""
    import numpy as np
    import pyarrow.compute as pc

    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(column))), 0)
        cuts = np.cumsum(sizes.to_numpy(zero_copy_only=False).astype(np.int64)) // limit
        starts = np.flatnonzero(np.diff(cuts, prepend=cuts[0] - 1))
        for a, b in zip(starts, [*starts[1:], batch.num_rows], strict=True):
            yield batch.slice(a, b - a)
