"""Connected components of a graph of links, as Spark jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gapbook.llm.common import materialise


def connected_components(links: DataFrame, tag: str = "components") -> DataFrame:
    """``id, component`` for every id in ``links`` (``a, b``, any order, repeats allowed), where the
    component is the smallest id reachable.

    Alternates large-star and small-star steps (Kiveris et al., 2014): each step replaces links by
    as many links to smaller ids at most, and the number of steps grows with the logarithm of the
    number of links. Every step is written to the shared folder, which cuts the lineage.
    """
    current = materialise(
        links.select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).where("hi <> lo").distinct(), tag
    )
    seen = None
    while True:
        # large star: larger neighbours of each node go to its smallest neighbour
        both = current.unionByName(current.select(F.col("lo").alias("hi"), F.col("hi").alias("lo")))
        least = both.groupBy("hi").agg(F.min("lo").alias("least"))
        # written first: a join of two plain shuffles lets Spark split the links of a hub
        least = materialise(least.select(F.col("hi").alias("node"), F.least("hi", "least").alias("least")), tag)
        large = (
            both.select(F.col("hi").alias("node"), F.col("lo").alias("other"))
            .where("other > node")
            .join(least, "node")
            .select(F.col("other").alias("hi"), F.col("least").alias("lo"))
            .distinct()
        )
        # small star: smaller neighbours of each node, and the node, go to the smallest of them
        least = large.groupBy("hi").agg(F.min("lo").alias("least"))
        small = (
            large.join(least, "hi")
            .select(F.explode(F.array("lo", "hi")).alias("hi"), F.col("least").alias("lo"))
            .where("hi <> lo")
            .distinct()
        )
        current = materialise(small, tag)
        mark = current.agg(
            F.count(F.lit(1)), F.countDistinct("hi"), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))
        ).first()
        if mark == seen:
            return current.select(F.col("hi").alias("id"), F.col("lo").alias("component")).unionByName(
                current.select(F.col("lo").alias("id"), F.col("lo").alias("component")).distinct()
            )
        seen = mark
