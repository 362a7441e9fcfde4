"""Mixing sources to target weights by Poisson replication, in DataFrame functions alone.

A source's repetition rate is its target share of the wanted number of documents over the documents
it has. Each document's count is a Poisson variate with that mean, found by inverting the
distribution at a uniform number hashed from the seed and the document; the document is exploded by
its count, and the copies are shuffled globally: a second uniform number is each copy's place, and
the partitions hold equal ranges of places in ascending order. Every number follows from the seed and
the document alone, so a lost task that runs again gives the same rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gapbook.llm.common import materialise

SEED = "mix-1"
#: Sources are weighted by their documents to this power: 1 leaves the mix, 0 makes all equal.
POWER = 0.5
#: Longest table of a Poisson distribution; above the mean it would serve, counts are split.
PART_MEAN = 32.0
#: Sources whose tables are broadcast at most; beyond, documents are joined by source and salt.
BROADCAST_SOURCES, SALTS = 20_000, 64


def uniform(*parts: Column) -> Column:
    """A number in [0, 1) from the first 52 bits of the MD5 of the parts joined by bars."""
    digest = F.md5(F.concat_ws("|", *parts).cast("binary"))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def rates(docs: DataFrame, source_col: str = "source", power: float = POWER, targets: DataFrame | None = None) -> DataFrame:
    """``source, n, rate, parts, cdf``: documents, repetition rate and cumulative distribution.

    ``targets`` (``source, weight``) sets the weights; without it they are ``n ** power``. The mix
    keeps the number of documents. A source that is absent from ``targets`` gets no weight; one that
    stands there twice, and a weight that is null, negative or not finite, is an error. A rate above
    PART_MEAN is the sum of ``parts`` equal ones, whose table stays short.
    """
    counted = docs.groupBy(F.col(source_col).alias("source")).agg(F.count(F.lit(1)).alias("n"))
    if targets is None:
        weighted = counted.withColumn("weight", F.pow(F.col("n").cast("double"), F.lit(power)))
    else:
        given = materialise(targets.select(F.col("source").alias("given"), F.col("weight").cast("double").alias("weight")), "mix-targets")
        wrong = F.col("weight").isNull() | ~F.coalesce(F.col("weight").between(0.0, 1.7e308), F.lit(False))
        if not given.where(wrong).isEmpty():
            raise ValueError("a target weight is null, negative or not finite")
        if not given.groupBy("given").agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty():
            raise ValueError("a source has two target weights")
        weighted = counted.join(given, F.col("source").eqNullSafe(F.col("given")), "left").drop("given").fillna(0.0, ["weight"])
    weighted = materialise(weighted, "mix-weights")
    weights, rows = weighted.agg(F.sum("weight"), F.sum("n")).first()
    mean = F.col("rate") / F.col("parts")
    # p(0..k) by the recursion p(k) = p(k - 1) * mean / k, summed as it goes
    steps = F.aggregate(
        F.sequence(F.lit(1), F.ceil(mean + 12 * F.sqrt(mean) + 24).cast("int")),
        F.struct(F.exp(-mean).alias("p"), F.array(F.exp(-mean)).alias("cdf")),
        lambda acc, k: F.struct(
            (acc["p"] * mean / k).alias("p"),
            F.concat(acc["cdf"], F.array(F.element_at(acc["cdf"], -1) + acc["p"] * mean / k)).alias("cdf"),
        ),
        lambda acc: acc["cdf"],
    )
    return (
        weighted.withColumn("rate", F.lit(float(rows)) * F.col("weight") / F.lit(float(weights)) / F.col("n") if weights else F.lit(0.0))
        .withColumn("parts", F.greatest(F.lit(1), F.ceil(F.col("rate") / PART_MEAN)).cast("int"))
        .select("source", "n", "rate", "parts", steps.alias("cdf"))
    )


def _with_rates(docs: DataFrame, tables: DataFrame, source_col: str, id_col: str) -> DataFrame:
    tables = materialise(tables, "mix-rates").select(F.col("source").alias("__mix_source"), *(F.col(c).alias(f"__mix_{c}") for c in ("rate", "parts", "cdf")))
    same = F.col(source_col).eqNullSafe(F.col("__mix_source"))
    if tables.count() <= BROADCAST_SOURCES:
        return docs.join(F.broadcast(tables), same, "left")
    salted = tables.withColumn("__mix_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return docs.join(salted, same & (F.pmod(F.xxhash64(id_col), F.lit(SALTS)) == F.col("__mix_salt")), "left").drop("__mix_salt")


def mix(
    docs: DataFrame,
    targets: DataFrame | None = None,
    power: float = POWER,
    seed: str = SEED,
    source_col: str = "source",
    id_col: str = "doc_id",
) -> DataFrame:
    """The rows of ``docs``, each repeated by its Poisson count, in a global random order.

    Adds ``mix_copy`` (0 for the first copy), ``mix_rate`` and ``mix_order``, a uniform number by which
    the result is ordered, from its first partition to its last; equal numbers go by id and copy. Any
    column of these names in ``docs`` is replaced. A null source is a source of its own. Rows that
    repeat an id get the same count. An empty table gives an empty result.
    """
    docs = docs.drop("mix_copy", "mix_rate", "mix_order")
    columns = docs.columns
    own = [F.lit(seed), F.coalesce(F.col(id_col).cast("string"), F.lit("null"))]
    rows = _with_rates(docs, rates(docs, source_col, power, targets), source_col, id_col)
    count = F.aggregate(
        F.sequence(F.lit(1), F.col("__mix_parts")),
        F.lit(0),
        lambda total, part: total
        + F.size(F.filter("__mix_cdf", lambda c: c < uniform(*own, F.lit("count"), part.cast("string")))),
    )
    # places are uniform, so equal ranges of them hold about equally many rows: no sample is needed
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return (
        rows.withColumn("__mix_count", count)
        .where("__mix_count > 0")
        .withColumn("mix_copy", F.explode(F.sequence(F.lit(0), F.col("__mix_count") - 1)))
        .withColumn("mix_order", uniform(*own, F.lit("order"), F.col("mix_copy").cast("string")))
        .select(*columns, F.col("__mix_rate").alias("mix_rate"), "mix_copy", "mix_order")
        .repartitionById(parts, F.floor(F.col("mix_order") * parts).cast("int"))
        .sortWithinPartitions("mix_order", id_col, "mix_copy")
    )
