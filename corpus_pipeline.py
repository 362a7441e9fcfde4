"""Five stages that make a training corpus of ``documents``, each one of the text operators.

Each stage takes (spark, docs, sf_dir) and returns what it keeps; all but the last return the
columns of ``documents``, and other columns, whatever their names, go. The driver writes a stage's rows
as Parquet and reads them as the next stage's documents; ``run`` does the same. Texts of any length are
judged whole, and an empty table leaves every stage empty.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gapbook.llm import exact_dedup, langid, mixing, ngram_join, sentencepiece_codec
from gapbook.llm.common import materialise, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _named(docs: DataFrame, name: str, text: Column) -> DataFrame:
    """``docs`` and ``name``: a text's hash and the id, null ids and null texts apart from all others."""
    parts = [F.coalesce(F.sha2(text.cast("binary"), 256), F.lit("")), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))]
    return docs.withColumn(name, F.concat_ws(":", *parts))


def _keep(docs: DataFrame, verdicts: DataFrame, name: str) -> DataFrame:
    """One row of ``docs`` for each ``name`` in ``verdicts``: of several the least by its columns. Tasks
    choose among their own rows before these move, so that a name many rows share is no burden."""
    own = ["text", "lang", "source", "n_chars", "doc_id"]
    found = docs.join(verdicts.select(name), name, "left_semi").groupBy(name).agg(F.min(F.struct(*own)).alias("row"))
    return found.select("row.*").select(*COLUMNS)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a language (null, or not a letter in them) go."""
    docs = docs.select(*COLUMNS)
    model = langid.learn(docs)
    return langid.keep_identified(docs, model).select(*COLUMNS)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts one row with the smallest id stays; a null id loses to any other."""
    docs = docs.select(*COLUMNS)
    kept = exact_dedup.exact_dedup(docs).where("kept")
    kept = kept.select(F.concat_ws(":", "text_sha256", F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).alias("row_name"))
    return _keep(_named(docs, "row_name", exact_dedup.normalised("text")), kept, "row_name")


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five words, similarity 0.8) one row with the smallest id stays; a
    null id loses to any other. Rows that share an id, or have none, are judged by their own texts;
    of rows that repeat both one stays."""
    docs = docs.select(*COLUMNS)
    ids = docs.where("doc_id is not null").groupBy("doc_id").agg(F.count(F.lit(1)).alias("rows"))
    repeated = materialise(ids.where("rows > 1").select("doc_id"), "repeated-ids")
    missing = docs.where("doc_id is null")
    if repeated.isEmpty() and missing.isEmpty():
        kept = ngram_join.jaccard_components(docs).where("doc_id = component_id").select("doc_id")
        return docs.join(kept, "doc_id", "left_semi").select(*COLUMNS)
    named = _named(docs, "row_name", F.col("text"))
    odd = named.join(repeated, "doc_id", "left_semi").select("row_name").unionByName(named.where("doc_id is null").select("row_name"))
    # numbers below all ids stand for them
    low = docs.agg(F.least(F.min("doc_id"), F.lit(0))).first()[0]
    numbers = materialise(odd.distinct().select("row_name", (F.lit(low) - 1 - F.monotonically_increasing_id()).alias("number")), "numbers")
    numbered = named.join(numbers, "row_name", "left").withColumn("row_id", F.coalesce("number", "doc_id"))
    group = ngram_join.jaccard_components(numbered, id_col="row_id").select("row_id", "component_id").distinct()
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "row_name", "row_id")
    least = numbered.select("row_id", "doc_id", "row_name").join(group, "row_id").groupBy("component_id").agg(F.min(order).alias("least"))
    return _keep(numbered, least.select("least.row_id"), "row_id")


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources come nearer to equal weights: documents repeat or go by Poisson counts."""
    return mixing.mix(docs.select(*COLUMNS)).select(*COLUMNS)


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The piece ids of every row."""
    return sentencepiece_codec.round_trip(docs.select(*COLUMNS))


STAGES = [
    ("language ID", language),
    ("exact dedup", exact),
    ("n-gram Jaccard join", near),
    ("mixing sources to target weights", mix),
    ("SentencePiece encoding and decoding", pieces),
]

#: Language models, similarity components and piece ids are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
