"""Document fingerprints by a homomorphic multiset hash, in DataFrame functions alone.

A paragraph is a line that is not empty, as it stands. Its vector has two halves. The wide one comes
from the SHA-256 of the whole paragraph, in WIDE lanes of 32 bits. The other is the sum over its pieces
of PIECE words, counted from the paragraph's start, of LANES lanes of 0 or 1 from the piece's MD5. A
document's fingerprint is the sum of its paragraphs' vectors modulo powers of two, so it does not
depend on their order, and a paragraph is inserted or deleted by adding or subtracting its vector.
Equal multisets of paragraphs have equal wide halves, and unlike ones have unlike halves but for a
chance of 2 ** -256; the 0/1 lanes, centred by the number of pieces, have a cosine that estimates the
share of common pieces.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gapbook.llm.common import materialise, text_or_empty

PIECE = 4
#: Lanes of one bit, from hex digits 1-15 of a piece's digest; lanes of 32 bits of a paragraph's.
LANES, WIDE = 60, 8
LANE_MOD, WIDE_MOD = 1 << 24, 1 << 32
#: Likeness of unlike fingerprints at most.
MOST_UNEQUAL = 0.999999
_PIECE = r"[^ \n]+(?: +[^ \n]+){0,%d}" % (PIECE - 1)
_PARAGRAPH = r"[^\n]+"


def _number(hex_digits: Column) -> Column:
    return F.conv(hex_digits, 16, 10).cast("long")


def vectors(docs: DataFrame, text_col: str, keys: list[str]) -> DataFrame:
    """``*keys, pieces, lanes, wide`` for each row of ``docs``, whose ``keys`` are unique. ``pieces``
    is the number of pieces modulo 2**24, as each lane is."""
    pieces = F.transform(F.regexp_extract_all(text_col, F.lit(_PIECE), F.lit(0)), lambda p: F.struct(F.lit(True).alias("piece"), p.alias("s")))
    whole = F.transform(F.regexp_extract_all(text_col, F.lit(_PARAGRAPH), F.lit(0)), lambda p: F.struct(F.lit(False).alias("piece"), p.alias("s")))
    parts = docs.select(*keys, F.explode_outer(F.concat(pieces, whole)).alias("part"))
    piece, data = F.col("part.piece"), F.col("part.s").cast("binary")
    hashed = parts.select(
        *keys,
        F.when(piece, _number(F.substring(F.md5(data), 1, 15))).alias("bits"),
        F.when(~piece, F.sha2(data, 256)).alias("digest"),
    )
    lane = [F.coalesce(F.sum(F.shiftright("bits", i).bitwiseAND(F.lit(1))), F.lit(0)) % LANE_MOD for i in range(LANES)]
    wide = [F.coalesce(F.sum(_number(F.substring("digest", 8 * i + 1, 8))), F.lit(0)) % WIDE_MOD for i in range(WIDE)]
    summed = hashed.groupBy(*keys).agg(F.count("bits").alias("pieces"), F.array(*lane).alias("lanes"), F.array(*wide).alias("wide"))
    return summed.withColumn("pieces", F.col("pieces") % LANE_MOD)


def insert(vector: Column, paragraph: Column, sign: int = 1) -> Column:
    """A fingerprint's vector (``pieces, lanes, wide`` in a struct) with the vector of a paragraph
    added, or with sign -1 taken away."""
    return F.struct(
        F.pmod(vector["pieces"] + sign * paragraph["pieces"], F.lit(LANE_MOD)).alias("pieces"),
        F.zip_with(vector["lanes"], paragraph["lanes"], lambda x, y: F.pmod(x + sign * y, F.lit(LANE_MOD))).alias("lanes"),
        F.zip_with(vector["wide"], paragraph["wide"], lambda x, y: F.pmod(x + sign * y, F.lit(WIDE_MOD))).alias("wide"),
    )


def printed(vector: Column) -> Column:
    """The fingerprint as text: pieces, wide lanes and lanes in hex."""
    def lanes(name: str) -> Column:
        return F.array_join(F.transform(vector[name], lambda x: F.hex(x)), ".")

    return F.concat_ws("-", F.hex(vector["pieces"]), lanes("wide"), lanes("lanes"))


def likeness(x: Column, y: Column) -> Column:
    """Cosine of the centred lanes, 0 where negative; 1 for equal fingerprints alone. Nothing is like an
    empty fingerprint but another one."""
    def dot(p: Column, q: Column) -> Column:
        return F.aggregate(
            F.zip_with(p["lanes"], q["lanes"], lambda s, t: (2 * s - p["pieces"]) * (2 * t - q["pieces"])), F.lit(0).cast("long"), lambda t, v: t + v
        ).cast("double")

    norm = F.sqrt(dot(x, x)) * F.sqrt(dot(y, y))
    most = F.lit(MOST_UNEQUAL)
    return F.when(x == y, F.lit(1.0)).when(norm > 0, F.greatest(F.lit(0.0), F.least(most, dot(x, y) / norm))).otherwise(0.0)


def next_ids(ids: DataFrame) -> DataFrame:
    """``id, n, next_id``: each row's next id in ascending order, the first after the last.

    Ids are dealt out by ranges and written, so each range is a window of its own; only the first
    id of each range meets those of the others.
    """
    ranged = materialise(ids.repartitionByRange("id").withColumn("range", F.spark_partition_id()), "ranges")
    heads = ranged.groupBy("range").agg(F.min("id").alias("head"))
    heads = heads.select("range", F.coalesce(F.lead("head").over(Window.orderBy("range")), F.min("head").over(Window.partitionBy(F.lit(1)))).alias("after"))
    inside = F.lead("id").over(Window.partitionBy("range").orderBy("id"))
    return ranged.withColumn("inside", inside).join(F.broadcast(heads), "range").select(
        "id", "n", F.coalesce("inside", "after").alias("next_id")
    )


def numbered(docs: DataFrame, text_col: str, id_col: str) -> tuple[DataFrame, bool]:
    """``id, doc_id, text`` with a number of its own for each row, ascending by id (null first), then
    text. Where every row has an id of its own, that is the number (True comes with it); else
    whole rows are sorted once more."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"))
    plain = rows.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1 or doc_id is null").isEmpty()
    if plain:
        return rows.withColumn("id", F.col("doc_id")), True
    # equal rows are alike, and dealt out by a third number
    copy = F.pmod(F.monotonically_increasing_id(), F.lit(1009))
    order = [F.asc_nulls_first("doc_id"), F.asc("hash"), F.asc("copy")]
    rows = materialise(rows.withColumns({"hash": F.xxhash64("text"), "copy": copy}), "fingerprint-rows")
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    return materialise(ranged.select("doc_id", "text", F.monotonically_increasing_id().alias("id")), "fingerprint-numbered"), False


def with_edited(rows: DataFrame) -> DataFrame:
    """``id, next_id, n, text, edited`` of ``id, text``, whose ids are unique: the last quarter of each text replaced by as much of the
    next one's beginning. Whole texts are shuffled once; both joins read the same exchange."""
    order = materialise(next_ids(rows.select("id", F.char_length("text").cast("long").alias("n"))), "neighbours")
    wants = order.select(F.col("next_id").alias("id"), F.col("id").alias("for_id"), F.floor(F.col("n") / 4).alias("quarter"))
    beginnings = rows.join(wants, "id").select(F.col("for_id").alias("id"), F.substring("text", F.lit(1), F.col("quarter").cast("int")).alias("beginning"))
    return (
        rows.join(order, "id")
        .join(beginnings, "id")
        .select(
            "id", "next_id", "n", "text", F.concat(F.substring("text", F.lit(1), (F.col("n") - F.floor(F.col("n") / 4)).cast("int")), "beginning").alias("edited")
        )
    )


def fingerprints(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """``id_col, fingerprint`` of every row's whole text; a null text counts as empty. Rows without an
    id and rows that repeat one have a fingerprint each."""
    rows, _ = numbered(docs, text_col, id_col)
    return vectors(rows, "text", ["id", "doc_id"]).select(F.col("doc_id").alias(id_col), printed(F.struct("pieces", "lanes", "wide")).alias("fingerprint"))


def edited_fingerprints(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """Fingerprints of every whole text and its edited text, and their likeness.

    Returns ``id_col, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited,
    near_next`` for every row. A null text counts as empty; a lone document is its own next one. Rows
    stand by id, those without one first, rows that repeat an id by a hash of their texts; each has
    the row after it as its next. Texts without a paragraph are alike, and texts of any length are read
    whole. Other columns are ignored.
    """
    rows, plain = numbered(docs, text_col, id_col)
    pairs = with_edited(rows.select("id", "text"))
    both = pairs.select(
        "id", "next_id", "n", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), F.explode(F.array(F.struct(F.lit(0).alias("which"), F.col("text").alias("t")), F.struct(F.lit(1).alias("which"), F.col("edited").alias("t")))).alias("v")
    )
    keys = ["id", "next_id", "n", "edited_sha256", "which"]
    found = vectors(both.select(*keys[:-1], "v.which", "v.t"), "t", keys)
    one = F.struct("pieces", "lanes", "wide")
    paired = materialise(
        found.groupBy("id", "next_id", "n", "edited_sha256").agg(
            F.max(F.when(F.col("which") == 0, one)).alias("own"), F.max(F.when(F.col("which") == 1, one)).alias("changed")
        ),
        "fingerprints",
    )
    after = paired.select(F.col("id").alias("next_id"), F.col("own").alias("next"))
    result = paired.join(after, "next_id").select(
        "id",
        F.col("n").alias("n_chars"),
        "edited_sha256",
        printed(F.col("own")).alias("fingerprint"),
        printed(F.col("changed")).alias("edited_fingerprint"),
        likeness(F.col("own"), F.col("changed")).alias("near_edited"),
        likeness(F.col("own"), F.col("next")).alias("near_next"),
    )
    if plain:
        return result.withColumnRenamed("id", id_col)
    return result.join(rows.select("id", F.col("doc_id").alias("doc")), "id").select(F.col("doc").alias(id_col), *result.columns[1:])
