"""Phrases whose words occur together more often than apart, by language.

Words that occur often enough get numbers; texts become chunks of these. Level by level the n-grams
whose parts are candidates are packed into counting quotient filters, one for each chunk. Filters of
all chunks are merged quotient by quotient, and each chunk gets back which of its n-grams occur often
enough in all; only these are extended at the next level, as an n-gram is no more frequent than its
parts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gapbook.llm import word_chunks
from gapbook.llm.common import materialise
from gapbook.llm.quotient_filter import CountingQuotientFilter, Layout, merged
from gapbook.sources.scratch import discard

UNDETERMINED = "und"
#: Occurrences of a candidate, words in it, phrases returned a language, and the share (in hundredths) of
#: its occurrences inside a longer candidate from which a candidate goes.
LEAST, MOST_WORDS, TOP, INSIDE = 30, 4, 2000, 80
SCALE = 2_000_000
#: N-grams of all filters that meet at a quotient, on average, and the least quotient bits.
RUN_GRAMS, LEAST_QUOTIENT = 1 << 19, 6


def _translation() -> bytes:
    """Lower-case A-Z, and one byte for all that ends a piece."""
    table = bytearray(range(256))
    for c in range(ord("A"), ord("Z") + 1):
        table[c] = c + 32
    for c in b".,;:!?\x0a\x0b\x0c\x0d":
        table[c] = 10
    return bytes(table)


TRANSLATION = _translation()
#: A place that no phrase goes across. As it ends pieces, it is no word.
GAP = b"."


def split(text: bytes) -> list[bytes]:
    """The words of a text, with a break before each further piece and one at the end."""
    return (text.translate(TRANSLATION).replace(b"\n", b" . ") + b" .").split()


@dataclass(frozen=True)
class CollocationSettings:
    least: int = LEAST
    most_words: int = MOST_WORDS
    top: int = TOP
    inside: int = INSIDE


def _word_numbers(data: pa.Scalar) -> np.ndarray:
    return word_chunks.unpacked(data.as_py())


def _frequent_chunks(chunked: DataFrame, back: DataFrame) -> DataFrame:
    """``chunk, words, mask, grams``: the numbers of frequent words, a 0 for each stretch without any,
    packed; which places have a word; and how many pairs of words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                local = _word_numbers(batch.column(1)[k])
                given = batch.column(2)[k].values
                numbers = np.zeros(int(local.max(initial=0)) + 1, np.uint32)
                numbers[given.field("place").to_numpy()] = given.field("word_id").to_numpy()
                words = numbers[local]
                words = words[(words > 0) | (np.concatenate([[0], words[:-1]]) > 0)]
                yield _coded(batch.column(0)[k].as_py(), words, words > 0)

    return chunked.select("chunk", "tokens").join(back, "chunk").mapInArrow(run, "chunk long, words binary, mask binary, grams long")


def _coded(chunk: int, words: np.ndarray, mask: np.ndarray) -> pa.RecordBatch:
    grams = int(np.count_nonzero(mask[:-1] & mask[1:]))
    fields = [pa.array([chunk], pa.int64()), pa.array([word_chunks.packed(words)], pa.binary()), pa.array([np.packbits(mask).tobytes()], pa.binary()), pa.array([grams], pa.int64())]
    return pa.RecordBatch.from_arrays(fields, ["chunk", "words", "mask", "grams"])


def _filter(words: np.ndarray, mask: bytes, layout: Layout) -> tuple[np.ndarray, CountingQuotientFilter]:
    """Where n-grams begin whose first and last n - 1 words are candidates, and their filter."""
    known = np.unpackbits(np.frombuffer(mask, np.uint8), count=len(words)).astype(bool)
    at = np.flatnonzero(known[:-1] & known[1:])
    return at, CountingQuotientFilter(layout, *layout.packed([words[at + k] for k in range(layout.n)]))


def _runs(coded: DataFrame, layout: Layout) -> DataFrame:
    """The filter of each chunk, a row for each quotient."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                _, own = _filter(_word_numbers(batch.column(1)[k]), batch.column(2)[k].as_py(), layout)
                quotients, starts, low, high, counts = ([*x] for x in zip(*own.runs(), strict=True)) if len(own.a) else ([],) * 5
                fields = [pa.array([batch.column(0)[k].as_py()] * len(quotients), pa.int64()), pa.array(quotients, pa.int64()), pa.array(starts, pa.int64())]
                yield pa.RecordBatch.from_arrays([*fields, *(pa.array(x, pa.binary()) for x in (low, high, counts))], ["chunk", "quotient", "start", "low", "high", "counts"])

    return coded.select("chunk", "words", "mask").mapInArrow(run, "chunk long, quotient long, start long, low binary, high binary, counts binary")


def _merge(runs: DataFrame, layout: Layout, least: int) -> DataFrame:
    """Rows of two kinds: an n-gram's word numbers ``gram`` and total ``a``; and for each ``chunk`` which
    entries of its run from ``start`` on are such n-grams."""

    def run(group: pa.Table) -> pa.Table:
        group = group.combine_chunks()
        rows = [*zip(*(group.column(c).to_pylist() for c in ("low", "high", "counts")), strict=True)]
        words, total, often = merged(layout, group.column("quotient")[0].as_py(), rows, least)
        some = [k for k, o in enumerate(often) if o.any()]
        flat = np.stack(words, axis=1).ravel().astype(np.int64) if len(total) else np.zeros(0, np.int64)
        grams = pa.ListArray.from_arrays(pa.array(np.arange(len(total) + 1) * layout.n, pa.int32()), pa.array(flat, pa.int64()))

        def empty(n: int, kind: pa.DataType) -> pa.Array:
            return pa.nulls(n, kind)

        picked = group.take(pa.array(some, pa.int64()))
        bits = [np.packbits(often[k]).tobytes() for k in some]
        n, m = len(total), len(some)
        columns = {
            "gram": [grams, empty(m, pa.list_(pa.int64()))],
            "a": [pa.array(total, pa.int64()), empty(m, pa.int64())],
            "chunk": [empty(n, pa.int64()), picked.column("chunk").combine_chunks()],
            "start": [empty(n, pa.int64()), picked.column("start").combine_chunks()],
            "size": [empty(n, pa.int64()), pa.array([len(often[k]) for k in some], pa.int64())],
            "bits": [empty(n, pa.binary()), pa.array(bits, pa.binary())],
        }
        return pa.table({c: pa.chunked_array(v) for c, v in columns.items()})

    return runs.groupBy("quotient").applyInArrow(run, "gram array<long>, a long, chunk long, start long, size long, bits binary")


def _extended(coded: DataFrame, found: DataFrame, layout: Layout) -> DataFrame:
    """The chunks with the words of candidates of this level alone, and where these begin."""
    back = word_chunks.answers(found.where("chunk is not null"), "start", "size", "bits")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                words = _word_numbers(batch.column(1)[k])
                at, own = _filter(words, batch.column(2)[k].as_py(), layout)
                often = np.zeros(len(own.a), bool)
                for r in batch.column(3)[k].as_py():
                    often[r["start"] : r["start"] + r["size"]] = np.unpackbits(np.frombuffer(r["bits"], np.uint8), count=r["size"])
                begins = np.zeros(len(words), bool)
                begins[at[often[own.place]]] = True
                covered = begins.copy()
                for d in range(1, layout.n):
                    covered[d:] |= begins[:-d]
                yield _coded(batch.column(0)[k].as_py(), words[covered], begins[covered])

    rows = coded.select("chunk", "words", "mask").join(back, "chunk")
    return rows.mapInArrow(run, "chunk long, words binary, mask binary, grams long")


def _layout(coded: DataFrame, n: int, bits: int) -> Layout:
    grams = coded.agg(F.coalesce(F.sum("grams"), F.lit(0))).first()[0]
    wanted = max(LEAST_QUOTIENT, (grams // RUN_GRAMS).bit_length())
    return Layout(n, bits, min(wanted, (n + 1) // 2 * bits))


def phrase_counts(docs: DataFrame, s: CollocationSettings | None = None, text_col: str = "text", lang_col: str = "lang") -> tuple[DataFrame, DataFrame]:
    """``lang, phrase, size, a`` of all phrases of up to ``most_words`` words that occur ``least`` times or
    more in a language, and ``lang, n``, the words of each language. Both are exact."""
    s = s or CollocationSettings()
    lang = F.coalesce(F.col(lang_col).cast("string"), F.lit(UNDETERMINED))
    chunked = word_chunks.chunks(docs, F.lit(None), lang, F.col(text_col), split, "collocations", GAP)
    totals = materialise(chunked.select("key", F.aggregate("counts", F.lit(0).cast("long"), lambda x, y: x + y).alias("n")).groupBy(F.col("key").alias("lang")).agg(F.sum("n").alias("n")), "language-words")
    each = word_chunks.chunk_words(chunked)
    words = each.groupBy("key", "word").agg(F.sum("n").alias("a")).where(F.col("a") >= s.least)
    words = word_chunks.numbered(words, "word_id", "frequent-words")
    bits = max(1, int(words.agg(F.coalesce(F.max("word_id"), F.lit(0))).first()[0]).bit_length())
    if bits > 32:
        raise ValueError("more than 2 ** 32 frequent words")
    back = word_chunks.answers(each.join(words.select("key", "word", "word_id"), ["key", "word"]).select("chunk", "place", "word_id"), "place", "word_id")
    coded = materialise(_frequent_chunks(chunked, back), "frequent-chunks")
    discard(chunked)
    levels = []
    for n in range(2, s.most_words + 1):
        layout = _layout(coded, n, bits)
        found = materialise(_merge(_runs(coded, layout), layout, s.least), "merged-filters")
        levels.append(found.where("chunk is null").select("gram", "a"))
        if n < s.most_words:
            before, coded = coded, materialise(_extended(coded, found, layout), "extended-chunks")
            discard(before)
    discard(coded)
    one = words.select(F.col("key").alias("lang"), F.col("word").alias("phrase"), F.lit(1).alias("size"), "a")
    if not levels:
        return one, totals
    grams = levels[0]
    for more in levels[1:]:
        grams = grams.unionByName(more)
    spelled = grams.select("gram", "a", F.posexplode("gram").alias("place", "word_id")).join(words.select("word_id", "key", "word"), "word_id")
    spelled = spelled.groupBy("gram").agg(F.first("a").alias("a"), F.first("key").alias("lang"), F.array_sort(F.collect_list(F.struct("place", "word"))).alias("w"))
    phrase = F.concat_ws(" ", F.transform("w", lambda x: x["word"]))
    many = spelled.select("lang", phrase.alias("phrase"), F.size("w").alias("size"), "a")
    return materialise(one.unionByName(many), "phrase-counts"), totals


def _part(first: Column, length: Column) -> Column:
    return F.concat_ws(" ", F.slice("words", first, length))


def collocations(docs: DataFrame, s: CollocationSettings | None = None, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score``: each language's first ``top`` candidates.

    A candidate of several words is cut after each of its words but the last; l and r are the counts of
    both parts, and SCALE * a / (l + r), rounded down, scores the cut. The lowest score counts, of equal
    ones that of the first cut. A candidate goes that stands within a longer one to ``inside`` hundredths
    or more; as a phrase occurs no more often than its parts, those longer by one word tell.

    Null languages are one language, ``und``; null and empty texts have no words; repeated rows count
    each time; other columns are ignored. Texts are never divided, so a phrase is counted wherever it
    stands in a text of any length; a word of any length is one word. Ties go to the phrase that is less
    by its UTF-8 bytes. Sums are longs, products decimals of 38 digits.
    """
    s = s or CollocationSettings()
    return ranked(*phrase_counts(docs, s, text_col, lang_col), s)


def ranked(counted: DataFrame, totals: DataFrame, s: CollocationSettings) -> DataFrame:
    """The candidates of ``lang, phrase, size, a`` by their scores, with each language's ``n``."""
    long = counted.where("size > 1").withColumn("words", F.split("phrase", " "))
    cuts = F.sequence(F.lit(1), F.col("size") - 1)
    sides = F.flatten(
        F.transform(cuts, lambda k: F.array(F.struct(k.alias("k"), F.lit(True).alias("first"), _part(F.lit(1), k).alias("part")), F.struct(k.alias("k"), F.lit(False).alias("first"), _part(k + 1, F.col("size") - k).alias("part"))))
    )
    parts = long.select("lang", "phrase", "a", F.explode(sides).alias("s")).select("lang", "phrase", "a", "s.*")
    counts = counted.select("lang", F.col("phrase").alias("part"), F.col("a").alias("f"))
    cut = parts.join(counts, ["lang", "part"]).groupBy("lang", "phrase", "k").agg(
        F.first("a").alias("a"), F.max(F.when(F.col("first"), F.col("f"))).alias("l"), F.max(F.when(~F.col("first"), F.col("f"))).alias("r")
    )
    score = F.expr(f"cast(a as decimal(20, 0)) * {SCALE} div (cast(l as decimal(20, 0)) + r)")
    best = cut.withColumn("score", score).groupBy("lang", "phrase").agg(F.first("a").alias("a"), F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    ends = F.array(_part(F.lit(1), F.col("size") - 1), _part(F.lit(2), F.col("size") - 1))
    inside = long.where("size > 2").select("lang", "a", F.explode(ends).alias("phrase")).groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    covered = F.expr(f"cast(longer as decimal(20, 0)) * 100 >= cast(a as decimal(20, 0)) * {int(s.inside)}")
    left = best.join(inside, ["lang", "phrase"], "left").where(~F.coalesce(covered, F.lit(False)))
    order = Window.partitionBy("lang").orderBy(F.col("cut.score").desc(), F.col("a").desc(), "phrase")
    first = left.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= s.top)
    return first.join(totals, "lang").select("lang", "rank", "phrase", "a", "cut.l", "cut.r", "n", "cut.score")
