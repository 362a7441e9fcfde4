"""Texts as chunks of word numbers, each with its own dictionary.

Tasks split texts into words and number these chunk by chunk; what is known of a word over the whole
corpus (its number, its count) then comes back to each chunk that holds it. So no task ever needs the
whole vocabulary, and nothing is broadcast, however large it grows.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Callable, Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gapbook.llm.common import materialise, sliced

#: Words of a chunk; one text more may stand in it. A text is never divided. Tasks sort a chunk's n-grams,
#: some 100 bytes a word.
CHUNK_WORDS = 1_500_000
SCHEMA = "chunk long, key string, ids array<long>, counted array<boolean>, lengths array<long>, tokens binary, words array<string>, counts array<long>"
#: Words of all chunks that meet in a bucket of hashes, on average, and the least bits of a bucket's number.
BUCKET_WORDS, LEAST_BITS = 1 << 17, 6


def packed(numbers: np.ndarray) -> bytes:
    """Numbers in as few bytes each as the greatest needs, compressed: a shuffle then moves little."""
    top = int(numbers.max(initial=0))
    width = next(w for w in (1, 2, 4, 8) if top < 1 << 8 * w)
    raw = numbers.astype(f"<u{width}").tobytes()
    return bytes([width]) + len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def unpacked(data: bytes) -> np.ndarray:
    raw = pa.decompress(data[9:], decompressed_size=int.from_bytes(data[1:9], "little"), codec="zstd", asbytes=True)
    return np.frombuffer(raw, f"<u{data[0]}").astype(np.uint32 if data[0] <= 4 else np.uint64)


def hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(zlib.crc32, words), np.uint32, len(words))


class _Chunk:
    def __init__(self, gap: bytes | None) -> None:
        self.number: dict[bytes, int] = defaultdict(count(1).__next__)
        if gap is not None:
            self.number[gap] = 0
        self.ids: list[int | None] = []
        self.counted: list[bool] = []
        self.lengths: list[int] = []
        self.parts: list[np.ndarray] = []
        self.size = 0

    def add(self, doc_id: int | None, counted: bool, tokens: list[bytes]) -> None:
        part = np.fromiter(map(self.number.__getitem__, tokens), np.uint32, len(tokens))
        self.ids.append(doc_id)
        self.counted.append(counted)
        self.lengths.append(len(part))
        self.parts.append(part)
        self.size += len(part) + 1

    def row(self, chunk: int, key: str) -> pa.RecordBatch:
        tokens = np.concatenate([np.zeros(0, np.uint32), *self.parts])
        own = [w for w, n in self.number.items() if n]
        # words are numbered anew in the order of their hashes, so that a bucket of hashes is a stretch
        order = np.argsort(hashes(own), kind="stable")
        place = np.zeros(len(own) + 1, np.uint32)
        place[order + 1] = np.arange(1, len(own) + 1)
        tokens = place[tokens]
        told = np.repeat(np.array(self.counted, bool), self.lengths)
        counts = np.bincount(tokens[told], minlength=len(own) + 1)[1:]
        words = pa.array([own[k] for k in order.tolist()], pa.binary()).cast(pa.string())

        def one(values: pa.Array) -> pa.Array:
            return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)

        fields = [
            pa.array([chunk], pa.int64()),
            pa.array([key], pa.string()),
            one(pa.array(self.ids, pa.int64())),
            one(pa.array(self.counted, pa.bool_())),
            one(pa.array(self.lengths, pa.int64())),
            pa.array([packed(tokens)], pa.binary()),
            one(words),
            one(pa.array(counts, pa.int64())),
        ]
        return pa.RecordBatch.from_arrays(fields, ["chunk", "key", "ids", "counted", "lengths", "tokens", "words", "counts"])


def chunks(docs: DataFrame, doc_id: Column, key: Column, text: Column, split: Callable[[bytes], list[bytes]], tag: str, gap: bytes | None = None, size: int | None = None, counted: Column | None = None) -> DataFrame:
    """A written table of chunks: of texts with the same ``key``, their ids, their numbers of tokens, all
    tokens in a row as ``packed`` local numbers, and the words that these stand for from 1 on, in the order
    of their hashes, with their counts in texts that are ``counted`` (all). ``split`` makes tokens of the UTF-8 bytes of a text (a null text has none); the token ``gap``
    is no word and has number 0.

    A chunk holds ``size`` tokens (CHUNK_WORDS), and those of one text more; a task holds no more than
    that over all keys, as it writes all its chunks when they reach this sum.
    """
    most = size or CHUNK_WORDS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, written, held, total = TaskContext.get().partitionId() << 32, 0, {}, 0
        for batch in sliced(batches, "text"):
            for i, k, told, t in zip(*(batch.column(c).to_pylist() for c in range(4)), strict=True):
                chunk = held.get(k)
                if chunk is None:
                    chunk = held[k] = _Chunk(gap)
                total -= chunk.size
                chunk.add(i, told, split(t or b""))
                total += chunk.size
                if total >= most:
                    for name, full in held.items():
                        yield full.row(place + written, name)
                        written += 1
                    held, total = {}, 0
        for name, full in held.items():
            yield full.row(place + written, name)
            written += 1

    rows = docs.select(doc_id.cast("long").alias("doc_id"), key.alias("key"), (F.lit(True) if counted is None else counted).alias("counted"), text.cast("binary").alias("text"))
    return materialise(rows.mapInArrow(run, SCHEMA), f"{tag}-chunks")


def chunk_words(chunked: DataFrame) -> DataFrame:
    """``chunk, key, place, word, n``: the dictionaries of all chunks; a word's local number is its place."""
    each = chunked.select("chunk", "key", F.posexplode(F.arrays_zip("words", "counts")).alias("place", "w"))
    return each.select("chunk", "key", (F.col("place") + 1).alias("place"), F.col("w.words").alias("word"), F.col("w.counts").alias("n"))


def buckets(chunked: DataFrame) -> DataFrame:
    """``bucket, chunk, start, words, counts``: the dictionaries of all chunks by the first bits of the
    words' hashes, words joined by blanks and compressed, counts packed. There are as many buckets as keep
    their words, of all chunks, to BUCKET_WORDS on average."""
    total = chunked.agg(F.coalesce(F.sum(F.size("words")), F.lit(0))).first()[0]
    shift = 32 - min(max(LEAST_BITS, (total // BUCKET_WORDS).bit_length()), 32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                words = batch.column(1)[k].values.cast(pa.binary()).to_pylist()
                counts = batch.column(2)[k].values.to_numpy()
                bucket = hashes(words).astype(np.int64) >> shift
                starts = np.flatnonzero(np.diff(bucket, prepend=-1)).tolist()
                ends = [*starts[1:], len(words)]
                fields = [
                    pa.array(bucket[starts] if starts else [], pa.int64()),
                    pa.array([batch.column(0)[k].as_py()] * len(starts), pa.int64()),
                    pa.array(starts, pa.int64()),
                    pa.array([pa.compress(b" ".join(words[a:b]), codec="zstd", asbytes=True) for a, b in zip(starts, ends, strict=True)], pa.binary()),
                    pa.array([sum(map(len, words[a:b])) + b - a - 1 for a, b in zip(starts, ends, strict=True)], pa.int64()),
                    pa.array([packed(counts[a:b]) for a, b in zip(starts, ends, strict=True)], pa.binary()),
                ]
                yield pa.RecordBatch.from_arrays(fields, ["bucket", "chunk", "start", "words", "size", "counts"])

    return chunked.select("chunk", "words", "counts").mapInArrow(run, "bucket long, chunk long, start long, words binary, size long, counts binary")


def bucket_words(group: pa.Table) -> tuple[np.ndarray, np.ndarray, list[int]]:
    """Of one bucket's rows: the place of each word among the bucket's different ones, its count, and where
    the words of each row end."""
    number: dict[bytes, int] = defaultdict(count().__next__)
    places, counts = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for words, size, own in zip(*(group.column(c).to_pylist() for c in ("words", "size", "counts")), strict=True):
        each = pa.decompress(words, decompressed_size=size, codec="zstd", asbytes=True).split(b" ")
        places.append(np.fromiter(map(number.__getitem__, each), np.int64, len(each)))
        counts.append(unpacked(own).astype(np.int64))
    return np.concatenate(places), np.concatenate(counts), np.cumsum([len(p) for p in places[1:]]).tolist()


def numbered(frame: DataFrame, name: str, tag: str) -> DataFrame:
    """``frame`` written, with a gapless number from 1 on: each partition's rows follow those before it."""
    start = F.spark_partition_id().cast("long")
    rows = materialise(frame.withColumns({"_part": start, "_row": F.monotonically_increasing_id() - F.shiftleft(start, 33)}), tag)
    sizes = rows.groupBy("_part").agg(F.count(F.lit(1)).alias("n")).orderBy("_part").collect()  # a row a partition
    first, before = [], 0
    for r in sizes:
        first.append((r["_part"], before))
        before += r["n"]
    if not first:
        return rows.select(*frame.columns, F.lit(0).cast("long").alias(name))
    offsets = frame.sparkSession.createDataFrame(first, "_part long, _first long")
    return materialise(rows.join(F.broadcast(offsets), "_part").select(*frame.columns, (F.col("_first") + F.col("_row") + 1).alias(name)), tag)


def answers(rows: DataFrame, *values: str) -> DataFrame:
    """``chunk, answers``: for each chunk the structs ``values`` of its rows."""
    return rows.groupBy("chunk").agg(F.collect_list(F.struct(*values)).alias("answers"))


def answered(chunked: DataFrame, back: DataFrame, run: Callable[[pa.Table, pa.Table], pa.Table], schema: str) -> DataFrame:
    """``run`` of each chunk's row and of the rows of ``back`` for that ``chunk`` (none, if there are none),
    one chunk at a time."""
    asked = back.withColumn("asked", F.col("chunk") + 0).drop("chunk")
    return chunked.groupBy("chunk").cogroup(asked.groupBy("asked")).applyInArrow(run, schema)
