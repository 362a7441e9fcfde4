"""Jaccard self-join on word shingles.

Two documents link when their sets of distinct shingles overlap by at least ``at_least`` percent of
their union. The work runs in five steps:

1. *Sets.* Words and shingles are hashed to 64 bits by vectorised arithmetic over whole batches.
   Documents with equal sets are one class and go on as its smallest id.
2. *Keys without loss.* Sizes fall into geometric bands so wide that linked sets lie in the same band
   or in neighbours. For each such pair of bands linked sets differ in at most d shingles; the hash
   range is cut into d + 1 parts and some spare ones, so linked sets agree in all of one that is not
   empty. Sets that share a part's content meet under a key and are tied to the smallest id there:
   first inside each map task, so that a key leaves a task once however many copies hold it, then
   across tasks. There are no more ties than keys. Two sets that share a key may be tied to different
   ids, those of their tasks, and these to a third; so groups are the connected components of the
   ties, in which every link shows up. A large component that passages shared by unlike documents
   string together has few ties for its size; there, each id with what one or two ties lead to it is
   a group of its own, if that makes fewer rows.
3. *Bit counts.* Groups are cut into size-banded tiles; each pair of tiles whose sizes allow a link is
   work of its own. There, hashed bitmap signatures bound the overlap of each pair from above by a
   bit count; pairs that pass, and are not yet connected in that tile, are kept. Their connected
   components are the candidate groups.
4. *Exact.* Only documents of candidate groups are read again. Equal sets become one class, its
   smallest id. Candidate groups are tiled in the same way, and there each pair that passes its bit
   count, and is not yet connected, is decided by intersecting sorted arrays.
5. *Components* of the links, and every row gets that of its class.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gapbook.llm.common import materialise, sliced, text_or_empty
from gapbook.llm.components import connected_components

#: Words in a shingle and percent of the union, as in the near-duplicate stages by default.
WORDS, AT_LEAST = 5, 80
#: Classes and elements of their sets in a tile at most (a larger set has one of its own), and how many
#: times as many where a tile holds bitmaps alone; bits of a bitmap for each element, and at least.
TILE, ELEMENTS, BIT_TILES, LOAD, LEAST_BITS = 512, 1 << 22, 4, 8, 256
#: Parts into which the sets of one size in a group are dealt before they are numbered.
SALTS = 64
#: Keys a map task holds before it passes them on; rows of ids that are broadcast at most.
HELD_KEYS, BROADCAST_ROWS = 1 << 20, 1_000_000
#: Up to so many parts none is spared for being empty.
FEW_PARTS = 12

_MUL = np.uint64(0x9E3779B97F4A7C15)
_POW = np.uint64(0xD6E8FEB86659FD93)


def _mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(29))) * _MUL
    return x ^ (x >> np.uint64(32))


_BYTE = _mix(np.arange(1, 257, dtype=np.uint64) * _MUL)
_LOWER = np.arange(256)
_LOWER[65:91] += 32
_BYTE = _BYTE[_LOWER]
_IS_BLANK = np.zeros(256, bool)
_IS_BLANK[[0x20, *range(9, 14)]] = True


def _powers(n: int, base: np.uint64) -> np.ndarray:
    out = np.ones(max(n, 1), np.uint64)
    out[1:] = base
    return np.multiply.accumulate(out)


def shingle_hashes(texts: pa.Array, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all shingles of UTF-8 ``texts`` in a row, and how many each text has. A text with
    fewer words than a shingle has one, its whole sequence; one without words has none."""
    texts = texts.cast(pa.large_binary())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = texts.buffers()[2]
    data = np.frombuffer(raw, np.uint8)[offsets[0] : offsets[-1]] if raw is not None else np.zeros(0, np.uint8)
    offsets = offsets - offsets[0]
    solid = ~_IS_BLANK[data]
    edge = np.zeros(len(data) + 1, bool)  # a word begins or ends before this byte
    edge[1:-1] = solid[1:] != solid[:-1]
    edge[offsets] = True
    begins = np.flatnonzero(edge[:-1] & solid)
    if not begins.size:
        return np.zeros(0, np.uint64), np.zeros(len(texts), np.int64)
    edges = np.flatnonzero(edge)
    ends = edges[np.searchsorted(edges, begins) + 1]
    # a word's hash: a polynomial in its mixed bytes, by position from its start
    at = np.zeros(len(data), np.int64)
    at[begins[0] :] = np.arange(begins[0], len(data)) - np.repeat(begins, np.diff(np.append(begins, len(data))))
    longest = int(at.max())
    power = _powers(min(longest + 1, 1 << 16), _POW)
    terms = np.where(solid, _BYTE[data] * power[at & 0xFFFF], np.uint64(0))
    if longest >> 16:
        # the power of a far place is that of its multiple of 65,536 times that of the rest
        terms *= _powers((longest >> 16) + 1, (power[-1:] * _POW)[0])[at >> 16]
    word = _mix(np.add.reduceat(terms, begins) + (ends - begins).astype(np.uint64))
    counts = np.searchsorted(begins, offsets[1:]) - np.searchsorted(begins, offsets[:-1])
    first = np.cumsum(counts) - counts
    # a shingle's hash: a polynomial in the hashes of its words
    power = _powers(words, _MUL)
    rolled = np.zeros(len(word), np.uint64)
    for k in range(words):
        rolled[: len(word) - k] += word[k:] * power[k]
    sizes = np.where(counts >= words, counts - words + 1, np.minimum(counts, 1))
    owner = np.repeat(np.arange(len(counts)), sizes)
    place = np.arange(len(owner)) - (np.cumsum(sizes) - sizes)[owner] + first[owner]
    out = rolled[place]
    for k in np.flatnonzero((counts > 0) & (counts < words)):
        few = word[first[k] : first[k] + counts[k]]
        out[np.searchsorted(owner, k)] = (few * power[: len(few)]).sum() + np.uint64(len(few))
    return _mix(out), sizes


def shingle_sets(texts: pa.Array, words: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    hashes, ends = distinct_hashes(texts, words)
    return [hashes[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]


def distinct_hashes(texts: pa.Array, words: int) -> tuple[np.ndarray, np.ndarray]:
    """The same in a row, and where each text's begin and end."""
    hashes, sizes = shingle_hashes(texts, words)
    ends = np.concatenate([[0], np.cumsum(sizes)])
    for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True):
        hashes[a:b].sort()
    new = np.ones(len(hashes), bool)
    new[1:] = hashes[1:] != hashes[:-1]
    new[ends[:-1][sizes > 0]] = True
    return hashes[new], np.concatenate([[0], np.cumsum(new)])[ends]


def bands(at_least: int, upto: int = 1 << 40) -> np.ndarray:
    """Lower ends of the size bands: a set and any it can link with are in one band or neighbours."""
    out = [1]
    while out[-1] < upto:
        # the largest size that can link with the band's smallest must be at most in the next band
        out.append(max(out[-1] + 1, out[-1] * 100 // at_least))
    return np.array(out, np.int64)


def differing(total: int, at_least: int) -> int:
    """The most shingles in which two linked sets of ``total`` elements in all can differ: from
    100 i >= at_least * u, with u = i + x and total = 2 i + x."""
    return (100 - at_least) * total // (100 + at_least)


def _part_sums(hashes: np.ndarray, which: np.ndarray, parts: int) -> np.ndarray:
    """A hash of the elements of each part, 0 for an empty one; ``which`` is ascending."""
    sums = np.zeros(parts, np.uint64)
    starts = np.flatnonzero(np.append(True, which[1:] != which[:-1]))
    sums[which[starts]] = np.add.reduceat(_mix(hashes + _POW), starts)
    return sums


@functools.lru_cache(maxsize=None)
def cut_of(low: int, smallest: int, small: int, large: int, at_least: int) -> tuple[int, int]:
    """Parts of the hash range for the sets of band ``low`` and the next, and how many of them may be
    empty: of a set of ``smallest`` elements hardly ever more are.

    Linked sets differ in at most d parts, so with d + 1 + e parts they agree in e + 1 at least, and
    a set with no more than e empty parts agrees in one that holds something.
    """
    need = differing(small + large, at_least) + 1
    spare = 0
    for _ in range(8 if need > FEW_PARTS else 0):
        empty = (need + spare) * math.exp(-smallest / (need + spare))
        spare = math.ceil(empty + 3 * math.sqrt(empty))
    return need + spare, spare


def part_keys(hashes: np.ndarray, band_ends: np.ndarray, at_least: int) -> np.ndarray:
    """Keys of one sorted set: for the band below with its own and for its own with the band above,
    a hash of each part of the hash range that holds something.

    Where more parts are empty than were spared, sets might agree in empty ones only. As that alone
    says little, each empty part is then joined with each part of a second, independent cut, of
    which linked sets agree in one as well.
    """
    n, out, high = len(hashes), [], hashes >> np.uint64(32)
    own = int(np.searchsorted(band_ends, n, side="right")) - 1
    for low in (own - 1, own):
        if low < 0:
            continue
        # the smaller set lies in band ``low``, the larger in it or the next
        small = int(band_ends[low + 1]) - 1
        large = min(int(band_ends[low + 2]) - 1, small * 100 // at_least)
        parts, spare = cut_of(low, int(band_ends[low]), small, large, at_least)
        salt = _mix(np.arange(parts, dtype=np.uint64) + np.uint64((low + 1) << 32))
        sums = _part_sums(hashes, (high * np.uint64(parts)) >> np.uint64(32), parts)
        full = sums != 0
        out.append(_mix(sums[full] ^ salt[full]))
        if parts - np.count_nonzero(full) > spare:
            second = ((hashes & np.uint64(0xFFFFFFFF)) * np.uint64(parts)) >> np.uint64(32)
            order = np.argsort(second, kind="stable")
            again = _mix(_part_sums(hashes[order], second[order], parts) ^ salt)
            out.append(_mix(again[None, :] + salt[~full][:, None] * _POW).ravel())
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def bitmap(hashes: np.ndarray) -> np.ndarray:
    """One bit for each element, by its hash modulo the number of bits: a power of two, LOAD times the
    size or more, so that bitmaps of any size are as full."""
    bits = max(LEAST_BITS, 1 << (LOAD * max(len(hashes), 1) - 1).bit_length())
    flags = np.zeros(bits, np.uint8)
    flags[(hashes & np.uint64(bits - 1)).astype(np.int64)] = 1
    return np.packbits(flags, bitorder="little").view(np.uint64)


def _half(bits: np.ndarray) -> np.ndarray:
    """Bitmaps of half as many bits: each bit modulo the new number."""
    middle = bits.shape[-1] // 2
    return bits[..., :middle] | bits[..., middle:]


class Bitmaps:
    """The bitmaps of a tile, in one matrix for each width and one of half that width."""

    def __init__(self, each: list[np.ndarray]):
        self.width = np.array([len(x) for x in each], np.int64)
        self.row = np.zeros(len(each), np.int64)
        self.full: dict[int, np.ndarray] = {}
        self.folded: dict[int, np.ndarray] = {}
        for w in np.unique(self.width).tolist():
            own = np.flatnonzero(self.width == w)
            self.row[own] = np.arange(len(own))
            self.full[w] = np.stack([each[k] for k in own])

    def overlap_at_most(self, i: int, others: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions like ``others``, and an upper bound of each one's overlap with ``i``. Sizes that
        may link differ by less than twice, so widths differ by one step at most, and the wider
        bitmap is folded."""
        w = int(self.width[i])
        mine, where, bound = self.full[w][self.row[i]], [], []
        for v in (w // 2, w, 2 * w):
            k = others[self.width[others] == v]
            if not k.size:
                continue
            if v == 2 * w and v not in self.folded:
                self.folded[v] = _half(self.full[v])
            theirs = (self.folded[v] if v == 2 * w else self.full[v])[self.row[k]]
            own = _half(mine) if v < w else mine
            only_i = np.bitwise_count(own & ~theirs).sum(axis=1, dtype=np.int64)
            only_k = np.bitwise_count(theirs & ~own).sum(axis=1, dtype=np.int64)
            where.append(k)
            bound.append(np.minimum(size[i] - only_i, size[k] - only_k))
        return np.concatenate(where), np.concatenate(bound)


class Connected:
    """Union-find over positions."""

    def __init__(self, n: int):
        self.root = np.arange(n)

    def find(self, i: int) -> int:
        while self.root[i] != i:
            self.root[i] = self.root[self.root[i]]
            i = self.root[i]
        return int(i)

    def join(self, i: int, j: int) -> None:
        self.root[max(self.find(i), self.find(j))] = min(self.find(i), self.find(j))

    def roots(self) -> np.ndarray:
        while (self.root[self.root] != self.root).any():
            self.root = self.root[self.root]
        return self.root


def links_in_tile(
    ids: np.ndarray, side: np.ndarray, size: np.ndarray, bits: Bitmaps, sets: list[np.ndarray] | None, at_least: int
) -> list[tuple[int, int]]:
    """Links that connect all linked pairs of a tile (side 0 only) or between two tiles (0 with 1).

    Each round takes one set against all those it may link with and is not connected to: the bit
    counts of both differences bound the overlap, and what passes is intersected exactly. Without
    ``sets`` what passes is taken as it is.
    """
    joined, out = Connected(len(ids)), []
    two = side.max(initial=0) > 0
    other = side == 1 if two else np.ones(len(ids), bool)
    for i in np.flatnonzero(side == 0):
        if not two:
            other[i] = False
        roots = joined.roots()
        j = np.flatnonzero(other & (roots != roots[i]) & (size * 100 >= size[i] * at_least) & (size[i] * 100 >= size * at_least))
        if not j.size:
            continue
        j, most = bits.overlap_at_most(i, j, size)
        for k in j[most * 100 >= (size[i] + size[j] - most) * at_least]:
            if joined.find(i) == joined.find(k):
                continue
            if sets is not None:
                both = len(np.intersect1d(sets[i], sets[k], assume_unique=True))
                if 100 * both < at_least * (size[i] + size[k] - both):
                    continue
            joined.join(i, k)
            out.append((int(ids[i]), int(ids[k])))
    return out


def _set_hashes(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit hashes of each whole set."""
    sizes = np.array([len(s) for s in sets], np.int64)
    one, two = np.zeros(len(sets), np.uint64), np.zeros(len(sets), np.uint64)
    if sizes.sum():
        flat, starts = np.concatenate(sets), (np.cumsum(sizes) - sizes)[sizes > 0]
        one[sizes > 0] = np.add.reduceat(_mix(flat ^ _POW), starts)
        two[sizes > 0] = np.add.reduceat(_mix(flat * _MUL + _POW), starts)
    return one.view(np.int64), two.view(np.int64)


def shingle_counts(rows: DataFrame, words: int) -> DataFrame:
    """``doc_id, n_shingles`` of ``doc_id, text``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "text"):
            n = pa.array(np.diff(distinct_hashes(batch.column(1), words)[1]))
            yield pa.RecordBatch.from_arrays([batch.column(0), n], ["doc_id", "n_shingles"])

    return rows.mapInArrow(run, "doc_id long, n_shingles long")


def _meeting_keys(rows: DataFrame, words: int, at_least: int) -> DataFrame:
    """``key, doc_id, near``: each key once for every run of ``HELD_KEYS`` keys of a task, with the
    smallest id there; another id of that run is tied to it under a key of their own (``near``)."""
    band_ends = bands(at_least)

    def tied(keys: np.ndarray, ids: np.ndarray) -> pa.RecordBatch:
        order = np.lexsort((ids, keys))
        keys, ids = keys[order], ids[order]
        first = np.append(True, keys[1:] != keys[:-1])
        least = ids[np.maximum.accumulate(np.where(first, np.arange(len(ids)), 0))]
        ties = np.unique(np.stack([ids, least])[:, ids != least], axis=1)
        pair = _mix(_mix(ties[0].view(np.uint64) ^ _MUL) + ties[1].view(np.uint64))
        return pa.RecordBatch.from_arrays(
            [
                pa.array(np.concatenate([keys[first], pair, pair]).view(np.int64)),
                pa.array(np.concatenate([ids[first], ties[0], ties[1]])),
                pa.array(np.repeat([False, True], [np.count_nonzero(first), 2 * len(pair)])),
            ],
            ["key", "doc_id", "near"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, ids, held = [], [], 0
        for batch in sliced(batches, "text"):
            for i, s in zip(batch.column(0).to_pylist(), shingle_sets(batch.column(1), words), strict=True):
                k = part_keys(s, band_ends, at_least)
                keys.append(k)
                ids.append(np.full(len(k), i, np.int64))
                held += len(k)
            if held > HELD_KEYS:
                yield tied(np.concatenate(keys), np.concatenate(ids))
                keys, ids, held = [], [], 0
        if held:
            yield tied(np.concatenate(keys), np.concatenate(ids))

    return rows.mapInArrow(run, "key long, doc_id long, near boolean")


def _signatures(rows: DataFrame, words: int) -> DataFrame:
    """``doc_id, n, bits`` of ``doc_id, text``: the size and the bitmap of each set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "text"):
            sets = shingle_sets(batch.column(1), words)
            bits = pa.array([bitmap(s).tobytes() for s in sets], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(s) for s in sets], pa.int64()), bits], ["doc_id", "n", "bits"])

    return rows.mapInArrow(run, "doc_id long, n long, bits binary")


def _set_rows(rows: DataFrame, words: int) -> DataFrame:
    """``doc_id, group, n, hash1, hash2, lead, set`` of ``doc_id, group, text``: the smallest id of an
    equal set in the same batch, and the sorted set as bytes, or null where that is another's."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "text"):
            sets = shingle_sets(batch.column(2), words)
            one, two = _set_hashes(sets)
            kept: dict[tuple, int] = {}
            ids = batch.column(0).to_pylist()
            for k in sorted(range(len(ids)), key=ids.__getitem__):
                kept.setdefault((one[k], two[k], len(sets[k])), k)
            chosen = set(kept.values())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    batch.column(1),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array(one),
                    pa.array(two),
                    pa.array([ids[kept[one[k], two[k], len(s)]] for k, s in enumerate(sets)], pa.int64()),
                    pa.array([s.tobytes() if k in chosen else None for k, s in enumerate(sets)], pa.binary()),
                ],
                ["doc_id", "group", "n", "hash1", "hash2", "lead", "set"],
            )

    return rows.mapInArrow(run, "doc_id long, group long, n long, hash1 long, hash2 long, lead long, set binary")


def _tile_pairs(classes: DataFrame, at_least: int, tile: int, elements: int) -> DataFrame:
    """``doc_id, group, x, y, side``: each row of ``doc_id, group, n`` once for every pair of tiles it
    takes part in. Tiles hold neighbouring sizes; pairs come from the tiles' ranges of sizes."""
    # places by size without a window over a whole group, nor over all of one size: counts of each size
    # and part, then places inside these. A set weighs as much as its elements, and a tile's share at least.
    share = max(1, elements // tile)
    weight = F.greatest(F.col("n"), F.lit(share))
    dealt = classes.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int"))
    # offsets in two levels: of sizes in a group, and of parts in a size
    sized = dealt.groupBy("group", "n", "salt").agg((F.count(F.lit(1)) * weight).alias("weight"))
    smaller = Window.partitionBy("group").orderBy("n").rowsBetween(Window.unboundedPreceding, -1)
    before = Window.partitionBy("group", "n").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sized.groupBy("group", "n").agg(F.sum("weight").alias("weight"))
    sizes = sizes.select("group", "n", F.coalesce(F.sum("weight").over(smaller), F.lit(0)).alias("base"))
    sized = sized.withColumn("inner", F.coalesce(F.sum("weight").over(before), F.lit(0))).join(sizes, ["group", "n"])
    sized = sized.select("group", "n", "salt", (F.col("base") + F.col("inner")).alias("below"))
    same = Window.partitionBy("group", "n", "salt").orderBy("doc_id")
    placed = dealt.withColumn("nth", F.row_number().over(same) - 1).join(sized, ["group", "n", "salt"])
    placed = materialise(
        placed.select("doc_id", "group", "n", F.floor((F.col("below") + F.col("nth") * weight) / (share * tile)).alias("tile")), "tiles"
    )
    spans = placed.groupBy("group", "tile").agg(F.min("n").alias("least"), F.max("n").alias("most"))
    other = spans.select("group", F.col("tile").alias("y"), F.col("least").alias("y_least"))
    pairs = (
        spans.withColumnRenamed("tile", "x")
        .join(other, "group")
        .where((F.col("y") >= F.col("x")) & (F.col("y_least") * at_least <= F.col("most") * 100))
    )
    parts = pairs.select("group", "x", "y", F.col("x").alias("tile"), F.lit(0).alias("side")).unionByName(
        pairs.where("x <> y").select("group", "x", "y", F.col("y").alias("tile"), F.lit(1).alias("side"))
    )
    return placed.join(parts, ["group", "tile"]).select("doc_id", "group", "x", "y", "side")


def _decide(rows: DataFrame, pairs: DataFrame, data: str, at_least: int) -> DataFrame:
    """Links ``a, b`` within each pair of tiles of ``pairs``, one at a time. ``data`` names the column
    of ``rows`` to judge by: ``set``, the sorted arrays, or ``bits``, the bitmaps alone."""

    def of(held: list[tuple]) -> list[tuple[int, int]]:
        held.sort(key=lambda r: r[4])
        ids, side, size = (np.array([r[k] for r in held], np.int64) for k in (4, 3, 5))
        arrays = [np.frombuffer(r[6], np.uint64) for r in held]
        if data == "bits":
            return links_in_tile(ids, side, size, Bitmaps(arrays), None, at_least)
        return links_in_tile(ids, side, size, Bitmaps([bitmap(x) for x in arrays]), arrays, at_least)

    def batch_of(links: list[tuple[int, int]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({n: pa.array([x[k] for x in links], pa.int64()) for k, n in enumerate("ab")})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, links = [], []
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held and held[0][:3] != row[:3]:
                    links += of(held)
                    held = []
                held.append(row)
            yield batch_of(links)
            links = []
        yield batch_of(of(held) if held else [])

    tiles = rows.select("doc_id", "n", data).join(_small(pairs), "doc_id").select("group", "x", "y", "side", "doc_id", "n", data)
    return tiles.repartition("group", "x", "y").sortWithinPartitions("group", "x", "y").mapInArrow(run, "a long, b long")


def _small(rows: DataFrame) -> DataFrame:
    """A written table of ids and small numbers, broadcast if it is counted as small enough (40 MB);
    beyond that a join with it shuffles."""
    return F.broadcast(rows) if rows.count() <= BROADCAST_ROWS else rows


def _meeting_groups(keys: DataFrame, size: int) -> DataFrame:
    """``group, doc_id``: groups in which every two sets that share a key of ``keys`` meet. These are
    the components of the ties, but one of more than ``size`` members that weak ties string together
    falls into its stars where these have fewer rows than its pairs of tiles.

    The star of an id holds what is tied to it, and what is tied within a run to one of these: a key's
    smallest ids of each run are tied to its smallest of all, and its other holders to those of their
    runs, so all that share the key are in the star of its smallest id.
    """
    least = F.min("doc_id").over(Window.partitionBy("key"))
    ties = keys.withColumn("least", least).where("doc_id <> least").select(F.col("doc_id").alias("a"), F.col("least").alias("b"), "near")
    ties = materialise(ties.distinct(), "meeting-ties")
    met = connected_components(ties, "ties").select(F.col("id").alias("doc_id"), F.col("component").alias("group"))
    met = materialise(met, "met")
    wide = met.groupBy("group").agg(F.count(F.lit(1)).alias("members")).where(F.col("members") > size)
    # rows that the stars have at most, from counts of the ties alone
    below = ties.where("near").groupBy(F.col("b").alias("doc_id")).agg(F.count(F.lit(1)).alias("below"))
    above = ties.where("not near").groupBy(F.col("a").alias("doc_id")).agg(F.count(F.lit(1)).alias("above"))
    rows = ties.select(F.col("b").alias("doc_id"), F.lit(1).cast("long").alias("rows")).unionByName(
        below.join(above, "doc_id").select("doc_id", (F.col("below") * F.col("above")).alias("rows"))
    )
    rows = rows.join(met, "doc_id").groupBy("group").agg(F.sum("rows").alias("rows"))
    loose = wide.join(rows, "group").where(F.col("rows") < F.col("members") / size * F.col("members"))
    loose = materialise(loose.select("group"), "loose-groups")
    if loose.isEmpty():
        return met.select("group", "doc_id")
    inside = met.join(loose, "group", "left_semi").select(F.col("doc_id").alias("b"))
    ties = materialise(ties.join(inside, "b"), "loose-ties")
    centre = ties.select(F.col("b").alias("group"), F.col("b").alias("doc_id"))
    direct = ties.select(F.col("b").alias("group"), F.col("a").alias("doc_id"))
    step = ties.where("not near").select(F.col("b").alias("group"), F.col("a").alias("b"))
    second = ties.where("near").join(step, "b").select("group", F.col("a").alias("doc_id"))
    stars = centre.unionByName(direct).unionByName(second).distinct()
    return materialise(met.join(loose, "group", "left_anti").select("group", "doc_id").unionByName(stars), "meeting-groups")


def _candidate_groups(rows: DataFrame, words: int, at_least: int, tile: int) -> DataFrame:
    """``doc_id, group`` of the documents that pass a bit count with another one."""
    met = _meeting_groups(_meeting_keys(rows, words, at_least), BIT_TILES * tile)
    ids = materialise(met.select("doc_id").distinct(), "meeting-ids")
    signed = materialise(_signatures(rows.join(_small(ids), "doc_id").select("doc_id", "text"), words), "signatures")
    pairs = materialise(_tile_pairs(met.join(signed.select("doc_id", "n"), "doc_id"), at_least, BIT_TILES * tile, BIT_TILES * ELEMENTS), "tile-pairs")
    passed = connected_components(_decide(signed, pairs, "bits", at_least), "candidates")
    return materialise(passed.select(F.col("id").alias("doc_id"), F.col("component").alias("group")), "candidate-groups")


def jaccard_links(rows: DataFrame, words: int, at_least: int, tile: int = TILE) -> tuple[DataFrame, DataFrame]:
    """For ``doc_id, text``: documents that have a partner (``doc_id, class``, classes of equal sets
    named by their smallest id), and links between classes (``a, b``) with the same components as
    all links."""
    rows = rows.where("doc_id is not null")
    groups = _candidate_groups(rows, words, at_least, tile)
    chosen = rows.join(_small(groups), "doc_id").select("doc_id", "group", "text")
    sets = materialise(_set_rows(chosen, words), "shingle-sets")
    # rows meet in their batch first, so a large class is as many rows here as batches hold it
    same = ["group", "hash1", "hash2", "n"]
    heads = sets.where("set is not null").select(F.col("doc_id").alias("lead"), *same)
    leaders = heads.groupBy(*same).agg(F.min("lead").alias("class"))
    classes = heads.join(leaders, same).select("lead", "hash1", "class").distinct()
    members = sets.select("doc_id", "lead", "hash1").join(classes, ["lead", "hash1"]).select("doc_id", "class").distinct()
    leaders = leaders.select(F.col("class").alias("doc_id"), "group", "n")
    pairs = materialise(_tile_pairs(materialise(leaders, "shingle-classes"), at_least, tile, ELEMENTS), "tile-pairs")
    return members, _decide(sets.where("set is not null"), pairs, "set", at_least)


def jaccard_components(
    docs: DataFrame,
    words: int = WORDS,
    at_least: int = AT_LEAST,
    text_col: str = "text",
    id_col: str = "doc_id",
    tile: int = TILE,
) -> DataFrame:
    """``id_col, n_shingles, component_id`` for every row of ``docs``.

    A-Z are lower-cased and words are runs of other characters than blanks. A text with fewer words
    than a shingle has its whole sequence as the one; a null text and one without words have none
    and link with nothing. The component is the smallest id reachable by links, itself included. Ids
    are taken as unique; rows that repeat an id with one text share its component. A null id takes
    no part and keeps a null component. Other columns are ignored.
    """
    if not 50 <= at_least <= 100:
        raise ValueError("at_least must lie between 50 and 100 percent")  # widths of bitmaps rest on it
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"))
    members, links = jaccard_links(rows, words, at_least, tile)
    components = connected_components(links, "jaccard").select(F.col("id").alias("class"), "component")
    found = members.join(components, "class", "left").groupBy("doc_id").agg(F.min(F.coalesce("component", "class")).alias("component"))
    return (
        shingle_counts(rows, words)
        .join(found, "doc_id", "left")
        .select(F.col("doc_id").alias(id_col), "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))
    )
