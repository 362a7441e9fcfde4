"""A hidden Markov language model, trained on the whole corpus.

Latent states emit words and follow one another. Every training word, however rare and whatever the
corpus holds, has expected counts of its own by state. Baum-Welch counts are gathered chunk by chunk
and meet in buckets of words, from which each chunk gets back the sums of its own words, so that the
model grows with the vocabulary and no task holds more of it than a chunk's or a bucket's words. A
scaled forward recursion gives the exact likelihood of each text.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gapbook.llm import word_chunks
from gapbook.llm.common import materialise
from gapbook.sources.scratch import discard

#: Latent states, rounds of Baum-Welch, tokens of a training sequence (longer texts are several), and
#: tokens of a text that are scored in a row before its parts are chained.
STATES, ROUNDS, SEGMENT, SCORED = 6, 4, 512, 2048
#: Tokens by which each state's emissions lean to the shares of all.
PRIOR = 100.0
#: A state's chance to stay, before the first round.
STAY = 0.8
#: Tokens of a chunk, of which a task holds one; of those whose states it holds at once; and of those whose
#: transitions it sums in single precision, unless one step has more.
CHUNK_TOKENS, BATCH, SUMMED = 1_500_000, 240_000, 4096
#: Tokens that are scored in step, of which no states are held.
SCORED_BATCH = 4 * BATCH
LEARN_MOD, LEARN_LEFT_OUT = 7, 2

#: A word's expected counts travel as shares of its occurrences, in parts of WHOLE; words meet in buckets
#: by their numbers without the last MEET bits (four buckets of hashes).
WHOLE, MEET = (1 << 16) - 1, 26

# symbols below SPECIAL are the same in all chunks: unknown words and the end of a text; the others are
# not used
UNKNOWN, END, SPECIAL = 0, 1, 8
#: The bucket of what belongs to no word: counts of special symbols, transitions, first states of texts
#: and of their further parts, and the log likelihood.
SHARED = -1

TRANSLATION = bytes(c + 32 if ord("A") <= c <= ord("Z") else c for c in range(256))


def held_out(id_col: str = "doc_id") -> Column:
    """The documents nothing is learned from: crc32 of the id as text leaves 2 modulo 7."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % LEARN_MOD == LEARN_LEFT_OUT, F.lit(False))


def split(text: bytes) -> list[bytes]:
    return text.translate(TRANSLATION).split()


# -- the recursion, in numpy


@dataclass
class Steps:
    """Sequences in step, longest sequences first: of all tokens at place t of their sequences, one stretch
    ``of[t]`` to ``of[t + 1]``, and the token that each of them is."""

    order: np.ndarray
    of: np.ndarray
    token: np.ndarray
    sizes: np.ndarray

    @classmethod
    def lay(cls, starts: np.ndarray, sizes: np.ndarray) -> Steps:
        order = np.argsort(-sizes, kind="stable")
        starts, sizes = starts[order], sizes[order]
        live = np.searchsorted(-sizes, -np.arange(int(sizes[0]) if len(sizes) else 0), side="left")
        of = np.concatenate([[0], np.cumsum(live)])
        token = np.arange(of[-1])
        token -= np.repeat(of[:-1], live)
        token = starts[token]
        token += np.repeat(np.arange(len(live)), live)
        return cls(order, of, token, sizes)

    @property
    def last(self) -> np.ndarray:
        """Where the sequences' last tokens stand."""
        return self.of[self.sizes - 1] + np.arange(len(self.sizes))


def stride(move: np.ndarray) -> int:
    """Steps from one scaling of state shares to the next. Emissions are at most 1 and are 1 in some state, so that
    a step leaves the least transition of the shares' sum, at least: sums then stay above 1e-20."""
    return int(np.clip(20 / max(-np.log10(float(move.min())), 1e-9), 1, 8))


def forward(e: np.ndarray, steps: Steps, init: np.ndarray, move: np.ndarray) -> tuple[np.ndarray, list[tuple[int, np.ndarray]]]:
    """The state shares after each token, and the steps at which, and scales by which, they were scaled to a
    sum of 1. ``e`` are emissions in step, a row a state, ``init`` the sequences' first shares, likewise."""
    alpha, scales, onto, every = np.empty_like(e), [], np.ascontiguousarray(move.T), stride(move)
    own = init
    for at, (s, t) in enumerate(itertools.pairwise(steps.of.tolist())):
        a = alpha[:, s:t]
        if at:
            np.matmul(onto, own[:, : t - s], out=a)
            a *= e[:, s:t]
        else:
            np.multiply(init, e[:, s:t], out=a)
        if at % every == 0:
            c = np.add.reduce(a, axis=0)
            a /= c
            scales.append((at, c))
        own = a
    return alpha, scales


def backward(e: np.ndarray, steps: Steps, alpha: np.ndarray, scales: list[tuple[int, np.ndarray]], move: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each token's state shares given the whole sequence, and the expected transitions. ``e`` and
    ``alpha`` are written over."""
    k, of = len(e), steps.of.tolist()
    for at, c in scales:
        e[:, of[at] : of[at + 1]] /= c
    beta = np.empty_like(alpha)
    beta[:, steps.last] = 1 / alpha[:, steps.last].sum(axis=0)
    for at in range(len(of) - 2, 0, -1):
        s, t = of[at], of[at + 1]
        after = e[:, s:t]
        after *= beta[:, s:t]
        np.matmul(move, after, out=beta[:, of[at - 1] : of[at - 1] + t - s])
    # steps of as many sequences as the step before stand as far from it as all of these
    moves, at = np.zeros((k, k)), 1
    live = np.diff(steps.of).tolist()
    while at < len(live):
        to = at + 1
        while to < len(live) and live[to] == live[at] == live[at - 1] and of[to + 1] - of[at] <= SUMMED:
            to += 1
        before = of[at - 1]
        moves += alpha[:, before : before + of[to] - of[at]] @ e[:, of[at] : of[to]].T
        at = to
    alpha *= beta
    return alpha, moves * move


def passed(e: np.ndarray, symbols: np.ndarray, steps: Steps, init: np.ndarray, move: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The log probability of each sequence and its state shares after the last token. ``e`` are emissions
    by symbol and state, ``init`` the sequences' first shares, a row a state."""
    onto, every, of = np.ascontiguousarray(move.T), stride(move), steps.of.tolist()
    logs, shares = np.zeros(len(steps.order)), init.copy()
    for at, (s, t) in enumerate(itertools.pairwise(of)):
        a = shares[:, : t - s]
        if at:
            a[...] = onto @ a
        a *= e.take(symbols[steps.token[s:t]], axis=0).T
        if at % every == 0:
            c = np.add.reduce(a, axis=0)
            a /= c
            logs[: t - s] += np.log(c)
    c = shares.sum(axis=0)
    return logs + np.log(c), shares / c


def in_parts_of_greatest(e: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Emissions by state and symbol, in parts of each symbol's greatest, and the logs of these."""
    e = e.T.copy()
    most = np.maximum(e.max(axis=0), np.finfo(e.dtype).tiny)
    e /= most
    return e, np.log(most)


def segments(first: np.ndarray, lengths: np.ndarray, longest: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Texts, whose ``first`` tokens are given, cut every ``longest`` tokens: where segments start, their
    sizes, their texts, and their number within these."""
    many = -(-lengths // longest)
    text = np.repeat(np.arange(len(lengths)), many)
    nth = np.arange(len(text)) - (np.cumsum(many) - many)[text]
    return first[text] + nth * longest, np.minimum(lengths[text] - nth * longest, longest), text, nth


@dataclass
class Model:
    """What all chunks share: ``special`` has expected counts by symbol and state, ``total`` by state;
    ``share`` the training shares of special symbols, ``unknown`` the chance of an unknown word, of one
    training token in ``tokens``."""

    start: np.ndarray
    onward: np.ndarray
    move: np.ndarray
    special: np.ndarray
    total: np.ndarray
    share: np.ndarray
    unknown: float
    tokens: int

    def emissions(self, counts: np.ndarray, occurrences: np.ndarray) -> np.ndarray:
        """By symbol and state: of special symbols, then of words with expected ``counts`` and training
        ``occurrences``. Known symbols share what unknown words leave, by expected counts and, as PRIOR
        tokens, by their shares of all training tokens."""
        if not self.tokens:
            return np.ones((SPECIAL, len(self.start)))
        n = np.concatenate([self.special, counts])
        p = np.concatenate([self.share, occurrences / self.tokens])
        e = (1 - self.unknown) * (n + PRIOR * p[:, None]) / (self.total + PRIOR)
        e[UNKNOWN] = self.unknown
        return e

    def gather(self, symbols: np.ndarray, lengths: np.ndarray, e: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
        """Expected counts by symbol, of transitions, of first and further segments' first states, and the
        log likelihood. Shares go by single precision, their sums by double."""
        k = len(self.start)
        counts, moves, starts = np.zeros((k, len(e))), np.zeros((k, k)), np.zeros((2, k))
        e, logs = in_parts_of_greatest(e)
        log = float(np.bincount(symbols, minlength=len(logs)) @ logs)
        start, onward, move, e = (x.astype(np.float32) for x in (self.start, self.onward, self.move, e))
        begin, size, _, nth = segments(np.cumsum(lengths) - lengths, lengths, SEGMENT)
        for own in batches_of(size, size, BATCH):
            steps = Steps.lay(begin[own], size[own])
            token = symbols[steps.token].astype(np.intp)
            further = nth[own][steps.order] > 0
            emitted = e.take(token, axis=1)
            alpha, scales = forward(emitted, steps, np.where(further, onward[:, None], start[:, None]), move)
            log += sum(float(np.log(c).sum(dtype=float)) for _, c in scales) + float(np.log(alpha[:, steps.last].sum(axis=0)).sum(dtype=float))
            gamma, moved = backward(emitted, steps, alpha, scales, move)
            for j in range(k):
                counts[j] += np.bincount(token, gamma[j], len(logs))
            moves += moved
            opening = gamma[:, : len(further)]
            starts += np.stack([opening[:, ~further].sum(axis=1, dtype=float), opening[:, further].sum(axis=1, dtype=float)])
        return counts.T, moves, starts, log

    def log_likelihoods(self, symbols: np.ndarray, lengths: np.ndarray, e: np.ndarray) -> np.ndarray:
        """The log probability of each text, exact: further segments of a text go from each state at once
        and are then chained."""
        k = len(self.start)
        e, logs = in_parts_of_greatest(e)
        e = np.ascontiguousarray(e.T)
        out = np.bincount(np.repeat(np.arange(len(lengths)), lengths), logs[symbols], len(lengths))
        begins = np.cumsum(lengths) - lengths
        for texts in batches_of(lengths, lengths + (k - 1) * np.maximum(lengths - SCORED, 0), SCORED_BATCH):
            begin, size, text, nth = segments(begins[texts], lengths[texts], SCORED)
            lanes = np.repeat(np.arange(len(begin)), np.where(nth > 0, k, 1))
            entry = np.arange(len(lanes)) - np.searchsorted(lanes, lanes)
            steps = Steps.lay(begin[lanes], size[lanes])
            init = np.where((nth[lanes] > 0)[:, None], self.move[entry], self.start)[steps.order]
            logs, last = passed(e, symbols, steps, np.ascontiguousarray(init.T), self.move)
            back = np.argsort(steps.order)
            logs, last = logs[back], last.T[back]
            place = np.searchsorted(lanes, np.arange(len(begin)))
            first = np.flatnonzero(nth == 0)
            log, shares = np.zeros(len(texts)), np.zeros((len(texts), k))
            log[text[first]], shares[text[first]] = logs[place[first]], last[place[first]]
            for j in range(1, int(nth.max(initial=0)) + 1):
                own = np.flatnonzero(nth == j)
                at = place[own][:, None] + np.arange(k)
                with np.errstate(divide="ignore"):
                    weight = np.log(shares[text[own]]) + logs[at]
                most = weight.max(axis=1)
                weight = np.exp(weight - most[:, None])
                total = weight.sum(axis=1)
                log[text[own]] += most + np.log(total)
                shares[text[own]] = (weight[:, :, None] * last[at]).sum(axis=1) / total[:, None]
            out[texts] += log
        return out


def batches_of(sizes: np.ndarray, weights: np.ndarray, most: int) -> Iterator[np.ndarray]:
    """Sequences, longest first, so that those of a batch are of like lengths, by about ``most`` in weight;
    a heavier one alone."""
    order = np.argsort(-sizes, kind="stable")
    if len(order):
        yield from np.split(order, np.flatnonzero(np.diff(np.cumsum(weights[order]) // most)) + 1)


def scattered(numbers: np.ndarray, states: int) -> np.ndarray:
    """How each word is dealt over states before the first round: by hashes of its number, mostly to few."""
    x = numbers.astype(np.uint64)[:, None] * np.uint64(states) + np.arange(states, dtype=np.uint64)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    u = ((x ^ (x >> np.uint64(31))) >> np.uint64(11)) / float(1 << 53)
    u = u**4 + 0.01
    return u / u.sum(axis=1, keepdims=True)


def in_parts(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Expected counts by word and state as parts of WHOLE, which sum to it, and their whole sums. Counts
    that come from parts give the same parts again."""
    total = counts.sum(axis=1)
    parts = np.rint(counts * (WHOLE / np.maximum(total, 1e-300))[:, None]).astype(np.int64)
    parts[np.arange(len(parts)), parts.argmax(axis=1)] += WHOLE - parts.sum(axis=1)
    return parts, np.rint(total).astype(np.int64)


def from_parts(parts: np.ndarray, n: np.ndarray) -> np.ndarray:
    return parts * (n / WHOLE)[:, None]


def _sent(parts: np.ndarray) -> bytes:
    """Parts state by state; those of the last of several are what the others leave of WHOLE."""
    return word_chunks.packed(parts[:, : max(parts.shape[1] - 1, 1)].T.ravel())


def _received(data: bytes, states: int) -> np.ndarray:
    parts = word_chunks.unpacked(data).astype(np.int64).reshape(max(states - 1, 1), -1).T
    if states == 1:
        return parts
    return np.concatenate([parts, WHOLE - parts.sum(axis=1, keepdims=True)], axis=1)


# -- training and scoring, on Spark


@dataclass
class Corpus:
    """Coded chunks of all documents, and counts of the training ones: tokens, different tokens, words that
    occur once, texts."""

    coded: DataFrame
    tokens: int
    types: int
    once: int
    texts: int


CODED = "chunk long, ids array<long>, train array<boolean>, lengths array<long>, known array<long>, base array<double>, symbols binary, words array<long>, occurrences array<long>"


def read_corpus(docs: DataFrame, text_col: str, id_col: str) -> Corpus:
    """Words as symbols, each training word by its number; and each text's words that are known, and its
    base score."""
    chunked = word_chunks.chunks(docs, F.col(id_col), F.lit(""), F.col(text_col), split, "hmm", size=CHUNK_TOKENS, counted=~held_out(id_col))

    words = F.aggregate("counts", F.lit(0).cast("long"), lambda x, y: x + y)
    texts = F.size(F.filter("counted", lambda x: x))
    words, texts = chunked.agg(F.coalesce(F.sum(words), F.lit(0)), F.coalesce(F.sum(texts), F.lit(0))).first()
    tokens = words + texts

    def merge(group: pa.Table) -> pa.Table:
        """Counts over all chunks of one bucket's words, back to each chunk; the numbers of training words;
        and, in a row of its own, sums."""
        place, n, ends = word_chunks.bucket_words(group)
        total = np.bincount(place, n).astype(np.int64)
        number = np.where(total > 0, np.cumsum(total > 0), 0)
        c, ids = np.split(total[place], ends[:-1]), np.split(number[place], ends[:-1])
        rows = group.num_rows
        columns = {
            "chunk": [*group.column("chunk").to_pylist(), None],
            "start": [*group.column("start").to_pylist(), None],
            "bucket": [*group.column("bucket").to_pylist(), None],
            "c": [*map(word_chunks.packed, c), None],
            "number": [*map(word_chunks.packed, ids), None],
            "sums": [None] * rows + [[int((total > 0).sum()), int((total == 1).sum())]],
        }
        return pa.table({k: pa.array(v, t) for (k, v), t in zip(columns.items(), [pa.int64()] * 3 + [pa.binary()] * 2 + [pa.list_(pa.int64())], strict=True)})

    schema = "chunk long, start long, bucket long, c binary, number binary, sums array<long>"
    known = materialise(word_chunks.buckets(chunked).groupBy("bucket").applyInArrow(merge, schema), "hmm-words")
    types, once = known.where("sums is not null").agg(*(F.coalesce(F.sum(F.get("sums", F.lit(k))), F.lit(0)) for k in range(2))).first()
    types += texts > 0
    back = known.where("chunk is not null").select("chunk", "start", "bucket", "c", "number")

    def code(own: pa.Table, given: pa.Table) -> pa.Table:
        row = {c: own.column(c)[0].as_py() for c in ("chunk", "ids", "counted", "lengths")}
        local = word_chunks.unpacked(own.column("tokens")[0].as_py())
        lengths = np.array(row["lengths"], np.int64)
        most = int(local.max(initial=0)) + 1
        count, number = np.zeros(most, np.int64), np.zeros(most, np.int64)
        for start, bucket, c, ids in zip(*(given.column(x).to_pylist() for x in ("start", "bucket", "c", "number")), strict=True):
            c, ids = word_chunks.unpacked(c).astype(np.int64), word_chunks.unpacked(ids).astype(np.int64)
            count[start + 1 : start + 1 + len(c)] = c
            number[start + 1 : start + 1 + len(c)] = np.where(ids > 0, bucket << 24 | ids, 0)
        symbol = np.zeros(len(count), np.int64)
        own_words = np.flatnonzero(number)
        own_words = own_words[np.argsort(number[own_words])]
        symbol[own_words] = SPECIAL + np.arange(len(own_words))
        # an end after each text's words
        ends = np.cumsum(lengths)
        symbols = np.insert(symbol[local], ends, END)
        text = np.repeat(np.arange(len(lengths)), lengths)

        def summed(values: np.ndarray) -> np.ndarray:
            return np.bincount(text, values[local], len(lengths))

        base = summed(np.log10(count + 1.0)) + np.log10(texts + 1.0) - (lengths + 1) * np.log10(tokens + types + 1.0)
        known = summed((count > 0).astype(float)).astype(np.int64) + (texts > 0)
        columns = [[row["chunk"]], [row["ids"]], [row["counted"]], [lengths + 1], [known], [base], [word_chunks.packed(symbols)], [number[own_words]], [count[own_words]]]
        return pa.table(dict(zip(SCHEMA.names, (pa.array(v, t) for v, t in zip(columns, SCHEMA.types, strict=True)), strict=True)))

    coded = word_chunks.answered(chunked.select("chunk", "ids", "counted", "lengths", "tokens"), back, code, CODED)
    found = Corpus(materialise(coded, "hmm-coded", "zstd"), int(tokens), int(types), int(once), int(texts))
    discard(chunked)
    discard(known)
    return found


SCHEMA = pa.schema(
    [("chunk", pa.int64()), ("ids", pa.list_(pa.int64())), ("train", pa.list_(pa.bool_())), ("lengths", pa.list_(pa.int64())), ("known", pa.list_(pa.int64()))]
    + [("base", pa.list_(pa.float64())), ("symbols", pa.binary()), ("words", pa.list_(pa.int64())), ("occurrences", pa.list_(pa.int64()))]
)


def _ready(own: pa.Table, given: pa.Table, states: int, first: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """A chunk's symbols, lengths, word numbers and occurrences, and expected counts that came back; before
    the ``first`` round those that words are dealt."""
    symbols = word_chunks.unpacked(own.column("symbols")[0].as_py())
    lengths, words, occurrences = (own.column(c)[0].values.to_numpy() for c in ("lengths", "words", "occurrences"))
    if first:
        return symbols, lengths, words, occurrences, scattered(words, states) * occurrences[:, None]
    counts = np.zeros((len(words), states))
    for start, data in zip(given.column("start").to_pylist(), given.column("parts").to_pylist(), strict=True):
        parts = _received(data, states)
        counts[start : start + len(parts)] = from_parts(parts, occurrences[start : start + len(parts)])
    return symbols, lengths, words, occurrences, counts


def _asked(coded: DataFrame, stats: DataFrame | None) -> DataFrame:
    """``chunk, start`` and the expected counts of the chunk's words from there on, as parts; none before the
    first round."""
    if stats is None:
        return coded.where("false").select("chunk", F.lit(0).cast("long").alias("start"), F.lit(b"").alias("parts"))
    return stats.where("chunk is not null").select("chunk", "start", "parts")


STATS = "bucket long, chunk long, start long, ids binary, n binary, parts binary, sums array<double>"
STATS_SCHEMA = pa.schema(
    [("bucket", pa.int64()), ("chunk", pa.int64()), ("start", pa.int64()), ("ids", pa.binary()), ("n", pa.binary()), ("parts", pa.binary()), ("sums", pa.list_(pa.float64()))]
)


def _stats_table(rows: list[tuple]) -> pa.Table:
    return pa.table([pa.array(v, t) for v, t in zip(zip(*rows, strict=True), STATS_SCHEMA.types, strict=True)], schema=STATS_SCHEMA)


def _round(coded: DataFrame, stats: DataFrame | None, model: Model) -> DataFrame:
    """One round's expected counts: for each chunk and bucket those of the chunk's words, summed over all
    chunks; with no chunk, for each bucket those of all its words and their ``sums`` by state; and in the
    bucket SHARED the sums of the model's own numbers."""
    k = len(model.start)
    first = stats is None

    def run(own: pa.Table, given: pa.Table) -> pa.Table:
        chunk = own.column("chunk")[0].as_py()
        symbols, lengths, words, occurrences, counts = _ready(own, given, k, first)
        train = own.column("train")[0].values.to_numpy(zero_copy_only=False)
        symbols, lengths = symbols[np.repeat(train, lengths)], lengths[train]
        n, moves, starts, log = model.gather(symbols, lengths, model.emissions(counts, occurrences))
        rows = [(SHARED, chunk, None, None, None, None, np.concatenate([n[:SPECIAL].ravel(), moves.ravel(), starts.ravel(), [log]]))]
        parts, total = in_parts(n[SPECIAL:])
        # words stand in the order of their numbers, so that a bucket is a stretch; sent are their distances
        bucket = words >> MEET
        places = [*np.flatnonzero(np.diff(bucket, prepend=-1)).tolist(), len(words)]
        for s, e in itertools.pairwise(places):
            ids = np.diff(words[s:e], prepend=bucket[s] << MEET)
            rows.append((int(bucket[s]), chunk, s, word_chunks.packed(ids), word_chunks.packed(total[s:e]), _sent(parts[s:e]), None))
        return _stats_table(rows)

    def add(group: pa.Table) -> pa.Table:
        bucket = group.column("bucket")[0].as_py()
        if bucket == SHARED:
            return _stats_table([(bucket, None, None, None, None, None, np.sum(group.column("sums").to_pylist(), axis=0))])
        given = [*zip(*(group.column(c).to_pylist() for c in ("chunk", "start", "ids", "n", "parts")), strict=True)]
        ids = [np.cumsum(word_chunks.unpacked(g[2]), dtype=np.int64) for g in given]
        own, place = np.unique(np.concatenate(ids), return_inverse=True)
        counts = np.zeros((len(own), k))
        ends = np.cumsum([len(i) for i in ids]).tolist()
        for (*_, n, parts), s, e in zip(given, [0, *ends[:-1]], ends, strict=True):
            counts[place[s:e]] += from_parts(_received(parts, k), word_chunks.unpacked(n))
        parts, n = in_parts(counts)
        rows = [(bucket, g[0], g[1], None, None, _sent(parts[place[s:e]]), None) for g, s, e in zip(given, [0, *ends[:-1]], ends, strict=True)]
        rows.append((bucket, None, None, word_chunks.packed(own), word_chunks.packed(n), _sent(parts), from_parts(parts, n).sum(axis=0)))
        return _stats_table(rows)

    needed = coded.select("chunk", "train", "lengths", "symbols", "words", "occurrences")
    rows = word_chunks.answered(needed, _asked(coded, stats), run, STATS)
    return materialise(rows.groupBy("bucket").applyInArrow(add, STATS), "expected-counts")


def _updated(model: Model, stats: DataFrame) -> tuple[Model, float]:
    """The model after a round, and the log likelihood before it."""
    k = len(model.start)
    shared = stats.where(f"bucket = {SHARED}").select("sums").first()
    if shared is None:
        return model, 0.0
    special, moves, starts, log = np.split(np.array(shared[0]), np.cumsum([SPECIAL * k, k * k, 2 * k]))
    special, moves, starts = special.reshape(-1, k), moves.reshape(k, k) + 1.0, starts.reshape(2, k)
    words = stats.where(f"chunk is null and bucket <> {SHARED}")
    total = words.agg(*(F.coalesce(F.sum(F.get("sums", F.lit(j))), F.lit(0.0)) for j in range(k))).first()

    def shares(x: np.ndarray) -> np.ndarray:
        return (x + 1.0) / (x + 1.0).sum()

    after = Model(shares(starts[0]), shares(starts[1]), moves / moves.sum(axis=1, keepdims=True), special, special.sum(axis=0) + np.array(total), model.share, model.unknown, model.tokens)
    return after, float(log[0])


@dataclass
class Trained:
    corpus: Corpus
    model: Model
    packed: DataFrame | None
    logs: list[float]

    @property
    def stats(self) -> DataFrame | None:
        """``word_id`` and its expected counts by state, ``s0`` and so on, a row a training word."""
        if self.packed is None:
            return None
        k = len(self.model.start)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for bucket, ids, n, parts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    counts = from_parts(_received(parts, k), word_chunks.unpacked(n))
                    words = word_chunks.unpacked(ids).astype(np.int64) + (bucket << MEET)
                    yield pa.RecordBatch.from_arrays([pa.array(words), *(pa.array(counts[:, j]) for j in range(k))], ["word_id", *(f"s{j}" for j in range(k))])

        rows = self.packed.where(f"chunk is null and bucket <> {SHARED}").select("bucket", "ids", "n", "parts")
        return rows.mapInArrow(run, "word_id long, " + ", ".join(f"s{j} double" for j in range(k)))


def train(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", states: int = STATES, rounds: int = ROUNDS) -> Trained:
    """Baum-Welch over all documents that are not held out. ``logs`` has the log likelihood of the training
    sequences before each round."""
    corpus = read_corpus(docs, text_col, id_col)
    n = max(corpus.tokens, 1)
    share = np.zeros(SPECIAL)
    share[END] = corpus.texts / n
    # the chance of a word not seen so far is the share of words seen once (Good and Turing)
    unknown = min(max(corpus.once / n, 1 / (corpus.tokens + corpus.types + 1)), 0.5) if corpus.tokens else 1.0
    even = np.full(states, 1 / states)
    move = np.full((states, states), (1 - STAY) / max(states - 1, 1))
    np.fill_diagonal(move, STAY if states > 1 else 1.0)
    model = Model(even, even, move, np.outer(share * n, even), np.full(states, n / states), share, unknown, corpus.tokens)
    stats, logs = None, []
    for _ in range(rounds):
        after = _round(corpus.coded, stats, model)
        if stats is not None:
            discard(stats)
        stats = after
        model, log = _updated(model, stats)
        logs.append(log)
    return Trained(corpus, model, stats, logs)


def score(trained: Trained) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score`` of all documents."""
    model, k, tokens = trained.model, len(trained.model.start), trained.corpus.tokens
    first = trained.packed is None

    def run(own: pa.Table, given: pa.Table) -> pa.Table:
        symbols, lengths, _, occurrences, counts = _ready(own, given, k, first)
        if tokens:
            log = model.log_likelihoods(symbols, lengths, model.emissions(counts, occurrences)) / np.log(10)
        else:
            log = np.zeros(len(lengths))  # every word is the one unknown
        train = own.column("train")[0].values.to_numpy(zero_copy_only=False)
        return pa.table(
            {
                "doc_id": own.column("ids")[0].values,
                "held_out": pa.array(~train, pa.bool_()),
                "n_tokens": pa.array(lengths, pa.int64()),
                "n_known": own.column("known")[0].values,
                "train_tokens": pa.array([tokens] * len(lengths), pa.int64()),
                "base_score": own.column("base")[0].values,
                "score": pa.array(log, pa.float64()),
            }
        )

    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    asked = _asked(trained.corpus.coded, trained.packed)
    return word_chunks.answered(trained.corpus.coded, asked, run, schema)


def language_model(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", states: int = STATES, rounds: int = ROUNDS) -> DataFrame:
    """Train on the documents that are not held out, and score all.

    Scores are log10 probabilities of a whole text with its end. ``base_score`` is that of single words
    with one added to each count; ``score`` that of the hidden Markov model over the same words, where all
    unknown words are one, as in the base. Training sequences are texts, longer ones in parts of SEGMENT
    tokens; scores are those of undivided texts.

    A null or empty text is its end alone. A row without an id is learned from and scored like others, as
    is each of repeated rows; other columns are ignored. Texts of any length are read whole. Without
    training texts all words are the one unknown, of probability 1, and scores are 0.
    """
    return score(train(docs, text_col, id_col, states, rounds))
