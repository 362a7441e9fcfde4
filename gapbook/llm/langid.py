"""Language identification by cross-parsing entropy.

For each language a suffix automaton of labelled text is trained. A text is parsed from left to
right into the longest pieces that occur in a language's training text; the language that needs the
fewest phrases for each character wins.

Whole texts are parsed. So that one long text does not run alone, the parse also starts afresh every
``BLOCK`` characters, all blocks and languages in step; each parse then goes on beyond its block
until it meets a phrase boundary of the next one's. A longest match depends on where it begins alone,
so from there on both are the same, and their counts are spliced to exactly that of the whole text.
"""

from __future__ import annotations

import functools
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gapbook.llm.common import sliced, text_or_empty

#: Labelled documents sampled for each language, and characters of them that go into its automaton.
TRAIN_ROWS, TRAIN_CHARS = 200, 40_000
#: Documents drawn for each of the sample.
DRAWN = 4
#: Characters after which the parse of a text also starts afresh, so that long texts run in parallel.
BLOCK = 1024
UNDETERMINED = "und"
BLANK = 32


def held_out(id_col: str = "doc_id") -> Column:
    """The documents nothing is learned from: crc32 of the id as text leaves 1 modulo 3."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(False))


@functools.lru_cache(maxsize=1)
def _folding() -> tuple[np.ndarray, np.ndarray]:
    """For each code point its lower-case letter, or a blank where it is neither letter nor combining
    mark; and whether it is a letter."""
    out, letter = np.full(0x110000, BLANK, np.uint32), np.zeros(0x110000, bool)
    for i in range(0x110000):
        c = chr(i)
        if c.isalpha():
            letter[i] = True
            out[i] = ord(low) if len(low := c.lower()) == 1 else i
        elif unicodedata.category(c)[0] == "M":
            out[i] = i
    return out, letter


def folded(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Lower-case code points of all texts in a row, each run of other characters than letters and
    their marks as one blank and none at a text's start, and the number of points of each text: 0
    for one without a letter."""
    table, letter = _folding()
    sizes = np.array([len(t) for t in texts], np.int64)
    raw = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    points, ends = table[raw], np.cumsum(sizes)
    letters = np.concatenate([[0], np.cumsum(letter[raw])])
    some = letters[ends] > letters[ends - sizes]
    blank = points == BLANK
    again = np.empty(len(points), bool)
    again[1:] = blank[:-1]
    again[(ends - sizes)[sizes > 0]] = True
    kept = ~(blank & again) & np.repeat(some, sizes)
    before = np.concatenate([[0], np.cumsum(kept)])
    return points[kept], before[ends] - before[ends - sizes]


def suffix_automaton(codes: list[int]) -> list[dict[int, int]]:
    """The minimal automaton of all substrings of a sequence of codes: for each state the following
    state by code. State 0 is the root."""
    follow: list[dict[int, int]] = [{}]
    link, length = [-1], [0]
    last = 0
    for c in codes:
        new = len(follow)
        follow.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in follow[p]:
            follow[p][c] = new
            p = link[p]
        if p >= 0:
            q = follow[p][c]
            if length[p] + 1 == length[q]:
                link[new] = q
            else:
                copy = len(follow)
                follow.append(dict(follow[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and follow[p].get(c) == q:
                    follow[p][c] = copy
                    p = link[p]
                link[q] = link[new] = copy
        last = new
    return follow


class EdgeTable:
    """The edges of several automata in one array, as long as there are edges, whatever the alphabet.

    A state is known by its place d, different for each in its automaton. Its edge by a code stands at
    (d + spread(code)) modulo 2 ** bits of its automaton's part, as d << 32 | place of the following
    state. ``root`` and ``lone`` are for each automaton the places of its first state and of a further
    one without edges.
    """

    def __init__(self, automata: list[list[dict[int, int]]], codes: int):
        most = max((max(sum(map(len, a)), len(a)) for a in automata), default=1)
        self.bits = max(8, codes.bit_length(), (3 * most // 2).bit_length())
        size = 1 << self.bits
        self.mask, self.part = size - 1, np.arange(len(automata), dtype=np.int64) * size
        self.edge = np.full(size * len(automata), -1, np.int64)
        self.lone, self.root = np.zeros(len(automata), np.int64), np.zeros(len(automata), np.int64)
        # different codes have different places; that of code 0 is 0
        self.spread = ((np.arange(codes, dtype=np.uint64) * np.uint64(0x9E3779B1)) & np.uint64(size - 1)).astype(np.int64)
        for k, follow in enumerate(automata):
            self._lay_out([*follow, {}], k)

    def _lay_out(self, follow: list[dict[int, int]], k: int) -> None:
        used, taken, place = bytearray(self.mask + 1), bytearray(self.mask + 1), [0] * len(follow)
        draws, at = np.random.default_rng(0).integers(0, self.mask + 1, 1 << 20).tolist(), 0
        spread, mask = self.spread.tolist(), self.mask
        # states of many edges first, while there is room
        for s in sorted(range(len(follow)), key=lambda s: -len(follow[s])):
            steps = [spread[c] for c in follow[s]]
            while True:
                d = draws[at & 0xFFFFF] ^ (at >> 20)
                at += 1
                if not taken[d] and not any(used[(d + x) & mask] for x in steps):
                    break
            place[s], taken[d] = d, 1
            for x in steps:
                used[(d + x) & mask] = 1
        own = self.edge[self.part[k] :]
        for s, edges in enumerate(follow):
            for c, t in edges.items():
                own[(place[s] + spread[c]) & mask] = place[s] << 32 | place[t]
        self.root[k], self.lone[k] = place[0], place[-1]

    def follow(self, state: np.ndarray, spread: np.ndarray, part: np.ndarray) -> np.ndarray:
        """The following states, or -1 where there is no edge."""
        found = np.take(self.edge, ((state + spread) & self.mask) + part, mode="clip")
        return np.where(found >> 32 == state, found & 0xFFFFFFFF, -1)


@dataclass
class LanguageModel:
    """Automata of all languages in one table.

    ``code`` numbers every character of the training texts, from 1; 0 is any other, by which no state
    has an edge. ``begun[code, k]`` is the state of language k after the first character of a phrase:
    where the language lacks it, the lone state, so that the character is a phrase of its own.
    """

    languages: list[str]
    edges: EdgeTable
    begun: np.ndarray
    code: np.ndarray

    @classmethod
    def train(cls, texts: dict[str, str]) -> LanguageModel:
        points = {k: folded([v])[0] for k, v in sorted(texts.items())}
        known = np.unique(np.concatenate([np.zeros(0, np.uint32), *points.values()]))
        code = np.zeros(0x110000, np.int32)
        code[known] = np.arange(1, len(known) + 1)
        e = EdgeTable([suffix_automaton(code[p].tolist()) for p in points.values()], len(known) + 1)
        begun = np.empty((len(known) + 1, len(points)), np.int64)
        for k in range(len(points)):
            after = e.follow(e.root[k], e.spread, e.part[k])
            begun[:, k] = np.where(after >= 0, after, e.lone[k])
        return cls(list(points), e, begun, code)

    def phrases(self, points: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Phrases that each whole folded text needs in each language: (texts, languages)."""
        codes = self.code[points]
        first = np.cumsum(sizes) - sizes
        blocks = -(-sizes // BLOCK)
        text = np.repeat(np.arange(len(sizes)), blocks)
        nth = np.arange(len(text)) - (np.cumsum(blocks) - blocks)[text]
        begin = first[text] + nth * BLOCK
        end = np.minimum(begin + BLOCK, (first + sizes)[text])
        starts, states = self._parse(codes, begin, end - begin)
        follows = np.flatnonzero(nth + 1 < blocks[text])
        exits, more, lost = self._go_on(codes, starts, states, follows, end, (first + sizes)[text])
        many = len(self.languages)
        out = np.zeros((len(sizes), many), np.int64)
        for k in range(many):
            before = np.concatenate([[0], np.cumsum(starts[:, k], dtype=np.int64)])
            entry = begin.copy()
            entry[follows + 1] = exits[:, k]
            own = before[end] - before[entry]
            own[follows] += more[:, k]
            out[:, k] = np.bincount(text, own, len(sizes))
        # where a parse met none of the next block's boundaries, the text is parsed from its beginning
        for i, k in sorted(set(zip(text[follows[lost // many]].tolist(), (lost % many).tolist(), strict=True))):
            out[i, k] = self._one(codes[first[i] : first[i] + sizes[i]].tolist(), k)
        return out

    def _one(self, codes: list[int], k: int) -> int:
        """The phrases of one text in one language, character by character."""
        edge, spread, begun = memoryview(self.edges.edge), self.edges.spread.tolist(), self.begun[:, k].tolist()
        mask, part, state, phrases = self.edges.mask, int(self.edges.part[k]), int(self.edges.lone[k]), 0
        for c in codes:
            found = edge[((state + spread[c]) & mask) + part]
            if found >> 32 == state:
                state = found & 0xFFFFFFFF
            else:
                state, phrases = begun[c], phrases + 1
        return phrases

    def _parse(self, codes: np.ndarray, begin: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All blocks in step, each from its begin on: where a phrase starts, (characters, languages),
        and the state of each block at its end."""
        starts = np.zeros((len(codes), len(self.languages)), bool)
        states = np.repeat(self.edges.lone[None, :], len(begin), axis=0)
        order = np.argsort(-size, kind="stable")
        begin, size = begin[order], size[order]
        if not len(begin) or not self.languages:
            return starts, states
        state, spread = states.copy(), self.edges.spread[codes]
        live = np.searchsorted(-size, -np.arange(int(size[0])), side="left")
        for t, m in enumerate(live.tolist()):
            at = begin[:m] + t
            after = self.edges.follow(state[:m], spread[at][:, None], self.edges.part)
            new = after < 0
            starts[at] = new
            np.copyto(after, np.take(self.begun, codes[at], axis=0), where=new)
            state[:m] = after
        states[order] = state
        return starts, states

    def _go_on(self, codes, starts, states, follows, end, last) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The parses of the blocks ``follows``, beyond their ends, up to the first phrase start they
        share with the next block's: its place, the phrases begun until then, and which parses
        (block times languages plus language) found none; one that ends with its text needs none."""
        many = len(self.languages)
        exits, more = np.zeros((len(follows), many), np.int64), np.zeros((len(follows), many), np.int64)
        lost = []
        lane = np.arange(len(follows) * many)
        at, state = np.repeat(end[follows], many), states[follows].ravel()
        limit, close = np.repeat(end[follows + 1], many), np.repeat(last[follows], many)
        while lane.size:
            k, code = lane % many, codes[at]
            after = self.edges.follow(state, self.edges.spread[code], self.edges.part[k])
            begins = after < 0
            met = begins & starts[at, k]
            exits.ravel()[lane[met]] = at[met]
            more.ravel()[lane[begins & ~met]] += 1
            state = np.where(begins, self.begun[code, k], after)
            at = at + 1
            out = ~met & (at == limit)
            exits.ravel()[lane[out]] = at[out]
            lost.append(lane[out & (at < close)])
            stay = ~met & ~out
            lane, at, state, limit, close = lane[stay], at[stay], state[stay], limit[stay], close[stay]
        return exits, more, np.concatenate([np.zeros(0, np.int64), *lost])

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        """The language of each text and how far it leads: 1 - best / second best phrase count.
        Ties go to the language that comes first by name, with score 0."""
        points, sizes = folded(texts)
        labels, scores = np.full(len(texts), UNDETERMINED, object), np.zeros(len(texts))
        some = np.flatnonzero(sizes)  # a text without a letter folds to nothing
        if some.size and self.languages:
            counts = self.phrases(points, sizes)[some]
            labels[some] = np.array(self.languages, object)[counts.argmin(axis=1)]
            ranked = np.sort(counts, axis=1)
            scores[some] = 1.0 - ranked[:, 0] / ranked[:, 1] if len(self.languages) > 1 else 1.0
        return labels.tolist(), scores


def learn(
    docs: DataFrame,
    text_col: str = "text",
    lang_col: str = "lang",
    id_col: str = "doc_id",
    rows: int = TRAIN_ROWS,
    chars: int = TRAIN_CHARS,
) -> LanguageModel:
    """Train on documents that are not held out and have a language and a text.

    The sample of each language is bounded: about DRAWN times ``rows`` documents are drawn by their
    hashed ids, all if there are fewer. Of these the first ``rows`` stay, those of a sixteenth of
    ``chars`` at most before longer ones; their whole texts are taken while they hold no more than
    ``chars`` characters in all, the first whatever its length. Every character of the sample counts.
    The model grows with the languages times ``chars``.
    """
    usable = docs.where(~held_out(id_col) & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    size = F.char_length("text")
    usable = usable.select(
        F.col(lang_col).cast("string").alias("lang"), F.xxhash64(F.col(id_col).cast("string")).alias("order"), F.col(text_col).alias("text")
    )
    # drawn by the counts before texts move, so that no task meets more than the sample
    counts = usable.groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
    place = F.shiftrightunsigned("order", 11) / float(1 << 53)
    usable = usable.join(F.broadcast(counts), "lang").where(place * F.col("n") < DRAWN * rows)
    usable = usable.withColumn("long", F.when(size > chars // 16, size).otherwise(0))
    first = Window.partitionBy("lang").orderBy("long", "order", "text")
    picked = usable.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= rows)
    total = F.sum(size + 1).over(first.rowsBetween(Window.unboundedPreceding, 0))
    found = picked.withColumn("total", total).where((F.col("total") <= chars) | (F.col("rank") == 1)).select("lang", "rank", "text").collect()
    texts: dict[str, list[str]] = {}
    for r in sorted(found, key=lambda r: (r.lang, r["rank"])):
        texts.setdefault(r.lang, []).append(r.text)
    return LanguageModel.train({k: " ".join(v) for k, v in texts.items()})


def identify(
    docs: DataFrame,
    model: LanguageModel,
    text_col: str = "text",
    id_col: str = "doc_id",
) -> DataFrame:
    """``id_col, lang_pred, score`` for every whole text, from the text alone.

    A null text, and one without a letter, is ``und`` with score 0. Rows that repeat are judged one
    by one; other columns are ignored. A model trained on nothing calls everything ``und``.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "text"):
            labels, scores = shared.value.predict(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(labels, pa.string()), pa.array(scores, pa.float64())],
                ["doc_id", "lang_pred", "score"],
            )

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, lang_pred string, score double").withColumnRenamed("doc_id", id_col)


def keep_identified(docs: DataFrame, model: LanguageModel, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that have a language: a null text, and one without a letter, goes. Rows
    keep all their columns, whatever their names, and go through Python as they are."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, text_col):
            texts = batch.column(batch.schema.get_field_index(text_col)).to_pylist()
            labels, _ = shared.value.predict([t or "" for t in texts])
            yield batch.filter(pa.array([x != UNDETERMINED for x in labels], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
