"""Unigram pieces: Viterbi over a double-array trie, with byte fallback and exact decoding.

The pieces of a model file are ranked by its scores and given Zipf-Mandelbrot log probabilities
(``log_scores``); nothing is trained. Encoding writes each blank as the whitespace marker, puts one
before the text, and takes for each stretch between markers the split into pieces with the largest
sum of log scores. A character that no piece covers becomes its UTF-8 bytes. Decoding is exact for
every text: a marker character that stands in the text itself is encoded as bytes.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gapbook.llm.common import sliced, text_or_empty

MODEL = "piece_bpe_32k.model"
MARK = "▁"
#: Zipf-Mandelbrot shift of the log scores, and what an uncovered character costs below the least.
SHIFT, UNKNOWN = 2.7, 10.0
#: Bytes of remembered stretches in each Python worker (the memory starts anew when it is full), and
#: characters of one that is remembered at most; parts longer than WIDE are split one by one, others
#: TOGETHER at a time.
MEMORY, MEMORABLE, WIDE, TOGETHER = 32 << 20, 64, 256, 5_000
#: Characters whose pieces are looked up together.
WINDOW = 1 << 16

_STRETCH = re.compile(r" *[^ ]+| +")


def model_path(name: str = MODEL) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@dataclass
class Pieces:
    """A vocabulary: the text and log score of each id; ``byte_ids[b]`` is the piece of byte b."""

    texts: list[str]
    scores: np.ndarray
    normal: np.ndarray
    byte_ids: np.ndarray


def log_scores(ranks: np.ndarray, shift: float = SHIFT) -> np.ndarray:
    """Log probabilities that fall with the rank as 1 / (rank + shift)."""
    p = 1.0 / (ranks + shift)
    return np.log(p / p.sum())


def load_pieces(path: str) -> Pieces:
    import sentencepiece

    m = sentencepiece.SentencePieceProcessor(model_file=path)
    ids = range(m.get_piece_size())
    texts = [m.id_to_piece(i) for i in ids]
    kept = np.array([not (m.is_control(i) or m.is_unknown(i) or m.is_byte(i) or m.is_unused(i)) for i in ids])
    raw = np.array([m.get_score(i) for i in ids])
    order = np.flatnonzero(kept)[np.argsort(-raw[kept], kind="stable")]
    scores = np.zeros(len(texts))
    scores[order] = log_scores(np.arange(len(order)))
    by_text = {t: i for i, t in enumerate(texts)}
    return Pieces(texts, scores, kept, np.array([by_text[f"<0x{b:02X}>"] for b in range(256)], np.int32))


@dataclass
class DoubleArray:
    """A trie over strings as two arrays: the child of node s by code c is base[s] + c, if check
    there says s. ``value`` is the number of the string that ends at a node, or -1."""

    base: np.ndarray
    check: np.ndarray
    value: np.ndarray
    code: np.ndarray
    longest: int

    @classmethod
    def build(cls, keys: dict[str, int]) -> DoubleArray:
        letters = sorted({c for k in keys for c in k})
        code = np.zeros(0x110000, np.int32)
        code[[ord(c) for c in letters]] = np.arange(1, len(letters) + 1)
        tree: dict[int, dict] = {}
        for key, value in keys.items():
            node = tree
            for c in key:
                node = node.setdefault(int(code[ord(c)]), {})
            node[0] = value
        room = 4 * sum(map(len, keys)) + 2 * len(letters) + 64
        base, check = np.zeros(room, np.int32), np.full(room, -1, np.int32)
        value, free = np.full(room, -1, np.int32), np.ones(room, bool)
        free[0], first, waiting, top = False, 1, [(0, tree)], 0
        # wide nodes first, while the arrays are empty; each level in turn
        while waiting:
            below = []
            for at, node in sorted(waiting, key=lambda x: -len(x[1])):
                value[at] = node.get(0, -1)
                codes = np.array(sorted(c for c in node if c), np.int64)
                if not codes.size:
                    continue
                start, width = first, 256
                while True:
                    spots = start + np.flatnonzero(free[start : start + width]) - codes[0]
                    spots = spots[spots >= 0]
                    fits = np.ones(len(spots), bool)
                    for c in codes[1:]:
                        fits &= free[np.minimum(spots + c, room - 1)]
                    if fits.any():
                        break
                    start, width = start + width, width * 2
                base[at] = b = int(spots[fits.argmax()])
                free[b + codes] = False
                check[b + codes] = at
                top = max(top, b + int(codes[-1]))
                while not free[first]:
                    first += 1
                below.extend((b + int(c), node[int(c)]) for c in codes)
            waiting = below
        end = top + len(letters) + 2
        return cls(base[:end], check[:end], value[:end], code, max(map(len, keys), default=0))


@dataclass
class Codec:
    """Encodes and decodes with one vocabulary; remembers the stretches it has split."""

    pieces: Pieces
    trie: DoubleArray
    known: dict[str, bytes] = field(default_factory=dict)
    held: int = 0

    @classmethod
    def of(cls, pieces: Pieces) -> Codec:
        codec = cls(pieces, DoubleArray.build({t: i for i, t in enumerate(pieces.texts) if pieces.normal[i]}))
        # a blank of the text stands for the marker; the marker itself has no piece
        codec.trie.code[ord(" ")], codec.trie.code[ord(MARK)] = codec.trie.code[ord(MARK)], 0
        return codec

    def __getstate__(self):
        return {"pieces": self.pieces, "trie": self.trie, "known": {}, "held": 0}

    def __post_init__(self):
        self.unknown = float(self.pieces.scores[self.pieces.normal].min()) - UNKNOWN
        of_byte = {int(i): b for b, i in enumerate(self.pieces.byte_ids)}
        self.bytes = [
            bytes([of_byte[i]]) if i in of_byte else t.replace(MARK, " ").encode() if self.pieces.normal[i] else b""
            for i, t in enumerate(self.pieces.texts)
        ]

    def __setstate__(self, state):
        self.__dict__.update(state)
        self.__post_init__()

    # -- encoding

    @staticmethod
    def stretches(text: str) -> list[str]:
        """The text, a marker before it, cut before each run of blanks."""
        if not text:
            return []
        if text[0] != " " and text[-1] != " " and "  " not in text:
            return list(map(" ".__add__, text.split(" ")))
        return _STRETCH.findall(" " + text)

    def encode_batch(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids in a row, and where each text's ids begin and end."""
        cut = [self.stretches(t) for t in texts]
        words = set().union(*cut)
        if self.held > MEMORY:
            self.known, self.held = {}, 0
        once = self._split([w for w in words if w not in self.known])
        look = ({w: once[w] if w in once else self.known[w] for w in words} if once else self.known).__getitem__
        parts = [b"".join(map(look, c)) for c in cut]
        ends = np.cumsum([0, *(len(p) // 4 for p in parts)]).astype(np.int32)
        return np.frombuffer(b"".join(parts), np.int32), ends

    def _split(self, words: list[str]) -> dict[str, bytes]:
        """The ids of new stretches: short ones are remembered, the others come back."""
        near, once = [w for w in words if len(w) <= WIDE], {}
        for a in range(0, len(near), TOGETHER):
            for w, ids in self._split_together(near[a : a + TOGETHER]).items():
                if len(w) > MEMORABLE:
                    once[w] = ids
                else:
                    self.known[w] = ids
                    self.held += 200 + 4 * len(w) + len(ids)
        for w in words:
            if len(w) > WIDE:
                once[w] = self._split_long(w)
        return once

    def _split_long(self, word: str) -> bytes:
        """A long stretch is cut where no piece goes across: every split goes through these places, so
        the parts are split alone."""
        ends = self._cuts(word)
        parts = [word[a:b] for a, b in zip([0, *ends], [*ends, len(word)], strict=True)]
        short = list({p for p in parts if len(p) <= WIDE})
        found: dict[str, bytes] = {}
        for a in range(0, len(short), TOGETHER):
            found |= self._split_together(short[a : a + TOGETHER])
        return b"".join(found[p] if p in found else self._as_ids(p, self._split_alone(p)) for p in parts)

    def _cuts(self, word: str) -> list[int]:
        """Places inside the stretch that no piece of it goes across."""
        t, n = self.trie, len(word)
        codes = t.code[np.frombuffer(word.encode("utf-32-le", "surrogatepass"), np.uint32)]
        across = np.zeros(n + 1, np.int32)
        for low in range(0, n, WINDOW):
            at, node = np.arange(low, min(n, low + WINDOW)), np.zeros(min(WINDOW, n - low), np.int64)
            for k in range(t.longest):
                inside = at + k < n
                at, node = at[inside], node[inside]
                c = codes[at + k]
                child = t.base[node] + c
                fits = (c > 0) & (t.check[child] == node)
                at, node = at[fits], child[fits]
                if not at.size:
                    break
                ends = at[t.value[node] >= 0]
                if k:
                    np.add.at(across, ends + 1, 1)
                    np.add.at(across, ends + k + 1, -1)
        return (np.flatnonzero(np.cumsum(across[1:n]) == 0) + 1).tolist()

    def _as_ids(self, word: str, found: list[tuple[int, int]]) -> bytes:
        """Ids of (start, id) pairs; id -1 is a character without a piece."""
        out: list[int] = []
        for start, i in found:
            out.extend([i] if i >= 0 else self.pieces.byte_ids[list(word[start].encode("utf-8", "surrogatepass"))].tolist())
        return np.array(out, np.int32).tobytes()

    def _split_alone(self, word: str) -> list[tuple[int, int]]:
        """Viterbi along one long stretch."""
        t = self.trie
        codes = t.code[np.frombuffer(word.encode("utf-32-le", "surrogatepass"), np.uint32)].tolist()
        if not hasattr(self, "lists"):
            self.lists = tuple(array(kind, x.tobytes()) for kind, x in (("i", t.base), ("i", t.check), ("i", t.value), ("d", self.pieces.scores)))
        base, check, value, scores = self.lists
        n = len(word)
        # of each place: the best sum, the piece that ends there and its length
        best, piece, size = array("d", [-np.inf]) * (n + 1), array("i", [-1]) * (n + 1), array("i", [1]) * (n + 1)
        best[0] = 0.0
        for i in range(n):
            node, k, here, single = 0, i, best[i], False
            while k < n and codes[k]:
                child = base[node] + codes[k]
                if check[child] != node:
                    break
                node, k = child, k + 1
                if value[node] >= 0:
                    single |= k == i + 1
                    if (s := here + scores[value[node]]) > best[k]:
                        best[k], piece[k], size[k] = s, value[node], k - i
            if not single and (s := here + self.unknown) > best[i + 1]:
                best[i + 1], piece[i + 1], size[i + 1] = s, -1, 1
        out, at = [], n
        while at:
            out.append((at - size[at], piece[at]))
            at -= size[at]
        return out[::-1]

    def _split_together(self, words: list[str]) -> dict[str, bytes]:
        """Viterbi along many short stretches in step."""
        t, sizes = self.trie, np.array([len(w) for w in words], np.int64)
        codes = t.code[np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)]
        first = np.cumsum(sizes) - sizes
        word = np.repeat(np.arange(len(words)), sizes)
        left = (first + sizes)[word] - np.arange(len(codes))  # characters from here to the stretch's end
        at, node, edges = np.arange(len(codes)), np.zeros(len(codes), np.int64), []
        single = np.zeros(len(codes), bool)
        for k in range(t.longest):
            inside = left[at] > k
            at, node = at[inside], node[inside]
            c = codes[at + k]
            child = t.base[node] + c
            fits = (c > 0) & (t.check[child] == node)
            at, node = at[fits], child[fits]
            if not at.size:
                break
            ends = t.value[node] >= 0
            edges.append((at[ends], np.full(ends.sum(), k + 1), t.value[node[ends]]))
            if not k:
                single[at[ends]] = True
        bare = np.flatnonzero(~single)
        edges.append((bare, np.ones(len(bare), np.int64), np.full(len(bare), -1, np.int32)))
        start, size, piece = (np.concatenate(x) for x in zip(*edges, strict=True))
        step = start - first[word[start]]
        order = np.argsort(step, kind="stable")
        start, size, piece, step = start[order], size[order], piece[order], step[order]
        score = np.where(piece >= 0, self.pieces.scores[piece], self.unknown)
        origin = start + word[start]  # nodes: one more than characters in each stretch
        best = np.full(len(codes) + len(words), -np.inf)
        back = np.full(len(best), -1, np.int64)
        best[first + np.arange(len(words))] = 0.0
        bounds = np.searchsorted(step, np.arange(int(sizes.max(initial=0)) + 1))
        for a, b in zip(bounds, bounds[1:], strict=False):
            total, to = best[origin[a:b]] + score[a:b], origin[a:b] + size[a:b]
            better = np.flatnonzero(total > best[to])
            # one origin per stretch in a step, so no two edges share a target
            best[to[better]] = total[better]
            back[to[better]] = a + better
        live, node = np.arange(len(words)), first + sizes + np.arange(len(words))
        owners, taken = [], []
        while live.size:
            e = back[node]
            owners.append(live)
            taken.append(e)
            node = origin[e]
            more = node > (first + np.arange(len(words)))[live]
            live, node = live[more], node[more]
        owner, edge = np.concatenate(owners)[::-1], np.concatenate(taken)[::-1]
        order = np.argsort(owner, kind="stable")
        owner, edge = owner[order], edge[order]
        ids = piece[edge].astype(np.int32)
        ends = np.searchsorted(owner, np.arange(len(words) + 1)).tolist()
        odd = set(owner[ids < 0].tolist())
        raw, out = ids.tobytes(), {}
        for k, w in enumerate(words):
            a, b = ends[k], ends[k + 1]
            if k in odd:
                out[w] = self._as_ids(w, list(zip((start[edge[a:b]] - first[k]).tolist(), ids[a:b].tolist(), strict=True)))
            else:
                out[w] = raw[4 * a : 4 * b]
        return out

    # -- decoding

    def decode(self, ids: list[int]) -> str:
        """Bytes that are not UTF-8 become the replacement character."""
        data = b"".join(map(self.bytes.__getitem__, ids))
        return (data[1:] if data[:1] == b" " else data).decode("utf-8", "replace")


def codec(path: str | None = None) -> Codec:
    return Codec.of(load_pieces(path or model_path()))


def _shared(docs: DataFrame, of: Codec | str | None):
    """The tables of a vocabulary, which its own size bounds, sent once to each executor."""
    return docs.sparkSession.sparkContext.broadcast(of if isinstance(of, Codec) else codec(of))


def encode(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", model: Codec | str | None = None) -> DataFrame:
    """``id_col, ids``: the piece ids of each whole text; none for a null or empty one. Rows that
    repeat are encoded one by one; other columns are ignored."""
    shared = _shared(docs, model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "text"):
            flat, ends = shared.value.encode_batch(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(ends, flat)], ["doc_id", "ids"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, ids array<int>").withColumnRenamed("doc_id", id_col)


def decode(encoded: DataFrame, id_col: str = "doc_id", model: Codec | str | None = None) -> DataFrame:
    """``id_col, text``: the text that ``ids`` stand for; null ids give an empty text."""
    shared = _shared(encoded, model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [shared.value.decode(x or []) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    rows = encoded.select(F.col(id_col).cast("long").alias("doc_id"), "ids")
    return rows.mapInArrow(run, "doc_id long, text string").withColumnRenamed("doc_id", id_col)


def round_trip(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", model: Codec | str | None = None) -> DataFrame:
    """Encoding and decoding in one pass: ``id_col, ids, n_pieces, n_byte_pieces, decoded_sha256,
    exact``, where ``exact`` says that the decoded text equals the given one."""
    import hashlib

    shared = _shared(docs, model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        is_byte = np.zeros(len(own.pieces.texts) + 1, bool)
        is_byte[own.pieces.byte_ids] = True
        for batch in sliced(batches, "text"):
            texts = batch.column(1).to_pylist()
            flat, ends = own.encode_batch(texts)
            ids = flat.tolist()
            back = [own.decode(ids[a:b]) for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
            in_bytes = np.concatenate([[0], np.cumsum(is_byte[flat])])
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.ListArray.from_arrays(ends, flat),
                    pa.array(np.diff(ends).astype(np.int64)),
                    pa.array((in_bytes[ends[1:]] - in_bytes[ends[:-1]]).astype(np.int64)),
                    pa.array([hashlib.sha256(t.encode()).hexdigest() for t in back], pa.string()),
                    pa.array([a == b for a, b in zip(texts, back, strict=True)], pa.bool_()),
                ],
                ["doc_id", "ids", "n_pieces", "n_byte_pieces", "decoded_sha256", "exact"],
            )

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"))
    schema = "doc_id long, ids array<int>, n_pieces long, n_byte_pieces long, decoded_sha256 string, exact boolean"
    return rows.mapInArrow(run, schema).withColumnRenamed("doc_id", id_col)
