"""Token counts of whole texts, with overlap resynchronisation for huge ones.

A huge document is encoded in overlapping chunks with offsets. Two neighbouring encodings are
spliced where both have token boundaries at the same places for a run of tokens inside the overlap
and one of these places is a proven boundary of the pre-tokeniser; while there is none, the overlap
is widened, up to the whole chunk, and then the chunk is doubled. An ordinary document is a single
chunk: its stable boundaries are known beforehand (before any single space that a non-blank follows),
so equal pieces between them are encoded once and remembered.

Boundaries are proven for byte-level tokenizers without a normaliser or a prefix space. Any other
tokenizer encodes whole texts.
"""

from __future__ import annotations

import functools
import json
import os
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gapbook.llm.common import sliced, text_or_empty

TOKENIZER = "byte_bpe_50k.json"
LIMIT = 1024
#: Texts of more characters are encoded in chunks of so many, overlapping by OVERLAP.
CHUNK = 1 << 13
OVERLAP = 256
#: Tokens that must agree on both sides of a splice.
RUN = 4
#: Bytes of remembered pieces in each Python worker (the memory starts anew when it is full), and
#: characters of a piece that is remembered at most.
MEMORY, MEMORABLE = 64 << 20, 64


_UNEVEN = re.compile(r" (?:\s|\Z)")
_PIECES = re.compile(r"(?: (?=\S))?(?:[^ ]| (?!\S))*", re.DOTALL)
_LETTER = r"a-zA-Z\u3041-\u3094\u30a1-\u30fa\u4e00-\u9fa5\uac00-\ud7a3"
_MARK = r"!-/:-@\[-`{-~\u3001\u3002\uff01\uff0c\uff1f"
#: Where the pre-tokeniser always cuts: before a space that a non-blank follows, before and after any
#: other last blank of a run, before the first blank of a run, and where a letter meets a digit or a
#: sign follows either. Letters and signs are such that all Unicode tables know.
_PROVEN = re.compile(
    rf" (?=\S)|(?<=\S)[\n\t]|(?<=[\n\t])\S|(?<=[{_LETTER}])[0-9]|(?<=[0-9])[{_LETTER}]|(?<=[{_LETTER}0-9])[{_MARK}]"
)


def _alphabet() -> dict[int, str]:
    """How the byte-level pre-tokeniser writes each byte: printable Latin-1 as itself, the others in
    order from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = (b for b in range(256) if b not in plain)
    return {b: chr(b) for b in plain} | {b: chr(0x100 + k) for k, b in enumerate(others)}


@functools.lru_cache(maxsize=2)
def counter_for(path: str, chunk: int) -> ChunkedCounter:
    """One counter, with what it remembers, for the tasks of a Python worker."""
    return ChunkedCounter(path, chunk=chunk)


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class ChunkedCounter:
    """Counts tokens of a ``tokenizers`` tokenizer."""

    def __init__(self, path: str, chunk: int = CHUNK, overlap: int = OVERLAP, run: int = RUN):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs a task on each core
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.chunk, self.overlap, self.run = chunk, overlap, run
        self.specials = [t.content for t in self.tok.get_added_tokens_decoder().values()]
        self.provable = self._provable()
        self.alphabet = _alphabet()
        self.known: dict[str, int] = {}
        self.held = self.widened = self.spliced = 0
        self.tok.no_truncation()
        self.tok.no_padding()

    def _provable(self) -> bool:
        """Whether this is a tokenizer for which ``_PROVEN`` holds."""
        made = json.loads(self.tok.to_str())
        before, model = made.get("pre_tokenizer") or {}, made.get("model") or {}
        plain = all(not (t["lstrip"] or t["rstrip"] or t["single_word"]) for t in made.get("added_tokens") or ())
        return (
            plain
            and made.get("normalizer") is None
            and before.get("type") == "ByteLevel"
            and not before.get("add_prefix_space")
            and before.get("use_regex", True)
            and model.get("type") == "BPE"
            and not model.get("dropout")
        )

    def encode(self, text: str):
        return self.tok.encode(text, add_special_tokens=False)

    def counts(self, texts: list[str]) -> list[int]:
        if not self.provable:
            return [len(e) for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)]
        out = [0] * len(texts)
        split: dict[int, list[str]] = {}
        for k, text in enumerate(texts):
            if len(text) > self.chunk:
                out[k] = self.huge(text)
            elif any(s in text for s in self.specials):
                out[k] = len(self.encode(text))
            elif text:
                split[k] = self.pieces(text)
        lengths = self._lengths(set().union(*split.values()))
        for k, pieces in split.items():
            out[k] = sum(map(lengths.__getitem__, pieces))
        return out

    @staticmethod
    def pieces(text: str) -> list[str]:
        """The text cut before each single space that a non-blank follows."""
        if not _UNEVEN.search(text):
            head, *rest = text.split(" ")
            return [head, *map(" ".__add__, rest)]
        return _PIECES.findall(text)

    def _lengths(self, pieces: set[str]) -> dict[str, int]:
        """The tokens of each piece; what is short enough is remembered."""
        if self.held > MEMORY:
            self.known, self.held = {}, 0
        once: dict[str, int] = {}
        hard = []
        for p in pieces - self.known.keys():
            word = p.rstrip(".,")
            if len(p) <= MEMORABLE and word.lstrip(" ").isalpha() and len(p) - len(word) < 2 and p[1:2] != " " and max(word) < "\u0530":
                # one pre-token of letters old in Unicode, perhaps a full stop or comma after it
                self._remember(p, self._word(word) + len(p) - len(word))
            elif p:
                hard.append(p)
            else:
                once[p] = 0
        for p, e in zip(hard, self.tok.encode_batch_fast(hard, add_special_tokens=False), strict=True):
            if len(p) <= MEMORABLE:
                self._remember(p, len(e))
            else:
                once[p] = len(e)
        return self.known if not once else {p: once[p] if p in once else self.known[p] for p in pieces}

    def _remember(self, piece: str, tokens: int) -> None:
        self.known[piece] = tokens
        self.held += 160 + 4 * len(piece)

    def _word(self, word: str) -> int:
        if (n := self.known.get(word)) is None:
            n = len(self.tok.model.tokenize(word.encode().decode("latin-1").translate(self.alphabet)))
            self._remember(word, n)
        return n

    def _splice(self, proven: set[int], left: list[int], right: list[int]) -> tuple[int, int] | None:
        """Positions in two lists of token starts where both agree for ``run`` tokens before and
        after a proven boundary."""
        where = {s: i for i, s in enumerate(left)}
        for j in range(self.run, len(right) - self.run):
            i = where.get(right[j])
            if (
                i is not None
                and right[j] in proven
                and left[i - self.run : i + self.run] == right[j - self.run : j + self.run]
            ):
                return i, j
        return None

    def huge(self, text: str) -> int:
        if any(s in text for s in self.specials):
            return self._around_specials(text)
        total, begin, end = 0, 0, min(self.chunk, len(text))
        starts = self._starts(text, begin, end)
        while end < len(text):
            overlap = self.overlap
            while True:
                again = max(begin, end - overlap)
                if again == begin:
                    # no splice in the whole chunk: it is encoded anew, twice as long
                    end = min(len(text), end + max(self.chunk, end - begin))
                    starts = self._starts(text, begin, end)
                    break
                # a start that stands alone is no proof: the right chunk begins there itself
                proven = {m.start() for m in _PROVEN.finditer(text, again + 1, end)}
                if proven:
                    reach = min(len(text), end + self.chunk)
                    right = self._starts(text, again, reach)
                    if cut := self._splice(proven, starts, right):
                        total += cut[0]
                        begin, starts, end = right[cut[1]], right[cut[1] :], reach
                        self.spliced += 1
                        break
                self.widened += 1
                overlap *= 2
        return total + len(starts)

    def _starts(self, text: str, begin: int, end: int) -> list[int]:
        return [begin + a for a, _ in self.encode(text[begin:end]).offsets]

    def _around_specials(self, text: str) -> int:
        """An added token is cut out before anything else is, so what stands between two of them is
        a text of its own."""
        parts = re.split("(" + "|".join(map(re.escape, sorted(self.specials, key=len, reverse=True))) + ")", text)
        return sum(
            1 if k % 2 else (self.huge(p) if len(p) > self.chunk else len(self.encode(p))) for k, p in enumerate(parts)
        )


def token_counts(
    docs: DataFrame,
    text_col: str = "text",
    id_col: str = "doc_id",
    path: str | None = None,
    limit: int = LIMIT,
    chunk: int = CHUNK,
) -> DataFrame:
    """Tokens of each whole text: ``id_col, n_bytes, n_tokens, over_limit``.

    A null or empty text has no tokens. Rows that repeat are counted one by one. The tokenizer's
    file is a parameter; it is read by each Python worker from where the package keeps it. A text
    without any proven boundary is encoded in one piece, in time linear in its length.
    """
    path = path or tokenizer_path()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = counter_for(path, chunk)
        for batch in sliced(batches, "text"):
            n = pa.array(counter.counts(batch.column(2).to_pylist()), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), n], ["doc_id", "n_bytes", "n_tokens"])

    text = text_or_empty(text_col)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.octet_length(text).cast("long").alias("n_bytes"), text.alias("text"))
    return rows.mapInArrow(count, "doc_id long, n_bytes long, n_tokens long").select(
        F.col("doc_id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit")
    )
