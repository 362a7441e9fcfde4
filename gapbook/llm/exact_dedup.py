"""Exact duplicates by Patricia-trie owners.

Texts are normalised (each run of blanks becomes one space), dealt out by their length and content
hash, and inserted whole into a compressed radix trie; the terminal node of a text keeps the
smallest identifier seen and the number of rows. A first trie in each map task merges local copies
before the shuffle, so a text that fills a third of the table crosses the network once a task.
"""

from __future__ import annotations

import hashlib
import os
import pickle
import tempfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gapbook.llm.common import text_or_empty

BLANKS = r"[\x20\x09-\x0D]+"
#: Bytes of text one trie may hold before it flushes (map side) or spills a subtree (owners).
MAP_TRIE_BYTES = 24 << 20
OWNER_TRIE_BYTES = 96 << 20


def normalised(text_col: str) -> Column:
    return F.regexp_replace(text_or_empty(text_col), BLANKS, " ")


def _shared_length(a: bytes, b: bytes, start: int) -> int:
    """How many bytes of ``a`` agree with ``b`` from ``start`` on, by bisection on slices."""
    low, high = 0, min(len(a), len(b) - start)
    while low < high:
        mid = (low + high + 1) // 2
        if a[low:mid] == b[start + low : start + mid]:
            low = mid
        else:
            high = mid - 1
    return low


def _smaller(a, b):
    """The smaller identifier; a null one loses to any other."""
    return b if a is None or (b is not None and b < a) else a


class PatriciaTrie:
    """A radix trie over byte strings; a terminal node holds [smallest id, rows].

    A node is ``[label, children by first byte, value]``. With ``limit`` set, the heaviest subtree
    below the root moves to a file of its own whenever more than ``limit`` bytes are resident;
    later strings of that subtree go straight to the file, and ``items`` reads each file back into
    a trie rooted at the longest prefix its strings share.
    """

    def __init__(self, limit: int | None = None, depth: int = 0):
        self.limit, self.depth = limit, depth
        self.root: list = [b"", {}, None]
        self.resident = 0
        self.weight: dict[int, int] = {}
        self.spilled: dict[int, object] = {}
        self.spills = 0

    def insert(self, text: bytes, owner, rows: int) -> None:
        at = self.depth
        first = text[at] if at < len(text) else -1
        if first in self.spilled:
            pickle.dump((text, owner, rows), self.spilled[first])
            return
        node = self.root
        while at < len(text):
            child = node[1].get(text[at])
            if child is None:
                node[1][text[at]] = node = [text[at:], {}, None]
                self._grew(first, len(text) - at)
                break
            label = child[0]
            if text.startswith(label, at):
                node, at = child, at + len(label)
                continue
            n = _shared_length(label, text, at)
            middle = [label[:n], {label[n]: child}, None]
            child[0] = label[n:]
            node[1][text[at]] = node = middle
            self._grew(first, 0)
            at += n
        value = node[2]
        node[2] = [owner, rows] if value is None else [_smaller(value[0], owner), value[1] + rows]
        if self.limit is not None and self.resident > self.limit and self.weight:
            self._spill(max(self.weight, key=self.weight.get))

    def _grew(self, first: int, size: int) -> None:
        size += 200  # a node's own cost
        self.resident += size
        self.weight[first] = self.weight.get(first, 0) + size

    def _walk(self, node: list, prefix: bytes) -> Iterator[tuple[bytes, object, int]]:
        stack = [(node, prefix)]
        while stack:
            node, prefix = stack.pop()
            if node[2] is not None:
                yield prefix, *node[2]
            stack.extend((c, prefix + c[0]) for c in node[1].values())

    def _spill(self, first: int) -> None:
        file = tempfile.TemporaryFile()
        child = self.root[1].pop(first)
        # labels are relative to the root; the bytes above it are equal for all and put back
        for text, owner, rows in self._walk(child, self.prefix + child[0]):
            pickle.dump((text, owner, rows), file)
        self.spilled[first] = file
        self.resident -= self.weight.pop(first)
        self.spills += 1

    prefix = b""

    def items(self) -> Iterator[tuple[bytes, object, int]]:
        """Each distinct text once, with its smallest id and its number of rows."""
        yield from self._walk(self.root, self.prefix)
        self.root = [b"", {}, None]
        for file in self.spilled.values():
            shared = None
            for text, _, _ in _read_back(file):
                shared = text if shared is None else shared[: _shared_length(shared, text, 0)]
            below = PatriciaTrie(self.limit, len(shared or b""))
            below.prefix = shared or b""
            for entry in _read_back(file):
                below.insert(*entry)
            file.close()
            yield from below.items()


def _read_back(file) -> Iterator[tuple]:
    file.flush()
    file.seek(0)
    while True:
        try:
            yield pickle.load(file)
        except EOFError:
            file.seek(0, os.SEEK_END)
            return


def _texts(entries: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict(
        {
            "text": pa.array([e[0] for e in entries], pa.binary()),
            "owner": pa.array([e[1] for e in entries], pa.int64()),
            "n": pa.array([e[2] for e in entries], pa.int64()),
        }
    )


def _chunks(entries: Iterator[tuple], limit: int = 4 << 20) -> Iterator[list[tuple]]:
    held, size = [], 0
    for e in entries:
        held.append(e)
        size += len(e[0])
        if size >= limit or len(held) >= 8192:
            yield held
            held, size = [], 0
    if held:
        yield held


def _merge_locally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Map side: copies met in one task become one row."""
    trie = PatriciaTrie()
    for batch in batches:
        for text, owner in zip(batch.column(0), batch.column(1), strict=True):
            trie.insert(text.as_buffer().to_pybytes(), owner.as_py(), 1)
            if trie.resident > MAP_TRIE_BYTES:
                for part in _chunks(trie.items()):
                    yield _texts(part)
                trie = PatriciaTrie()
    for part in _chunks(trie.items()):
        yield _texts(part)


def _own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Reduce side: the owner of each text of this length-and-hash partition."""
    trie = PatriciaTrie(limit=OWNER_TRIE_BYTES)
    for batch in batches:
        for text, owner, n in zip(*(batch.column(i) for i in range(3)), strict=True):
            trie.insert(text.as_buffer().to_pybytes(), owner.as_py(), n.as_py())
    for part in _chunks(trie.items()):
        yield pa.RecordBatch.from_pydict(
            {
                "text_sha256": pa.array([hashlib.sha256(e[0]).hexdigest() for e in part], pa.string()),
                "keep_id": pa.array([e[1] for e in part], pa.int64()),
                "group_size": pa.array([e[2] for e in part], pa.int64()),
            }
        )


def owners(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """One row per distinct normalised text: text_sha256, keep_id, group_size."""
    texts = docs.select(
        normalised(text_col).cast("binary").alias("text"), F.col(id_col).cast("long").alias("owner")
    )
    local = texts.mapInArrow(_merge_locally, "text binary, owner long, n long")
    dealt = local.repartition(F.length("text"), F.xxhash64("text"))
    return dealt.mapInArrow(_own, "text_sha256 string, keep_id long, group_size long")


def exact_dedup(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """Every row of ``docs`` with its group of equal texts.

    Returns ``id_col, keep_id, group_size, kept, text_sha256``. A null text counts as empty, and
    empty texts are copies of one another. Of equal texts the smallest id stays; a null id loses to
    any other. Rows that repeat an id with the same text count in ``group_size`` and share one fate.
    Texts of any length are compared whole. An empty table gives an empty result; other columns, whatever their names, are ignored.
    """
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.sha2(normalised(text_col).cast("binary"), 256).alias("text_sha256"),
    )
    return rows.join(owners(docs, text_col, id_col), "text_sha256").select(
        F.col("doc_id").alias(id_col),
        "keep_id",
        "group_size",
        F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        "text_sha256",
    )
