"""Sum-of-squares online packing of token sequences into fixed windows.

Each document's ids (and an end id) come as whole windows, which are full at once, and one rest.
A rest goes to the fill level that minimises the sum, over all levels, of the squared number
of partly filled windows of that level; a level array holds these numbers. Each task packs what it
reads in one pass and holds only its partly filled windows. At its end the emptiest of them are
cut up to fill the fullest, so that one window per task stays partly filled at most, and what
that holds is dealt into windows of powers of two, which need no padding.

Null texts count as empty: such a document is its end id alone. Repeated rows are packed each.
An empty table gives no rows. Windows are numbered by task and order, without a shuffle.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from causeway.llm import arrays as A
from causeway.llm.tokens import encoder

PIECES = "start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


class Windows:
    """Partly filled windows by level. A piece is (document, start, ids)."""

    def __init__(self, size: int):
        self.size = size
        self.count = np.zeros(size + 1, np.int64)
        self.at: list[list[list]] = [[] for _ in range(size + 1)]

    def level(self, length: int) -> int:
        """The level that a piece goes to: 0 for a new window; the fullest of equally good ones."""
        levels = np.arange(self.size - length + 1)
        count = self.count[: self.size - length + 1]
        to = self.count[levels + length]
        gain = np.where(levels > 0, 1 - 2 * count, 0) + np.where(levels + length < self.size, 1 + 2 * to, 0)
        gain = np.where((count > 0) | (levels == 0), gain, np.iinfo(np.int64).max)
        return int(levels[len(gain) - 1 - np.argmin(gain[::-1])])

    def put(self, piece: tuple) -> list | None:
        """The window that the piece fills, if it does."""
        length = len(piece[2])
        level = self.level(length)
        window = [*self.at[level].pop(), piece] if level else [piece]
        self.count[level] -= level > 0
        if level + length == self.size:
            return window
        self.at[level + length].append(window)
        self.count[level + length] += 1
        return None

    def close(self) -> Iterator[list]:
        """All windows that are left, the emptiest cut up to fill the fullest, and the last by powers of two."""
        open_ = [w for level in self.at for w in level]  # emptiest first
        spare: list[tuple] = []
        while open_ or spare:
            if not open_:
                rest, spare = spare[::-1], []
                left = sum(len(p[2]) for p in rest)
                while left:
                    want = min(self.size, 1 << left.bit_length() - 1)
                    yield _take(rest, want)
                    left -= want
                return
            window = open_.pop()
            want = self.size - sum(len(p[2]) for p in window)
            while want and (spare or open_):
                if not spare:
                    spare = open_.pop(0)[::-1]
                got = _take(spare, min(want, sum(len(p[2]) for p in spare)))
                window += got
                want -= sum(len(p[2]) for p in got)
            if want:
                spare = window[::-1]
            else:
                yield window


def _take(pieces: list[tuple], n: int) -> list[tuple]:
    """``n`` ids from the end of a list of pieces, cutting the last of them."""
    out = []
    while n:
        doc, start, ids = pieces.pop()
        out.append((doc, start, ids[:n]))
        if len(ids) > n:
            pieces.append((doc, start + n, ids[n:]))
        n -= len(out[-1][2])
    return out


def _pack(batches: Iterator[pa.RecordBatch], path: str, end_id: int, size: int, with_ids: bool) -> Iterator[pa.RecordBatch]:
    context = TaskContext.get()
    sequence = (context.partitionId() if context else 0) << 36
    encode, windows, rows = encoder(path).encode, Windows(size), []

    def placed(window: list[tuple]) -> None:
        nonlocal sequence
        offset = 0
        for (doc_id, tokens), start, ids in window:
            rows.append((doc_id, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), tokens, sequence, offset, ids if with_ids else None))
            offset += len(ids)
        sequence += 1

    def batch() -> pa.RecordBatch:
        columns = list(zip(*rows, strict=True)) if rows else [()] * 8
        arrays = [pa.array(columns[0], kind), *(pa.array(c, pa.int64()) for c in columns[1:7])]
        arrays += [pa.array(columns[7], pa.list_(pa.int64()))] * with_ids
        rows.clear()
        return pa.RecordBatch.from_arrays(arrays, [*(x.split()[0] for x in f"doc_id long, {PIECES}".split(", ")), *["ids"] * with_ids])

    kind = pa.int64()
    for part in batches:
        kind = part["doc_id"].type
        for at in range(0, len(part), 256):
            few = part.slice(at, 256)
            for doc_id, ids in zip(few["doc_id"].to_pylist(), encode(few["text"].to_pylist()), strict=True):
                ids = np.append(ids, np.uint32(end_id))
                doc = doc_id, len(ids)
                for start in range(0, len(ids), size):
                    piece = doc, start, ids[start : start + size]
                    window = [piece] if len(piece[2]) == size else windows.put(piece)
                    if window:
                        placed(window)
            if len(rows) > 20_000 or with_ids and rows:
                yield batch()
    for window in windows.close():
        placed(window)
    yield batch()


def pack(docs: DataFrame, tokenizer: str, end_id: int = 1, size: int = 2048, with_ids: bool = False) -> DataFrame:
    """A row for each piece of each document of ``docs`` (doc_id, text): where it begins, and where in which window it stands.

    ``with_ids`` adds the ids themselves. Windows are padded to ``size`` by their reader, save those of a power of two.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    A.small_batches(docs.sparkSession)
    schema = f"doc_id {kind}, {PIECES}" + ", ids array<long>" * with_ids
    return docs.select("doc_id", "text").mapInArrow(lambda it: _pack(it, tokenizer, end_id, size, with_ids), schema)
