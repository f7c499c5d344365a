"""Words, hashes and windows of many texts at once, as numpy arrays over one UTF-8 buffer.

Null texts count as empty. Words are maximal runs of bytes other than 0x20 and 0x09-0x0D,
so they never depend on the locale or on Unicode tables. Hashes are 64 bits wide.
"""

from __future__ import annotations

import ctypes
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32
_BYTES = np.array([0, *((1 << 8 * k) - 1 for k in range(1, 9))], np.uint64)
_LONG = 512
C1, C2, C3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
S27, S31, S32 = np.uint64(27), np.uint64(31), np.uint64(32)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection on 64 bits after which every bit depends on every other."""
    h = (h ^ (h >> S32)) * C2
    h = (h ^ (h >> S27)) * C3
    return h ^ (h >> S31)


try:
    _trim = ctypes.CDLL("libc.so.6").malloc_trim
except (OSError, AttributeError):  # another C library
    _trim = None


def release() -> None:
    """Gives the memory of freed arrays back to the system: workers live on, and an executor has several."""
    if _trim:
        _trim(0)


def small_batches(spark, rows: int = 1000) -> None:
    """From now on the session hands Python ``rows`` rows at a time at most: whole texts are long, and buffers on both sides are as large as a batch."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= rows:
        spark.conf.set(name, str(rows))


def column(name: str) -> Column:
    """The column of that very name, whatever its characters."""
    return F.col("`" + name.replace("`", "``") + "`")


def text_slices(table: pa.Table | pa.RecordBatch, column: str = "text", size: int = 4 << 20) -> Iterator[tuple[pa.Table, np.ndarray, np.ndarray]]:
    """Runs of rows with about ``size`` bytes of text (one row may be longer): rows, UTF-8 bytes, offsets of the texts."""
    if isinstance(table, pa.RecordBatch):
        table = pa.Table.from_batches([table])
    lengths = pc.fill_null(pc.binary_length(table[column]), 0).to_numpy().astype(np.int64)
    ends = np.cumsum(lengths)
    at = 0
    while at < len(lengths):
        done = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, done + size, "right")))
        rows = table.slice(at, to - at)
        data, offsets = text_bytes(rows[column])
        yield rows, data, offsets
        at = to


def text_bytes(column: pa.ChunkedArray | pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a column of strings, and where each of them begins and the last one ends."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    buffer = column.buffers()[2]
    data = np.frombuffer(buffer, np.uint8) if buffer is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def word_bounds(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Begin and end of each word, and for each text the index of its first word, then the number of all words."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    inside = ~_SPACE[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    begins, ends = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1] | edge[1:-1]
    ends[:-1] &= ~inside[1:] | edge[1:-1]
    begins, ends = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    return begins, ends, np.searchsorted(begins, offsets)


def word_hashes(data: np.ndarray, begins: np.ndarray, ends: np.ndarray, lower: bool = False) -> np.ndarray:
    """A hash of each word's bytes, A-Z as a-z if ``lower``; eight bytes at a time."""
    if not len(begins):
        return np.zeros(0, np.uint64)
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[:-8] = _LOWER[data] if lower else data
    eights = np.ndarray(len(data) + 1, "<u8", padded, strides=(1,))
    lengths = ends - begins
    h = lengths.astype(np.uint64) * C1
    rows: np.ndarray | slice = slice(None)
    short = np.minimum(lengths, _LONG)
    for k in range(0, int(short.max()), 8):
        if k:
            rows = np.flatnonzero(short > k)
        part = eights[begins[rows] + k] & _BYTES[np.minimum(short[rows] - k, 8)]
        h[rows] = mix(h[rows] ^ (part * C1))
    for w in np.flatnonzero(lengths > _LONG):
        h[w] = int.from_bytes(hashlib.blake2b(padded[begins[w] : ends[w]].tobytes(), digest_size=8).digest(), "little")
    return h


def run_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of every ``k`` consecutive words, the runs across two texts among them: one for each index from 0 to len - k."""
    if len(words) < k:
        return np.zeros(0, np.uint64)
    power, width, out, at = words, 1, None, 0
    while True:
        if k & width:
            part = power[at : at + len(words) - k + 1]
            out = part if out is None else mix(out * C1 + part)
            at += width
        if at == k:
            return out if k > 1 else out.copy()
        power = mix(power[:-width] * C2 + power[width:])
        width *= 2


def run_starts(first: np.ndarray, k: int) -> np.ndarray:
    """True at each index of a word where ``k`` words of the same text begin; as long as run_hashes()."""
    total = int(first[-1])
    if total < k:
        return np.zeros(0, bool)
    inside = np.ones(total + 1, bool)
    for back in range(1, k):  # the last k - 1 words of a text begin no run
        inside[np.maximum(first[1:] - back, first[:-1])[first[1:] > first[:-1]]] = False
    return inside[: total - k + 1]


def owners(first: np.ndarray) -> np.ndarray:
    """The index of its text, for each word."""
    return np.repeat(np.arange(len(first) - 1), np.diff(first))
