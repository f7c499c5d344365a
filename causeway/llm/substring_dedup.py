"""Substring deduplication by fixed-block anchors.

Every word that lies in a run of ``window`` words which begins at another place too (of any
text, the same one included) is removed; all occurrences go. Judged on the input.

The index holds non-overlapping blocks of ``(window + 1) // 2`` words of each text: any run
of ``window`` words contains one of them whole. All rolling windows of that size probe the
index. A run is a candidate if its own block was met at another place; candidates are then
extended to ``window`` words and compared by 64-bit hashes of the whole run, so that overlapping ones give the maximal repeats.

Texts are dealt into groups of a few MB by a hash of id, text and input partition. A group sends each bucket of
hashes one packed list without its own repeats (so a passage in a third of all texts costs
a bucket one entry per group), and gets back one bit for each entry. Nothing is collected; a text
that very many rows repeat, id and all, is in one group for each input partition.

Null texts count as empty; texts shorter than the window keep all words. Null or repeated ids
are ordinary rows. Kept words are joined by one space. Extra columns are passed through whatever their names; those
called n_words or n_removed give way to the operator's.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from causeway.llm import arrays as A

_LOW = np.uint64((1 << 38) - 1)
_MULTI, _BLOCK = np.uint64(1 << 38), np.uint64(1 << 39)
_LISTS = "bucket int, grp int, size int, data binary"


class _Group:
    """The words of one group's texts, in an order that does not depend on how rows arrived."""

    def __init__(self, table: pa.Table, window: int, buckets: int):
        order = pc.sort_indices(table, sort_keys=[("doc_id", "ascending"), ("text", "ascending")])
        self.table = table.take(order)
        self.window, self.block, self.buckets = window, (window + 1) // 2, buckets
        self.data, self.offsets = A.text_bytes(self.table["text"])
        self.begins, self.ends, self.first = A.word_bounds(self.data, self.offsets)
        self.words = A.word_hashes(self.data, self.begins, self.ends)

    def anchors(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of all rolling windows: the keys without repeats, each window's key, its place, whether it is a block of the index."""
        hashes = A.run_hashes(self.words, self.block)
        at = np.flatnonzero(A.run_starts(self.first, self.block))
        hashes = hashes[at]
        keys = (hashes >> A.S32) % np.uint64(self.buckets) << np.uint64(38) | A.mix(hashes) & _LOW
        keys, of = np.unique(keys, return_inverse=True)
        begin = self.first[np.searchsorted(self.first, at, "right") - 1]
        return keys, of, at, (at - begin) % self.block == 0

    def candidates(self, keys: np.ndarray, of: np.ndarray, at: np.ndarray, met: np.ndarray) -> np.ndarray:
        """True for each run of ``window`` words whose own block was met elsewhere."""
        there = np.zeros(int(self.first[-1]) + 1, bool)
        there[at] = met[of]
        starts = np.flatnonzero(A.run_starts(self.first, self.window))
        begin = self.first[np.searchsorted(self.first, starts, "right") - 1]
        own = begin + -(-(starts - begin) // self.block) * self.block
        out = np.zeros(max(0, int(self.first[-1]) - self.window + 1), bool)
        out[starts] = there[own]
        return out

    def runs(self, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The hashes of chosen runs without repeats, ordered by bucket, and which of them each run has."""
        hashes, of = np.unique(A.run_hashes(self.words, self.window)[chosen], return_inverse=True)
        order = np.argsort(hashes % np.uint64(self.buckets), kind="stable")
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        return hashes[order], place[of]


def _cut(buckets: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """Each bucket, and where its entries begin and end."""
    if len(buckets):
        starts = np.flatnonzero(np.concatenate(([True], buckets[1:] != buckets[:-1])))
        yield from zip(buckets[starts].tolist(), starts.tolist(), [*starts[1:].tolist(), len(buckets)], strict=True)


def _rows(rows: list[tuple]) -> pa.Table:
    bucket, grp, size, data = zip(*rows, strict=True) if rows else ((),) * 4
    return pa.table({"bucket": pa.array(bucket, pa.int32()), "grp": pa.array(grp, pa.int32()), "size": pa.array(size, pa.int32()), "data": pa.array(data, pa.binary())})


def _bits(table: pa.Table, total: int, buckets: np.ndarray) -> np.ndarray:
    """The answers that a group got, in the order of the entries it sent."""
    got = {b: (n, d) for b, n, d in zip(table["bucket"].to_pylist(), table["size"].to_pylist(), table["data"].to_pylist(), strict=True)}
    out = np.zeros(total, bool)
    for b, start, end in _cut(buckets):
        out[start:end] = np.unpackbits(np.frombuffer(got[b][1], np.uint8), count=got[b][0]).astype(bool)
    return out


def remove_repeats(docs: DataFrame, window: int = 35, group_bytes: int = 4 << 20) -> DataFrame:
    """``docs`` with the kept words as text, and n_words and n_removed; ``group_bytes`` of text are held in memory at a time."""
    if window < 2:
        raise ValueError("window must be 2 words at least")
    spark = docs.sparkSession
    docs = docs.drop("n_words", "n_removed")
    A.small_batches(spark)
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // group_bytes))
    # the same columns for each use, so that all read one exchange; the others travel packed, their names can't clash
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    packed = F.struct(*(A.column(c) for c in others)) if others else F.lit(None).cast("int")
    dealt = docs.select("doc_id", "text", packed.alias("others"), F.pmod(F.xxhash64("doc_id", "text", F.spark_partition_id()), F.lit(n)).cast("int").alias("grp"))

    def probe(key, table):
        g = _Group(table, window, n)
        keys, of, _, block = g.anchors()
        flags = np.where(np.bincount(of, minlength=len(keys)) > 1, _MULTI, np.uint64(0))
        flags[of[block]] |= _BLOCK
        low = ((keys & _LOW) | flags).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5]
        return _rows([(b, key[0].as_py(), e - s, low[s:e].tobytes()) for b, s, e in _cut(keys >> np.uint64(38))])

    def meet(table):
        sizes = np.array(table["size"].to_pylist(), np.int64)
        flat = np.zeros((sizes.sum(), 8), np.uint8)
        flat[:, :5] = np.frombuffer(b"".join(table["data"].to_pylist()), np.uint8).reshape(-1, 5)
        entries = flat.view("<u8").ravel()
        _, of, count = np.unique(entries & _LOW, return_inverse=True, return_counts=True)
        block, multi = np.zeros(len(count), bool), count > 1
        block[of[(entries & _BLOCK) > 0]] = True
        multi[of[(entries & _MULTI) > 0]] = True
        return _answers(table, sizes, (block & multi)[of])

    def extend(key, table, answers):
        g = _Group(table, window, n)
        keys, of, at, _ = g.anchors()
        chosen = g.candidates(keys, of, at, _bits(answers, len(keys), keys >> np.uint64(38)))
        hashes, of = g.runs(chosen)
        multi = np.bincount(of, minlength=len(hashes)) > 1
        rows = [(b, key[0].as_py(), e - s, hashes[s:e].astype("<u8").tobytes() + np.packbits(multi[s:e]).tobytes()) for b, s, e in _cut(hashes % np.uint64(n))]
        return _rows([*rows, (-1 - key[0].as_py(), key[0].as_py(), len(chosen), np.packbits(chosen).tobytes())])

    def compare(key, table):
        if key[0].as_py() < 0:
            return table
        sizes, data = np.array(table["size"].to_pylist(), np.int64), table["data"].to_pylist()
        hashes = np.concatenate([np.frombuffer(d, "<u8", k) for d, k in zip(data, sizes.tolist(), strict=True)])
        own = np.concatenate([np.unpackbits(np.frombuffer(d, np.uint8, offset=8 * k), count=k) for d, k in zip(data, sizes.tolist(), strict=True)])
        _, of, count = np.unique(hashes, return_inverse=True, return_counts=True)
        multi = count > 1
        multi[of[own > 0]] = True
        return _answers(table, sizes, multi[of])

    def remove(key, table, answers):
        g = _Group(table, window, n)
        own = np.array(answers["bucket"].to_pylist(), np.int64) < 0
        mask = answers.filter(pa.array(own))
        chosen = np.unpackbits(np.frombuffer(mask["data"][0].as_py(), np.uint8), count=mask["size"][0].as_py()).astype(bool)
        hashes, of = g.runs(chosen)
        again = _bits(answers.filter(pa.array(~own)), len(hashes), hashes % np.uint64(n))
        starts = np.flatnonzero(chosen)[again[of]]
        depth = np.zeros(int(g.first[-1]) + window + 1, np.int32)
        depth[starts] += 1
        depth[starts + window] -= 1
        gone = np.cumsum(depth)[: int(g.first[-1])] > 0
        out = _kept(g, gone).select(["doc_id", "text", "others", "n_words", "n_removed"])
        del g, depth, gone, of, hashes
        A.release()
        return out

    probes = dealt.groupBy("grp").applyInArrow(probe, _LISTS)
    met = probes.groupBy("bucket").applyInArrow(meet, _LISTS)
    runs = dealt.groupBy("grp").cogroup(met.groupBy("grp")).applyInArrow(extend, _LISTS)
    again = runs.groupBy("bucket").applyInArrow(compare, _LISTS)
    schema = T.StructType([*dealt.drop("grp").schema.fields, T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType())])
    out = dealt.groupBy("grp").cogroup(again.groupBy("grp")).applyInArrow(remove, schema)
    return out.select(*(F.col(c) if c in ("doc_id", "text") else F.col("others").getField(c).alias(c) for c in docs.columns), "n_words", "n_removed")


def _answers(table: pa.Table, sizes: np.ndarray, bits: np.ndarray) -> pa.Table:
    ends = np.cumsum(sizes).tolist()
    data = [np.packbits(bits[e - k : e]).tobytes() for e, k in zip(ends, sizes.tolist(), strict=True)]
    return table.set_column(table.schema.get_field_index("data"), "data", pa.array(data, pa.binary()))


def _kept(g: _Group, gone: np.ndarray) -> pa.Table:
    """The group's rows with what is left of the texts, each word but the last followed by one space."""
    data, keep = g.data.copy(), np.flatnonzero(~gone)
    edge = np.zeros(len(data) + 1, np.int8)
    edge[g.begins[keep]] += 1
    np.subtract.at(edge, g.ends[keep], 1)
    mask = np.cumsum(edge[:-1], dtype=np.int8) > 0
    owner = np.searchsorted(g.first, keep, "right") - 1
    follows = np.flatnonzero(owner[1:] == owner[:-1])
    space = g.ends[keep[follows]]
    data[space], mask[space] = 0x20, True
    before = np.concatenate(([0], np.cumsum(mask, dtype=np.int64)))
    offsets = before[g.offsets].astype(np.int32)
    text = pa.StringArray.from_buffers(len(offsets) - 1, pa.py_buffer(offsets.tobytes()), pa.py_buffer(data[mask].tobytes()))
    lost = np.concatenate(([0], np.cumsum(gone)))
    out = g.table.set_column(g.table.schema.get_field_index("text"), "text", text)
    out = out.append_column("n_words", pa.array(np.diff(g.first), pa.int64()))
    return out.append_column("n_removed", pa.array(np.diff(lost[g.first]), pa.int64()))
