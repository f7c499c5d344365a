"""Benchmark decontamination: exact search by rare words, then Smith-Waterman alignment.

Words are runs of ASCII letters, digits and bytes above 127, A-Z as a-z: case and punctuation
don't tell copies apart. A character of a script that sets no spaces between words (Chinese, Japanese,
Thai, Lao, Khmer, Burmese) is a word of its own. A copy is a passage that aligns with the item (match 2, mismatch -1, gap -1)
to a score of ``least`` times that of the whole item, 2 for each word, and of 2 ``n`` - 1 at
least; an item of fewer words than ``n`` must stand there word for word.

No such passage is missed. A score of ``need`` takes ``need`` / 2 matched words, so all but a few of
an item's words must stand in the passage; of any set of its words larger than those few by k, k stand
there. Each item is probed by such a set of its rarest words, and a place counts where k of them are
as near to each other as the longest passage allows. One pass counts the items' words in all documents;
the counts choose set and k by cost alone and never change a result. Each place is then bounded (2 for
each word the item has, -1 for any other, over the best stretch) and, if that suffices, aligned.

The items are a stated query set: they are collected and broadcast where their text is below
``item_bytes`` (checked), and in slices below it otherwise, one after another, against all
documents. Documents are never shuffled. Null or empty documents match nothing, nor do items
without a word; repeated items are items of their own, those with a null id too, repeated documents are searched each. Ids may be of any type that orders.
Extra columns are ignored, or kept by without_contaminated().
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from causeway.llm import arrays as A

MATCH, MISMATCH, GAP = 2, -1, -1
_WORD = np.full(256, 0x20, np.uint8)
_WORD[0x30:0x3A] = np.arange(0x30, 0x3A)
_WORD[0x61:0x7B] = np.arange(0x61, 0x7B)
_WORD[0x41:0x5B] = np.arange(0x61, 0x7B)
_WORD[0x80:] = np.arange(0x80, 0x100)
# fixed values: scripts without spaces between words, as ranges of characters
_WIDE = [(0x0E00, 0x0EFF), (0x1000, 0x109F), (0x1780, 0x17FF), (0x3005, 0x3007), (0x3040, 0x30FF), (0x3400, 0x9FFF), (0xF900, 0xFAFF), (0x20000, 0x3FFFF)]


def _alone(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begin and end of each character that is a word of its own, in UTF-8."""
    at = np.flatnonzero(data >= 0xE0)
    if not len(at):
        return at, at
    size = np.where(data[at] < 0xF0, 3, 4)
    code = data[at].astype(np.int64) & np.where(size == 3, 0x0F, 0x07)
    for k in (1, 2, 3):
        code = np.where(k < size, code << 6 | data[np.minimum(at + k, len(data) - 1)] & 0x3F, code)
    wide = np.zeros(len(at), bool)
    for low, high in _WIDE:
        wide |= (code >= low) & (code <= high)
    return at[wide], (at + size)[wide]


def _words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    data = _WORD[data]
    begins, ends, first = A.word_bounds(data, offsets)
    starts, stops = _alone(data)
    if len(starts):
        cut = np.union1d(starts, stops)
        begins = np.union1d(begins, cut[np.append(data, 0x20)[cut] != 0x20])
        ends = np.union1d(ends, cut[(cut > 0) & (data[cut - 1] != 0x20)])
        first = np.searchsorted(begins, offsets)
    return A.word_hashes(data, begins, ends), first


class Index:
    """The items' words. ``vocabulary``: sorted hashes of them; ``of``: which of these each word of the items is."""

    def __init__(self, ids: list, texts: list, n: int, least: float):
        self.ids = ids
        data, offsets = A.text_bytes(pa.chunked_array([pa.array(texts, pa.string())]))
        self.words, self.first = _words(data, offsets)
        self.vocabulary, self.of = np.unique(self.words, return_inverse=True)
        self.lengths = np.diff(self.first)
        self.need = np.maximum(np.ceil(MATCH * least * self.lengths - 1e-9), np.minimum(MATCH * n - 1, MATCH * self.lengths)).astype(np.int64)
        matched = -(-self.need // MATCH)
        self.span = 3 * self.lengths - self.need  # words of the longest passage with that score
        self.spare = self.lengths - matched  # so many words of the item may lack
        self.usable = (matched > 0) & (matched <= self.lengths)
        self._maybe = np.zeros(1 << 20, bool)  # most words end here, without a search
        self._maybe[(self.vocabulary >> np.uint64(44)).astype(np.int64)] = True

    def find(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Words and bounds of texts, and where which word of the vocabulary stands in them."""
        words, first = _words(data, offsets)
        at = np.flatnonzero(self._maybe[(words >> np.uint64(44)).astype(np.int64)])
        k = np.searchsorted(self.vocabulary, words[at])
        same = self.vocabulary[np.minimum(k, len(self.vocabulary) - 1)] == words[at] if len(self.vocabulary) else np.zeros(len(at), bool)
        return words, first, at[same], k[same]

    def choose(self, counts: np.ndarray) -> None:
        """Chooses each item's rare words and how many of them must meet, by the counts of the vocabulary."""
        share = (counts + 1) / (counts.sum() + 1)
        item, word = [], []
        self.meet = np.ones(len(self.ids), np.int64)
        for k in np.flatnonzero(self.usable):
            own, times = np.unique(self.of[self.first[k] : self.first[k + 1]], return_counts=True)
            order = np.argsort(share[own], kind="stable")
            own, times, best = own[order], np.cumsum(times[order]), None
            rate, chance = np.cumsum(share[own]), 1.0
            for j in range(1, self.lengths[k] - self.spare[k] + 1):
                size = int(np.searchsorted(times, self.spare[k] + j)) + 1
                seen = rate[size - 1]
                chance = 1.0 if j == 1 else min(1.0, chance * seen * self.span[k] / (j - 1))
                cost = seen * (1 + chance * self.span[k] * self.lengths[k] / 20)  # a cell of an alignment is about a twentieth of a hit
                if best is None or cost < best[0]:
                    best = cost, size, j
            item.append(np.full(best[1], k))
            word.append(own[: best[1]])
            self.meet[k] = best[2]
        item, word = (np.concatenate(v) if v else np.zeros(0, np.int64) for v in (item, word))
        order = np.argsort(word, kind="stable")
        self.probe_item, self.probe_at = item[order], np.searchsorted(word[order], np.arange(len(self.vocabulary) + 1))


def align(item: np.ndarray, passages: np.ndarray, valid: np.ndarray) -> np.ndarray:
    """The best local score of each passage (a row of word hashes, True where ``valid``) with the item."""
    best, above = np.zeros(len(passages), np.int32), np.zeros((len(passages), passages.shape[1] + 1), np.int32)
    ramp = np.arange(passages.shape[1] + 1, dtype=np.int32) * -GAP
    for word in item:
        step = above[:, :-1] + np.where((passages == word) & valid, MATCH, MISMATCH)
        here = np.zeros_like(above)
        here[:, 1:] = np.maximum(np.maximum(step, above[:, 1:] + GAP), 0)
        above = np.maximum.accumulate(here + ramp, axis=1) - ramp  # gaps along the passage
        best = np.maximum(best, above.max(axis=1))
    return best


def _places(index: Index, first: np.ndarray, at: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, ...]:
    """(text, item, start, end, number of meetings) of the passages that may hold a copy."""
    n = index.probe_at[word + 1] - index.probe_at[word]
    at, word, n = at[n > 0], word[n > 0], n[n > 0]
    item = index.probe_item[np.repeat(index.probe_at[word] - np.cumsum(n) + n, n) + np.arange(n.sum())]
    order = np.argsort(item, kind="stable")  # places ascend within an item
    item, where = item[order], np.repeat(at, n)[order]
    last = np.arange(len(item)) + index.meet[item] - 1
    inside = last < len(item)
    item_at, where_at, last = item[inside], where[inside], last[inside]
    near = (item[last] == item_at) & (where[last] - where_at < index.span[item_at])
    item, begin, end = item_at[near], where_at[near], where[last[near]]
    text = np.searchsorted(first, begin, "right") - 1
    same = end < first[text + 1]
    text, item, begin, end = text[same], item[same], begin[same], end[same]
    if not len(text):
        return (np.zeros(0, np.int64),) * 5
    start, end = np.maximum(end - index.span[item] + 1, first[text]), np.minimum(begin + index.span[item], first[text + 1])
    # overlapping passages of an item are one; both ends ascend within a text
    new = np.concatenate(([True], (text[1:] != text[:-1]) | (item[1:] != item[:-1]) | (start[1:] > end[:-1])))
    head = np.flatnonzero(new)
    tail = np.append(head[1:], len(new)) - 1
    return text[head], item[head], start[head], end[tail], tail - head + 1


def _matches(index: Index, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """(text, item, score, number of meetings of its rare words) for each pair whose score suffices."""
    words, first, at, word = index.find(data, offsets)
    text, item, start, end, seeds = _places(index, first, at, word)
    if not len(text):
        return (np.zeros(0, np.int64),) * 2 + (np.zeros(0), np.zeros(0, np.int64))
    known = np.full(len(words), len(index.vocabulary), np.int32)
    known[at] = word
    has = np.zeros(len(index.vocabulary) + 1, bool)
    score = np.zeros(len(text), np.int64)
    by = np.lexsort((end - start, item))
    s = 0
    while s < len(by):
        k, e = item[by[s]], s + 1
        while e < len(by) and item[by[e]] == k and (e + 1 - s) * (end[by[e]] - start[by[e]]) < 2_000_000:
            e += 1
        rows = by[s:e]
        width = int((end - start)[rows].max())
        grid = start[rows][:, None] + np.arange(width)
        inside = grid < end[rows][:, None]
        grid = np.minimum(grid, len(words) - 1)
        own = index.of[index.first[k] : index.first[k + 1]]
        has[own] = True
        sums = np.cumsum(np.where(has[known[grid]] & inside, MATCH, MISMATCH), axis=1, dtype=np.int32)
        has[own] = False
        lowest = np.minimum.accumulate(np.append(np.zeros((len(rows), 1), np.int32), sums[:, :-1], axis=1), axis=1)
        some = (sums - lowest).max(axis=1) >= index.need[k]
        if some.any():
            score[rows[some]] = align(index.words[index.first[k] : index.first[k + 1]], words[grid[some]], inside[some])
        s = e
    pair, of = np.unique(np.stack([text, item], 1), axis=0, return_inverse=True)
    best, total = np.zeros(len(pair), np.int64), np.bincount(of.ravel(), seeds, len(pair)).astype(np.int64)
    np.maximum.at(best, of.ravel(), score)
    good = best >= index.need[pair[:, 1]]
    return pair[good, 0], pair[good, 1], (best / (MATCH * index.lengths[pair[:, 1]]))[good], total[good]


def _slices(items: DataFrame, item_bytes: int) -> Iterator[tuple[list, list]]:
    """Items, collected: all if their text is small enough, slices of them otherwise."""
    items = items.where("text is not null").select("item_id", "text")
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    slices = max(1, -(-2 * total // item_bytes)) if total > item_bytes else 1
    for k in range(slices):
        part = items if slices == 1 else items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(slices)) == k)
        rows = sorted(((r.item_id, r.text) for r in part.collect()), key=lambda r: (r[0] is not None, *r))
        yield [r[0] for r in rows], [r[1] for r in rows]


def _prepared(docs: DataFrame, items: DataFrame, n: int, least: float, item_bytes: int) -> Iterator[Index]:
    A.small_batches(docs.sparkSession)
    for ids, texts in _slices(items, item_bytes):
        index = Index(ids, texts, n, least)
        held = docs.sparkSession.sparkContext.broadcast(index)

        def count(batches, held=held):
            total = np.zeros(len(held.value.vocabulary), np.int64)
            for batch in batches:
                for _, data, offsets in A.text_slices(batch):
                    total += np.bincount(held.value.find(data, offsets)[3], minlength=len(total))
            found = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(total[found])], ["word", "n"])

        counts = np.zeros(len(index.vocabulary), np.int64)
        found = docs.select("text").mapInArrow(count, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")).toArrow()  # as many as the items have words
        counts[found["word"].to_numpy()] = found["n"].to_numpy()
        index.choose(counts)
        yield index


def contaminated(docs: DataFrame, items: DataFrame, n: int = 3, least: float = 0.5, item_bytes: int = 32 << 20) -> DataFrame:
    """(doc_id, item_id, score, n_seeds) of each document and item of which it holds a copy, from a score of ``least`` on."""
    spark, out = docs.sparkSession, None
    of_item = items.schema["item_id"].dataType
    schema = T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType), T.StructField("item_id", of_item), T.StructField("score", T.DoubleType()), T.StructField("n_seeds", T.LongType())])
    kind = to_arrow_type(of_item)
    for index in _prepared(docs, items, n, least, item_bytes):
        held = spark.sparkContext.broadcast(index)

        def match(batches, held=held):
            for batch in batches:
                for rows, data, offsets in A.text_slices(batch):
                    text, item, score, seeds = _matches(held.value, data, offsets)
                    ids = pa.array([held.value.ids[k] for k in item.tolist()], kind)
                    yield pa.RecordBatch.from_arrays([rows["doc_id"].combine_chunks().take(pa.array(text, pa.int64())), ids, pa.array(score, pa.float64()), pa.array(seeds, pa.int64())], ["doc_id", "item_id", "score", "n_seeds"])

        found = docs.select("doc_id", "text").mapInArrow(match, schema)
        out = found if out is None else out.union(found)
    return out


def without_contaminated(docs: DataFrame, items: DataFrame, n: int = 3, least: float = 0.5, item_bytes: int = 32 << 20) -> DataFrame:
    """The rows of ``docs`` that hold no copy of an item."""
    schema = docs.schema
    for index in _prepared(docs, items, n, least, item_bytes):
        held = docs.sparkSession.sparkContext.broadcast(index)

        def clean(batches, held=held):
            for batch in batches:
                for rows, data, offsets in A.text_slices(batch):
                    keep = np.ones(len(rows), bool)
                    keep[_matches(held.value, data, offsets)[0]] = False
                    yield from rows.filter(pa.array(keep)).to_batches()

        docs = docs.mapInArrow(clean, schema)
    return docs
