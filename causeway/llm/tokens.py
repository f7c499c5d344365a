"""Token ids of whole texts by a public tokenizer file, with one look-up for each word met before.

Both supported pre-tokenizers begin a new piece at single white space between two other
characters, and between a letter or digit and another printing ASCII character than the
apostrophe; no merge crosses a piece, so the ids of a text are those of its chunks one after
another. Each worker keeps the ids of chunks that the tokenizers library gave, by hash. Where white
space counts, texts with more of it than single spaces and line breaks go to the library whole.
"""

from __future__ import annotations

import os
from operator import itemgetter

import numpy as np

from causeway.llm import arrays as A

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
_loaded: dict[str, Encoder] = {}
_STEP = 4 << 20


_OTHER, _LETTER, _SIGN = 0, 1, 2
_CLASS = np.zeros(256, np.uint8)
_CLASS[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B)]] = _LETTER
_CLASS[[*range(0x21, 0x27), *range(0x28, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x7F)]] = _SIGN


def _edges(data: np.ndarray) -> np.ndarray:
    """Where a letter or digit and a sign meet. Of the letters beyond ASCII only U+00C0 to U+00FF count; all else meets nothing."""
    kind = _CLASS[data]
    lead = np.flatnonzero(data[:-1] == 0xC3)
    lead = lead[(data[lead + 1] != 0x97) & (data[lead + 1] != 0xB7)]
    kind[lead], kind[lead + 1] = _LETTER, _LETTER
    return np.flatnonzero((kind[:-1] | kind[1:]) == (_LETTER | _SIGN)) + 1


def _uneven(data: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Which texts have white space other than single spaces and line breaks between other characters, or a zero byte."""
    gap = (data == 0x20) | (data == 0x0A)
    bad = (data == 0) | (data == 0x09) | ((data >= 0x0B) & (data <= 0x0D)) | ((data >= 0x1C) & (data <= 0x1F))
    bad[1:] |= gap[1:] & gap[:-1]
    some = first[:-1] < first[1:]
    bad[first[:-1][some]] |= gap[first[:-1][some]]
    bad[first[1:][some] - 1] |= gap[first[1:][some] - 1]
    # fixed values: white space beyond ASCII, as UTF-8
    lead = np.flatnonzero(data >= 0xC2)
    two, three = lead + 1 < len(data), lead + 2 < len(data)
    a, b, c = data[lead], np.where(two, data[np.minimum(lead + 1, len(data) - 1)], 0), np.where(three, data[np.minimum(lead + 2, len(data) - 1)], 0)
    wide = (a == 0xC2) & ((b == 0x85) | (b == 0xA0)) | (a == 0xE1) & (b == 0x9A) & (c == 0x80) | (a == 0xE2) & (b == 0x81) & (c == 0x9F) | (a == 0xE3) & (b == 0x80) & (c == 0x80)
    wide |= (a == 0xE2) & (b == 0x80) & ((c <= 0x8A) | (c == 0xA8) | (c == 0xA9) | (c == 0xAF))
    bad[lead[wide]] = True
    return np.diff(np.concatenate(([0], np.cumsum(bad)))[first]) > 0


class Encoder:
    """Encodes texts with the tokenizer in ``path``. Beyond ``most`` chunks only those met again are kept.

    Chunks are looked up by 64-bit hashes of their bytes, all different chunks of some texts at once.
    """

    def __init__(self, path: str, most: int = 800_000):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.most = most
        # a word tokenizer drops white space, so that a chunk's ids don't depend on what stands before it
        self.drops_space = not len(self._whole(" \n"))
        # chunks by ascending hash, and where the ids of each are
        self.hash, self.flat = np.zeros(0, np.uint64), np.zeros(0, np.uint32)
        self.starts, self.lengths, self.met = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)

    def _whole(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)

    def _thin(self) -> None:
        keep = self.met > 1
        if keep.mean() > 0.5:
            keep = self.met > np.median(self.met)
        n = self.lengths[keep]
        ends = np.cumsum(n)
        self.flat = self.flat[np.repeat(self.starts[keep] - ends + n, n) + np.arange(ends[-1] if len(ends) else 0)]
        self.hash, self.starts, self.lengths, self.met = self.hash[keep], ends - n, n, np.zeros(len(n), np.int32)

    def _learn(self, hashes: np.ndarray, chunks: list[bytes], kinds: list[int]) -> None:
        """Encodes new chunks (by ascending hash) as one text; a token belongs to the chunk that its first character lies in."""
        if self.drops_space:
            texts = [f"{c.decode()} " for c in chunks]
        else:  # kind 0: nothing before it, 1: a space, 2: it begins with its line break
            texts = [c.decode() if k == 2 else f"{' ' if k else chr(10)}{c.decode()}" for c, k in zip(chunks, kinds, strict=True)]
        found = self.tokenizer.encode("".join(texts), add_special_tokens=False)
        begins = np.cumsum([0, *map(len, texts)])
        first = np.fromiter(map(itemgetter(0), found.offsets), np.int64, len(found.ids))
        n = np.bincount(np.searchsorted(begins, first, "right") - 1, minlength=len(texts))[: len(texts)]
        starts = len(self.flat) + np.cumsum(n) - n
        if not self.drops_space:  # a chunk with nothing before it was given a line break, one token
            bare = np.array(kinds) == 0
            starts, n = starts + bare, n - bare
        self.flat = np.append(self.flat, np.array(found.ids, np.uint32))
        at = np.searchsorted(self.hash, hashes)
        self.hash, self.starts, self.lengths, self.met = (np.insert(a, at, b) for a, b in ((self.hash, hashes), (self.starts, starts), (self.lengths, n), (self.met, 0)))

    def _cut(self, data: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Begin, end and kind of the chunks of texts."""
        some = first[:-1][first[:-1] < first[1:]]
        edge = np.zeros(len(data) + 1, bool)
        edge[_edges(data)] = True
        edge[some] = True
        if self.drops_space:
            inside = ~((data == 0x20) | ((data >= 0x09) & (data <= 0x0D)))
            start, stop = inside.copy(), inside.copy()
            start[1:] &= ~inside[:-1] | edge[1:-1]
            stop[:-1] &= ~inside[1:] | edge[1:-1]
            begins = np.flatnonzero(start)
            return begins, np.flatnonzero(stop) + 1, np.zeros(len(begins), np.int64)
        space, line = data == 0x20, data == 0x0A
        start = edge[:-1] | line
        start[1:] |= space[:-1]
        start &= ~space
        begins = np.flatnonzero(start)
        ends = np.append(begins[1:], len(data))
        ends = ends - space[np.maximum(ends - 1, 0)]
        kind = np.where(line[begins], 2, np.where(space[np.maximum(begins - 1, 0)] & (begins > 0), 1, 0))
        return begins, ends, np.where(np.isin(begins, some), np.where(line[begins], 2, 0), kind)

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        """The ids of each text; a null text has those of an empty one."""
        out: list[np.ndarray] = []
        raw = [(t or "").encode() for t in texts]
        ends = np.cumsum([len(r) for r in raw])
        at = 0
        while at < len(raw):  # a few MB at a time
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + _STEP, "right")))
            out += self._some(texts[at:to], raw[at:to])
            at = to
        return out

    def _some(self, texts: list[str | None], raw: list[bytes]) -> list[np.ndarray]:
        data = np.frombuffer(b"".join(raw), np.uint8)
        if not len(data):
            return [np.zeros(0, np.uint32) for _ in raw]
        first = np.concatenate(([0], np.cumsum([len(r) for r in raw])))
        whole = np.zeros(len(raw), bool) if self.drops_space else _uneven(data, first)
        if whole.any():
            data = np.frombuffer(b"".join(r for r, w in zip(raw, whole.tolist(), strict=True) if not w), np.uint8)
            first = np.concatenate(([0], np.cumsum(np.where(whole, 0, np.diff(first)))))
        if not len(data):
            return [self._whole(t) for t in texts]
        if len(self.hash) > self.most:
            self._thin()
        begins, stops, kind = self._cut(data, first)
        hashes = A.mix(A.word_hashes(data, begins, stops, lower=self.drops_space) + kind.astype(np.uint64) * A.C3)
        unique, one, of = np.unique(hashes, return_index=True, return_inverse=True)
        slot = np.searchsorted(self.hash, unique)
        new = np.ones(len(unique), bool)
        new[slot < len(self.hash)] = self.hash[slot[slot < len(self.hash)]] != unique[slot < len(self.hash)]
        if new.any():
            text, fresh = data.tobytes(), one[new]
            chunks = [text[a:b] for a, b in zip(begins[fresh].tolist(), stops[fresh].tolist(), strict=True)]
            self._learn(unique[new], [c.lower() for c in chunks] if self.drops_space else chunks, kind[fresh].tolist())
            slot = np.searchsorted(self.hash, unique)
        self.met[slot] += np.bincount(of, minlength=len(unique)).astype(np.int32)
        where = slot[of]
        starts, n = self.starts[where], self.lengths[where]
        ends = np.cumsum(n)
        ids = self.flat[np.repeat(starts - ends + n, n) + np.arange(ends[-1] if len(ends) else 0)]
        cut = np.concatenate(([0], ends))[np.searchsorted(begins, first)].tolist()
        return [self._whole(texts[k]) if w else ids[cut[k] : cut[k + 1]] for k, w in enumerate(whole.tolist())]


def encoder(path: str) -> Encoder:
    """The encoder of this worker for a file."""
    if path not in _loaded:
        _loaded[path] = Encoder(path)
    return _loaded[path]
