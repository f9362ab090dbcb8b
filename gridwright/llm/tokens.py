"""Token ids of whole texts by a public tokenizer's file, many words at a time.

White space is never part of a token and merges end with the word, so the ids of a text are those of
its words in a row. For texts of ASCII and Latin-1 letters the tokenizer's normaliser and splitting
rule are applied to the bytes of many texts at once in NumPy; each distinct word of a slice is looked
up once in a bounded cache, and new words go through the tokenizer's own merges together. A text
with any other character goes through the whole tokenizer. Words are named by 64-bit hashes.
"""

from __future__ import annotations

import json
import os

import numpy as np
import pyarrow as pa

from .text import prefix_hash, range_hash, slices, utf8

#: Words that a Python worker keeps at most; then it starts afresh.
CACHED = 400_000
_SPACE, _LETTER, _NUMBER, _OTHER = range(4)


def _kinds() -> np.ndarray:
    kind = np.full(256, _OTHER, dtype=np.uint8)
    kind[[9, 10, 11, 12, 13, 32]] = _SPACE
    kind[[*range(65, 91), *range(97, 123), *range(128, 256)]] = _LETTER
    kind[48:58] = _NUMBER
    return kind


_KIND = _kinds()
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def _small(raw: np.ndarray) -> np.ndarray:
    """Lower case of ASCII and of the Latin-1 letters, whose UTF-8 form keeps its length."""
    out = _LOWER[raw]
    second = np.flatnonzero((raw[:-1] == 0xC3) & (raw[1:] >= 0x80) & (raw[1:] <= 0x9E)) + 1
    out[second] += 32
    return out


def _other_rows(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Texts with characters beyond ASCII and Latin-1 letters."""
    follows = np.append(raw[1:], 0).astype(np.uint8)
    bad = (raw >= 0xC4) | (raw == 0xC2) | ((raw == 0xC3) & ((follows == 0x97) | (follows == 0xB7)))
    out = np.zeros(len(offsets) - 1, dtype=bool)
    out[np.searchsorted(offsets, np.flatnonzero(bad), side="right") - 1] = True
    return out


def pieces(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start, stop) of the tokenizer's words in lower-case bytes: contractions, runs of letters, single digits, runs of the rest."""
    kind = _KIND[raw]
    start = np.ones(len(raw), dtype=bool)
    start[1:] = (kind[1:] != kind[:-1]) | (kind[1:] == _NUMBER)
    edges = offsets[:-1][np.diff(offsets) > 0]
    start[edges] = True
    # a quote that begins a word and is followed by s, t, m, d, re, ve or ll is a word with them
    quote = np.flatnonzero((raw == 39) & start)
    if len(quote):
        end = offsets[np.searchsorted(offsets, quote, side="right")]
        wide = np.concatenate([raw, np.zeros(3, np.uint8)])
        a, b = wide[quote + 1], wide[quote + 2]
        two = np.isin(a, np.frombuffer(b"stmd", np.uint8)) & (quote + 2 <= end)
        three = (((np.isin(a, np.frombuffer(b"rv", np.uint8))) & (b == 101)) | ((a == 108) & (b == 108))) & (quote + 3 <= end) & ~two
        for at, n in ((quote[two], 2), (quote[three], 3)):
            start[at + 1] = False
            after = at + n
            after = after[after < len(raw)]
            start[after] = True
    body = kind != _SPACE
    last = np.ones(len(raw), dtype=bool)
    last[:-1] = start[1:]
    return np.flatnonzero(start & body), np.flatnonzero(last & body) + 1


class Encoder:
    """ids(column): (all ids in a row, number of ids of each text)."""

    def __init__(self, vocabulary: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import public_tokenizers
        from tokenizers import Tokenizer

        path = public_tokenizers.path(vocabulary)
        self.whole = Tokenizer.from_file(path)
        self.whole.encode_special_tokens = True
        with open(path) as f:
            plan = json.load(f)
        plan |= {"normalizer": None, "pre_tokenizer": {"type": "WhitespaceSplit"}, "added_tokens": []}
        self.model = Tokenizer.from_str(json.dumps(plan))
        names = self.model.get_vocab()
        self.ends = np.zeros(max(names.values()) + 1, dtype=bool)
        self.ends[[i for w, i in names.items() if w.endswith("</w>")]] = True
        kept = [*range(33, 127), *range(161, 173), *range(174, 256)]
        moved = [b for b in range(256) if b not in set(kept)]
        self.letters = {b: chr(b) for b in kept} | {b: chr(256 + i) for i, b in enumerate(moved)}
        self._forget()

    def _forget(self) -> None:
        self.known: dict[int, int] = {}
        self.pool, self.at, self.size = [np.zeros(0, np.uint16)], np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.length = 0

    def _learn(self, names: list[int], words: list[bytes]) -> None:
        line = " ".join([w.decode("latin-1").translate(self.letters) for w in words])
        ids = np.array(self.model.encode_batch_fast([line], add_special_tokens=False)[0].ids, dtype=np.uint16)
        stop = np.flatnonzero(self.ends[ids]) + 1
        if len(stop) != len(words):
            raise ValueError("the vocabulary does not mark the ends of words")
        size = np.diff(stop, prepend=0)
        self.known.update(zip(names, range(len(self.known), len(self.known) + len(words)), strict=True))
        self.at = np.concatenate([self.at, self.length + stop - size])
        self.size = np.concatenate([self.size, size])
        self.pool = [np.concatenate([*self.pool, ids])]
        self.length += len(ids)

    def _slice(self, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        raw = _small(raw)
        start, stop = pieces(raw, offsets)
        if len(self.known) > CACHED:
            self._forget()
        name, first, where = np.unique(range_hash(prefix_hash(raw), start, stop), return_index=True, return_inverse=True)
        names = name.tolist()
        new = [i for i, x in enumerate(names) if x not in self.known]
        if new:
            data = raw.tobytes()
            self._learn([names[i] for i in new], [data[a:b] for a, b in zip(start[first[new]].tolist(), stop[first[new]].tolist(), strict=True)])
        index = np.fromiter(map(self.known.__getitem__, names), dtype=np.int64, count=len(names))[where]
        size = self.size[index]
        before = np.cumsum(size) - size
        ids = self.pool[0][np.repeat(self.at[index] - before, size) + np.arange(int(size.sum()))]
        text = np.searchsorted(offsets, start, side="right") - 1
        return ids, np.bincount(text, weights=size, minlength=len(offsets) - 1).astype(np.int64)

    def ids(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """column: strings; null counts as empty."""
        raw, offsets = utf8(column)
        parts, counts = [], []
        for lo, hi in slices(offsets):
            part, own = raw[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
            other = _other_rows(part, own)
            if not other.any():
                ids, n = self._slice(part, own)
                parts.append(ids)
                counts.append(n)
                continue
            for i in range(hi - lo):
                text = part[own[i] : own[i + 1]]
                if other[i]:
                    ids = np.array(self.whole.encode(text.tobytes().decode(), add_special_tokens=False).ids, dtype=np.uint16)
                else:
                    ids, _ = self._slice(text, np.array([0, len(text)]))
                parts.append(ids)
                counts.append(np.array([len(ids)]))
        return np.concatenate(parts) if parts else np.zeros(0, np.uint16), np.concatenate(counts) if counts else np.zeros(0, np.int64)
