"""Token ids of whole texts with a byte-level BPE of the tokenizers library, each distinct word encoded once.

The vocabulary's splitting pattern always ends a piece before a space that stands between two
non-space characters, and pieces are encoded on their own. So a text is cut before such spaces,
and a unit's ids are kept for the next time it comes. Texts in which a space touches other white
space or an end go to the library whole. The ids are those of one call over the whole text.
"""

from __future__ import annotations

import os
from collections import defaultdict
from itertools import count, islice

import numpy as np

_WHITE = [c for c in map(chr, range(0x3001)) if c.isspace() and c != " "]


def odd(text: str) -> bool:
    """Whether a space touches other white space or an end."""
    return text[:1] == " " or text[-1:] == " " or "  " in text or any(w in text and (f" {w}" in text or f"{w} " in text) for w in _WHITE)


class Encoder:
    """encode(texts) gives each text's ids. Once more than `most` units are remembered, those that came once are forgotten, and the rarest of the others down to half of `most`."""

    def __init__(self, path: str, most: int = 700_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.most = most
        vocab = self.tok.get_vocab(with_added_tokens=True)
        self.top = max(vocab.values())
        self.bytes_of = np.zeros(self.top + 1, np.int64)
        for token, i in vocab.items():
            self.bytes_of[i] = len(token)  # a byte-level vocabulary writes each byte as one character
        self.clear()

    def clear(self) -> None:
        self._number([])
        self.flat, self.used = np.zeros(1 << 16, np.uint32), 0
        self.begin, self.size, self.uses = (np.zeros(1 << 12, np.int64) for _ in range(3))

    def _number(self, units: list[str]) -> None:
        """Number units from 0; a unit that is looked up and not known gets the next number."""
        self.known: defaultdict[str, int] = defaultdict(count(len(units)).__next__)
        self.known.update(zip(units, range(len(units)), strict=True))

    def forget(self) -> None:
        """Keep units that came more than once since the last time, the most frequent half of `most` at most; counts start afresh."""
        uses = self.uses[: len(self.known)]
        ranked = np.sort(uses)[::-1]
        stay = uses >= max(2, ranked[self.most // 2] + 1 if len(ranked) > self.most // 2 else 2)
        units = [u for u, s in zip(self.known, stay.tolist(), strict=True) if s]
        begin, size = self.begin[: len(uses)][stay], self.size[: len(uses)][stay]
        end = np.cumsum(size)
        flat = self.flat[np.repeat(begin - (end - size), size) + np.arange(end[-1] if len(end) else 0)]
        self.clear()
        self._number(units)
        self._store(flat, end - size, size, 0)

    def _store(self, flat: np.ndarray, begin: np.ndarray, size: np.ndarray, n: int) -> None:
        """Ids of the units from number n on; begin is within flat."""
        while self.used + len(flat) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        while n + len(size) > len(self.begin):
            self.begin, self.size, self.uses = (np.concatenate([x, np.zeros_like(x)]) for x in (self.begin, self.size, self.uses))
        self.flat[self.used : self.used + len(flat)] = flat
        self.begin[n : n + len(size)], self.size[n : n + len(size)] = begin + self.used, size
        self.used += len(flat)

    def _learn(self, n: int) -> None:
        """Encode the units from number n on, a thousand to a call, and find where each ends by the bytes of its tokens."""
        units = list(islice(reversed(self.known), len(self.known) - n))[::-1]
        for a in range(0, len(units), 100_000):
            some = units[a : a + 100_000]
            groups = [" " + " ".join(some[i : i + 1000]) for i in range(0, len(some), 1000)]
            flat = np.concatenate([np.array(e.ids, np.uint32) for e in self.tok.encode_batch_fast(groups, add_special_tokens=False)])
            size = np.array([len(u) if u.isascii() else len(u.encode("utf-8", "surrogatepass")) for u in some], np.int64) + 1
            ends = np.searchsorted(np.cumsum(self.bytes_of[flat]), np.cumsum(size)) + 1
            first = np.concatenate([[0], ends[:-1]])
            self._store(flat, first, ends - first, n + a)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        heads: list[str] = []
        units: list[str] = []
        counts = np.zeros(len(texts), np.int64)
        for k, t in enumerate(texts):
            if odd(t):
                heads.append(t)
                continue
            rest = t.split(" ")
            heads.append(rest[0])
            del rest[0]
            units += rest
            counts[k] = len(rest)
        if len(self.known) > self.most:
            self.forget()
        n = len(self.known)
        try:
            at = np.fromiter(map(self.known.__getitem__, units), np.int64, len(units))
            if len(self.known) > n:
                self._learn(n)
        except BaseException:
            self.clear()  # new units have numbers, but maybe no ids
            raise
        self.uses[: len(self.known)] += np.bincount(at, minlength=len(self.known))
        size = self.size[at]
        end = np.cumsum(size)
        flat = self.flat[np.repeat(self.begin[at] - (end - size), size) + np.arange(end[-1] if len(end) else 0)]
        token_end = np.concatenate([[0], end])[np.cumsum(counts)]
        parts = np.split(flat, token_end[:-1]) if len(texts) else []
        first = self.tok.encode_batch_fast(heads, add_special_tokens=False)
        return [np.concatenate([np.array(h.ids, np.uint32), p]) for h, p in zip(first, parts, strict=True)]


_HELD: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The one encoder of this process for a vocabulary file; it outlives a task."""
    if path not in _HELD:
        _HELD[path] = Encoder(path)
    return _HELD[path]
