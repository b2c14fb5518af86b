"""Words and word hashes of whole Arrow text columns, by numpy over their UTF-8 bytes.

A word is a run of letters or digits. Bytes above 0x7F count as letters, except those of the
punctuation blocks U+0080-U+00BF, U+2000-U+206F and U+3000-U+303F. Hashes are the same in
every process.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
#: Odd, so that it has an inverse modulo 2^64.
BASE = 0x9E3779B97F4A7C15
_ASCII_WORD = np.zeros(256, bool)
_ASCII_WORD[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
_POWERS: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit over all others."""
    x = x ^ (x >> U(32))
    x *= U(0xD6E8FEB86659FD93)
    x ^= x >> U(32)
    x *= U(0xD6E8FEB86659FD93)
    x ^= x >> U(32)
    return x


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE^i and BASE^-i modulo 2^64 for i below n at least."""
    if len(_POWERS.get("up", ())) < n:
        size = max(n, 1 << 20)
        _POWERS["up"] = np.cumprod(np.concatenate([[U(1)], np.full(size - 1, U(BASE))]))
        _POWERS["down"] = np.cumprod(np.concatenate([[U(1)], np.full(size - 1, U(pow(BASE, -1, 1 << 64)))]))
    return _POWERS["up"], _POWERS["down"]


def prefix(data: np.ndarray) -> np.ndarray:
    """P with P[i] = the sum of (data[j] + 1) * BASE^j over j < i, modulo 2^64."""
    up, _ = powers(len(data) + 1)
    out = np.zeros(len(data) + 1, U)
    step = data.astype(U)
    step += U(1)
    step *= up[: len(data)]
    np.cumsum(step, out=out[1:])
    return out


def span_hash(p: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of the spans [start, end) of the data that p is the prefix() of."""
    _, down = powers(len(p))
    return mix((p[end] - p[start]) * down[start] + (end - start).astype(U) * U(0xBF58476D1CE4E5B9))


def window_minimum(h: np.ndarray, size: int) -> np.ndarray:
    """Minimum of every `size` neighbours, by running minima of blocks from both sides."""
    pad = np.concatenate([h, np.full(-len(h) % size, U(0xFFFFFFFFFFFFFFFF), U)]).reshape(-1, size)
    ahead = np.minimum.accumulate(pad, axis=1).ravel()
    back = np.minimum.accumulate(pad[:, ::-1], axis=1)[:, ::-1].ravel()
    m = len(h) - size + 1
    return np.minimum(back[:m], ahead[size - 1 : size - 1 + m])


def runs_of(low: np.ndarray, offsets: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of equal values of windows of `length` that don't cross a document's border: document, value, first window in low, windows."""
    size = np.diff(offsets)
    starts = np.maximum(size - length + 1, 0)
    doc_of = np.full(len(low), -1, np.int64)
    inside = np.repeat(offsets[:-1], starts) + np.arange(starts.sum()) - np.repeat(np.cumsum(starts) - starts, starts)
    doc_of[inside] = np.repeat(np.arange(len(size)), starts)
    new = np.ones(len(low), bool)
    new[1:] = (low[1:] != low[:-1]) | (doc_of[1:] != doc_of[:-1])
    begin = np.flatnonzero(new)
    n = np.diff(np.concatenate([begin, [len(low)]]))
    ok = doc_of[begin] >= 0
    begin, n = begin[ok], n[ok]
    return doc_of[begin], low[begin], begin, n


def text_parts(column: pa.Array | pa.ChunkedArray, part_bytes: int = 4 << 20) -> Iterator[tuple[int, int]]:
    """Row ranges of about part_bytes of text each, so that numpy's working memory is bounded."""
    sizes = np.asarray(pc.fill_null(pc.binary_length(column), 0)).astype(np.int64)
    begin = np.concatenate([[0], np.cumsum(sizes)])
    at = 0
    while at < len(sizes):
        to = max(at + 1, int(np.searchsorted(begin, begin[at] + part_bytes, "right")) - 1)
        yield at, to
        at = to


def raw(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all rows, one after the other, and the n + 1 row offsets; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        column = column if isinstance(column, pa.Array) else pa.concat_arrays(column.chunks)
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    if data is None:
        return np.zeros(0, np.uint8), np.zeros(len(off), np.int64)
    return np.frombuffer(data, np.uint8)[off[0] : off[-1]], off - off[0]


class Words(NamedTuple):
    """Words of many documents: byte starts and ends, hashes, and n + 1 word offsets of the documents."""

    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    offsets: np.ndarray

    @property
    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.offsets) - 1), np.diff(self.offsets))


def is_word(data: np.ndarray) -> np.ndarray:
    ok = _ASCII_WORD[data]
    if len(data) > 2 and (data >= 0x80).any():
        for lead, low, high, size in ((0xC2, 0x80, 0xBF, 2), (0xE2, 0x80, 0x81, 3), (0xE3, 0x80, 0x80, 3)):
            at = np.flatnonzero((data[:-1] == lead) & (data[1:] >= low) & (data[1:] <= high))
            for k in range(size):
                ok[np.minimum(at + k, len(ok) - 1)] = False
    return ok


def words(column: pa.Array) -> Words:
    """Lower-cased words of every row."""
    data, offsets = raw(pc.utf8_lower(column.cast(pa.large_string())))
    ok = np.zeros(len(data) + 2, bool)
    ok[1:-1] = is_word(data)
    edge = ok[1:] != ok[:-1]
    cut = np.flatnonzero(edge)
    borders = np.unique(offsets)
    borders = borders[ok[1:][borders] & ok[borders]]  # a word ends where its document ends, and another begins
    if len(borders):
        cut = np.sort(np.concatenate([cut, borders, borders]))
    start, end = cut[::2], cut[1::2]
    return Words(start, end, span_hash(prefix(data), start, end), np.searchsorted(start, offsets))


def shingles(w: Words, size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of `size` words within a document, and their n + 1 document offsets.

    A document of fewer words has one run of all its words; one of none has no run.
    """
    n = np.diff(w.offsets)
    count = np.where(n >= size, n - size + 1, np.minimum(n, 1))
    offsets = np.concatenate([[0], np.cumsum(count)])
    doc = np.repeat(np.arange(len(n)), count)
    first = w.offsets[:-1][doc] + np.arange(offsets[-1]) - offsets[:-1][doc]
    length = np.minimum(n, size)[doc]
    out = np.zeros(len(first), U)
    for k in range(size):
        have = k < length
        at = np.where(have, first + k, 0)
        if len(w.hash):
            out += np.where(have, w.hash[at] * U(pow(BASE, 2 * k + 1, 1 << 64)), U(0))
    return mix(out), offsets
