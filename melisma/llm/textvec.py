"""Words of whole Arrow batches as numpy arrays: no Python object per word.

A word is a maximal run of ASCII letters, digits and bytes above 0x7F (so letters
outside ASCII are word characters), case-folded over ASCII and Latin-1 letters
without changing any byte offset.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash

_WORD = np.zeros(256, bool)
_WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
#: Longer words are hashed one by one.
_LONG = 48


def mix64(x: np.ndarray) -> np.ndarray:
    """The 64-bit finalizer of splitmix64, elementwise."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def raw_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts in a row, and the offsets of each; null is empty."""
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, column.offset * 8)
    data = column.buffers()[2]
    if data is None or len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def text_slices(column: pa.Array, limit: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``limit`` bytes, one row at least."""
    if len(column) == 0:
        return
    _, offsets = raw_bytes(column)
    first = 0
    while first < len(column):
        last = int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1
        last = max(first + 1, last)
        yield first, last
        first = last


def fold_case(data: np.ndarray) -> np.ndarray:
    out = _FOLD[data]
    if len(out) > 1:
        upper = (out[:-1] == 0xC3) & (out[1:] >= 0x80) & (out[1:] <= 0x9E) & (out[1:] != 0x97)
        out[1:][upper] += 32
    return out


@dataclass
class Words:
    data: np.ndarray  # folded bytes of all texts
    offsets: np.ndarray  # of each text in data
    start: np.ndarray  # of each word in data
    end: np.ndarray
    first: np.ndarray  # index of each text's first word, and the number of words
    hash: np.ndarray  # 64 bits of each word
    prefix: dict[int, np.ndarray]  # hashes of prefixes, by length in bytes

    def text_of(self) -> np.ndarray:
        """The text that each word is in."""
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def words_of(column: pa.Array, prefixes: tuple[int, ...] = ()) -> Words:
    raw, offsets = raw_bytes(column)
    data = fold_case(raw)
    inside = _WORD[data]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    edges = offsets[:-1][offsets[:-1] < len(data)]
    begins[edges] = inside[edges]
    finish = inside.copy()
    finish[:-1] &= ~inside[1:]
    edges = offsets[1:][offsets[1:] > 0] - 1
    finish[edges] = inside[edges]
    start, end = np.flatnonzero(begins), np.flatnonzero(finish) + 1
    hashed, prefix = _hash(data, start, end, prefixes)
    return Words(data, offsets, start, end, np.searchsorted(start, offsets), hashed, prefix)


def _hash(data: np.ndarray, start: np.ndarray, end: np.ndarray, prefixes: tuple[int, ...]) -> tuple[np.ndarray, dict]:
    size = end - start
    h = np.full(len(start), 0x9E3779B97F4A7C15, np.uint64)
    kept, live, at = {}, np.arange(len(start)), start
    for k in range(min(_LONG, int(size.max(initial=0)))):
        h[live] = (h[live] ^ data[at + k]) * np.uint64(0x100000001B3)
        if k + 1 in prefixes:
            kept[k + 1] = mix64(h + np.uint64(k + 1))
        more = size[live] > k + 1
        live, at = live[more], at[more]
    for i in np.flatnonzero(size > _LONG):
        h[i] = xxhash.xxh64_intdigest(data[start[i] : end[i]].tobytes())
    for k in prefixes:
        kept.setdefault(k, mix64(h + np.uint64(k)))
    return mix64(h), kept


def shingles(words: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the runs of ``n`` words of each text, in order, and the bounds of
    each text's runs; a text of fewer words is one run, one without words none."""
    held = np.diff(words.first)
    count = np.where(held == 0, 0, np.maximum(1, held - n + 1))
    bound = np.concatenate([[0], np.cumsum(count)])
    at = np.arange(int(bound[-1])) + np.repeat(words.first[:-1] - bound[:-1], count)
    limit = np.repeat(words.first[1:], count)
    h = np.full(len(at), n, np.uint64)
    for k in range(n):
        now = words.hash[np.minimum(at + k, max(0, len(words.hash) - 1))] if len(at) else h
        h = mix64(h + np.where(at + k < limit, now, np.uint64(k)))
    return h, bound
