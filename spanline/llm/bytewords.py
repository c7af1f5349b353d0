"""Words of many texts at once: numpy over the bytes of an Arrow text column.

UTF-8 bytes from 0x80 on belong to characters outside ASCII, so a word class that takes
all of those can be told byte by byte.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: A-Z to a-z, other bytes as they are.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Everything but blank, \t, \n, \v, \f, \r.
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[[0x20, *range(0x09, 0x0E)]] = False
#: Letters, digits and everything outside ASCII.
ALNUM = np.zeros(256, bool)
ALNUM[0x30:0x3A] = ALNUM[0x41:0x5B] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True

CHUNK_BYTES = 2 << 20
#: Words hashed at a time.
BLOCK = 1 << 17
_BASE = np.uint64(0x9E3779B97F4A7C15)
_powers = np.ones(1, np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(n: int) -> np.ndarray:
    """_BASE to the power 0 .. n - 1, modulo 2^64."""
    global _powers
    if len(_powers) < n:
        size = 1 << max(n - 1, 1).bit_length()
        _powers = np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(size - 1, _BASE))])
    return _powers[:n]


@dataclass
class Words:
    """Words of a chunk of texts: text ``i`` has those from ``first[i]`` to ``first[i + 1]``."""

    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    first: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)


def text_chunks(column: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets) of stretches of about ``limit`` bytes, whole texts each; null as empty."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    n = len(column)
    if not n:
        return
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1)
        yield lo, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        lo = hi


def word_spans(data: np.ndarray, offsets: np.ndarray, word_bytes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begin and end of the maximal runs of ``word_bytes`` within each text."""
    if not len(data):
        none = np.zeros(0, np.int64)
        return none, none
    inside = word_bytes[data]
    texts = np.flatnonzero(np.diff(offsets))
    starts, ends = inside.copy(), inside.copy()
    starts[1:] &= ~inside[:-1]
    ends[:-1] &= ~inside[1:]
    starts[offsets[texts]] = inside[offsets[texts]]
    ends[offsets[texts + 1] - 1] = inside[offsets[texts + 1] - 1]
    return np.flatnonzero(starts), np.flatnonzero(ends) + 1


def _value(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A value of each word's lower-cased bytes."""
    length = end - start
    first = np.cumsum(length) - length
    inner = np.arange(length.sum()) - np.repeat(first, length)
    terms = (LOWER[data[inner + np.repeat(start, length)]].astype(np.uint64) + np.uint64(1)) * powers(int(length.max()))[inner]
    return np.add.reduceat(terms, first) + length.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)


def find_words(data: np.ndarray, offsets: np.ndarray, word_bytes: np.ndarray) -> Words:
    """Maximal runs of ``word_bytes`` within each text, hashed as lower-cased bytes.

    Hashes are made for ``BLOCK`` words at a time, so that a very long text needs little
    more memory than its words' places.
    """
    start, end = word_spans(data, offsets, word_bytes)
    value = np.zeros(len(start), np.uint64)
    for lo in range(0, len(start), BLOCK):
        value[lo : lo + BLOCK] = _value(data, start[lo : lo + BLOCK], end[lo : lo + BLOCK])
    return Words(start, end, mix(value), np.searchsorted(start, offsets))


def chain(hashes: np.ndarray, n: int) -> np.ndarray:
    """A hash of each ``n`` neighbours in order; ``len(hashes) - n + 1`` values."""
    out = np.zeros(max(len(hashes) - n + 1, 0), np.uint64)
    for k in range(n if len(out) else 0):
        out = out * _BASE + hashes[k : k + len(out)]
    return mix(out)


def sequence_hash(words: Words, salt: int) -> np.ndarray:
    """A hash of each text's whole sequence of words."""
    n = words.counts
    out = n.astype(np.uint64) * np.uint64(0xA0761D6478BD642F) + np.uint64(salt)
    some = n > 0
    if some.any():
        inner = np.arange(len(words.hash)) - np.repeat(words.first[:-1], n)
        terms = mix(words.hash + np.uint64(salt)) * powers(int(n.max()))[inner]
        out[some] += np.add.reduceat(terms, words.first[:-1][some])
    return mix(out)
