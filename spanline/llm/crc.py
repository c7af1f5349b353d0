"""CRC-32 of many words and of runs of words at once.

CRC-32 is linear over bits: the checksum of two strings in a row is the first one's,
carried over as many zero bytes as the second is long, xor the second one's.  So words are
summed up from tables by a byte's distance to the word's end, and a run of words from the
checksums of its words, whatever its length.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np

from spanline.llm.bytewords import BLOCK, LOWER

POLYNOMIAL = 0xEDB88320
#: Words up to so many bytes are summed up from tables, longer ones one by one.
NEAR = 256
_BYTE = np.arange(256, dtype=np.uint32)
_SPACE = np.uint32(zlib.crc32(b" "))
_tables: list[np.ndarray] = []


def _carry_tables() -> tuple[np.ndarray, np.ndarray]:
    """``[n, place, byte]``: a register with that byte there, after n zero bytes; and after 2^(8 + k) of them."""
    if not _tables:
        step = _BYTE.copy()
        for _ in range(8):
            step = np.where(step & 1, (step >> np.uint32(1)) ^ np.uint32(POLYNOMIAL), step >> np.uint32(1))
        near = np.empty((NEAR + 1, 4, 256), np.uint32)
        near[0] = _BYTE << (np.arange(4, dtype=np.uint32)[:, None] * np.uint32(8))
        for n in range(NEAR):
            near[n + 1] = (near[n] >> np.uint32(8)) ^ step[near[n] & np.uint32(255)]
        far = [near[NEAR]]
        for _ in range(32):
            far.append(_look_up(far[-1][None], far[-1], 0))
        _tables.extend([near, np.stack(far)])
    return _tables[0], _tables[1]


def _look_up(tables: np.ndarray, x: np.ndarray, which: np.ndarray | int) -> np.ndarray:
    flat, at = tables.reshape(-1), np.asarray(which) * 1024
    out = flat[at + (x & np.uint32(255))]
    for place in range(1, 4):
        out ^= flat[at + 256 * place + ((x >> np.uint32(8 * place)) & np.uint32(255))]
    return out


def carry(x: np.ndarray, zeros: np.ndarray) -> np.ndarray:
    """Registers ``x`` after as many zero bytes."""
    near, far = _carry_tables()
    out = _look_up(near, x, zeros % NEAR)
    left = zeros // NEAR
    k = 0
    while left.any():
        odd = np.flatnonzero(left & 1)
        out[odd] = _look_up(far, out[odd], k)
        left, k = left >> 1, k + 1
    return out


def _words(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Checksums of words as lower-cased bytes."""
    near, _ = _carry_tables()
    length = end - start
    out = np.empty(len(start), np.uint32)
    short = np.flatnonzero(length <= NEAR)
    if len(short):
        n = length[short]
        first = np.cumsum(n) - n
        inner = np.arange(n.sum()) - np.repeat(first, n)
        at = inner + np.repeat(start[short], n)
        terms = near[:, 0].take((np.repeat(n, n) - inner) * 256 + LOWER[data[at]])
        ones = np.full(len(short), 0xFFFFFFFF, np.uint32)
        out[short] = np.bitwise_xor.reduceat(terms, first) ^ carry(ones, n) ^ np.uint32(0xFFFFFFFF)
    for k in np.flatnonzero(length > NEAR):
        out[k] = zlib.crc32(LOWER[data[start[k] : end[k]]].tobytes())
    return out


def runs(data: np.ndarray, start: np.ndarray, end: np.ndarray, first: np.ndarray) -> Iterator[tuple[int, list[np.ndarray], list[np.ndarray]]]:
    """Runs of one to three words of a text, joined by one space, ``BLOCK`` first words at a time.

    ``(lo, words, sums)``: for each length of run, the first words' numbers less ``lo``, and the checksums.
    """
    n = len(start)
    last = np.zeros(n + 2, bool)  # of its text
    last[first[1:][np.diff(first) > 0] - 1] = True
    last[n:] = True
    for lo in range(0, n, BLOCK):
        hi = min(lo + BLOCK, n)
        top = min(hi + 2, n)
        one, size = _words(data, start[lo:top], end[lo:top]), (end - start)[lo:top]
        spaced = carry(one, np.ones(len(one), np.int64)) ^ _SPACE
        two = carry(spaced[:-1], size[1:]) ^ one[1:]
        three = carry(spaced[:-2], size[1:-1] + 1 + size[2:]) ^ two[1:]
        m = hi - lo
        has_two = np.flatnonzero(~last[lo:hi])
        has_three = has_two[~last[lo + 1 + has_two]]
        yield lo, [np.arange(m), has_two, has_three], [one[:m], two[has_two], three[has_three]]
