"""Suffix arrays over words, and search of many suffixes in them at once.

A shard is one array of word numbers with a 0 after each text, so no match runs over the
end of a text.  Word numbers follow the order of word hashes; any order of words will do.
"""

from __future__ import annotations

import numpy as np


def suffix_array(ids: np.ndarray, depth: int) -> np.ndarray:
    """Positions of ``ids`` in the order of the first ``depth`` numbers that follow there.

    One sort by as many numbers as 62 bits hold, then prefix doubling of those positions
    that are still tied.
    """
    n = len(ids)
    bits = max(int(ids.max()).bit_length(), 1) if n else 1
    known = max(62 // bits, 1)
    padded = np.concatenate([ids, np.zeros(known, np.int64)])
    key = padded[:n].copy()
    for j in range(1, known):
        key = (key << bits) | padded[j : j + n]
    order = np.argsort(key, kind="stable")
    new = np.ones(n, bool)
    new[1:] = key[order][1:] != key[order][:-1]
    rank = np.empty(n + 1, np.int64)
    rank[n] = -1
    while True:
        slots = np.arange(n)
        head = np.maximum.accumulate(np.where(new, slots, 0))
        rank[order] = head
        last = np.ones(n, bool)
        last[:-1] = new[1:]
        tied = np.flatnonzero(~(new & last))
        if known >= depth or not len(tied):
            return order
        at = order[tied]
        after = rank[np.minimum(at + known, n)]
        by = np.lexsort((after, head[tied]))
        order[tied] = at[by]
        first, after = head[tied][by], after[by]
        fresh = np.ones(len(tied), bool)
        fresh[1:] = (first[1:] != first[:-1]) | (after[1:] != after[:-1])
        new[tied] = fresh
        known *= 2


class Shard:
    """The suffix array of some texts' words."""

    def __init__(self, hashes: np.ndarray, first: np.ndarray, depth: int):
        self.vocabulary, number = np.unique(hashes, return_inverse=True)
        texts = np.arange(len(first) - 1)
        self.text = np.repeat(texts, np.diff(first) + 1)  # of each place
        self.begin = first[:-1] + texts  # each text's first place
        ids = np.zeros(len(self.text), np.int64)
        places = np.ones(len(ids), bool)
        places[first[1:] + texts] = False
        ids[places] = number + 1
        order = suffix_array(ids, depth)
        self.order = order[ids[order] > 0]
        # even, so that words this shard lacks can be put between: odd
        self.ids = np.concatenate([2 * ids, np.zeros(1, np.int64)])

    def number(self, hashes: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.vocabulary, hashes)
        known = at < len(self.vocabulary)
        known[known] = self.vocabulary[at[known]] == hashes[known]
        return np.where(known, 2 * at + 2, 2 * at + 1)

    def common(self, words: np.ndarray, t: np.ndarray, length: np.ndarray, place: np.ndarray):
        """Equal words from ``words[t]`` and from ``place`` on, and how the next ones compare."""
        same, sign = np.zeros(len(t), np.int64), np.zeros(len(t), np.int64)
        live = np.flatnonzero(length > 0)
        while len(live):
            d = words[t[live] + same[live]] - self.ids[place[live] + same[live]]
            sign[live] = np.sign(d)
            live = live[d == 0]
            same[live] += 1
            live = live[same[live] < length[live]]
        return same, sign

    def bound(self, words, t, length, after: bool) -> np.ndarray:
        """How many suffixes come before ``words[t : t + length]``, or with ``after`` before or from it."""
        low, high = np.zeros(len(t), np.int64), np.full(len(t), len(self.order))
        while True:
            live = np.flatnonzero(low < high)
            if not len(live):
                return low
            mid = (low[live] + high[live]) >> 1
            _, sign = self.common(words, t[live], length[live], self.order[mid])
            right = sign >= 0 if after else sign > 0
            low[live[right]] = mid[right] + 1
            high[live[~right]] = mid[~right]

    def longest(self, words, t, length) -> np.ndarray:
        """The most words from ``words[t]`` on that stand together anywhere in the shard."""
        if not len(self.order):
            return np.zeros(len(t), np.int64)
        at = self.bound(words, t, length, after=False)
        before, _ = self.common(words, t, length, self.order[np.maximum(at - 1, 0)])
        behind, _ = self.common(words, t, length, self.order[np.minimum(at, len(self.order) - 1)])
        return np.maximum(before, behind)
