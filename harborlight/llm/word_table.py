"""Numbers for the words of many texts, looked up by arrays: no Python object for a word that is known."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

from .common import Words, eights, equal_spans
from .piece_memo import Encoded

#: Words of more bytes are encoded anew in each slice.
LONGEST = 16


class WordTable:
    """A bounded memory of words' encodings, sorted by word hash.

    A word is known if its hash, length, first eight and last eight bytes are all those of an entry.
    Only words of up to ``LONGEST`` bytes are remembered, so that is the word itself; words of one slice
    that share a hash are told apart by their bytes.  ``encode`` maps a list of words to all their values joined, and each one's number of
    values.  The memory starts anew when it holds ``most`` words, or 16 values for each of so many.
    """

    def __init__(self, encode: Callable[[list[bytes]], Encoded], most: int = 1_500_000) -> None:
        self.encode, self.most = encode, most
        self._clear()

    def _clear(self) -> None:
        self.hash, self.head, self.tail = (np.zeros(0, np.uint64) for _ in range(3))
        self.size, self.at, self.count = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.values, self.used = np.zeros(1 << 16, np.int32), 0

    def _store(self, values: np.ndarray) -> int:
        """Where the values now lie."""
        first = self.used
        while first + len(values) > len(self.values):
            self.values = np.concatenate([self.values, np.zeros_like(self.values)])
        self.values[first : first + len(values)] = values
        self.used += len(values)
        return first

    def __call__(self, data: np.ndarray, words: Words) -> Encoded:
        """All values of the words joined, and how many each word has."""
        if len(self.hash) >= self.most or self.used >= 16 * self.most:
            self._clear()
        hashes, first, which = np.unique(words.hash, return_index=True, return_inverse=True)
        sizes, like = words.end - words.start, first[which]
        same = (sizes == sizes[like]) & equal_spans(data, words.start, words.start[like], np.minimum(sizes, sizes[like]))
        if not same.all():  # words with one hash: each such word is an entry of its own, which is not remembered
            odd = np.flatnonzero(~same)
            which[odd] = len(hashes) + np.arange(len(odd))
            hashes, first = np.concatenate([hashes, words.hash[odd]]), np.concatenate([first, odd])
        plain = np.arange(len(hashes)) < len(hashes) - np.count_nonzero(~same)
        start, size = words.start[first], sizes[first]
        eight = eights(data)
        head = eight[start] & np.where(size >= 8, ~np.uint64(0), (np.uint64(1) << (np.minimum(size, 7).astype(np.uint64) * np.uint64(8))) - np.uint64(1))
        tail = np.where(size > 8, eight[np.maximum(start + size - 8, 0)], np.uint64(0))
        near = np.minimum(np.searchsorted(self.hash, hashes), max(0, len(self.hash) - 1))
        if len(self.hash):
            known = (self.hash[near] == hashes) & (self.head[near] == head) & (self.tail[near] == tail) & (self.size[near] == size) & plain
        else:
            known = np.zeros(len(hashes), bool)
        at, count = np.zeros(len(hashes), np.int64), np.zeros(len(hashes), np.int64)
        at[known], count[known] = self.at[near[known]], self.count[near[known]]
        new = np.flatnonzero(~known)
        if len(new):
            values, counts = self.encode([data[a : a + n].tobytes() for a, n in zip(start[new].tolist(), size[new].tolist(), strict=True)])
            at[new] = self._store(values) + np.cumsum(counts) - counts
            count[new] = counts
            # An entry with the same hash but another word stays; the new word is then asked for again.
            add = new[plain[new] & (size[new] <= LONGEST) & ((self.hash[near[new]] != hashes[new]) if len(self.hash) else True)]
            place = np.searchsorted(self.hash, hashes[add])
            for name, column in (("hash", hashes), ("head", head), ("tail", tail), ("size", size), ("at", at), ("count", count)):
                setattr(self, name, np.insert(getattr(self, name), place, column[add]))
        counts = count[which]
        take = np.repeat(at[which] - (np.cumsum(counts) - counts), counts)
        take += np.arange(len(take))
        return self.values[take], counts
