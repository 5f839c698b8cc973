"""Encoding of text pieces with a bounded memory of the pieces seen before."""

from __future__ import annotations

from collections.abc import Callable
from itertools import chain, repeat

import numpy as np

Encoded = tuple[np.ndarray, np.ndarray]


def joined(found: list) -> Encoded:
    """Integer sequences as all their values, and how many each has."""
    counts = np.fromiter(map(len, found), np.int64, len(found))
    return np.fromiter(chain.from_iterable(found), np.int32, int(counts.sum())), counts


class PieceMemo:
    """Numbers for many pieces at once, asking ``encode`` only for pieces it does not remember.

    ``encode`` maps a list of pieces to all their values joined, and how many values each has.  The
    memory is dropped when it holds ``max_pieces`` pieces or ``max_chars`` characters, so it stays
    bounded on any input.
    """

    def __init__(self, encode: Callable[[list], Encoded], max_pieces: int = 1_000_000, max_chars: int = 24_000_000) -> None:
        self.encode, self.max_pieces, self.max_chars = encode, max_pieces, max_chars
        self._clear()

    def _clear(self) -> None:
        self.number: dict = {}
        self.chars = 0
        self.values = np.zeros(1 << 16, np.int32)
        self.ends = np.zeros(1 << 14, np.int64)  # ends[i]: where the values of piece i - 1 end
        self.used = 0

    def _learn(self, pieces: list) -> None:
        values, counts = self.encode(pieces)
        known = len(self.number)
        while self.used + len(values) > len(self.values):
            self.values = np.concatenate([self.values, np.zeros_like(self.values)])
        while known + len(pieces) + 1 > len(self.ends):
            self.ends = np.concatenate([self.ends, np.zeros_like(self.ends)])
        self.values[self.used : self.used + len(values)] = values
        self.ends[known + 1 : known + 1 + len(pieces)] = self.used + np.cumsum(counts)
        self.used += len(values)
        self.number.update(zip(pieces, range(known, known + len(pieces)), strict=True))
        self.chars += sum(map(len, pieces))

    def __call__(self, pieces: list) -> Encoded:
        """All pieces' values joined, and how many values each piece has."""
        if len(self.number) >= self.max_pieces or self.chars >= self.max_chars:
            self._clear()
        at = np.fromiter(map(self.number.get, pieces, repeat(-1)), np.int64, len(pieces))
        new = np.flatnonzero(at < 0).tolist()
        if new:
            self._learn(list(dict.fromkeys(pieces[i] for i in new)))
            at[new] = [self.number[pieces[i]] for i in new]
        starts = self.ends[at]
        counts = self.ends[at + 1] - starts
        take = np.repeat(starts - (np.cumsum(counts) - counts), counts)
        take += np.arange(len(take))
        return self.values[take], counts


def encode_spaced(library, words: list[str], run: int = 512) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
    """Ids and end offsets of words, each encoded behind one space, and how many tokens each has.

    Many words make one text, as a call for each costs more than its tokens do.  None if a word's tokens
    do not end where the word does, as the library's offsets then don't tell words apart.
    """
    runs = [words[i : i + run] for i in range(0, len(words), run)]
    ids, ends, counts = [], [], []
    for some, e in zip(runs, library.encode_batch([" " + " ".join(x) for x in runs], add_special_tokens=False), strict=True):
        stop = np.cumsum(np.fromiter(map(len, some), np.int64, len(some)) + 1)
        end = np.fromiter((b for _, b in e.offsets), np.int64, len(e.ids))
        word = np.searchsorted(stop, end)
        last = np.searchsorted(word, np.arange(len(some)), "right") - 1
        if len(end) == 0 or (np.diff(end) < 0).any() or (last < 0).any() or (end[last] != stop).any():
            return None
        ids.append(np.array(e.ids, np.int32))
        ends.append((end - np.r_[0, stop[:-1]][word]).astype(np.int32))
        counts.append(np.bincount(word, minlength=len(some)))
    return np.concatenate(ids), np.concatenate(ends), np.concatenate(counts)
