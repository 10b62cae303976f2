"""A run-compressed Burrows-Wheeler index of a few texts, in memory, and matching statistics streamed from it.

Texts are bytes below 0xFF (UTF-8 is), each followed by a separator of its own that is greater than all bytes and smaller
than later ones. Of the transform only runs of equal bytes are kept, and of the suffix array what stands at both
sides of a border between runs, with the length that these two suffixes have in common.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

SEPARATOR = b"\xff"


def _words(text: np.ndarray, left: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on, zeros after its text's separator."""
    n = len(text)
    padded = np.concatenate([text, np.zeros(8, np.uint8)])
    words = np.ndarray((n,), ">u8", padded.data, 0, (1,)).astype(np.uint64)
    short = left < 7
    words[short] &= np.uint64(0xFFFFFFFFFFFFFFFF) << (np.uint64(8) * (7 - left[short]).astype(np.uint64))
    return words


def suffix_array(words: np.ndarray, left: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, list[tuple[int, np.ndarray]]]:
    """The suffix array, and the ranks of all places by their first 8, 8 * k, 8 * k * k, ... bytes: a place's rank by
    h bytes, and those h, 2 * h, ... places on, are its rank by k * h bytes, k being as many as fit in 63 bits.

    left: bytes before a place's separator; number: the place's text. Only suffixes that still have equals are sorted again.
    """
    n = len(words)
    texts = int(number[-1]) + 1 if n else 0
    bits = max(1, int(n + texts).bit_length())
    order = np.argsort(words)
    found = words[order]
    slots, new = np.arange(n), np.append(True, found[1:] != found[:-1])
    rank, sa = np.empty(n, np.int64), order
    h, levels = 8, []
    while n:
        rank[order] = np.maximum.accumulate(np.where(new, slots, 0))
        levels.append((h, rank.astype(np.int32)))
        alone = new & np.append(new[1:], True)
        if alone.all():
            break
        slots, order = slots[~alone], order[~alone]
        key, rest = rank[order], left[order]
        for step in range(1, 63 // bits):
            ended = rest < step * h  # their separators tell them apart
            key = (key << bits) | np.where(ended, number[order], rank[np.where(ended, 0, order + step * h)] + texts)
        by = np.argsort(key)
        order, key = order[by], key[by]
        sa[slots] = order
        new = np.append(True, key[1:] != key[:-1])
        h *= 63 // bits
    return sa, levels


def _common(a: np.ndarray, b: np.ndarray, words: np.ndarray, left: np.ndarray, levels: list[tuple[int, np.ndarray]]) -> np.ndarray:
    """How many bytes the suffixes at a and b have in common, separators excluded."""
    last = len(words) - 1
    long, above = np.zeros(len(a), np.int64), None
    for h, rank in reversed(levels):
        for _ in range(above // h - 1 if above else 1):
            long += h * (rank[np.minimum(a + long, last)] == rank[np.minimum(b + long, last)])
        above = h
    differ = words[np.minimum(a + long, last)] ^ words[np.minimum(b + long, last)]
    for k in range(1, 8):
        long += differ < np.uint64(1 << (64 - 8 * k))
    return np.minimum(long, np.minimum(left[a], left[b]))


@dataclass
class RunIndex:
    """n: places, with separators; byte and first: each run's byte (-1: a separator) and first row; begins and ends: the
    suffixes at a run's first and last row; common: what its first suffix and the one before it have in common."""

    n: int
    byte: np.ndarray
    first: np.ndarray
    begins: np.ndarray
    ends: np.ndarray
    common: np.ndarray

    @classmethod
    def of(cls, texts: list[bytes]) -> RunIndex:
        text = np.frombuffer(b"".join(t + SEPARATOR for t in texts), np.uint8)
        lengths = np.array([len(t) + 1 for t in texts], np.int64)
        stops = np.repeat(np.cumsum(lengths) - 1, lengths)
        left, number = stops - np.arange(len(text)), np.repeat(np.arange(len(texts)), lengths)
        words = _words(text, left)
        sa, levels = suffix_array(words, left, number)
        opens = np.append(True, left[:-1] == 0)[: len(text)]  # what stands before them is a separator
        before = np.where(opens[sa], -1, text[sa - 1].astype(np.int16))
        first = np.flatnonzero(np.append(True, (before[1:] != before[:-1]) | (before[1:] < 0))[: len(sa)])
        common = np.append(0, _common(sa[first[1:]], sa[first[1:] - 1], words, left, levels))[: len(first)]
        return cls(len(text), before[first], first, sa[first], sa[np.append(first[1:], len(sa))[: len(first)] - 1], common)

    def _streamed(self, places: np.ndarray, common: np.ndarray) -> np.ndarray:
        """One neighbour's matches at all places, in their order: one byte less than at the place before, but for sampled ones."""
        at = np.zeros(self.n, np.int64)
        at[places] = places
        sampled = np.zeros(self.n, np.int64)
        sampled[places] = common
        at = np.maximum.accumulate(at)
        return np.maximum(sampled[at] - (np.arange(self.n) - at), 0)

    def statistics(self) -> np.ndarray:
        """The length of the longest match of each place's suffix with any other one, within their texts.

        The longest match is with a neighbour in the suffix array. Inside a run a suffix and its neighbour follow a
        suffix and its neighbour that match in one byte more; so what borders of runs have settles all places.
        """
        after = self._streamed(self.begins, self.common)
        before = self._streamed(self.ends, np.append(self.common[1:], 0)[: len(self.ends)])
        return np.maximum(after, before)


def long_matches(texts: list[bytes], window: int) -> list[tuple[int, int, int]]:
    """(text, first place, places) of runs of places where `window` bytes also begin elsewhere in these texts."""
    if not texts:
        return []
    long = RunIndex.of(texts).statistics() >= window
    lengths = np.array([len(t) + 1 for t in texts], np.int64)
    begin = np.cumsum(lengths) - lengths
    at = np.flatnonzero(long)
    first = np.flatnonzero(np.append(True, at[1:] != at[:-1] + 1)) if len(at) else at
    count = np.diff(np.append(first, len(at)))
    of = np.searchsorted(begin, at[first], side="right") - 1
    return list(zip(of.tolist(), (at[first] - begin[of]).tolist(), count.tolist(), strict=True))
