"""Words and word hashes of texts as UTF-8 bytes, for tasks that go through whole texts."""

from __future__ import annotations

import numpy as np
import xxhash

from .common import per_worker

LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
#: A-Z lowered; bytes that are no ASCII letter or digit and no part of a longer character become a space.
ALNUM = bytes(LOWER[b] if b >= 128 or chr(b).isalnum() else 32 for b in range(256))
#: Distinct words whose hashes a Python worker keeps.
KEPT_WORDS = 250_000
#: Bytes of words that are hashed one by one.
LONG_WORD = 48
K1, K2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= KEPT_WORDS:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h


def word_hashes(words: list[bytes]) -> np.ndarray:
    """A 64-bit hash of each word."""
    kept = per_worker("word-hashes", _Hashes)
    return np.fromiter(map(kept.__getitem__, words), dtype=np.uint64, count=len(words))


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(29))) * K2
    return x ^ (x >> np.uint64(32))


def gram_hashes(h: np.ndarray, n: int) -> np.ndarray:
    """A 64-bit hash of each run of n words, from their hashes."""
    if len(h) < n:
        return np.zeros(0, np.uint64)
    out = mixed(h[: len(h) - n + 1] + K1)
    for k in range(1, n):
        out = mixed(out * K1 + h[k : len(h) - n + 1 + k])
    return out


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """n powers of K ** -1 and of K, kept by the worker while texts aren't longer."""

    def made(n: int) -> tuple[np.ndarray, np.ndarray]:
        k = int(K1)
        return np.cumprod(np.full(n, pow(k, -1, 1 << 64), np.uint64)), np.cumprod(np.full(n, k, np.uint64))

    usual = 1 << 21
    return per_worker("powers", lambda: made(usual)) if n <= usual else made(n)


class Words:
    """The words of some texts, one after the other, each followed by one space.

    blob: their bytes; counts: how many words each text has; starts and ends: a word's first byte, and the
    place of its space. Short words are hashed by differences of one running sum of byte[i] * K ** -i, whose low bits say
    little of long words of few letters: those of LONG_WORD bytes and more are hashed one by one.
    """

    def __init__(self, texts: list[bytes | None], table: bytes | None = None):
        parts = [(t.translate(table) if table else t).split() if t else [] for t in texts]
        self.blob = np.frombuffer(b"".join(b" ".join(p) + b" " for p in parts if p), np.uint8)
        self.counts = np.array([len(p) for p in parts], np.int64)
        self.ends = np.flatnonzero(self.blob == 0x20)
        self.starts = np.append(0, self.ends + 1)[: len(self.ends)]
        self.first = np.cumsum(self.counts) - self.counts

    def values(self) -> np.ndarray:
        """A 64-bit hash of each word."""
        down, up = _powers(len(self.blob))
        total = np.zeros(len(self.blob) + 1, np.uint64)
        np.cumsum((self.blob.astype(np.uint64) + np.uint64(1)) * down[: len(self.blob)], out=total[1:])
        out = mixed((total[self.ends + 1] - total[self.starts]) * up[self.starts])
        for k in np.flatnonzero(self.ends - self.starts >= LONG_WORD):
            out[k] = xxhash.xxh64_intdigest(self.blob[self.starts[k] : self.ends[k]].tobytes(), seed=1)
        return out

    def hashes(self, n: int) -> np.ndarray:
        """A 64-bit hash of each run of n words, also of those that go over the end of a text."""
        return gram_hashes(self.values(), n)

    def left(self) -> np.ndarray:
        """How many words of its text each word has from itself on."""
        return np.repeat(self.first + self.counts, self.counts) - np.arange(len(self.ends))

    def cut(self, word: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes of n words from each of these words on, with the spaces after them, in one array, and where they begin."""
        lo, hi = self.starts[word], self.ends[word + n - 1] + 1
        begin = np.append(0, np.cumsum(hi - lo))
        return self.blob[np.arange(begin[-1]) + np.repeat(lo - begin[:-1], hi - lo)], begin
