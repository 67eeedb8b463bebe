"""Words of texts: byte classes, and keyed 128-bit digests of words."""

from __future__ import annotations

from hashlib import blake2b

import numpy as np

#: Maps A-Z to a-z.
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
#: The same, and every byte outside `[^\x20\x09-\x0D]+` to a space.
WORDS = bytes(32 if 9 <= b <= 13 else b for b in LOWER)
#: The same as LOWER, and every byte outside `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` (digits, letters and all beyond ASCII) to a space.
ALNUM = bytes(b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 32 for b in LOWER)


def word_bounds(folded: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words of a text folded by WORDS or ALNUM."""
    inside = np.empty(len(folded) + 2, np.int8)
    inside[0] = inside[-1] = 0
    inside[1:-1] = np.frombuffer(folded, np.uint8) != 32
    change = np.flatnonzero(inside[1:] != inside[:-1])
    return change[::2], change[1::2]


class WordDigests(dict):
    """128-bit digests of words under a secret key, each word digested once: nobody can build words that collide.

    halves(words) gives the two 64-bit halves of each. What is remembered is bounded by `most` words.
    """

    def __init__(self, key: bytes, most: int = 400_000):
        super().__init__()
        self.key, self.most, self.raw = key, most, bytearray()

    def __missing__(self, word: bytes) -> int:
        at = self[word] = len(self)
        self.raw += blake2b(word, digest_size=16, key=self.key).digest()
        return at

    def halves(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        if len(self) > self.most:
            self.clear()
            self.raw = bytearray()
        at = np.fromiter(map(self.__getitem__, words), np.int64, len(words))
        table = np.frombuffer(bytes(self.raw), np.uint64).reshape(-1, 2)[at]
        return table[:, 0].copy(), table[:, 1].copy()
