"""Keyed permutations of 0..n-1: Feistel networks with cycle-walking.

A balanced network permutes the smallest even number of bits that holds n;
values outside 0..n-1 are put through it again until they fall inside, which
takes fewer than four passes on average.  ``Permutation`` uses keyed BLAKE2
rounds for values; ``permute_array`` integer-mixing rounds for whole arrays
(an order for training, not a cipher).
"""

from __future__ import annotations

import hashlib

import numpy as np

ROUNDS = 8


class Permutation:
    def __init__(self, n: int, key: bytes, tweak: str):
        self.n = n
        self.half = max(1, ((n - 1).bit_length() + 1) // 2)
        self.mask = (1 << self.half) - 1
        self.width = (self.half + 7) // 8
        self.base = hashlib.blake2b(f"{tweak}/{n}".encode(), key=hashlib.blake2b(key).digest(),
                                    digest_size=min(64, self.width))
        #: a keyed step, so that ``other`` moves every value
        self.shift = 1 + self._round(99, n & self.mask) % (n - 1) if n > 1 else 0

    def _round(self, k: int, x: int) -> int:
        h = self.base.copy()
        h.update(bytes([k]) + x.to_bytes(self.width, "little"))
        return int.from_bytes(h.digest(), "little") & self.mask

    def _walk(self, x: int, rounds) -> int:
        while True:
            a, b = x >> self.half, x & self.mask
            if rounds[0] == 0:
                for k in rounds:
                    a, b = b, a ^ self._round(k, b)
            else:
                for k in rounds:
                    a, b = b ^ self._round(k, a), a
            x = a << self.half | b
            if x < self.n:
                return x

    def forward(self, x: int) -> int:
        return self._walk(x, range(ROUNDS))

    def backward(self, x: int) -> int:
        return self._walk(x, range(ROUNDS - 1, -1, -1))

    def other(self, x: int, back: bool = False) -> int:
        """A keyed permutation without fixed points (n > 1): the values in
        their keyed order, moved on by a keyed step."""
        if self.n < 2:
            return x
        return self.forward((self.backward(x) + (-self.shift if back else self.shift)) % self.n)


def permute_array(x: np.ndarray, n: int, key: int, back: bool = False) -> np.ndarray:
    """The permutation of 0..n-1 applied to each of ``x`` (int64)."""
    half = np.uint64(max(1, ((n - 1).bit_length() + 1) // 2))
    mask = np.uint64((1 << int(half)) - 1)
    out = x.astype(np.uint64)
    todo = np.arange(len(out))
    rounds = range(ROUNDS - 1, -1, -1) if back else range(ROUNDS)

    def mixed(k: int, v: np.ndarray) -> np.ndarray:
        v = (v + np.uint64((key * 0x9E3779B97F4A7C15 + k * 0xD1342543DE82EF95) % (1 << 64))) * np.uint64(0xBF58476D1CE4E5B9)
        v = (v ^ (v >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
        return (v ^ (v >> np.uint64(32))) & mask
    while len(todo):
        v = out[todo]
        a, b = v >> half, v & mask
        for k in rounds:
            a, b = (b ^ mixed(k, a), a) if back else (b, a ^ mixed(k, b))
        out[todo] = a << half | b
        todo = todo[out[todo] >= np.uint64(n)]
    return out.astype(np.int64)
