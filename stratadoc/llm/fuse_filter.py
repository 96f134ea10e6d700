"""Static 3-wise binary fuse filters (Graf and Lemire, 2022) over 64-bit keys, in numpy.

About 9 bits a key, no false negative, false positives at 1 in 256. Keys are peeled in
waves: all slots that hold one key are taken at once, as such slots never meet in the
same wave.
"""

from __future__ import annotations

import math

import numpy as np


def _mix(keys: np.ndarray, seed: int) -> np.ndarray:
    """The 64-bit finaliser of MurmurHash3 over key + seed."""
    h = keys + np.uint64(seed & 0xFFFFFFFFFFFFFFFF)
    for shift, by in ((33, 0xFF51AFD7ED558CCD), (33, 0xC4CEB9FE1A85EC53)):
        h = (h ^ (h >> np.uint64(shift))) * np.uint64(by)
    return h ^ (h >> np.uint64(33))


class FuseFilter:
    def __init__(self, seed: int, segment: int, segments: int, table: np.ndarray):
        self.seed, self.segment, self.segments, self.table = seed, segment, segments, table

    def _slots(self, h: np.ndarray) -> np.ndarray:
        first = ((h >> np.uint64(32)) * np.uint64(self.segments * self.segment)) >> np.uint64(32)
        mask = np.uint64(self.segment - 1)
        one = (first + np.uint64(self.segment)) ^ ((h >> np.uint64(18)) & mask)
        two = (first + np.uint64(2 * self.segment)) ^ (h & mask)
        return np.stack([first, one, two]).astype(np.int64)

    @classmethod
    def build(cls, keys: np.ndarray) -> FuseFilter:
        """keys: distinct uint64."""
        n = len(keys)
        segment = 4 if n < 2 else min(1 << 18, 1 << int(math.log(n) / math.log(3.33) + 2.25))
        factor = 1.125 if n < 2 else max(1.125, 0.875 + 0.25 * math.log(1e6) / math.log(n))
        segments = max(1, math.ceil(n * factor / segment) - 2)
        for seed in range(1, 200):
            f = cls(seed * 0x9E3779B97F4A7C15, segment, segments, np.zeros((segments + 2) * segment, np.uint8))
            if f._fill(keys):
                return f
            if seed % 10 == 0:
                segments += 1 + segments // 8
        raise ValueError("the keys are not distinct")

    def _fill(self, keys: np.ndarray) -> bool:
        h = _mix(keys, self.seed)
        slots = self._slots(h)
        n, size = len(keys), len(self.table)
        count = np.bincount(slots.ravel(), minlength=size)
        held = np.zeros(size, np.int64)  # the xor of the numbers of the keys at each slot
        for s in slots:
            np.bitwise_xor.at(held, s, np.arange(n))
        waves, left = [], n
        ready = np.flatnonzero(count == 1)
        while len(ready):
            key, first = np.unique(held[ready], return_index=True)
            waves.append((key, ready[first]))
            left -= len(key)
            touched = slots[:, key].ravel()
            np.subtract.at(count, touched, 1)
            np.bitwise_xor.at(held, touched, np.tile(key, 3))
            touched = np.unique(touched)
            ready = touched[count[touched] == 1]
        if left:
            return False
        for key, slot in reversed(waves):
            s = slots[:, key]
            self.table[slot] = 0
            self.table[slot] = (h[key] & np.uint64(255)).astype(np.uint8) ^ self.table[s[0]] ^ self.table[s[1]] ^ self.table[s[2]]
        return True

    def has(self, keys: np.ndarray) -> np.ndarray:
        h = _mix(keys, self.seed)
        s = self._slots(h)
        return (h & np.uint64(255)).astype(np.uint8) == self.table[s[0]] ^ self.table[s[1]] ^ self.table[s[2]]
