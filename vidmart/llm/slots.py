"""A minimal perfect hash of 128-bit digests, as flat numpy arrays."""

from __future__ import annotations

import numpy as np

from vidmart.llm.arrays import U, mix

#: Places for each key still without one, at every level.
ROOM = 2


class Slots:
    """slot(key) in 0..n-1, another one for each of n distinct keys.

    Each level hashes the keys that are left into twice as many places; a key alone in its
    place keeps it. A key's slot is the rank of its place among the kept ones. The digest in
    the slot is compared on lookup, so a key that is not in the table gets -1."""

    def __init__(self, keys: np.ndarray):
        self.size, self.levels, self.starts = len(keys), [], []
        left, kept = np.asarray(keys, U).reshape(-1, 2), 0
        while len(left):
            if len(self.levels) > 64:
                raise ValueError("keys of a perfect hash must be distinct")
            places = self._places(left, len(self.levels), ROOM * len(left))
            alone = np.bincount(places, minlength=ROOM * len(left)) == 1
            self.levels.append(np.where(alone, np.cumsum(alone) - 1, -1))
            self.starts.append(kept)
            kept += int(alone.sum())
            left = left[~alone[places]]
        self.table = np.zeros((self.size, 2), U)
        self.table[self._find(np.asarray(keys, U).reshape(-1, 2))] = keys

    @staticmethod
    def _places(keys: np.ndarray, level: int, room: int) -> np.ndarray:
        return (mix(mix(keys[:, 0] + U(level)) ^ keys[:, 1]) % U(room)).astype(np.int64)

    def _find(self, keys: np.ndarray) -> np.ndarray:
        slot, open_ = np.full(len(keys), -1), np.arange(len(keys))
        for i, (ranks, start) in enumerate(zip(self.levels, self.starts, strict=True)):
            rank = ranks[self._places(keys[open_], i, len(ranks))]
            slot[open_[rank >= 0]] = start + rank[rank >= 0]
            open_ = open_[rank < 0]
        return slot

    def lookup(self, keys: np.ndarray) -> np.ndarray:
        keys = np.asarray(keys, U).reshape(-1, 2)
        slot = self._find(keys)
        known = np.flatnonzero(slot >= 0)
        wrong = known[(self.table[slot[known]] != keys[known]).any(axis=1)]
        slot[wrong] = -1
        return slot
