"""Vectorised lookup of 64-bit keys."""

from __future__ import annotations

import numpy as np


class Lookup:
    """Positions of distinct uint64 keys, by open addressing in flat arrays."""

    def __init__(self, keys: np.ndarray):
        self.keys = np.ascontiguousarray(keys, np.uint64)
        bits = max(4, int(len(keys) * 2).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), np.int64((1 << bits) - 1)
        self.slots = np.full(1 << bits, -1, np.int32)
        todo, at = np.arange(len(self.keys), dtype=np.int32), self._home(self.keys)
        while len(todo):
            free = self.slots[at] < 0
            self.slots[at[free]] = todo[free]
            lost = self.slots[at] != todo
            todo, at = todo[lost], (at[lost] + 1) & self.mask

    def _home(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Position of each key, -1 where it is unknown."""
        keys = np.ascontiguousarray(keys, np.uint64)
        if not len(self.keys):
            return np.full(len(keys), -1, np.int32)
        at = self._home(keys)
        out = self.slots[at]
        todo = np.flatnonzero((out >= 0) & (self.keys[out] != keys))
        at = at[todo]
        while len(todo):
            at = (at + 1) & self.mask
            got = self.slots[at]
            out[todo] = got
            on = (got >= 0) & (self.keys[got] != keys[todo])
            todo, at = todo[on], at[on]
        return out


class Memo:
    """Grows by batches of new keys, each with its spelling and a run of int32 values; a find looks through a few tables."""

    def __init__(self, most: int):
        self.most, self.tables, self.size = most, [], 0
        self.first, self.pool = np.zeros(1, np.int64), np.empty(0, np.int32)
        self.edge, self.data = np.zeros(1, np.int64), np.empty(0, np.uint8)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Number of each key, -1 where it is new."""
        out = np.full(len(keys), -1, np.int64)
        for table, base in self.tables:
            todo = np.flatnonzero(out < 0)
            got = table.find(keys[todo])
            out[todo] = np.where(got < 0, -1, got.astype(np.int64) + base)
        return out

    def add(self, keys: np.ndarray, spelled: list[bytes], values: list[np.ndarray]) -> None:
        self.tables.append((Lookup(keys), self.size))
        self.size += len(keys)
        self.first = np.concatenate((self.first, self.first[-1] + np.cumsum([len(v) for v in values])))
        self.pool = np.concatenate((self.pool, *values))
        self.edge = np.concatenate((self.edge, self.edge[-1] + np.cumsum([len(s) for s in spelled])))
        self.data = np.concatenate((self.data, np.frombuffer(b"".join(spelled), np.uint8)))
        if len(self.tables) > 4:
            self.tables = [(Lookup(np.concatenate([t.keys for t, _ in self.tables])), 0)]
