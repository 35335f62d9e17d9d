"""Cuckoo filters of 16-bit fingerprints: membership with deletion, as arrays.

A filter is a list of layers. A key has two buckets of four places in a layer; its fingerprint is in
one of them. When the last layer is full, a layer of twice the size follows, so insertion never
fails. Lookups may say yes to absent keys (about 8 in 2^16 per layer), never no to present ones.
"""

from __future__ import annotations

import numpy as np

from actorlens.llm.words import mixed

PLACES = 4
MOST_FILLED = 0.8
ROUNDS = 200


class CuckooFilter:
    def __init__(self, layers: list[np.ndarray] | None = None, capacity: int = 1024):
        self.layers = layers or [self._layer(capacity)]

    @staticmethod
    def _layer(capacity: int) -> np.ndarray:
        buckets = 1 << max(2, int(np.ceil(np.log2(max(1, capacity) / (PLACES * MOST_FILLED)))))
        return np.zeros((buckets, PLACES), np.uint16)

    @classmethod
    def from_bytes(cls, data: bytes) -> CuckooFilter:
        sizes = np.frombuffer(data, np.int32, 1 + int(np.frombuffer(data, np.int32, 1)[0]))[1:]
        at, layers = 4 * (1 + len(sizes)), []
        for buckets in sizes.tolist():
            layers.append(np.frombuffer(data, np.uint16, buckets * PLACES, at).reshape(-1, PLACES).copy())
            at += buckets * PLACES * 2
        return cls(layers)

    def to_bytes(self) -> bytes:
        head = np.array([len(self.layers), *(len(x) for x in self.layers)], np.int32)
        return head.tobytes() + b"".join(x.tobytes() for x in self.layers)

    @staticmethod
    def _marks(keys: np.ndarray) -> np.ndarray:
        marks = (mixed(keys) >> np.uint64(48)).astype(np.uint16)
        return np.where(marks == 0, np.uint16(1), marks)

    @staticmethod
    def _other(bucket: np.ndarray, marks: np.ndarray, size: int) -> np.ndarray:
        return bucket ^ (mixed(marks.astype(np.uint64)) & np.uint64(size - 1)).astype(np.int64)

    def _buckets(self, keys: np.ndarray, marks: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        first = (keys & np.uint64(size - 1)).astype(np.int64)
        return first, self._other(first, marks, size)

    def contains(self, keys: np.ndarray) -> np.ndarray:
        marks, found = self._marks(keys), np.zeros(len(keys), bool)
        for table in self.layers:
            for bucket in self._buckets(keys, marks, len(table)):
                found |= (table[bucket] == marks[:, None]).any(axis=1)
        return found

    def insert(self, keys: np.ndarray) -> None:
        """Add keys that are not in the filter yet, once each."""
        while len(keys):
            table = self.layers[-1]
            room = max(0, int(table.size * MOST_FILLED) - int(np.count_nonzero(table)))
            now, keys = keys[:room], keys[room:]
            if len(now):
                attempt, marks = table.copy(), self._marks(now)
                if self._settle(attempt, self._buckets(now, marks, len(table))[0], marks):
                    self.layers[-1] = attempt
                else:  # an unlucky layer stays as it was and counts as full
                    keys = np.concatenate([now, keys])
                    self.layers.append(self._layer(2 * table.size))
            elif len(keys):
                self.layers.append(self._layer(2 * table.size))

    def _settle(self, table: np.ndarray, bucket: np.ndarray, marks: np.ndarray) -> bool:
        """Place fingerprints, all at a time, moving others to their second bucket; false if some are left."""
        size, draw = len(table), np.random.default_rng(len(marks))
        for _ in range(ROUNDS):
            for _ in range(2):
                order = np.argsort(bucket, kind="stable")
                bucket, marks = bucket[order], marks[order]
                # The n-th fingerprint of a bucket takes its n-th free place, if there is one.
                nth = np.arange(len(bucket)) - np.searchsorted(bucket, bucket)
                free = table[bucket] == 0
                fits = nth < free.sum(axis=1)
                place = np.argmax(np.cumsum(free[fits], axis=1) == nth[fits, None] + 1, axis=1)
                table[bucket[fits], place] = marks[fits]
                bucket, marks = bucket[~fits], marks[~fits]
                if not len(bucket):
                    return True
                bucket = self._other(bucket, marks, size)
            chosen, first = np.unique(bucket, return_index=True)
            place = draw.integers(0, PLACES, len(chosen))
            marks = marks.copy()
            marks[first], table[chosen, place] = table[chosen, place].copy(), marks[first]
            bucket[first] = self._other(chosen, marks[first], size)
        return False

    def delete(self, keys: np.ndarray) -> None:
        """Remove keys that are in the filter, once each.

        A fingerprint that more than one layer may hold stays, as one of them can be another key's:
        it costs a lookup, while a present key must never be missed.
        """
        marks = self._marks(keys)
        places = [self._buckets(keys, marks, len(table)) for table in self.layers]
        held = np.array([
            np.any([(table[bucket] == marks[:, None]).any(axis=1) for bucket in both], axis=0)
            for table, both in zip(self.layers, places, strict=True)
        ])
        alone = held.sum(axis=0) == 1
        for table, (first, _), here in zip(self.layers, places, held, strict=True):
            self._clear(table, first[here & alone], marks[here & alone])

    def _clear(self, table: np.ndarray, bucket: np.ndarray, marks: np.ndarray) -> None:
        """Empty one place for each fingerprint, in its bucket or else the other one."""
        for _ in range(2):
            pair = (bucket << 16) | marks
            order = np.argsort(pair, kind="stable")
            pair, bucket, marks = pair[order], bucket[order], marks[order]
            # The n-th of equal fingerprints takes the n-th place that holds one.
            nth = np.arange(len(pair)) - np.searchsorted(pair, pair)
            match = table[bucket] == marks[:, None]
            fits = nth < match.sum(axis=1)
            place = np.argmax(np.cumsum(match[fits], axis=1) == nth[fits, None] + 1, axis=1)
            table[bucket[fits], place] = 0
            bucket, marks = self._other(bucket[~fits], marks[~fits], len(table)), marks[~fits]
