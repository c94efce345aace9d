"""A cuckoo filter: a set of fingerprints that can be added to, taken from and stored.

Keys are digests of 16 bytes, as pairs of unsigned 64-bit numbers.  A key's fingerprint is
32 bits of it and may lie in either of two buckets of four slots, each of which is found
from the other and the fingerprint.  A key that was added is always found, until it is
removed; any other key is found with a probability of some 2e-9.
"""

from __future__ import annotations

import random

import numpy as np

SLOTS = 4
#: Moves of one insertion before the table counts as full.
MOST_MOVES = 500


def pairs(digests: bytes) -> np.ndarray:
    """Digests of 16 bytes end to end as an array of two numbers each."""
    return np.frombuffer(digests, "<u8").reshape(-1, 2)


_FACTOR = 0x9E3779B97F4A7C15


def _spread(fingerprint: np.ndarray) -> np.ndarray:
    return (fingerprint.astype(np.uint64) * np.uint64(_FACTOR)) >> np.uint64(24)


class CuckooFilter:
    def __init__(self, slots: np.ndarray):
        """``slots``: 4 x 2^n fingerprints, 0 where a slot is free."""
        self.slots = slots.reshape(-1, SLOTS)

    @classmethod
    def sized(cls, n_keys: int) -> CuckooFilter:
        """An empty filter with room for so many keys."""
        buckets = 1 << max(0, int(np.ceil(np.log2(max(n_keys, 1) / (0.85 * SLOTS)))))
        return cls(np.zeros(buckets * SLOTS, np.uint32))

    @classmethod
    def built(cls, keys: np.ndarray) -> CuckooFilter:
        room = len(keys)
        while not (made := cls.sized(room)).add(keys):
            room = 2 * room + 1
        return made

    @classmethod
    def stored(cls, raw: bytes) -> CuckooFilter:
        return cls(np.frombuffer(raw, np.uint32).copy())

    def raw(self) -> bytes:
        return self.slots.tobytes()

    def __len__(self) -> int:
        return int(np.count_nonzero(self.slots))

    def _places(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        mask = np.uint64(len(self.slots) - 1)
        fingerprint = np.maximum(keys[:, 1] & np.uint64(0xFFFFFFFF), np.uint64(1)).astype(np.uint32)
        first = keys[:, 0] & mask
        return fingerprint, first, (first ^ _spread(fingerprint)) & mask

    def contains(self, keys: np.ndarray) -> np.ndarray:
        fingerprint, first, second = self._places(keys)
        at = lambda bucket: (self.slots[bucket.astype(np.int64)] == fingerprint[:, None]).any(axis=1)
        return at(first) | at(second)

    def add(self, keys: np.ndarray) -> bool:
        """Put every key in once more; False if there was no room, after which the filter is of no use."""
        mask, rng = len(self.slots) - 1, random.Random(len(keys))
        table = self.slots.tolist()
        fingerprints, firsts, seconds = (x.tolist() for x in self._places(keys))
        for held, bucket, other in zip(fingerprints, firsts, seconds):
            for there in (bucket, other):
                if 0 in table[there]:
                    table[there][table[there].index(0)] = held
                    break
            else:
                there = rng.choice((bucket, other))
                for _ in range(MOST_MOVES):
                    slot = rng.randrange(SLOTS)
                    held, table[there][slot] = table[there][slot], held
                    there = (there ^ ((held * _FACTOR & 0xFFFFFFFFFFFFFFFF) >> 24)) & mask
                    if 0 in table[there]:
                        table[there][table[there].index(0)] = held
                        break
                else:
                    return False
        self.slots = np.array(table, np.uint32).reshape(-1, SLOTS)
        return True

    def remove(self, keys: np.ndarray) -> None:
        """Take every key, each of which must have been added, out once."""
        table = self.slots.tolist()
        for held, bucket, other in zip(*(x.tolist() for x in self._places(keys))):
            there = bucket if held in table[bucket] else other
            table[there][table[there].index(held)] = 0
        self.slots = np.array(table, np.uint32).reshape(-1, SLOTS)
