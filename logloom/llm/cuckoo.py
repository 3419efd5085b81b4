"""A cuckoo filter in numpy: four 16-bit fingerprints per bucket.

A key lies in one of two buckets; the second is the first xor a hash of the
fingerprint, so either is found from the other and deleting needs no key.
Keys are inserted in rounds: those with room are placed, the rest evict a
fingerprint each and the evicted go on to their other bucket. Fingerprints
that find no place after ``ROUNDS`` go, with their bucket, into a stash that
is searched as well, so no key is ever missed.
"""

from __future__ import annotations

from collections import Counter

import numpy as np

SLOTS = 4
LOAD = 0.8
ROUNDS = 200
_MIX = np.uint64(0x9E3779B97F4A7C15)


def spread(x: np.ndarray) -> np.ndarray:
    """Mix 64-bit values so that all bits depend on all bits."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def fingerprints(keys: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprint (never 0) and first bucket of each key."""
    mixed = spread(keys.astype(np.int64).view(np.uint64))
    prints = (mixed >> np.uint64(48)).astype(np.uint16)
    return np.where(prints == 0, np.uint16(1), prints), (mixed & np.uint64(buckets - 1)).astype(np.int64)


def other(bucket: np.ndarray, prints: np.ndarray, buckets: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return bucket ^ ((prints.astype(np.uint64) * _MIX) >> np.uint64(20) & np.uint64(buckets - 1)).astype(np.int64)


def rank_within(values: np.ndarray) -> np.ndarray:
    """0, 1, 2 .. among equal values, in order of place."""
    order = np.argsort(values, kind="stable")
    ordered = values[order]
    first = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]])) if len(values) else np.zeros(0, np.int64)
    rank = np.empty(len(values), np.int64)
    rank[order] = np.arange(len(values)) - np.repeat(first, np.diff(np.concatenate([first, [len(values)]])))
    return rank


class CuckooFilter:
    def __init__(self, capacity: int = 0, table: bytes | None = None, stash: list[int] | None = None) -> None:
        if table is None:
            buckets = 1 << max(0, int(np.ceil(np.log2(max(1, capacity) / (SLOTS * LOAD)))))
            self.table = np.zeros((buckets, SLOTS), np.uint16)
        else:
            self.table = np.frombuffer(table, np.uint16).reshape(-1, SLOTS).copy()
        self.stash = np.array([] if stash is None else stash, np.int64)

    def insert(self, keys: np.ndarray) -> None:
        buckets = len(self.table)
        prints, at = fingerprints(keys, buckets)
        tried, pending = np.zeros(len(keys), bool), np.arange(len(keys))
        for turn in range(ROUNDS):
            free = self.table[at[pending]] == 0
            rank = rank_within(at[pending])
            fits = rank < free.sum(axis=1)
            slot = np.argsort(~free, axis=1, kind="stable")[np.arange(len(pending)), np.minimum(rank, SLOTS - 1)]
            put = pending[fits]
            self.table[at[put], slot[fits]] = prints[put]
            pending = pending[~fits]
            if not len(pending):
                return
            moved, stuck = pending[~tried[pending]], pending[tried[pending]]
            at[moved], tried[moved] = other(at[moved], prints[moved], buckets), True
            stuck = stuck[rank_within(at[stuck]) == 0]  # one eviction per bucket and round
            slot = (turn + at[stuck]) % SLOTS
            evicted = self.table[at[stuck], slot]
            self.table[at[stuck], slot] = prints[stuck]
            prints[stuck], at[stuck] = evicted, other(at[stuck], evicted, buckets)
        self.stash = np.concatenate([self.stash, at[pending] << 16 | prints[pending]])

    def contains(self, keys: np.ndarray) -> np.ndarray:
        prints, first = fingerprints(keys, len(self.table))
        found = np.zeros(len(prints), bool)
        for bucket in (first, other(first, prints, len(self.table))):
            found |= (self.table[bucket] == prints[:, None]).any(axis=1)
            if len(self.stash):
                found |= np.isin(bucket << 16 | prints, self.stash)
        return found

    def delete(self, keys: np.ndarray) -> None:
        """Take out keys that were inserted, each once.

        Keys with one fingerprint and one pair of buckets are alike, so the
        first of them takes the first copy in the pair, the next the next.
        """
        prints, first = fingerprints(keys, len(self.table))
        second = other(first, prints, len(self.table))
        low, high = np.minimum(first, second), np.maximum(first, second)
        turn = rank_within(low << 16 | prints)
        for bucket in (low, np.where(high > low, high, -1)):
            there = (self.table[bucket] == prints[:, None]) & (bucket >= 0)[:, None]
            here = np.flatnonzero((turn >= 0) & (turn < there.sum(axis=1)))
            slot = np.argsort(~there, axis=1, kind="stable")[here, turn[here]]
            turn = turn - there.sum(axis=1)
            self.table[bucket[here], slot] = 0
            turn[here] = -1
        if len(self.stash):
            lost = Counter((low << 16 | prints)[turn >= 0].tolist())
            pair = dict(zip((high << 16 | prints)[turn >= 0].tolist(), (low << 16 | prints)[turn >= 0].tolist()))
            kept = []
            for item in self.stash.tolist():
                name = pair.get(item, item)
                if lost[name] > 0:
                    lost[name] -= 1
                else:
                    kept.append(item)
            self.stash = np.array(kept, np.int64)

    @property
    def room(self) -> int:
        """Keys that fit before the filter should be built anew."""
        return int(self.table.size * LOAD)

    def to_bytes(self) -> bytes:
        return self.table.tobytes()
