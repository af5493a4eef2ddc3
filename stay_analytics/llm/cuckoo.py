"""Cuckoo filters with deletion, over batches of 64-bit hashes (numpy).

A member leaves a 16-bit mark in one of two buckets of four slots; either
bucket follows from the other and the mark. A member may be held up to twice,
and ``copies`` tells how often: never too few, and too many only where another
member has the same mark and buckets. Marks that find no slot go to an exact
overflow list, so nothing held is ever missed.
"""

from __future__ import annotations

import numpy as np

from .hashing import mix

SLOTS = 4
MOST_LOAD = 0.85
#: Rounds of moving marks before the rest goes to the overflow list.
MOST_MOVES = 200


class CuckooFilter:
    def __init__(self, members: int):
        """An empty filter with room for ``members`` marks."""
        buckets = 16
        while buckets * SLOTS * MOST_LOAD < members:
            buckets *= 2
        self.slots = np.zeros((buckets, SLOTS), dtype=np.uint16)
        self.overflow = np.zeros(0, dtype=np.uint64)
        self.held = 0

    @property
    def room(self) -> int:
        """Marks that may be added before the filter is too full."""
        return max(0, int(self.slots.size * MOST_LOAD) - self.held)

    def _places(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        h = mix(hashes.astype(np.uint64))
        marks = (np.uint64(1) + (h >> np.uint64(32)) % np.uint64(65535)).astype(np.uint16)
        return (h & np.uint64(len(self.slots) - 1)).astype(np.int64), marks

    def _other(self, buckets: np.ndarray, marks: np.ndarray) -> np.ndarray:
        return buckets ^ (mix(marks.astype(np.uint64)) & np.uint64(len(self.slots) - 1)).astype(np.int64)

    def _codes(self, buckets: np.ndarray, marks: np.ndarray) -> np.ndarray:
        """One number for a mark and its two buckets, from either bucket."""
        return np.minimum(buckets, self._other(buckets, marks)).astype(np.uint64) << np.uint64(16) | marks.astype(np.uint64)

    def _fill(self, buckets: np.ndarray, marks: np.ndarray) -> np.ndarray:
        """Puts marks into free slots of their buckets; returns which found none."""
        order = np.argsort(buckets, kind="stable")
        b = buckets[order]
        starts = np.flatnonzero(np.concatenate(([True], b[1:] != b[:-1])))
        turn = np.arange(len(b)) - np.repeat(starts, np.diff(np.concatenate((starts, [len(b)]))))
        free = np.cumsum(self.slots[b] == 0, axis=1)
        fits = turn < free[:, -1]
        slot = np.argmax(free == (turn + 1)[:, None], axis=1)
        self.slots[b[fits], slot[fits]] = marks[order][fits]
        rest = np.ones(len(b), dtype=bool)
        rest[order[fits]] = False
        return rest

    def add(self, hashes: np.ndarray) -> None:
        """Adds each hash once; the same hash at most twice in the filter's life."""
        if not len(hashes):
            return
        self.held += len(hashes)
        b, m = self._places(hashes)
        rest = self._fill(b, m)
        b, m = self._other(b[rest], m[rest]), m[rest]
        rng = np.random.default_rng(len(hashes))
        for _ in range(MOST_MOVES):
            if not len(b):
                return
            rest = self._fill(b, m)
            b, m = b[rest], m[rest]
            if len(b):  # one mark per full bucket takes a slot; the mark that was there moves to its other bucket
                _, one = np.unique(b, return_index=True)
                slot = rng.integers(0, SLOTS, len(one))
                moved = self.slots[b[one], slot]
                self.slots[b[one], slot] = m[one]
                m[one] = moved
                b[one] = self._other(b[one], moved)
        self.overflow = np.concatenate((self.overflow, self._codes(b, m)))

    def copies(self, hashes: np.ndarray) -> np.ndarray:
        """How often each hash seems to be held."""
        b, m = self._places(hashes)
        other = self._other(b, m)
        found = np.count_nonzero(self.slots[b] == m[:, None], axis=1)
        found += np.where(other != b, np.count_nonzero(self.slots[other] == m[:, None], axis=1), 0)
        if len(self.overflow):
            codes = np.sort(self.overflow)
            mine = self._codes(b, m)
            found += np.searchsorted(codes, mine, side="right") - np.searchsorted(codes, mine, side="left")
        return found

    def remove(self, hashes: np.ndarray) -> np.ndarray:
        """Takes one copy of each hash away; returns which were not found."""
        missing = np.zeros(len(hashes), dtype=bool)
        left = np.arange(len(hashes))
        b, m = self._places(hashes)
        codes = self._codes(b, m)
        while len(left):
            _, first = np.unique(codes[left], return_index=True)
            now = left[first]
            done = np.zeros(len(now), dtype=bool)
            for bucket in (b[now], self._other(b[now], m[now])):
                hit = self.slots[bucket] == m[now][:, None]
                take = hit.any(axis=1) & ~done
                self.slots[bucket[take], np.argmax(hit[take], axis=1)] = 0
                done |= take
            for k in now[~done]:
                at = np.flatnonzero(self.overflow == codes[k])
                missing[k] = not len(at)
                self.overflow = np.delete(self.overflow, at[:1])
            left = np.delete(left, first)
        self.held -= int((~missing).sum())
        return missing

    def to_bytes(self) -> bytes:
        return np.array([len(self.slots), len(self.overflow), self.held], dtype=np.int64).tobytes() + self.overflow.tobytes() + self.slots.tobytes()

    @classmethod
    def from_bytes(cls, data: bytes) -> CuckooFilter:
        out = cls.__new__(cls)
        buckets, over, out.held = (int(x) for x in np.frombuffer(data, dtype=np.int64, count=3))
        out.overflow = np.frombuffer(data, dtype=np.uint64, count=over, offset=24).copy()
        out.slots = np.frombuffer(data, dtype=np.uint16, offset=24 + 8 * over).reshape(buckets, SLOTS).copy()
        return out


class FilterChain:
    """Filters of one shard: when the last is full, a larger one is added, so members never have to be known again."""

    def __init__(self, filters: list[CuckooFilter] | None = None):
        self.filters = filters or []

    def add(self, hashes: np.ndarray) -> None:
        while len(hashes):
            if not self.filters or not self.filters[-1].room:
                self.filters.append(CuckooFilter(max(len(hashes), 2 * sum(f.held for f in self.filters[-1:]))))
            n = self.filters[-1].room
            self.filters[-1].add(hashes[:n])
            hashes = hashes[n:]

    def copies(self, hashes: np.ndarray) -> np.ndarray:
        return sum((f.copies(hashes) for f in self.filters), np.zeros(len(hashes), dtype=np.int64))

    def remove(self, hashes: np.ndarray) -> None:
        for f in reversed(self.filters):
            hashes = hashes[f.remove(hashes)]
