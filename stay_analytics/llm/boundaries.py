"""Compressed sets of whole numbers with rank and select, in the manner of Roaring bitmaps.

Numbers are dealt by their high bits into containers of 65,536. A container is
kept in the smallest of three forms: an array of the low bits, a bitmap, or
runs (first, length). Cumulative cardinalities tell which container holds the
k-th member; a select inside the container gives its low bits.
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np

#: Members of a container share all but the lowest 16 bits.
SPAN = 1 << 16
ARRAY, BITMAP, RUNS = "array", "bitmap", "runs"
BITMAP_BYTES = SPAN // 8


def container(low: np.ndarray) -> tuple[str, tuple[np.ndarray, ...]]:
    """(form, parts) of sorted distinct low bits, none empty: the smallest form, an array on a tie."""
    first = np.flatnonzero(np.concatenate(([True], np.diff(low) != 1)))
    sizes = {ARRAY: 2 * len(low), BITMAP: BITMAP_BYTES, RUNS: 4 * len(first)}
    form = min(sizes, key=sizes.get)
    if form == ARRAY:
        return form, (low.astype(np.uint16),)
    if form == RUNS:
        lengths = np.diff(np.concatenate((first, [len(low)])))
        return form, (low[first].astype(np.uint16), np.cumsum(lengths))
    bits = np.zeros(SPAN, dtype=np.uint8)
    bits[low] = 1
    packed = np.packbits(bits, bitorder="little")
    return form, (packed, np.cumsum(np.bitwise_count(packed.view(np.uint64)).astype(np.int64)))


def select_in(form: str, parts: tuple[np.ndarray, ...], k: int) -> int:
    """Low bits of member ``k`` (from 0) of a container."""
    if form == ARRAY:
        return int(parts[0][k])
    place = int(np.searchsorted(parts[1], k, side="right"))
    k -= int(parts[1][place - 1]) if place else 0
    if form == RUNS:
        return int(parts[0][place]) + k
    word = np.unpackbits(parts[0][8 * place:8 * place + 8], bitorder="little")
    return 64 * place + int(np.flatnonzero(word)[k])


class BoundarySet:
    """A sorted set of whole numbers, added in ascending order container by container."""

    def __init__(self):
        self.high: list[int] = []
        self.containers: list[tuple[str, tuple[np.ndarray, ...]]] = []
        self.until: list[int] = []  # members up to and with each container

    def add_container(self, high: int, low: np.ndarray) -> None:
        """Adds the members high * SPAN + low; ``high`` ascends over the calls."""
        if len(low):
            self.high.append(high)
            self.containers.append(container(low))
            self.until.append(len(self) + len(low))

    def __len__(self) -> int:
        return self.until[-1] if self.until else 0

    def select(self, k: int) -> int:
        """Member ``k`` in ascending order, from 0."""
        at = int(np.searchsorted(self.until, k, side="right"))
        return self.high[at] * SPAN + select_in(*self.containers[at], k - (self.until[at - 1] if at else 0))


def boundary_set(members: Iterable[int]) -> BoundarySet:
    """The set of any whole numbers from 0."""
    values = np.unique(np.fromiter(members, dtype=np.int64))
    out = BoundarySet()
    for high in np.unique(values // SPAN):
        out.add_container(int(high), values[values // SPAN == high] % SPAN)
    return out


def unit_boundaries(text: str) -> BoundarySet:
    """Where the units `[A-Za-z]+|[^A-Za-z]` of a text begin, and its end, in code points; an empty text has 0 alone.

    One container's stretch of the text is decoded at a time.
    """
    out, n, after_letter = BoundarySet(), len(text), False
    for high in range(n // SPAN + 1):
        points = np.frombuffer(text[high * SPAN:(high + 1) * SPAN].encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        letter = ((points | np.uint32(32)) - np.uint32(97)) < 26
        begins = ~letter
        if len(letter):
            begins[0] |= not after_letter
            begins[1:] |= ~letter[:-1]
            after_letter = bool(letter[-1])
        low = np.flatnonzero(begins)
        out.add_container(high, np.append(low, n % SPAN) if high == n // SPAN else low)
    return out
