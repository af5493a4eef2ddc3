"""Vectorised hashes of byte and word windows over many texts at once (numpy)."""

from __future__ import annotations

import numpy as np

# Odd multipliers of a well-known 64-bit finaliser, and the base of the rolling hashes.
MIX_1, MIX_2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
BASE = 0x9E3779B97F4A7C15
MASK = (1 << 64) - 1


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every bit of the input changes about half the bits of the output."""
    x = x ^ (x >> np.uint64(30))
    x *= MIX_1
    x ^= x >> np.uint64(27)
    x *= MIX_2
    x ^= x >> np.uint64(31)
    return x


def window_hashes(values: np.ndarray, width: int, base: int = BASE) -> np.ndarray:
    """Rabin-Karp hash (mod 2**64) of every run of ``width`` values; position i covers values[i:i + width].

    Built by doubling: the hash of 2k values is hash(first k) * base**k +
    hash(next k), so a width needs about log2(width) passes. Empty if there
    are fewer values than ``width``.
    """
    n = len(values) - width + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    part, have = values.astype(np.uint64), 1  # hashes of runs of ``have`` values
    out, done = None, 0
    while True:
        if width & have:  # append this run to what is built so far
            tail = part[done:done + n]
            out = tail.copy() if out is None else out * np.uint64(pow(base, have, 1 << 64)) + tail
            done += have
        if have * 2 > width:
            return out
        part = part[:len(part) - have] * np.uint64(pow(base, have, 1 << 64)) + part[have:]
        have *= 2


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every run of ``width`` values, by doubling."""
    have = 1
    out = values
    while have * 2 <= width:
        out = np.minimum(out[:len(out) - have], out[have:])
        have *= 2
    if have < width:
        out = np.minimum(out[:len(out) - (width - have)], out[width - have:])
    return out


def splits_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of the texts in one array, and where each text starts (one more entry: the end)."""
    starts = np.zeros(len(texts) + 1, dtype=np.int64)
    np.cumsum([len(t) for t in texts], out=starts[1:])
    return np.frombuffer(b"".join(texts), dtype=np.uint8), starts


# The bytes that separate words, space and \x09-\x0D.
IS_SPACE = np.zeros(256, dtype=bool)
IS_SPACE[[9, 10, 11, 12, 13, 32]] = True
TO_LOWER = np.arange(256, dtype=np.uint8)
TO_LOWER[65:91] += 32


def word_hashes(data: np.ndarray, starts: np.ndarray, lower: bool = False, salt: int = 1) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words of texts laid end to end: (hash, first byte, end, text number) of each word, in order.

    ``lower`` folds A-Z. The hash of a word is the mixed prefix hash of its
    bytes and its length, so equal words have equal hashes wherever they stand.
    """
    n = len(data)
    if not n:
        z = np.zeros(0, dtype=np.int64)
        return np.zeros(0, dtype=np.uint64), z, z, z
    space = IS_SPACE[data]
    is_start, is_end = ~space, ~space
    edge = np.zeros(n + 1, dtype=bool)
    edge[starts] = True
    is_start = ~space
    is_start[1:] &= space[:-1] | edge[1:n]
    is_end[:-1] &= space[1:] | edge[1:n]
    first, end = np.flatnonzero(is_start), np.flatnonzero(is_end) + 1
    text = np.searchsorted(starts, first, side="right") - 1
    lengths = end - first
    folded = TO_LOWER[data] if lower else data
    # Words are read 8 bytes at a time: one gather per 8 bytes of the longest word.
    padded = np.concatenate((folded, np.zeros(8, dtype=np.uint8)))
    eight = np.lib.stride_tricks.as_strided(padded, shape=(n + 1, 8), strides=(1, 1))
    h = lengths.astype(np.uint64) * np.uint64(BASE) + np.uint64(salt)
    left, where = lengths, None
    at = first
    while True:
        block = np.ascontiguousarray(eight[at]).view(np.uint64)[:, 0]
        short = left < 8
        block[short] &= (np.uint64(1) << (left[short].astype(np.uint64) * np.uint64(8))) - np.uint64(1)
        if where is None:
            h = mix(h ^ block)
        else:
            h[where] = mix(h[where] * np.uint64(BASE) ^ block)
        more = np.flatnonzero(left > 8)
        if not len(more):
            return h, first, end, text
        where = more if where is None else where[more]
        at, left = at[more] + 8, left[more] - 8
