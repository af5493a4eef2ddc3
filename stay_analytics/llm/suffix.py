"""Removal of repeated byte strings with suffix arrays built by two-stage sorting.

A string of ``window`` bytes that also starts earlier in the corpus is removed.
Work narrows in steps, each of which loses nothing:

0. A document whose whole text a smaller one has is all repeat.
1. Windows whose anchor (see ``anchors``) occurs once cannot repeat.
2. The windows that share one anchor place form a segment. Of segments with
   equal bytes all but the first are removed whole; copies end here.
3. The remaining distinct segments that share an anchor are laid end to end in
   corpus order and sorted by a suffix array. Only suffixes smaller than their
   successors are sorted directly; the rest are induced by bucket scans.
   Neighbours with a common prefix of ``window`` bytes are equal strings, and
   all but the first of them are removed.

An anchor with too many distinct segments for one task (a passage with
thousands of surroundings) has its windows counted one by one in Spark instead.
Equality of segments in step 2 rests on two 64-bit hashes folded into one.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .anchors import TEXT_COLUMNS, keyed, repeated_segments, runs, window_anchors, with_copies
from .common import column, give_back, partitions_for, text_bytes
from .hashing import mix, splits_of, window_hashes

WINDOW_BYTES = 100
GRAM_BYTES = 24
#: Bytes that one suffix array holds, about; an anchor's segments are never parted.
BLOCK_BYTES = 1 << 18
#: Distinct segments of one anchor that go to one suffix array at most.
SEGMENTS_PER_ANCHOR = 16384
#: Longer texts are read in overlapping parts of so many bytes.
PART_BYTES = 4 << 20
#: Texts are hashed together up to about so many bytes; the arrays of a group stay in a core's cache.
GROUP_BYTES = 1 << 16

# --- suffix arrays ---------------------------------------------------------------------------------------------------


def packed(symbols: np.ndarray) -> np.ndarray:
    """Seven 9-bit symbols from each place on, as one number; zeros follow the end."""
    out = np.zeros(len(symbols), dtype=np.uint64)
    padded = np.concatenate((symbols, np.zeros(7, dtype=symbols.dtype)))
    for k in range(7):
        out <<= np.uint64(9)
        out |= padded[k:k + len(symbols)].astype(np.uint64)
    return out


def smaller_than_next(symbols: np.ndarray) -> np.ndarray:
    """Whether each suffix is smaller than the one after it; the last one is not."""
    n = len(symbols)
    differs = np.flatnonzero(symbols[:-1] != symbols[1:])
    following = np.searchsorted(differs, np.arange(n - 1))  # the type of equal neighbours is that of the next change
    out = np.zeros(n, dtype=bool)
    has = following < len(differs)
    at = differs[following[has]]
    out[:-1][has] = symbols[at] < symbols[at + 1]
    return out


def ranks(keys: np.ndarray) -> np.ndarray:
    """The rank of each key among the distinct keys, from 1."""
    order = np.argsort(keys)
    along = keys[order]
    out = np.empty(len(keys), dtype=np.uint64)
    out[order] = np.cumsum(np.concatenate(([True], along[1:] != along[:-1])))
    return out


def later(values: np.ndarray, by: int) -> np.ndarray:
    """The value ``by`` places on from each place; 0 beyond the end."""
    return np.concatenate((values[by:], np.zeros(min(by, len(values)), dtype=values.dtype)))


def run_ranks(words: np.ndarray, most: int) -> tuple[np.ndarray, int]:
    """Ranks of the runs of symbols from each place on, and the runs' length: 7, 14 or 28, over ``most`` only if 7 is.

    Ranks grow with the runs' order; what lies beyond the end is smaller than any symbol.
    """
    out, width = ranks(words), 7
    while width < 28 and 2 * width <= most:
        out = ranks((out << np.uint64(32)) | later(out, width))
        width *= 2
    return out, width


def sort_directly(places: np.ndarray, runs: np.ndarray, width: int, depth: int) -> np.ndarray:
    """``places`` in order of their suffixes, compared over the first ``depth`` symbols at least; ties by place.

    ``runs`` has the rank of the run of ``width`` symbols from each place on.
    """
    order, n = places.copy(), len(runs)
    if not len(order):
        return order
    bits = [np.uint64(int(x).bit_length()) for x in (len(order), runs.max())]
    tied, group = np.arange(len(order)), np.zeros(len(order), dtype=np.uint64)  # places yet to part, and the number of their group
    for done in range(0, depth, width):
        at = order[tied] + done
        key = (group << bits[1]) | np.where(at < n, runs[np.minimum(at, n - 1)], np.uint64(0))
        number = np.arange(len(tied), dtype=np.uint64)
        if int(key.max()).bit_length() + int(bits[0]) <= 64:  # one sort of plain numbers is much faster than one of places
            both = np.sort((key << bits[0]) | number)
            key, again = both >> bits[0], (both & ((np.uint64(1) << bits[0]) - np.uint64(1))).astype(np.int64)
        else:
            again = np.argsort(key, kind="stable")
            key = key[again]
        order[tied] = order[tied][again]
        new = np.concatenate(([True], key[1:] != key[:-1]))
        lone = new & np.concatenate((new[1:], [True]))
        tied, group = tied[~lone], np.cumsum(new)[~lone].astype(np.uint64)
        if not len(tied):
            break
        group = np.cumsum(np.concatenate(([False], group[1:] != group[:-1]))).astype(np.uint64)
    return order


def suffix_array(symbols: np.ndarray, depth: int, ranked: tuple[np.ndarray, int] | None = None) -> np.ndarray:
    """Places of the suffixes in order, by two-stage sorting; suffixes equal over ``depth`` symbols stand together.

    ``symbols`` are numbers from 0 to 256 and end with a 0, which stands for
    the end of a segment; ``ranked`` are their ``run_ranks``, if known.
    """
    n = len(symbols)
    small = np.flatnonzero(smaller_than_next(symbols))
    direct = sort_directly(small, *(ranked or run_ranks(packed(symbols), depth)), depth)
    heads = np.searchsorted(symbols[direct], np.arange(258))
    waiting: list[list[np.ndarray]] = [[] for _ in range(257)]
    waiting[int(symbols[-1])].append(np.array([n - 1]))
    out = []
    for c in range(257):
        # Larger than the next: those whose next suffix stands in an earlier bucket are here by now, in order; runs of c follow from them.
        induced = waiting[c]
        run = np.concatenate(induced) if induced else np.zeros(0, dtype=np.int64)
        parts = [run]
        while len(run):
            run = run[run > 0] - 1
            run = run[symbols[run] == c]
            parts.append(run)
        bucket = np.concatenate([*parts, direct[heads[c]:heads[c + 1]]])
        waiting[c] = []
        out.append(bucket)
        before = bucket[bucket > 0] - 1
        before = before[symbols[before] > c]
        if len(before):
            firsts = symbols[before]
            before = before[np.argsort(firsts, kind="stable")]
            counts = np.bincount(firsts, minlength=257)
            ends = np.cumsum(counts)
            for d in np.flatnonzero(counts):
                waiting[d].append(before[ends[d] - counts[d]:ends[d]])
    return np.concatenate(out)


def common_prefixes(symbols: np.ndarray, order: np.ndarray, most: int) -> np.ndarray:
    """Length of the common prefix of each suffix in order and the one before it, up to ``most``; 0 for the first."""
    n = len(symbols)
    words = packed(symbols)
    out = np.zeros(len(order), dtype=np.int64)
    for i in range(1, len(order), 1 << 17):  # in slices, for memory
        live = np.arange(i, min(i + (1 << 17), len(order)))
        for done in range(0, most, 7):
            a, b = order[live] + done, order[live - 1] + done
            inside = (a < n) & (b < n)
            x = words[np.minimum(a, n - 1)] ^ words[np.minimum(b, n - 1)]
            same = np.zeros(len(live), dtype=np.int64)
            for k in range(7):  # symbols equal from the front
                same += (x >> np.uint64(9 * (6 - k))) == 0
            out[live] += np.where(inside, same, 0)
            live = live[inside & (same == 7)]
            if not len(live):
                break
    return np.minimum(out, most)


def equal_neighbours(runs: np.ndarray, width: int, order: np.ndarray, depth: int) -> np.ndarray:
    """Whether each suffix in order and the one before it are equal over ``depth`` symbols, ``width`` at least; the first is not."""
    out = np.zeros(len(order), dtype=bool)
    same, n = np.arange(1, len(order)), len(runs)
    for done in [*range(0, depth - width, width), depth - width]:
        a, b = order[same] + done, order[same - 1] + done
        inside = (a < n) & (b < n)
        same = same[inside & (runs[np.minimum(a, n - 1)] == runs[np.minimum(b, n - 1)])]
    out[same] = True
    return out


def later_starts(segments: list[bytes], window: int = WINDOW_BYTES) -> list[np.ndarray]:
    """For segments in corpus order: the places in each where a string of ``window`` bytes starts that also starts earlier."""
    data, starts = splits_of(segments)
    symbols = np.zeros(len(data) + len(segments), dtype=np.int16)
    at = starts + np.arange(len(starts))  # a zero after each segment
    real = np.ones(len(symbols), dtype=bool)
    real[at[1:] - 1] = False
    symbols[real] = data.astype(np.int16) + 1
    ranked = run_ranks(packed(symbols), window)
    order = suffix_array(symbols, window, ranked)
    fresh = ~equal_neighbours(*ranked, order, window) if window >= ranked[1] else common_prefixes(symbols, order, window) < window
    # A class of equal strings holds no end of a segment within its window, or none of it counts.
    heads = np.flatnonzero(fresh)
    least = np.repeat(np.minimum.reduceat(order, heads), np.diff(np.concatenate((heads, [len(order)]))))
    repeated = np.sort(order[order != least])
    owner = np.searchsorted(at, repeated, side="right") - 1
    inside = repeated + window <= at[owner + 1] - 1
    repeated, owner = repeated[inside], owner[inside]
    bounds = np.searchsorted(owner, np.arange(len(segments) + 1))
    return [repeated[i:j] - at[k] for k, (i, j) in enumerate(zip(bounds[:-1], bounds[1:], strict=True))]


# --- segments --------------------------------------------------------------------------------------------------------


def byte_windows(texts: list[bytes], window: int, hashed: bool = False):
    """(row, first byte, anchor place, anchor, window hashes or None) of each text or part with at least one window."""
    gram = min(GRAM_BYTES, window)

    def of(group):
        data, starts = splits_of([t for _, _, t in group])
        place, anchor = window_anchors(data, window, gram)
        hashes = mix(window_hashes(data, window)) if hashed else None
        for k, (row, first, _) in enumerate(group):
            i, j = starts[k], starts[k + 1] - window + 1
            if j > i:
                yield row, first, place[i:j], anchor[i:j], None if hashes is None else hashes[i:j]

    group, size = [], 0
    for row, text in enumerate(texts):
        if not text or len(text) < window:
            continue
        if len(text) > PART_BYTES:
            for first in range(0, len(text) - window + 1, PART_BYTES):
                yield from of([(row, first, text[first:first + PART_BYTES + window - 1])])
            continue
        group.append((row, 0, text))
        size += len(text)
        if size >= GROUP_BYTES:
            yield from of(group)
            group, size = [], 0
    if group:
        yield from of(group)


def sliced(window: int):
    """(a, key, t, start, bytes): the bytes of the segments that a row lists."""
    names = ["a", "key", "t", "start", "bytes"]

    def run(batches):
        for part, texts in text_bytes(batches):
            keys, tags, lists = column(part, "key").to_pylist(), column(part, "t").to_pylist(), column(part, "segments")
            rows = [(x["a"], keys[r], tags[r], x["start"], texts[r][x["start"]:x["start"] + x["n"] - 1 + window])
                    for r in range(len(texts)) for x in lists[r].as_py() if x["t"] == tags[r]]
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in rows], kind) for k, kind in enumerate(
                (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()))], names=names)

    return run


REMOVED = "key bigint, t bigint, start bigint, n bigint"


def removed_batch(rows: list[tuple[int, int, int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.int64()) for k in range(4)], names=["key", "t", "start", "n"])


def sorted_repeats(window: int):
    """Removed stretches of start places among distinct segments; rows come with the segments of an anchor together."""
    def run(batches):
        def search(block):
            block.sort(key=lambda x: x[1:4])
            rows = []
            for (_, key, t, start, _), later in zip(block, later_starts([x[4] for x in block], window), strict=True):
                if len(later):
                    s = runs(later - np.arange(len(later)))
                    rows += [(key, t, start + int(later[i]), int(n)) for i, n in zip(s, np.diff(np.concatenate((s, [len(later)]))), strict=True)]
            return removed_batch(rows)

        block, size = [], 0
        for batch in batches:
            for row in zip(*[column(batch, c).to_pylist() for c in ("a", "key", "t", "start", "bytes")], strict=True):
                if size >= BLOCK_BYTES and row[0] != block[-1][0]:
                    yield search(block)
                    block, size = [], 0
                block.append(row)
                size += len(row[4])
        if block:
            yield search(block)
        give_back()

    return run


def hot_windows(window: int):
    """(h, key, t, start) of every window of the given segments."""
    def run(batches):
        for batch in batches:
            parts = [(mix(window_hashes(np.frombuffer(b, dtype=np.uint8), window)).view(np.int64), key, t, start)
                     for key, t, start, b in zip(*[column(batch, c).to_pylist() for c in ("key", "t", "start", "bytes")], strict=True)]
            counts = [len(p[0]) for p in parts]
            yield pa.RecordBatch.from_arrays([
                pa.array(np.concatenate([p[0] for p in parts]) if parts else np.zeros(0, np.int64)),
                *[pa.array(np.repeat(np.array([p[k] for p in parts], dtype=np.int64), counts)) for k in (1, 2)],
                pa.array(np.concatenate([p[3] + np.arange(len(p[0])) for p in parts]) if parts else np.zeros(0, np.int64))], names=["h", "key", "t", "start"])

    return run


def remove_repeated_bytes(docs: DataFrame, window: int = WINDOW_BYTES) -> DataFrame:
    """What is left of each text of ``docs`` (doc_id, text) when byte strings that start earlier are removed.

    Earlier is a smaller id, or an earlier place in the same document. Returns
    row (a struct of the columns of ``docs`` but ``text``), n_bytes, spans (maximal
    removed runs as [start, end) of bytes), kept (the remaining bytes) and
    kept_text (the remaining text: a character goes only if all its bytes do).
    A null text is empty, its kept_text too; texts shorter than ``window`` stay.
    A null id counts as the smallest. Rows of equal id and text are one
    document; rows of equal id and other texts follow each other by text hash.
    An empty table gives an empty result.
    """
    n_parts = partitions_for(docs)
    known = with_copies(docs, keyed(docs))
    texts = known.where(~F.col("copy"))
    segments = repeated_segments(texts, lambda data, hashed: byte_windows(data, window, hashed))
    # One value for all uses (a and n are the same within a content), so that the segments are made and shuffled once for them.
    first = segments.groupBy("g").agg(F.min(F.struct("key", "t", "start", "a", "n")).alias("first"))
    copies = segments.join(first, "g").where(F.struct("key", "t", "start") != F.struct("first.key", "first.t", "first.start")).select("key", "t", "start", "n")
    kinds = first.groupBy(F.col("first.a").alias("a")).agg(F.count("*").alias("c")).where("c > 1")
    open_ = first.select("first.*").join(kinds, "a").select("key", "t", "start", "a", "n", (F.col("c") > SEGMENTS_PER_ANCHOR).alias("hot"))
    def parts(hot):
        asked = open_.where(hot).groupBy("key").agg(F.collect_list(F.struct("t", "a", "start", "n")).alias("segments"))
        return texts.join(asked, "key").select(*TEXT_COLUMNS, "segments").mapInArrow(
            sliced(window), "a bigint, key bigint, t bigint, start bigint, bytes binary")

    sorted_ = parts(~F.col("hot")).repartition(n_parts, "a").sortWithinPartitions("a").mapInArrow(sorted_repeats(window), REMOVED)
    hot = parts(F.col("hot")).mapInArrow(hot_windows(window), "h bigint, key bigint, t bigint, start bigint")
    least = hot.groupBy("h").agg(F.min(F.struct("key", "t", "start")).alias("first"))
    counted = hot.join(least, "h").where(F.struct("key", "t", "start") != F.col("first")).select("key", "t", "start", F.lit(1).cast("long").alias("n"))
    removed = copies.union(sorted_).union(counted).groupBy("key").agg(F.collect_list(F.struct("t", "start", "n")).alias("gone"))
    row_type = texts.schema["row"].dataType.simpleString()

    def strip(batches):
        span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        for part, data in text_bytes(batches):
            rows, tags, gone = column(part, "row"), column(part, "t").to_pylist(), column(part, "gone")
            copies = column(part, "copy").to_pylist()
            out = []
            for r, text in enumerate(data):
                spans, kept, whole = [], [], []
                if copies[r] and len(text) >= window:
                    spans = [(0, len(text))]
                elif gone[r].is_valid:
                    fields = gone[r].values.flatten()
                    t, start, n = [np.asarray(f) for f in fields]
                    order = np.argsort(start[t == tags[r]], kind="stable")
                    start, n = start[t == tags[r]][order], n[t == tags[r]][order]
                    if len(start):
                        end = np.maximum.accumulate(start + n - 1 + window)
                        cut = np.flatnonzero(start[1:] > end[:-1])
                        spans = list(zip(start[np.concatenate(([0], cut + 1))].tolist(), end[np.concatenate((cut, [len(end) - 1]))].tolist(), strict=True))
                at = at_text = 0
                for i, j in spans:
                    kept.append(text[at:i])
                    while i < j and text[i] & 0xC0 == 0x80:  # a character that began before stays
                        i += 1
                    while j > i and j < len(text) and text[j] & 0xC0 == 0x80:  # and so does one that ends after
                        j -= 1
                    whole.append(text[at_text:i])
                    at, at_text = spans[len(kept) - 1][1], max(i, j)
                kept.append(text[at:])
                whole.append(text[at_text:])
                out.append((len(text), [{"start": i, "end": j} for i, j in spans], b"".join(kept), b"".join(whole).decode()))
            yield pa.RecordBatch.from_arrays([rows, *[pa.array([o[k] for o in out], kind) for k, kind in enumerate((pa.int64(), span, pa.binary(), pa.string()))]],
                                             names=["row", "n_bytes", "spans", "kept", "kept_text"])

    return known.join(removed, "key", "left").select(*TEXT_COLUMNS, "copy", "gone").mapInArrow(
        strip, f"row {row_type}, n_bytes bigint, spans array<struct<start: bigint, end: bigint>>, kept binary, kept_text string")
