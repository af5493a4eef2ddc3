"""Removal of repeated passages: Rabin-Karp hashes of fixed-length word windows, counted in Spark.

Every window of a document has a rolling hash over its words. The smallest
document id is taken per hash; a window that also starts in a document of a
smaller id is removed, and removed windows merge into maximal intervals.

Four steps keep what is shuffled small, and none loses a window. A document
whose whole text a smaller one has is all repeat. Windows whose anchor (see ``anchors``) has one place only cannot repeat. The windows
that share an anchor place form a segment: a segment whose whole content also
stands in a smaller document is removed at once. Only the windows of the rest,
where an anchor has several contents, are counted one by one. Window hashes
have 64 bits.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .anchors import TEXT_COLUMNS, keyed, repeated_segments, window_anchors, with_copies
from .common import WORD_PATTERN, column, text_bytes
from .hashing import mix, splits_of, window_hashes, word_hashes

WINDOW_WORDS = 50
GRAM_WORDS = 12
WORD = re.compile(WORD_PATTERN.encode())
#: Longer texts are read in overlapping parts of about so many bytes.
PART_BYTES = 4 << 20


def parts_of(text: bytes, window: int, most: int) -> Iterator[tuple[int, bytes]]:
    """(first word number, part) of a long text: parts share window - 1 words with the next, so each window is in one of them."""
    words = [(m.start(), m.end()) for m in WORD.finditer(text)]
    i = 0
    while i < len(words):
        j = i + 1
        while j < len(words) and (words[j][1] - words[i][0] <= most or j - i < 2 * window):
            j += 1
        yield i, text[words[i][0]:words[j - 1][1]]
        if j == len(words):
            return
        i = j - (window - 1)


def text_windows(texts: list[bytes], window: int = WINDOW_WORDS, hashed: bool = True):
    """(row, first word number, anchor place, anchor, window hashes or None) of each text or part with at least one window."""
    gram = min(GRAM_WORDS, window)

    def of(group: list[tuple[int, int, bytes]]):
        data, starts = splits_of([t for _, _, t in group])
        words, _, _, text = word_hashes(data, starts)
        place, anchor = window_anchors(words, window, gram)
        hashes = mix(window_hashes(words, window)) if hashed else None
        bounds = np.searchsorted(text, np.arange(len(group) + 1))
        for k, (row, number, _) in enumerate(group):
            i, j = bounds[k], bounds[k + 1] - window + 1
            if j > i:
                yield row, number, place[i:j], anchor[i:j], None if hashes is None else hashes[i:j]

    group, size = [], 0
    for row, text in enumerate(texts):
        if text and len(text) <= PART_BYTES:
            group.append((row, 0, text))
            size += len(text)
            if size >= 1 << 20:
                yield from of(group)
                group, size = [], 0
        elif text:
            for number, part in parts_of(text, window, PART_BYTES):
                yield from of([(row, number, part)])
    if group:
        yield from of(group)


def listed_windows(window: int):
    """(h, key, t, start): every window of the segments that a row lists."""
    def run(batches):
        for part, texts in text_bytes(batches):
            keys, tags, lists = column(part, "key").to_pylist(), column(part, "t").to_pylist(), column(part, "segments")
            out: list[list[np.ndarray]] = [[] for _ in range(4)]
            for row, number, _, _, hashes in text_windows(texts, window):
                t, start, n = (np.asarray(f) for f in lists[row].values.flatten())
                own = (t == tags[row]) & (start >= number) & (start < number + len(hashes))
                wanted = np.zeros(len(hashes) + 1, dtype=np.int64)
                np.add.at(wanted, start[own] - number, 1)
                np.add.at(wanted, np.minimum(start[own] - number + n[own], len(hashes)), -1)
                at = np.flatnonzero(np.cumsum(wanted[:-1]))
                for k, v in enumerate((hashes[at].view(np.int64), np.full(len(at), keys[row]), np.full(len(at), tags[row]), at + number)):
                    out[k].append(v)
            if out[0]:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(v).astype(np.int64)) for v in out], names=["h", "key", "t", "start"])

    return run


def covered(starts: np.ndarray, window: int) -> list[tuple[int, int]]:
    """Maximal intervals [i, j) of the union of [s, s + window) over the sorted starts."""
    if not len(starts):
        return []
    breaks = np.flatnonzero(np.diff(starts) > window)
    return list(zip(starts[np.concatenate(([0], breaks + 1))].tolist(), (starts[np.concatenate((breaks, [len(starts) - 1]))] + window).tolist(), strict=True))


def remove_repeated_passages(docs: DataFrame, window: int = WINDOW_WORDS) -> DataFrame:
    """What is left of each document of ``docs`` (doc_id, text; other columns are ignored).

    Returns doc_id, n_words, n_removed, removed (maximal intervals of word
    numbers) and kept_text (the kept words joined by one space). Words are runs
    without white space (space, \\x09-\\x0D). A null text has no words; a text
    with fewer than ``window`` words keeps them all. A null id counts as
    smaller than any other; rows of equal id do not count against each other.
    An empty table gives an empty result.
    """
    plain = docs.select("doc_id", "text")
    known = with_copies(plain, keyed(plain))
    texts = known.where(~F.col("copy"))
    segments = repeated_segments(texts, lambda data, hashed: text_windows(data, window, hashed))
    # One value for all uses (a is the same within a content), so that the segments are made and shuffled once for them.
    least = segments.groupBy("g").agg(F.min(F.struct(F.col("key").alias("lo"), "a")).alias("least"))
    copies = segments.join(least, "g").where("key > least.lo").select("key", "t", "start", "n")
    # A content's smallest holder may still have windows of other contents of the same anchor, in smaller documents.
    several = least.groupBy(F.col("least.a").alias("a")).agg(F.count("*").alias("c")).where("c > 1").select("a")
    open_ = least.select("g", "least.*").join(several, "a").select("g", "lo")
    asked = segments.select("g", "key", "t", "start", "n").join(open_, "g").where("key = lo").groupBy("key").agg(
        F.collect_list(F.struct("t", "start", "n")).alias("segments"))
    counted = texts.join(asked, "key").select(*TEXT_COLUMNS, "segments").mapInArrow(listed_windows(window), "h bigint, key bigint, t bigint, start bigint")
    lowest = counted.groupBy("h").agg(F.min("key").alias("lo"))
    single = counted.join(lowest, "h").where("key > lo").select("key", "t", "start", F.lit(1).cast("long").alias("n"))
    removed = copies.union(single).groupBy("key").agg(F.collect_list(F.struct("t", "start", "n")).alias("gone"))
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def strip(batches):
        schema = None
        for part, data in text_bytes(batches):
            ids, tags, gone = column(part, "row").field("doc_id"), column(part, "t").to_pylist(), column(part, "gone")
            copies = column(part, "copy").to_pylist()
            schema = schema or pa.schema([("doc_id", ids.type), ("n_words", pa.int64()), ("n_removed", pa.int64()),
                                          ("removed", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), ("kept_text", pa.string())])
            out = []
            for row, text in enumerate(data):
                words, spans = text.split(), []
                if copies[row] and len(words) >= window:
                    spans = [(0, len(words))]
                elif gone[row].is_valid:
                    t, start, n = (np.asarray(f) for f in gone[row].values.flatten())
                    start, n = start[t == tags[row]], n[t == tags[row]]
                    spans = covered(np.sort(np.repeat(start, n) + (np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n))), window)
                kept, at = [], 0
                for i, j in spans:
                    kept += words[at:i]
                    at = j
                kept += words[at:]
                out.append((len(words), len(words) - len(kept), [{"start": i, "end": j} for i, j in spans], b" ".join(kept).decode()))
            yield pa.RecordBatch.from_arrays([ids, *[pa.array([o[k] for o in out], schema.field(k + 1).type) for k in range(4)]], schema=schema)

    return known.join(removed, "key", "left").select(*TEXT_COLUMNS, "copy", "gone").mapInArrow(
        strip, f"doc_id {id_type}, n_words bigint, n_removed bigint, removed array<struct<start: bigint, end: bigint>>, kept_text string")
