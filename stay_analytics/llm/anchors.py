"""Anchors: a few places of a text that every equal window finds again.

The anchor of a window is its smallest short-gram hash. Equal windows have
equal anchors at the same place inside them, and neighbouring windows mostly
share one, so a text has few anchors. A window whose anchor occurs nowhere
else cannot repeat. Repeat searches therefore count anchors first and look
only at windows whose anchor repeats; nothing is lost by it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import column, partitions_for, text_bytes
from .hashing import BASE, mix, sliding_min, window_hashes

TEXT_COLUMNS = ("key", "t", "text", "row")
LOW = np.uint64(0xFFFFFFFF)
#: Null ids come before all others.
NULL_KEY = -(1 << 63)


def window_anchors(values: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """(place, hash) of the anchor of each window of ``window`` values; the leftmost of equal hashes.

    Entry i is for values[i:i + window]; empty if there are fewer values.
    """
    if len(values) < window:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64)
    grams = mix(window_hashes(values, gram))
    at = (grams & ~LOW) | np.arange(len(grams), dtype=np.uint64)
    place = (sliding_min(at, window - gram + 1) & LOW).astype(np.int64)
    return place, grams[place]


def key_of(doc_id="doc_id"):
    """The id by which documents are ordered: nulls first."""
    return F.coalesce(F.col(doc_id).cast("long"), F.lit(NULL_KEY))


def keyed(docs: DataFrame) -> DataFrame:
    """(key, t, text, row) of ``docs`` dealt by key; used several times in a plan, it is shuffled once.

    t is a hash of the text, which tells rows of equal id apart; row holds the
    other columns; a null text is empty. All uses take all of TEXT_COLUMNS:
    with other columns the optimiser would plan another shuffle of the texts.
    """
    text = F.coalesce("text", F.lit(""))
    return docs.select(key_of().alias("key"), F.xxhash64(text).alias("t"), text.alias("text"), F.struct(*[
        F.col(f"`{c}`") for c in docs.columns if c != "text"]).alias("row")).repartition(partitions_for(docs), "key")


def with_copies(docs: DataFrame, texts: DataFrame) -> DataFrame:
    """``texts``, which is ``keyed(docs)``, with the boolean ``copy``: a document of a smaller key has the same text.

    Texts are compared by 128 bits of hashes; only keys and hashes are shuffled.
    """
    text = F.coalesce("text", F.lit(""))
    hashes = docs.select(key_of().alias("key"), F.xxhash64(text).alias("t"), F.xxhash64(F.lit("copy"), text).alias("u"))
    least = hashes.groupBy("t", "u").agg(F.min("key").alias("lo"), F.count("*").alias("c")).where("c > 1")
    later = hashes.join(least, ["t", "u"]).where("key > lo").groupBy("key").agg(F.collect_set("t").alias("copied"))
    return texts.join(later, "key", "left").withColumn("copy", F.coalesce(F.array_contains("copied", F.col("t")), F.lit(False))).drop("copied")


def runs(values: np.ndarray) -> np.ndarray:
    """Where each run of equal values starts."""
    return np.flatnonzero(np.concatenate(([True], values[1:] != values[:-1])))


def anchor_rows(windows):
    """(key, h): a row for each anchor place, at most two for a stretch of equal anchors.

    ``windows(texts, hashed)`` yields (row, first, place, anchor, hashes) of
    each text or part: the number of its first window, and of each window the
    anchor's place and hash and, if hashed, the window's own hash.
    """
    def run(batches):
        for part, texts in text_bytes(batches):
            keys = column(part, "key").to_pylist()
            k_out, h_out = [], []
            for row, _, place, anchor, _ in windows(texts, False):
                h = anchor[runs(place)]
                h = h[np.concatenate((np.ones(min(2, len(h)), bool), (h[2:] != h[1:-1]) | (h[2:] != h[:-2])))]
                k_out.append(np.full(len(h), keys[row], dtype=np.int64))
                h_out.append(h.view(np.int64))
            if k_out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(k_out)), pa.array(np.concatenate(h_out))], names=["key", "h"])

    return run


def segment_rows(windows):
    """(a, g, key, t, start, n): the segments of listed anchors.

    A segment is a run of n windows with one anchor place; a is the anchor, g
    stands for the segment's content. First and last window overlap or touch,
    so their hashes together stand for all of it.
    """
    def run(batches):
        for part, texts in text_bytes(batches):
            keys, tags, lists = column(part, "key").to_pylist(), column(part, "t").to_pylist(), column(part, "listed")
            out: list[list[np.ndarray]] = [[] for _ in range(6)]
            for row, first, place, anchor, hashes in windows(texts, True):
                s = runs(place)
                n = np.diff(np.concatenate((s, [len(place)])))
                wanted = np.isin(anchor[s], np.asarray(lists[row].values).view(np.uint64))
                s, n = s[wanted], n[wanted]
                g = mix(mix(hashes[s]) * np.uint64(BASE) ^ hashes[s + n - 1] + n.astype(np.uint64))
                for k, v in enumerate((anchor[s].view(np.int64), g.view(np.int64), np.full(len(s), keys[row]), np.full(len(s), tags[row]), s + first, n)):
                    out[k].append(v)
            if out[0]:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(v).astype(np.int64)) for v in out], names=["a", "g", "key", "t", "start", "n"])

    return run


def repeated_segments(texts: DataFrame, windows) -> DataFrame:
    """(a, g, key, t, start, n): segments of all anchors of ``texts`` (key, t, text) that have two places or more."""
    anchors = texts.select(*TEXT_COLUMNS).mapInArrow(anchor_rows(windows), "key bigint, h bigint")
    shared = anchors.groupBy("h").agg(F.count("*").alias("c")).where("c > 1").select("h")
    lists = anchors.join(shared, "h").groupBy("key").agg(F.collect_set("h").alias("listed"))
    # No g is null; said here, the filter that joins on g infer is the same for all uses, and one shuffle serves them.
    return texts.join(lists, "key").select(*TEXT_COLUMNS, "listed").mapInArrow(
        segment_rows(windows), "a bigint, g bigint, key bigint, t bigint, start bigint, n bigint").where("g IS NOT NULL")
