"""Near-duplicate documents by min-max hashing, confirmed on full shingle sets.

Each permutation of the shingle hashes gives two signature values, its minimum
and its maximum, so a signature of 2k values costs k hash evaluations per
shingle. Bands of the signature bring candidates together; the links between
them are computed exactly, on whole shingle sets, inside units of bounded
size; the links' connected components are the groups.

Documents of equal sets are one class from the start. Candidates are linked to
the smallest class of their bucket only, never pairwise; the components of
these candidate links are the units. A component too large for one task is
verified bucket by bucket, and a bucket too large for one task by pairs of
blocks, so that no pair of classes that share a bucket is left out.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stay_analytics.session import cut_lineage, written_once

from .anchors import NULL_KEY, key_of, keyed
from .common import column, give_back, partitions_for, text_bytes
from .components import components
from .hashing import BASE, mix, splits_of, window_hashes, word_hashes

SHINGLE_WORDS = 3
#: Links have 100 * intersection >= THRESHOLD * union.
THRESHOLD = 85
#: 32 bands of 3 permutations, 6 values each: a pair of similarity 0.85 is missed with probability (1 - 0.85**6)**32 < 1e-6.
BANDS, PER_BAND = 32, 3
#: A unit of verification holds at most so many classes and shingles, but two classes at least.
UNIT_CLASSES, UNIT_SHINGLES = 4096, 1_000_000


def shingle_sets(texts: list[bytes], width: int = SHINGLE_WORDS) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text: ``width`` words with A-Z folded, or all words if there are fewer."""
    data, starts = splits_of(texts)
    words, _, _, text = word_hashes(data, starts, lower=True)
    bounds = np.searchsorted(text, np.arange(len(texts) + 1))
    hashes = mix(window_hashes(words, width))
    out = []
    for i, j in zip(bounds[:-1], bounds[1:], strict=True):
        if j - i >= width:
            out.append(np.unique(hashes[i:j - width + 1]))
        else:
            out.append(mix(window_hashes(words[i:j], j - i) + np.uint64(j - i)) if j > i else np.zeros(0, dtype=np.uint64))
    return out


def permutations(n: int, seed: int = 11) -> tuple[np.ndarray, np.ndarray]:
    """Odd multipliers and offsets of n permutations of the 64-bit hashes."""
    rng = np.random.default_rng(seed)
    return rng.integers(0, 1 << 64, n, dtype=np.uint64) | np.uint64(1), rng.integers(0, 1 << 64, n, dtype=np.uint64)


def band_keys(sets: list[np.ndarray], bands: int = BANDS, per_band: int = PER_BAND) -> np.ndarray:
    """One 64-bit key per set (none empty) and band: the hash of the minima and maxima of its permutations."""
    flat = np.concatenate(sets)
    starts = np.concatenate(([0], np.cumsum([len(s) for s in sets])[:-1]))
    times, plus = permutations(bands * per_band)
    keys = np.empty((len(sets), bands), dtype=np.uint64)
    for band in range(bands):
        key = np.full(len(sets), band, dtype=np.uint64)
        for p in range(band * per_band, (band + 1) * per_band):
            moved = flat * times[p] + plus[p]
            for values in (np.minimum.reduceat(moved, starts), np.maximum.reduceat(moved, starts)):
                key = mix(key * np.uint64(BASE) ^ values)
        keys[:, band] = key
    return keys


def signature_rows(width: int):
    """(key, doc_id, n, s1, s2, bands): size and 128-bit digest of the shingle set, and its band keys."""
    def run(batches):
        for part, texts in text_bytes(batches):
            ids, keys = (column(part, c) for c in ("doc_id", "key"))
            sets = shingle_sets([t or b"" for t in texts], width)
            full = [k for k, s in enumerate(sets) if len(s)]
            n = np.array([len(s) for s in sets], dtype=np.int64)
            digests = np.zeros((2, len(sets)), dtype=np.uint64)
            bands: list = [None] * len(sets)
            if full:
                some = [sets[k] for k in full]
                flat, starts = np.concatenate(some), np.concatenate(([0], np.cumsum([len(s) for s in some])[:-1]))
                for k in (0, 1):
                    digests[k, full] = np.add.reduceat(mix(flat ^ np.uint64(BASE >> (k + 1))), starts)
                for k, row in zip(full, band_keys(some).view(np.int64), strict=True):
                    bands[k] = row
            yield pa.RecordBatch.from_arrays([keys, ids, pa.array(n), *[pa.array(d.view(np.int64)) for d in digests], pa.array(bands, pa.list_(pa.int64()))],
                                             names=["key", "doc_id", "n", "s1", "s2", "bands"])

    return run


def set_rows(width: int):
    """(unit, whole, key, shingles): the full shingle set of each member of a unit, as bytes."""
    def run(batches):
        for part, texts in text_bytes(batches):
            known = [column(part, c) for c in ("unit", "whole", "key")]
            yield pa.RecordBatch.from_arrays([*known, pa.array([s.tobytes() for s in shingle_sets(texts, width)], pa.binary())], names=["unit", "whole", "key", "shingles"])

    return run


def linked_pairs(sets: list[np.ndarray], threshold: int = THRESHOLD) -> list[tuple[int, int]]:
    """A forest of the exact links among the sets: pairs that span each group of linked sets."""
    n = np.array([len(s) for s in sets])
    order = np.argsort(np.concatenate(sets), kind="stable")
    shingle = np.concatenate(sets)[order]
    owner = np.repeat(np.arange(len(sets)), n)[order]
    first = np.flatnonzero(np.concatenate(([True], shingle[1:] != shingle[:-1])))
    last = np.concatenate((first[1:], [len(shingle)]))
    of = np.empty(len(order), dtype=np.int64)  # for each entry of the sets laid end to end: its run in ``owner``
    of[order] = np.repeat(np.arange(len(first)), last - first)
    ends = np.cumsum(n)
    group = np.arange(len(sets))
    out = []
    for i in range(len(sets) - 1):
        runs = of[ends[i] - n[i]:ends[i]]
        a, z = first[runs], last[runs]
        lengths = z - a
        many = lengths > 1
        a, lengths = a[many], lengths[many]
        if not len(a):
            continue
        at = np.repeat(a - np.concatenate(([0], np.cumsum(lengths)[:-1])), lengths) + np.arange(lengths.sum())
        common = np.bincount(owner[at], minlength=len(sets))
        link = np.flatnonzero(100 * common >= threshold * (n + n[i] - common))
        for j in link[(link > i) & (group[link] != group[i])]:
            if group[j] != group[i]:
                out.append((i, int(j)))
                group[group == group[j]] = group[i]
    return out


def least_of(links: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """(key, smallest key of its group) of the keys that the links join, but for the smallest keys themselves."""
    up: dict[int, int] = {}

    def top(x):
        while up.setdefault(x, x) != x:
            up[x] = x = up[up[x]]
        return x

    for pair in links:
        a, b = sorted(map(top, pair))
        up[b] = a
    return [(x, top(x)) for x in up if top(x) != x]


def verify(threshold: int):
    """(a, b, whole): exact links inside each unit; rows come sorted by unit.

    A whole unit holds every link of its classes, so b is the smallest key of the group of a there.
    """
    def run(batches):
        def links(keys, sets, whole):
            found = [(keys[i], keys[j]) for i, j in linked_pairs(sets, threshold)] if len(keys) > 1 else []
            found = least_of(found) if whole else found
            return pa.RecordBatch.from_arrays([*[pa.array([f[k] for f in found], pa.int64()) for k in (0, 1)], pa.array([whole] * len(found), pa.bool_())],
                                              names=["a", "b", "whole"])

        unit, keys, sets = None, [], []
        for batch in batches:
            for *u, key, data in zip(*[column(batch, c).to_pylist() for c in ("unit", "whole", "key", "shingles")], strict=True):
                if u != unit:
                    if len(keys) > 1:
                        yield links(keys, sets, unit[1])
                    unit, keys, sets = u, [], []
                keys.append(key)
                sets.append(np.frombuffer(data, dtype=np.uint64))
        if len(keys) > 1:
            yield links(keys, sets, unit[1])
        give_back()

    return run


def units_of(classes: DataFrame, cells: DataFrame) -> DataFrame:
    """(unit, whole, key): which classes are verified together, and whether they are a whole component. See the module's text for large components and buckets."""
    members = cells.join(classes.select(F.col("rep").alias("node"), "n", "bands"), "node")
    sizes = cells.join(classes.select(F.col("rep").alias("node"), "n"), "node").groupBy("root").agg(F.count("*").alias("c"), F.sum("n").alias("total"))
    members = members.join(sizes, "root")
    large = (F.col("c") > 2) & ((F.col("c") > UNIT_CLASSES) | (F.col("total") > UNIT_SHINGLES))
    whole = members.where(~large).select(F.col("root").alias("unit"), F.lit(True).alias("whole"), F.col("node").alias("key"))
    buckets = members.where(large).select(F.explode("bands").alias("band"), F.col("node").alias("key"), "n")
    sizes = buckets.groupBy("band").agg(F.count("*").alias("c"), F.sum("n").alias("total")).where("c > 1") \
        .withColumn("blocks", F.greatest(F.ceil(2 * F.col("c") / UNIT_CLASSES), F.ceil(2 * F.col("total") / UNIT_SHINGLES)))
    sizes = sizes.withColumn("blocks", F.when((F.col("c") <= UNIT_CLASSES) & (F.col("total") <= UNIT_SHINGLES), 1).otherwise(F.least("blocks", "c")).cast("int"))
    block = F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int")
    other = buckets.join(sizes, "band").withColumn("block", block).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    split = other.select(F.xxhash64(F.lit("bucket"), "band", F.least("block", "other"), F.greatest("block", "other")).alias("unit"), F.lit(False).alias("whole"), "key")
    return whole.union(split)


def near_duplicates(docs: DataFrame, width: int = SHINGLE_WORDS, threshold: int = THRESHOLD) -> DataFrame:
    """Groups of near duplicates: one row per row of ``docs`` (doc_id, text; other columns are ignored).

    Returns doc_id, n_shingles, component_id (smallest id of its group) and
    kept (doc_id = component_id). Words are runs without white space (space,
    \\x09-\\x0D) with A-Z folded. A null or empty text, or one without words,
    has no shingles and is alone. Ids should be unique: rows that share an id
    are judged by their own texts, but classes they both represent are joined.
    A null id counts as the smallest. An empty table gives an empty result.
    """
    id_type = docs.schema["doc_id"].dataType.simpleString()
    rows = cut_lineage(docs.select(key_of().alias("key"), "doc_id", "text").mapInArrow(
        signature_rows(width), f"key bigint, doc_id {id_type}, n bigint, s1 bigint, s2 bigint, bands array<bigint>"))
    # Equal sets have equal bands, so any row's will do.
    classes = rows.where("n > 0").groupBy("s1", "s2", "n").agg(F.min("key").alias("rep"), F.first("bands").alias("bands"))
    bands = classes.select("rep", F.explode("bands").alias("band"))
    buckets = bands.groupBy("band").agg(F.min("rep").alias("lo"), F.count("*").alias("c")).where("c > 1").select("band", "lo")
    cells = components(bands.join(buckets, "band").where("rep <> lo").select("rep", "lo"))
    texts = keyed(docs.select("doc_id", "text"))
    members = texts.join(units_of(classes, cells), "key").select("unit", "whole", "key", "text").mapInArrow(set_rows(width), "unit bigint, whole boolean, key bigint, shingles binary")
    links = written_once(members.repartition(partitions_for(docs), "unit").sortWithinPartitions("unit", "whole").mapInArrow(
        verify(threshold), "a bigint, b bigint, whole boolean"))
    # What a whole component's task has found is final; only the links of parted components meet across tasks.
    groups = links.where("whole").select(F.col("a").alias("node"), F.col("b").alias("root")).union(components(links.where("NOT whole").select("a", "b")))
    known = classes.join(groups, classes.rep == groups.node, "left").select("s1", "s2", "n", F.coalesce("root", "rep").alias("root"))
    found = F.coalesce("root", "key")
    return rows.drop("bands").join(known, ["s1", "s2", "n"], "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.when(found != NULL_KEY, found).cast(id_type).alias("component_id"), (F.col("key") == found).alias("kept"))
