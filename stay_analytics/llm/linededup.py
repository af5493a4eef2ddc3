"""Line dedup with sharded cuckoo filters in front of exact reference-count tables.

The index of a corpus has three parts. ``references`` has a row per document
and distinct line key. ``counts`` has, per key, the number of those rows and
the smallest and largest document id: exact, and the only thing that decides.
``filters`` has a row per shard of the keys with its cuckoo filters, in which a
key that one document holds is kept once and a key that several hold twice.

Documents may be inserted and deleted at any time. The filters tell which keys
of an insertion the index may already hold, so only these meet the counts; when
duplicates are dropped they tell which lines may be held by several documents,
so lines of one document alone never reach the exact join. A deletion takes the
document's references away, and lines that it caused to be dropped come back.

Rows of a very frequent line are never brought to one task: counts are
aggregated before the shuffle, and keys with at least 1 in ``HOT`` of all
references, of which there are at most ``HOT``, are joined by broadcast.
"""

from __future__ import annotations

from dataclasses import dataclass, replace
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stay_analytics.session import cut_lineage

from .anchors import key_of
from .common import column, partitions_for, text_bytes
from .cuckoo import CuckooFilter, FilterChain

#: White space stripped from keys, and the fold of A-Z.
BLANKS = b"\x20\x09\x0a\x0b\x0c\x0d"
FOLD = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
#: Shorter keys, in code points, are never dropped.
LEAST_CHARS = 10
#: Keys with at least 1 in HOT of all references are joined by broadcast: at most HOT rows.
HOT = 1024
SHARDS_PER_PARTITION = 8


def line_key(line: bytes) -> bytes | None:
    """128-bit digest of a line's key; None if the key is too short to be dropped."""
    key = line.strip(BLANKS).translate(FOLD)
    if len(key) < LEAST_CHARS or (len(key) < 4 * LEAST_CHARS and len(key.decode("utf-8", "replace")) < LEAST_CHARS):
        return None
    return blake2b(key, digest_size=16).digest()


def line_references(docs: DataFrame) -> DataFrame:
    """(key, t, h1, h2): each distinct line key of every row; key is the id, nulls first, and t a hash of the text."""
    def run(batches):
        for part, texts in text_bytes(batches):
            digests, counts = [], np.zeros(len(texts), dtype=np.int64)
            for k, text in enumerate(texts):
                own = {d for d in map(line_key, (text or b"").split(b"\n")) if d}
                digests.extend(own)
                counts[k] = len(own)
            h = np.frombuffer(b"".join(digests), dtype=np.int64).reshape(-1, 2)
            at = pa.array(np.repeat(np.arange(len(texts)), counts))
            yield pa.RecordBatch.from_arrays([column(part, "key").take(at), column(part, "t").take(at), pa.array(h[:, 0].copy()), pa.array(h[:, 1].copy())],
                                             names=["key", "t", "h1", "h2"])

    return docs.select(*row_key(), "text").mapInArrow(run, "key bigint, t bigint, h1 bigint, h2 bigint")


def row_key():
    return key_of().alias("key"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("t")


def count_table(references: DataFrame) -> DataFrame:
    """(h1, h2, n_docs, lo, hi): per key its references and the ids at both ends; summed up before the shuffle."""
    return references.groupBy("h1", "h2").agg(F.count("*").alias("n_docs"), F.min("key").alias("lo"), F.max("key").alias("hi"))


def held(lo="lo", hi="hi"):
    """How often the filters keep a key: once for one document, twice for more, never if none holds it."""
    return F.when(F.col(lo).isNull(), 0).when(F.col(lo) < F.col(hi), 2).otherwise(1)


@dataclass(frozen=True)
class LineIndex:
    """See the module's text. ``shards`` is fixed when the index is made."""

    references: DataFrame
    counts: DataFrame
    filters: DataFrame
    shards: int


def with_filters(rows: DataFrame, filters: DataFrame, shards: int) -> DataFrame:
    """``rows`` (h1, ...) in the tasks of their shards, each shard's filters first."""
    rows = rows.withColumn("shard", F.pmod("h1", F.lit(shards)).cast("int"))
    both = rows.unionByName(filters, allowMissingColumns=True).withColumn("later", F.col("filters").isNull())
    return both.repartition(partitions_for(rows), "shard").sortWithinPartitions("shard", "later")


def by_shard(batches):
    """(shard, chain or None, batch or None): a shard's filters when they are met, and slices of its rows."""
    for batch in batches:
        shard = column(batch, "shard").to_numpy()
        first = column(batch, "later").to_numpy(zero_copy_only=False) == 0
        cuts = np.flatnonzero(np.concatenate(([True], (shard[1:] != shard[:-1]) | (first[1:] != first[:-1])))) if len(shard) else np.zeros(0, dtype=np.int64)
        for i, j in zip(cuts, np.append(cuts[1:], len(shard)), strict=True):
            if first[i]:
                chain = FilterChain([CuckooFilter.from_bytes(f) for f in column(batch, "filters")[int(i)].as_py()])
                yield int(shard[i]), chain, None
            else:
                yield int(shard[i]), None, batch.slice(i, j - i)


def probe(rows: DataFrame, filters: DataFrame, shards: int) -> DataFrame:
    """``rows`` (h1, ...) with ``seen``: how often the filters seem to keep the key, never too few."""
    names = rows.columns

    def run(batches):
        of, chain = None, FilterChain()
        for shard, found, part in by_shard(batches):
            if shard != of:
                of, chain = shard, FilterChain()
            if part is None:
                chain = found
                continue
            seen = chain.copies(column(part, "h1").to_numpy())
            yield pa.RecordBatch.from_arrays([*[column(part, c) for c in names], pa.array(seen.astype(np.int32))], names=[*names, "seen"])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema)
    return with_filters(rows, filters, shards).mapInArrow(run, f"{schema}, seen int")


def change_filters(changes: DataFrame, filters: DataFrame, shards: int) -> DataFrame:
    """The filters (shard, filters) after ``changes`` (h1, step): so many copies more or, below 0, fewer."""
    def run(batches):
        of, chain, steps = None, FilterChain(), []

        def changed():
            h, step = (np.concatenate([s[k] for s in steps]) if steps else np.zeros(0, dtype=np.int64) for k in (0, 1))
            chain.remove(np.repeat(h, np.maximum(-step, 0)))
            chain.add(np.repeat(h, np.maximum(step, 0)))
            return pa.RecordBatch.from_arrays([pa.array([of], pa.int32()), pa.array([[f.to_bytes() for f in chain.filters]], pa.list_(pa.binary()))],
                                              names=["shard", "filters"])

        for shard, found, part in by_shard(batches):
            if shard != of:
                if of is not None:
                    yield changed()
                of, chain, steps = shard, FilterChain(), []
            if part is None:
                chain = found
            else:
                steps.append((column(part, "h1").to_numpy(), column(part, "step").to_numpy()))
        if of is not None:
            yield changed()

    return with_filters(changes, filters, shards).mapInArrow(run, "shard int, filters array<binary>")


def empty_index(docs: DataFrame, shards: int | None = None) -> LineIndex:
    """An index without documents."""
    spark = docs.sparkSession
    return LineIndex(spark.createDataFrame([], "key bigint, t bigint, h1 bigint, h2 bigint"),
                     spark.createDataFrame([], "h1 bigint, h2 bigint, n_docs bigint, lo bigint, hi bigint"),
                     spark.createDataFrame([], "shard int, filters array<binary>"), shards or SHARDS_PER_PARTITION * partitions_for(docs))


def insert(index: LineIndex, docs: DataFrame) -> LineIndex:
    """The index with the rows of ``docs`` (doc_id, text; other columns are ignored) as well."""
    new = cut_lineage(line_references(docs))
    probed = cut_lineage(probe(count_table(new), index.filters, index.shards))
    old = index.counts.select("h1", "h2", F.col("n_docs").alias("n_old"), F.col("lo").alias("lo_old"), F.col("hi").alias("hi_old"))
    # Keys that the filters do not know are new; the others may be.
    merged = probed.where("seen > 0").join(old, ["h1", "h2"], "left").select(
        "h1", "h2", (F.col("n_docs") + F.coalesce("n_old", F.lit(0))).alias("n_docs"), F.least("lo", "lo_old").alias("lo"),
        F.greatest("hi", "hi_old").alias("hi"), held("lo_old", "hi_old").alias("before"))
    changed = merged.unionByName(probed.where("seen = 0").drop("seen").withColumn("before", F.lit(0)))
    same = index.counts.join(merged.select("h1", "h2"), ["h1", "h2"], "left_anti")
    steps = changed.select("h1", (held() - F.col("before")).cast("int").alias("step")).where("step <> 0")
    return replace(index, references=index.references.unionByName(new), counts=cut_lineage(same.unionByName(changed.drop("before"))),
                   filters=cut_lineage(change_filters(steps, index.filters, index.shards)))


def delete(index: LineIndex, doc_ids: DataFrame) -> LineIndex:
    """The index without the documents of ``doc_ids`` (doc_id); ids that it does not hold change nothing."""
    ids = doc_ids.select(key_of().alias("key")).distinct()
    gone = cut_lineage(index.references.join(ids, "key", "left_semi"))
    left = cut_lineage(index.references.join(ids, "key", "left_anti"))
    touched = cut_lineage(index.counts.join(gone.select("h1", "h2").distinct(), ["h1", "h2"]))
    total = touched.agg(F.sum("n_docs")).first()[0] or 0
    hot = touched.where(F.col("n_docs") * HOT >= total).select("h1", "h2")  # at most HOT keys, as their references are at most ``total``
    cold = touched.where(F.col("n_docs") * HOT < total).select("h1", "h2")
    still = count_table(left.join(F.broadcast(hot), ["h1", "h2"], "left_semi").unionByName(left.join(cold, ["h1", "h2"], "left_semi")))
    new = still.select("h1", "h2", F.col("n_docs").alias("n_new"), F.col("lo").alias("lo_new"), F.col("hi").alias("hi_new"))
    changed = cut_lineage(touched.join(new, ["h1", "h2"], "left"))
    steps = changed.select("h1", (held("lo_new", "hi_new") - held()).cast("int").alias("step")).where("step <> 0")
    kept = changed.where("n_new is not null").select("h1", "h2", F.col("n_new").alias("n_docs"), F.col("lo_new").alias("lo"), F.col("hi_new").alias("hi"))
    same = index.counts.join(touched.select("h1", "h2"), ["h1", "h2"], "left_anti")
    return replace(index, references=left, counts=cut_lineage(same.unionByName(kept)), filters=cut_lineage(change_filters(steps, index.filters, index.shards)))


def repeated_references(index: LineIndex) -> DataFrame:
    """(key, t, h1, h2): references to a key that a document of a smaller id holds as well."""
    total = index.counts.agg(F.sum("n_docs")).first()[0] or 0
    several = index.counts.where("lo < hi")
    hot = F.broadcast(several.where(F.col("n_docs") * HOT >= total).select("h1", "h2", "lo"))  # at most HOT rows, as counts add up to ``total``
    common = index.references.join(hot, ["h1", "h2"]).where(F.col("key") > F.col("lo"))
    rare = index.references.join(hot, ["h1", "h2"], "left_anti")
    maybe = probe(rare.select("key", "t", "h1", "h2"), index.filters, index.shards).where("seen > 1")
    exact = maybe.join(several.select("h1", "h2", "lo"), ["h1", "h2"]).where(F.col("key") > F.col("lo"))
    return common.select("key", "t", "h1", "h2").unionByName(exact.select("key", "t", "h1", "h2"))


def drop_repeated_lines(docs: DataFrame, index: LineIndex) -> DataFrame:
    """Rows of ``docs``, which the index holds, without lines that a document of a smaller id holds as well.

    Returns row (a struct of the columns of ``docs`` but text), n_lines, n_dropped and
    kept_text. A text is split at \\n; a null or empty text is one empty line.
    A line's key is the line without white space (space, \\x09-\\x0D) at both
    ends and with A-Z folded; keys of fewer than 10 code points are kept. All
    lines of a key go, but those of the smallest id that holds it; rows of
    equal id are one document and all keep them. A null id is the smallest.
    Lines are as they were, white space included. Keys are compared by 128-bit
    digests. Rows that the index does not hold come back whole; an empty table
    gives no rows.
    """
    lost = repeated_references(index).groupBy(F.col("key").alias("of_key"), F.col("t").alias("of_t")).agg(F.collect_list(F.struct("h1", "h2")).alias("lost"))
    others = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"]).alias("row")
    met = docs.select(others, *row_key(), F.coalesce("text", F.lit("")).alias("text")) \
        .join(lost, (F.col("key") == F.col("of_key")) & (F.col("t") == F.col("of_t")), "left").select("row", "text", "lost")

    def run(batches):
        for part, texts in text_bytes(batches):
            kept, n_lines, n_dropped = [], [], []
            for text, pairs in zip(texts, column(part, "lost"), strict=True):
                if not pairs.is_valid:
                    kept.append(text)
                    n_lines.append(text.count(b"\n") + 1)
                    n_dropped.append(0)
                    continue
                gone = {np.array([p["h1"], p["h2"]], dtype=np.int64).tobytes() for p in pairs.as_py()}
                lines = text.split(b"\n")
                stay = [x for x in lines if line_key(x) not in gone]
                kept.append(b"\n".join(stay))
                n_lines.append(len(lines))
                n_dropped.append(len(lines) - len(stay))
            yield pa.RecordBatch.from_arrays([column(part, "row"), pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64()),
                                              pa.array(kept, pa.binary()).cast(pa.string())], names=["row", "n_lines", "n_dropped", "kept_text"])

    return met.mapInArrow(run, f"row {met.schema['row'].dataType.simpleString()}, n_lines bigint, n_dropped bigint, kept_text string")


ORACLE = r"""
WITH b AS (SELECT ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13) AS blanks),
l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS place FROM documents),
k AS (SELECT doc_id, line, place, translate(trim(line, blanks), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l, b),
r AS (SELECT key, min(doc_id) AS lo FROM k WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) >= 2)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE coalesce(doc_id > lo, false)) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (WHERE NOT coalesce(doc_id > lo, false)), '')) AS kept_sha256
FROM k LEFT JOIN r ON k.key = r.key GROUP BY doc_id
"""
