"""Document fingerprints: threshold-scaled sketches of shingle hashes.

A sketch keeps every 10-byte shingle hash below a fixed fraction of the hash
range, so sketches of different documents sample the same shingles: their
union is the sketch of the joined documents, and the share of a small
document's hashes found in a large one estimates its containment, however
unequal the two are. A document of few distinct shingles keeps all of them; two
sketches are compared below the smaller fraction of the two.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch_of, partitions_for
from .hashing import mix, splits_of, window_hashes

SHINGLE_BYTES = 10
#: One in so many shingle hashes is kept.
SCALE = 16
#: Texts with at most so many distinct shingles keep them all.
SMALL = 256
#: Hashes are written with 32 bits: 8 hexadecimal digits.
BITS = 32


def all_if_few(h: np.ndarray, small: int) -> np.ndarray | None:
    """The sorted distinct hashes if there are at most ``small``; longer and longer beginnings are tried, so most texts end at the first."""
    size = 2 * small
    while True:
        distinct = np.unique(h[:size])
        if len(distinct) > small:
            return None
        if size >= len(h):
            return distinct
        size *= 4


def sketches(texts: list[bytes], scale: int = SCALE, width: int = SHINGLE_BYTES, small: int = SMALL) -> list[tuple[int, np.ndarray]]:
    """(scale, sorted distinct 32-bit hashes) of each text. A text shorter than a shingle is one shingle; an empty one has none."""
    short = [t.ljust(width, b"\0") if 0 < len(t) < width else t for t in texts]
    data, starts = splits_of(short)
    h = mix(window_hashes(data, width)) >> np.uint64(64 - BITS)
    counts = np.diff(starts) - width + 1
    out = []
    under = np.flatnonzero(h < np.uint64((1 << BITS) // scale)) if len(h) else np.zeros(0, dtype=np.int64)
    lo, hi = np.searchsorted(under, starts[:-1]), np.searchsorted(under, np.maximum(starts[1:] - width + 1, starts[:-1]))
    for k, n in enumerate(counts):
        few = all_if_few(h[starts[k]:starts[k] + max(n, 0)], small)
        out.append((1, few) if few is not None else (scale, np.unique(h[under[lo[k]:hi[k]]])))
    return out


def written(sketch: tuple[int, np.ndarray]) -> str:
    """A sketch as text: its scale, a colon, 8 hexadecimal digits per hash."""
    return f"{sketch[0]}:{sketch[1].astype('>u4').tobytes().hex()}"


def read_sketch(fingerprint: str) -> tuple[int, np.ndarray]:
    scale, _, digits = fingerprint.partition(":")
    return int(scale), np.frombuffer(bytes.fromhex(digits), dtype=">u4").astype(np.uint64)


def merged(a: tuple[int, np.ndarray], b: tuple[int, np.ndarray]) -> tuple[int, np.ndarray]:
    """Sketch of two documents together."""
    scale = max(a[0], b[0])
    both = np.union1d(a[1], b[1])
    return scale, both[both < np.uint64((1 << BITS) // scale)]


def likeness(a: tuple[int, np.ndarray], b: tuple[int, np.ndarray]) -> float:
    """Estimated share of the smaller document's shingles that the other has; for empty sketches 1 if they are equal, else 0."""
    x, y = a[1], b[1]
    if a[0] != b[0]:
        limit = np.uint64((1 << BITS) // max(a[0], b[0]))
        x, y = x[:np.searchsorted(x, limit)], y[:np.searchsorted(y, limit)]
    if not len(x) or not len(y):
        return float(a[0] == b[0] and len(a[1]) == len(b[1]) == 0)
    if len(x) > len(y):
        x, y = y, x
    at = np.searchsorted(y, x)
    at[at == len(y)] = 0
    return float(np.count_nonzero(y[at] == x)) / len(x)


def fingerprints(docs: DataFrame, scale: int = SCALE, out: str = "fingerprint") -> DataFrame:
    """``docs`` with the fingerprint of ``text`` in column ``out``; null texts count as empty. No shuffle."""
    @F.pandas_udf("string")
    def of(texts):
        data = [(t or "").encode() for t in texts]
        return texts.__class__([written(s) for s in sketches(data, scale)])

    return docs.withColumn(out, of(F.coalesce(F.col("text"), F.lit(""))))


def with_next(docs: DataFrame) -> tuple[DataFrame, int]:
    """Rows dealt so that each meets its successor by ascending ``doc_id`` in one task, sorted there.

    Cut points are ids of the table (approximate quantiles). A row goes to the
    range of its id; a row at a cut point is also sent ahead to the range
    before, and the first row to the last range, so that whole texts are
    shuffled once and nothing is gathered. Columns: part, ahead, key, doc_id, text.
    """
    # Null ids come first; equal ids are ordered by text.
    key = F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63)))
    n = partitions_for(docs)
    pieces = 4 * n
    row = docs.select(key.alias("key")).agg(F.percentile_approx("key", [k / pieces for k in range(1, pieces)] or [0.5], 100 * pieces).alias("cuts"),
                                            F.min("key").alias("first")).first()
    cuts = np.unique(np.array(row.cuts or [], dtype=np.int64))
    first = row.first

    @F.pandas_udf("array<int>")
    def parts(keys):
        k = keys.to_numpy()
        p = np.searchsorted(cuts, k, side="right")
        at_cut = np.zeros(len(k), dtype=bool) if not len(cuts) else cuts[np.maximum(p - 1, 0)] == k
        out = [[int(x)] for x in p]
        for i in np.flatnonzero(at_cut):
            out[i].append(int(p[i]) - 1)
        for i in np.flatnonzero(k == first):
            out[i].append(len(cuts))
        return keys.__class__(out)

    dealt = docs.select(key.alias("key"), "doc_id", F.coalesce("text", F.lit("")).alias("text")) \
        .withColumn("parts", parts("key")).select("key", "doc_id", "text", F.posexplode("parts").alias("ahead", "part"))
    return dealt.select("part", F.least("ahead", F.lit(1)).alias("ahead"), "key", "doc_id", "text") \
        .repartition(n, "part").sortWithinPartitions("part", "ahead", "key", "text"), len(cuts)


def edited_text(text: str, following: str) -> str:
    """The text with its last quarter of code points replaced by the first as many of the next one."""
    k = len(text) // 4
    return text[:len(text) - k] + following[:k]


def compare_with_edits(docs: DataFrame, scale: int = SCALE) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): its fingerprint, that of its edited text, and likenesses.

    Returns doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint,
    near_edited, near_next. The next document is the one with the next larger
    id (after the last: the first; a single row follows itself). Null texts
    count as empty; null ids come first; rows of equal id follow each other by
    text. An empty table gives an empty result.
    """
    id_type = docs.schema["doc_id"].dataType.simpleString()
    rows, _ = with_next(docs)

    def compare(batches):
        schema, held = None, []

        def group(rows, prepared):
            """Rows of every pair of neighbours; prepared: the sketch of the first row, if known."""
            texts = [r[3] for r in rows]
            own = ([prepared] if prepared else []) + sketches([t.encode() for t in texts[bool(prepared):]], scale)
            pairs = [i for i in range(len(rows) - 1) if not rows[i][1] and rows[i][0] == rows[i + 1][0]]
            edits = [edited_text(texts[i], texts[i + 1]).encode() for i in pairs]
            made = sketches(edits, scale)
            return batch_of({
                "doc_id": [rows[i][2] for i in pairs], "n_chars": [len(texts[i]) for i in pairs],
                "edited_sha256": [hashlib.sha256(e).hexdigest() for e in edits], "fingerprint": [written(own[i]) for i in pairs],
                "edited_fingerprint": [written(m) for m in made], "near_edited": [likeness(own[i], m) for i, m in zip(pairs, made, strict=True)],
                "near_next": [likeness(own[i], own[i + 1]) for i in pairs]}, schema), own[-1]

        size, prepared = 0, None
        for batch in batches:
            schema = schema or pa.schema([("doc_id", batch.schema.field("doc_id").type), ("n_chars", pa.int64()), *[
                (c, pa.string()) for c in ("edited_sha256", "fingerprint", "edited_fingerprint")], ("near_edited", pa.float64()), ("near_next", pa.float64())])
            columns = [batch.column(batch.schema.get_field_index(c)) for c in ("part", "ahead", "doc_id")]
            texts = batch.column(batch.schema.get_field_index("text"))
            for part, ahead, doc, text in zip(*[c.to_pylist() for c in columns], texts, strict=True):
                held.append((part, ahead, doc, text.as_py()))
                size += len(held[-1][3])
                if size >= 1 << 20 and len(held) > 1:
                    out, prepared = group(held, prepared)
                    yield out
                    held, size = held[-1:], 0
        if len(held) > 1:
            yield group(held, prepared)[0]

    return rows.mapInArrow(compare, f"doc_id {id_type}, n_chars bigint, edited_sha256 string, fingerprint string, "
                                    "edited_fingerprint string, near_edited double, near_next double")
