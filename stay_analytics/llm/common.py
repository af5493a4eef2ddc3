"""Small helpers shared by the operators of this package."""

from __future__ import annotations

import ctypes
import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: White space that separates words everywhere in this package: space and \x09-\x0D.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"


def word_count(text):
    """Number of words of a text column; null counts 0."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD_PATTERN)), F.lit(0)).cast("long")


def batch_of(columns: dict, schema: pa.Schema) -> pa.RecordBatch:
    """A record batch from arrays or lists in the order of ``schema``."""
    return pa.RecordBatch.from_arrays([c if isinstance(c, (pa.Array, pa.ChunkedArray)) else pa.array(c, type=f.type)
                                       for f, c in ((f, columns[f.name]) for f in schema)], schema=schema)


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    """The first column of that name."""
    return batch.column(batch.schema.get_field_index(name))


def byte_slices(texts: pa.Array, most: int) -> Iterator[tuple[int, int]]:
    """Row ranges [i, j) of a string array whose bytes total about ``most``, one row at least."""
    sizes = np.diff(np.frombuffer(texts.buffers()[1], dtype=np.int32)[texts.offset:texts.offset + len(texts) + 1].astype(np.int64)) \
        if pa.types.is_string(texts.type) else np.array([len(x.as_py() or "") for x in texts], dtype=np.int64)
    total = np.concatenate(([0], np.cumsum(sizes)))
    i = 0
    while i < len(sizes):
        j = max(i + 1, int(np.searchsorted(total, total[i] + most, side="right")) - 1)
        yield i, j
        i = j


def text_bytes(batches: Iterable[pa.RecordBatch], most: int = 1 << 20,
               text: str = "text") -> Iterator[tuple[pa.RecordBatch, list[bytes | None]]]:
    """Slices of the batches with their texts as UTF-8 bytes, about ``most`` bytes of text each."""
    for batch in batches:
        column = batch.column(batch.schema.get_field_index(text))
        for i, j in byte_slices(column, most):
            yield batch.slice(i, j - i), column.slice(i, j - i).cast(pa.binary()).to_pylist()
        give_back()


def give_back() -> None:
    """Returns what this process has freed to the system.

    Spark keeps its Python workers from stage to stage; without this each
    holds on to the most that any of its tasks has needed.
    """
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
    if trim is not None:
        trim(0)


def free_name(df: DataFrame, name: str) -> str:
    """``name``, lengthened until no column of ``df`` has it (case ignored, as Spark does)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def partitions_for(df: DataFrame, factor: float = 1.0) -> int:
    """Number of partitions for a shuffle of whole texts: the session's, times ``factor``."""
    return max(1, math.ceil(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) * factor))
