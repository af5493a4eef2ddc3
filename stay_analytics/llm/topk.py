"""Exact top-k search by Fagin's threshold algorithm, block by block.

Candidates are dealt into blocks of bounded size. Inside a block every
dimension has a list of its candidates in order of value. A query walks all
lists at once from the end that its sign favours, scores each candidate that
it meets in full, and stops when its k-th score beats the bound: the score
that a candidate would have that stood at the reached depth in every list.
Queries are dealt into blocks too; each pair of blocks is one task, and the
best k of a query over all blocks are kept.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

K = 5
CANDIDATES_PER_BLOCK = 8192
QUERIES_PER_BLOCK = 16384
#: Depths at which the walk compares the k-th score with the bound.
DEPTHS = (16, 64, 256, 1024, 4096)


class Lists:
    """Sorted per-dimension lists of a block: ids (ascending) and the vectors as rows of integers."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        order = np.argsort(ids, kind="stable")
        self.ids, self.x = ids[order], np.ascontiguousarray(vectors[order])
        n, d = self.x.shape
        by_value = np.argsort(self.x, axis=0, kind="stable").T  # (dimension, place) -> row, ascending values
        self.values = np.take_along_axis(self.x.T, by_value, axis=1)
        small = np.int16 if n < 1 << 15 else np.int32
        self.low = np.empty((d, n), dtype=small)  # (dimension, row) -> place from the low end
        np.put_along_axis(self.low, by_value, np.broadcast_to(np.arange(n, dtype=small), (d, n)), axis=1)
        self.high = small(n - 1) - self.low

    def search(self, query: np.ndarray, own, k: int = K) -> list[tuple[int, int]]:
        """(id, score) of the k best rows but those with id ``own``: score descending, id ascending."""
        n = len(self.ids)
        up, down = np.flatnonzero(query > 0), np.flatnonzero(query < 0)
        met = np.full(n, n - 1 if len(up) + len(down) else 0)  # the depth at which each row is met first
        if len(up):
            met = np.minimum(met, self.high[up].min(axis=0))
        if len(down):
            met = np.minimum(met, self.low[down].min(axis=0))
        rows, scores, done = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=self.x.dtype), 0
        for depth in (*[d for d in DEPTHS if d < n], n):
            new = np.flatnonzero((met >= done) & (met < depth))
            new = new[self.ids[new] != own]
            rows, scores = np.concatenate((rows, new)), np.concatenate((scores, self.x[new] @ query))
            if len(rows) > k:  # rows are by id, so a stable order puts the smaller id first on a tie
                edge = np.partition(scores, len(scores) - k)[len(scores) - k]
                keep = np.flatnonzero(scores >= edge)
                keep = keep[np.lexsort((rows[keep], -scores[keep]))][:k]
                rows, scores = rows[keep], scores[keep]
            done = depth
            if depth < n and len(rows) >= k:
                bound = self.values[up, n - 1 - depth] @ query[up] + self.values[down, depth] @ query[down]
                if scores.min() > bound:  # on a tie an unmet row could have the smaller id
                    break
        order = np.lexsort((rows, -scores))
        return [(self.ids[r], scores[i]) for i, r in zip(order, rows[order], strict=True)]


def integers(vectors) -> np.ndarray:
    """Vectors as rows of whole numbers: floats where every product sum is exact in them, else Python's integers."""
    x = np.stack([np.asarray(v, dtype=np.float64) for v in vectors])
    top = np.abs(x).max(initial=0)
    return x if x.shape[1] * top * top < 2 ** 53 else np.array([[int(v) for v in row] for row in x], dtype=object)


def usable(vectors: DataFrame, key: str, vector: str, scale: int) -> DataFrame:
    """Rows that take part, as (id, v, dim): v holds floor(scale * x) of each component x."""
    x = F.col(vector)
    finite = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double")) < float("inf")))
    return vectors.where(F.col(key).isNotNull() & x.isNotNull() & (F.size(x) > 0)).where(finite).select(
        F.col(key).alias("id"), F.transform(x, lambda c: F.floor(c.cast("double") * scale).cast("double")).alias("v"), F.size(x).alias("dim"))


def top_k(vectors: DataFrame, every: int = 50, k: int = K, key: str = "vec_id", vector: str = "embedding", scale: int = 256) -> DataFrame:
    """The k best rows by integer inner product for each row whose id is divisible by ``every``.

    Returns query_id, rank (from 1), vec_id, score; all candidates if there
    are fewer than k. Ties go to the smaller id. Rows with a null id, a null
    or empty vector, or a null or non-finite component take no part; vectors
    are compared with those of their own length. A row is no candidate for a
    query of its own id; a query id that is repeated is asked once. Scores
    must fit a long.
    """
    rows = usable(vectors, key, vector, scale)
    sizes = rows.agg(F.count("*").alias("n"), F.count(F.when(F.col("id") % every == 0, 1)).alias("q")).first()
    cells_c = -(-sizes.n // CANDIDATES_PER_BLOCK) or 1
    cells_q = -(-sizes.q // QUERIES_PER_BLOCK) or 1
    to_all = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    candidates = rows.withColumn("c", F.pmod(F.xxhash64("id"), F.lit(cells_c)).cast("int")).withColumn("q", to_all(cells_q))
    queries = rows.where(F.col("id") % every == 0).withColumn("q", F.pmod(F.xxhash64("id"), F.lit(cells_q)).cast("int")).withColumn("c", to_all(cells_c))

    def search(asked: pd.DataFrame, block: pd.DataFrame) -> pd.DataFrame:
        found = []
        if len(asked) and len(block):
            lists = Lists(block["id"].to_numpy(), integers(block["v"]))
            asked = asked.assign(t=[tuple(v) for v in asked["v"]]).sort_values(["id", "t"]).drop_duplicates("id")
            for own, q in zip(asked["id"], integers(asked["v"]), strict=True):
                if q.dtype != lists.x.dtype or len(q) * np.abs(q).max(initial=0) * np.abs(lists.x).max(initial=0) >= 2 ** 53:
                    lists = lists if lists.x.dtype == object else Lists(lists.ids, np.array([[int(v) for v in r] for r in lists.x], dtype=object))
                    q = np.array([int(v) for v in q], dtype=object)
                found += [(own, i, int(s)) for i, s in lists.search(q, own, k)]
        return pd.DataFrame(found, columns=["query_id", "vec_id", "score"])

    best = queries.groupBy("dim", "q", "c").cogroup(candidates.groupBy("dim", "q", "c")).applyInPandas(
        search, "query_id bigint, vec_id bigint, score bigint")
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


ORACLE = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
           WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.v, c.v)::BIGINT AS score
      FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id AND len(c.v) = len(q.v))
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM p) WHERE rank <= 5
"""
