"""Principal components of every group of a table (CL5).

One aggregate gives the sums of products of every group, whatever its size; a
task solves the small symmetric matrices. Rows meet their group's axes by a
join of one row per group and are projected by expressions.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .cluster import seeded_sample


def principal_axes(df: DataFrame, features: Sequence[str], by: str = "city") -> DataFrame:
    """(group, rows, means, variances, axes): all axes of every group, by falling variance (population).

    The largest loading of an axis, the first on a tie, is positive. A group of
    one row has variances 0. Rows with a null in ``features`` take no part.
    """
    d = len(features)
    upper = [(i, j) for i in range(d) for j in range(i, d)]
    x = [F.col(c).cast("double") for c in features]
    full = df.dropna(subset=list(features))
    # Shifted by a value of the group itself, so that means far from 0 cost no digits.
    origin = full.groupBy(by).agg(F.array(*[F.avg(v) for v in x]).alias("_o"))
    y = [v - F.col("_o")[i] for i, v in enumerate(x)]
    sums = full.join(origin, full[by].eqNullSafe(origin[by])).drop(origin[by]).groupBy(by).agg(
        F.count(F.lit(1)).alias("rows"), F.first("_o").alias("means"), F.array(*[F.avg(y[i] * y[j]) for i, j in upper]).alias("cov"))

    def solve(batches):
        for batch in batches:
            cov = batch.column(batch.schema.get_field_index("cov")).to_pylist()
            variances, axes = [], []
            for c in cov:
                m = np.zeros((d, d))
                m[tuple(zip(*upper, strict=True))] = c
                lam, vec = np.linalg.eigh(m + np.triu(m, 1).T)
                vec = vec[:, ::-1].T
                vec = vec * np.where(vec[np.arange(d), np.abs(vec).argmax(axis=1)] < 0, -1.0, 1.0)[:, None]
                variances.append(np.maximum(lam[::-1], 0.0).tolist())
                axes.append(vec.tolist())
            kept = [batch.column(batch.schema.get_field_index(c)) for c in (by, "rows", "means")]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(variances, pa.list_(pa.float64())), pa.array(axes, pa.list_(pa.list_(pa.float64())))],
                                             names=[by, "rows", "means", "variances", "axes"])

    kind = df.schema[by].dataType.simpleString()
    return sums.mapInArrow(solve, f"{by} {kind}, rows bigint, means array<double>, variances array<double>, axes array<array<double>>")


def pca_view(df: DataFrame, features: Sequence[str], key: str, sample_n: int = 2500, by: str = "city", seed: int = 42) -> DataFrame:
    """CL5: the first two components, fitted on all rows of each group, of a seeded sample of it, with their shares of the variance.

    A group without variance has shares 0.
    """
    axes = principal_axes(df, features, by)
    sample = seeded_sample(df.dropna(subset=list(features)), key, sample_n, [by], seed)
    met = sample.join(axes, sample[by].eqNullSafe(axes[by])).drop(axes[by])
    x = F.array(*[F.col(c).cast("double") for c in features])
    centred = F.zip_with(x, "means", lambda v, m: v - m)
    total = F.aggregate("variances", F.lit(0.0), lambda s, v: s + v)
    place = lambda i: F.aggregate(F.zip_with(centred, F.col("axes")[i], lambda v, a: v * a), F.lit(0.0), lambda s, v: s + v)
    share = lambda i: F.when(total > 0, F.col("variances")[i] / total).otherwise(0.0)
    return met.select(key, by, place(0).alias("pc1"), place(1).alias("pc2"), share(0).alias("explained_variance_pc1"),
                      share(1).alias("explained_variance_pc2"))
