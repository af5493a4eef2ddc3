"""Market segmentation (CL1-CL10).

Exact, SQL-checkable parts (scaling, profiles, nearest centroid, Calinski-
Harabasz and Davies-Bouldin) are aggregates. Centroids are a bounded
``k x d`` table: they are attached to every row as one array column through
a scalar subquery, so nearest-centroid search is an array expression per row
(no join, no row-pair product). Model fits use ``pyspark.ml``.
Hierarchical (Ward) segmentation is re-aimed: k-means micro-clusters over all
rows, a Ward merge of at most ``micro_k`` weighted centroids, then every row
inherits its micro-cluster's segment.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.ml.clustering import KMeans
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.feature import PCA, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import pround
from ..session import at_once, spread
from . import pooled
from .ranking import grouped, median_of

# Segment names in ascending median-price order.
SEGMENT_LABELS = ["Value", "Standard", "Premium", "Luxury"]


def scale_features(df: DataFrame, features: Sequence[str], by: Sequence[str] = ("city",)) -> DataFrame:
    """CL1: z-scores per group with the population std (a zero std scales to 0)."""
    by = list(by)
    stats = df.groupBy(*by).agg(*[F.avg(c).alias(f"_m_{c}") for c in features],
                                *[F.stddev_pop(c).alias(f"_s_{c}") for c in features])
    j = df.join(stats, by)
    for c in features:
        s = F.col(f"_s_{c}")
        j = j.withColumn(f"{c}_z", F.when(s == 0, F.lit(0.0)).otherwise((F.col(c) - F.col(f"_m_{c}")) / s))
    return j.drop(*[f"_m_{c}" for c in features], *[f"_s_{c}" for c in features])


def profile_segments(df: DataFrame, cluster: str, by: Sequence[str] = ("city",),
                     labels: Sequence[str] = SEGMENT_LABELS) -> DataFrame:
    """CL4: profile per cluster and names by ascending median price (2 dp)."""
    by = list(by)
    g = grouped(df, [*by, cluster], F.count(F.lit(1)).alias("listings"), median_of("price_eur", 2).alias("median_price_eur"),
        pround(F.avg("price_eur"), 2).alias("mean_price_eur"), median_of("accommodates", 2).alias("median_accommodates"),
        median_of("amenities_count", 2).alias("median_amenities"),
        median_of("distance_to_center_km", 2).alias("median_distance_to_center_km"),
        median_of("availability_365", 2).alias("median_availability_365"),
        pround(F.avg("review_scores_rating"), 2).alias("mean_review_score"),
        median_of("minimum_nights", 2).alias("median_minimum_nights"),
        median_of("price_eur").alias("_mp"))
    order = F.row_number().over(Window.partitionBy(*by).orderBy(F.col("_mp").asc(), F.col(cluster).asc()))
    names = F.array(*[F.lit(x) for x in labels])
    g = g.withColumn("_o", order)
    seg = F.when(F.col("_o") <= len(labels), F.element_at(names, F.col("_o"))).otherwise(
        F.concat(F.lit("Segment "), F.col("_o").cast("string")))
    return g.withColumn("segment", seg).drop("_mp", "_o")


def with_segment_labels(df: DataFrame, profile: DataFrame, cluster: str, by: Sequence[str] = ("city",),
                        label: str = "segment") -> DataFrame:
    """JN15: rows with the label that ``profile`` (one row per group and cluster) gives to their cluster; null if it has none."""
    return df.join(profile.select(*by, cluster, label), [*by, cluster], "left")


def centroids(df: DataFrame, vec: str, label: str) -> DataFrame:
    """Per-label mean vector (array<double>), computed element-wise with posexplode."""
    long = df.select(label, F.posexplode(F.col(vec).cast("array<double>")).alias("pos", "v"))
    g = long.groupBy(label, "pos").agg(F.avg("v").alias("v"))
    return g.groupBy(label).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "v"))),
                                            lambda s: s["v"]).alias("centroid"),
                                F.count(F.lit(1)).alias("_d"))


def _sqdist(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda acc, v: acc + v)


def nearest_centroid(df: DataFrame, vec: str, cents: DataFrame, label: str = "label") -> DataFrame:
    """CL9: nearest centroid id and Euclidean distance for every row.

    The (bounded) centroid table is attached as one array via a scalar subquery.
    """
    arr = cents.agg(F.array_sort(F.collect_list(F.struct(F.col(label).alias("id"), F.col("centroid").alias("c"))))
                    .alias("a")).select("a").scalar()
    x = F.col(vec).cast("array<double>")
    # the subquery result becomes a column first (subqueries may not sit inside lambdas)
    d = F.transform(F.col("_cents"), lambda s: F.struct(_sqdist(x, s["c"]).alias("d2"), s["id"].alias("id")))
    best = F.array_min(d)
    return (df.withColumn("_cents", arr).withColumn("_best", best)
            .withColumn("nearest_centroid", F.col("_best")["id"]).withColumn("distance", F.sqrt(F.col("_best")["d2"]))
            .drop("_cents", "_best"))


def cluster_quality(df: DataFrame, vec: str, label: str) -> DataFrame:
    """CL10: Calinski-Harabasz and Davies-Bouldin indices of a labelled table (one row)."""
    x = df.select(label, F.col(vec).cast("array<double>").alias("x"))
    cents = centroids(x, "x", label).drop("_d")
    sizes = x.groupBy(label).agg(F.count(F.lit(1)).alias("n_j"))
    overall = centroids(x.withColumn("_all", F.lit(0)), "x", "_all").select("centroid").scalar()
    arr = cents.agg(F.array_sort(F.collect_list(F.struct(F.col(label).alias("id"), F.col("centroid").alias("c"))))
                    .alias("a")).select("a").scalar()
    own = F.filter(F.col("_cents"), lambda s: s["id"] == F.col(label))[0]["c"]
    per_row = x.withColumn("_cents", arr).withColumn("_d2", _sqdist(F.col("x"), own)).drop("_cents")
    within = per_row.groupBy(label).agg(F.sum("_d2").alias("w_j"), F.avg(F.sqrt("_d2")).alias("s_j"))
    cl = within.join(sizes, label).join(cents, label)
    cl = cl.withColumn("_all", overall).withColumn("b_j", F.col("n_j") * _sqdist(F.col("centroid"), F.col("_all")))
    # Davies-Bouldin: for each cluster, the worst (s_i + s_j) / d(c_i, c_j) over the other clusters
    sarr = cl.agg(F.array_sort(F.collect_list(F.struct(F.col(label).alias("id"), F.col("s_j").alias("s"),
                                                       F.col("centroid").alias("c")))).alias("a")).select("a").scalar()
    ratio = F.array_max(F.transform(F.filter(F.col("_s"), lambda o: o["id"] != F.col(label)),
                                    lambda o: (F.col("s_j") + o["s"]) / F.sqrt(_sqdist(F.col("centroid"), o["c"]))))
    cl = cl.withColumn("_s", sarr).withColumn("r_j", ratio)
    return cl.agg(
        F.count(F.lit(1)).alias("k"), F.sum("n_j").alias("n"),
        ((F.sum("b_j") / (F.count(F.lit(1)) - 1)) / (F.sum("w_j") / (F.sum("n_j") - F.count(F.lit(1)))))
        .alias("calinski_harabasz"),
        F.avg("r_j").alias("davies_bouldin"))


# ------------------------------------------------------------ model fits
def _vectors(df: DataFrame, features: Sequence[str], out: str = "features") -> DataFrame:
    return VectorAssembler(inputCols=list(features), outputCol=out).transform(df)


def kmeans_sweep(df: DataFrame, features: Sequence[str], ks: Sequence[int] = range(2, 9),
                 seed: int = 42) -> DataFrame:
    """CL2: inertia (training cost) and silhouette (squared Euclidean, exact, linear time) per k."""
    data = spread(_vectors(df, features).select("features"))
    ev = ClusteringEvaluator(featuresCol="features", predictionCol="prediction")

    def row(k):
        model = KMeans(k=k, seed=seed, featuresCol="features").fit(data)
        return int(k), float(model.summary.trainingCost), float(ev.evaluate(model.transform(data)))

    rows = at_once(df.sparkSession, [lambda k=k: row(k) for k in ks])
    return df.sparkSession.createDataFrame(rows, "k int, inertia double, silhouette double")


def fit_kmeans(df: DataFrame, features: Sequence[str], k: int = 4, seeds: Sequence[int] = range(42, 72),
               out: str = "cluster_id") -> DataFrame:
    """CL3: final k-means, best of 30 seeded fits by training cost; cluster id per row."""
    data, d = spread(_vectors(df, features)), len(features)
    rows = data.select("features").persist()  # one copy for all draws; each fit would keep its own
    starts = at_once(df.sparkSession, [lambda s=s: KMeans(k=k, seed=s, maxIter=0, featuresCol="features").fit(rows).clusterCenters() for s in seeds])
    rows.unpersist()
    best = min(pooled.fit_kmeans(data, d, starts), key=lambda r: r.cost)
    return pooled.nearest_rows(data, d, best, out)


def pca_view(df: DataFrame, features: Sequence[str], key: str, sample_n: int = 800, seed: int = 42) -> DataFrame:
    """CL5: 2-D PCA fitted on all rows; projection of a seeded md5 sample; explained variance columns."""
    data = _vectors(df, features)
    model = PCA(k=2, inputCol="features", outputCol="pc").fit(data)
    ev = model.explainedVariance.toArray().tolist()
    sample = seeded_sample(data, key, sample_n, seed=seed)
    out = model.transform(sample).withColumn("_pc", vector_to_array("pc"))
    return out.select(key, F.col("_pc")[0].alias("pc1"), F.col("_pc")[1].alias("pc2"),
                      F.lit(ev[0]).alias("explained_variance_pc1"), F.lit(ev[1]).alias("explained_variance_pc2"))


def gmm_sweep(df: DataFrame, features: Sequence[str], ks: Sequence[int] = range(2, 9), seed: int = 42,
              starts: int = 5) -> DataFrame:
    """CL6: AIC, BIC, mean max membership probability, share below 0.60 and silhouette (squared Euclidean, exact,
    linear time; null if all rows fall into one cluster) per k, each the best of ``starts`` fits."""
    data = spread(_vectors(df, features).select("features"))
    d = len(features)
    blocks, fits = pooled.fit_mixtures(data, d, [(k, s) for k in ks for s in range(seed, seed + starts)])
    best = pooled.best_by_k(fits)
    found = pooled.confidence(blocks, d, best, 0.60)
    rows = []
    for k in ks:
        ll, own = best[k].log_likelihood, found[k]
        p = k * (d + d * (d + 1) / 2) + k - 1
        rows.append((int(k), ll, 2 * p - 2 * ll, p * float(np.log(own["rows"])) - 2 * ll, float(own["probability"]), float(own["low"]), own["silhouette"]))
    return df.sparkSession.createDataFrame(
        rows, "k int, log_likelihood double, aic double, bic double, mean_max_probability double, "
              "low_confidence_share double, silhouette double")


def fit_gmm(df: DataFrame, features: Sequence[str], k: int = 4, seed: int = 42, low: float = 0.60,
            starts: int = 10) -> DataFrame:
    """CL7: GMM membership (cluster, max probability, low-confidence flag) per row, best of ``starts`` fits."""
    data, d = spread(_vectors(df, features)), len(features)
    _, fits = pooled.fit_mixtures(data, d, [(k, s) for s in range(seed, seed + starts)])
    out = pooled.members(data, d, pooled.best_by_k(fits)[k], "cluster_id", "membership_probability")
    return out.withColumn("low_confidence", F.col("membership_probability") < low)


def seeded_sample(df: DataFrame, key: str, n: int, by: Sequence[str] = (), seed: int = 42) -> DataFrame:
    """SO3: the ``n`` rows with the smallest md5(seed:key) per group (stable under repartitioning;
    the per-group limit is applied before the shuffle)."""
    h = F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")))
    w = Window.partitionBy(*by).orderBy(h, F.col(key))
    return df.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= n).drop("_r")


def ward_merge(points: np.ndarray, weights: np.ndarray, k: int) -> np.ndarray:
    """Weighted Ward agglomeration (Lance-Williams) of a few centroids down to ``k`` groups."""
    n = len(points)
    groups = {i: [i] for i in range(n)}
    cent = {i: points[i].astype(float) for i in range(n)}
    wt = {i: float(weights[i]) for i in range(n)}
    while len(groups) > k:
        ids = sorted(groups)
        best = None
        for a_i, a in enumerate(ids):
            for b in ids[a_i + 1:]:
                cost = wt[a] * wt[b] / (wt[a] + wt[b]) * float(np.sum((cent[a] - cent[b]) ** 2))
                if best is None or cost < best[0]:
                    best = (cost, a, b)
        _, a, b = best
        cent[a] = (cent[a] * wt[a] + cent[b] * wt[b]) / (wt[a] + wt[b])
        wt[a] += wt[b]
        groups[a].extend(groups.pop(b))
        del cent[b], wt[b]
    label = np.zeros(n, dtype=int)
    for g, (_, members) in enumerate(sorted(groups.items())):
        label[members] = g
    return label


def ward_segments(df: DataFrame, features: Sequence[str], k: int = 4, micro_k: int = 100, seed: int = 42) -> DataFrame:
    """CL8: micro k-means over all rows, Ward merge of <= micro_k weighted centroids, assignment join."""
    data = spread(_vectors(df, features))
    micro = KMeans(k=micro_k, seed=seed, featuresCol="features", predictionCol="micro").fit(data)
    assigned = micro.transform(data)
    sizes = {r["micro"]: r["n"] for r in assigned.groupBy("micro").agg(F.count(F.lit(1)).alias("n")).collect()}
    centers = np.array([c for c in micro.clusterCenters()])
    weights = np.array([sizes.get(i, 0) for i in range(len(centers))], dtype=float)
    keep = np.where(weights > 0)[0]
    labels = ward_merge(centers[keep], weights[keep], min(k, len(keep)))
    mapping = df.sparkSession.createDataFrame([(int(i), int(l)) for i, l in zip(keep, labels)],
                                              "micro int, cluster_id int")
    return assigned.join(F.broadcast(mapping), "micro").drop("features")


__all__ = ["array_to_vector"]
