"""Registered segmentation queries (CL1-CL10, FI9, SO3)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.numeric import pround
from ..operators import citywise as cw
from ..operators import cluster as cs
from ..operators import mixture as mx
from ..operators import pca as pc
from ..operators.filters import complete_cases
from ..operators.ranking import grouped, median_of
from ..session import written_once
from ..sources import fixtures as fx
from ..sources.tables import read_table
from .registry import register
from .sqlkit import pround_sql, with_views

# The nine clustering inputs (fixture column names).
FEATURES = ["price_eur", "accommodates", "amenities_count", "distance_to_center_km", "availability_365",
            "review_scores_rating", "minimum_nights", "number_of_reviews", "availability_30"]


def _complete(spark, sf_dir):
    l = fx.listings(spark, sf_dir).select("listing_id", "city", *FEATURES)
    return complete_cases(l, FEATURES)


_COMPLETE_SQL = with_views("listings")[:-1] + ", cc AS (SELECT listing_id, city, " + ", ".join(
    f"CAST({c} AS DOUBLE) AS {c}" for c in FEATURES) + " FROM listings WHERE " + " AND ".join(
    f"{c} IS NOT NULL AND NOT isinf(CAST({c} AS DOUBLE)) AND NOT isnan(CAST({c} AS DOUBLE))" for c in FEATURES) + ")\n"


@register("cl1_scaled_features", _COMPLETE_SQL + "SELECT listing_id, city, " + ", ".join(
    f"{c}, CASE WHEN stddev_pop({c}) OVER (PARTITION BY city) = 0 THEN 0.0 ELSE ({c} - avg({c}) OVER (PARTITION BY city)) "
    f"/ stddev_pop({c}) OVER (PARTITION BY city) END AS {c}_z" for c in FEATURES) + " FROM cc")
def scaled(spark, sf_dir):
    """FI9 + CL1: complete cases on nine features, z-scores per city with the population std."""
    return cs.scale_features(_complete(spark, sf_dir), FEATURES)


@register("cl4_segment_profile", _COMPLETE_SQL + f""", g AS (SELECT city, CAST(listing_id % 4 AS BIGINT) AS cluster_id, count(*) AS listings,
  {pround_sql('median(price_eur)', 2)} AS median_price_eur, {pround_sql('avg(price_eur)', 2)} AS mean_price_eur,
  {pround_sql('median(accommodates)', 2)} AS median_accommodates, {pround_sql('median(amenities_count)', 2)} AS median_amenities,
  {pround_sql('median(distance_to_center_km)', 2)} AS median_distance_to_center_km,
  {pround_sql('median(availability_365)', 2)} AS median_availability_365, {pround_sql('avg(review_scores_rating)', 2)} AS mean_review_score,
  {pround_sql('median(minimum_nights)', 2)} AS median_minimum_nights, median(price_eur) AS mp FROM cc GROUP BY city, listing_id % 4)
SELECT * EXCLUDE (mp, o), CASE WHEN o <= 4 THEN ['Value', 'Standard', 'Premium', 'Luxury'][o] ELSE 'Segment ' || o END AS segment
FROM (SELECT *, row_number() OVER (PARTITION BY city ORDER BY mp, cluster_id) AS o FROM g)""")
def profile(spark, sf_dir):
    """CL4: cluster profiles named Value < Standard < Premium < Luxury by median price (clusters = id mod 4)."""
    c = _complete(spark, sf_dir).withColumn("cluster_id", (F.col("listing_id") % 4))
    return cs.profile_segments(c, "cluster_id")


_EMB_SQL = """WITH e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS x FROM embeddings),
u AS (SELECT label, unnest(range(1, len(x) + 1)) AS pos, unnest(x) AS v FROM e),
c AS (SELECT label, list(v ORDER BY pos) AS c FROM (SELECT label, pos, avg(v) AS v FROM u GROUP BY label, pos) GROUP BY label),
d AS (SELECT e.vec_id, e.label, c.label AS cid, list_sum(list_transform(range(1, len(e.x) + 1), lambda i: (e.x[i] - c.c[i]) * (e.x[i] - c.c[i]))) AS d2
  FROM e, c)
"""


@register("cl9_nearest_centroid", _EMB_SQL + """SELECT vec_id, CAST(label AS BIGINT) AS label, CAST(cid AS BIGINT) AS nearest_centroid,
  sqrt(d2) AS distance FROM d QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY d2, cid) = 1""")
def nearest(spark, sf_dir):
    """CL9: nearest label centroid and distance for every embedding (centroids as one bounded array)."""
    e = read_table(spark, sf_dir, "embeddings")
    out = cs.nearest_centroid(e, "embedding", cs.centroids(e, "embedding", "label"))
    return out.select("vec_id", "label", "nearest_centroid", "distance")


@register("cl10_cluster_quality", _EMB_SQL + """, own AS (SELECT label, sum(d2) AS w_j, avg(sqrt(d2)) AS s_j, count(*) AS n_j FROM d WHERE cid = label GROUP BY label),
allc AS (SELECT list(v ORDER BY pos) AS o FROM (SELECT pos, avg(v) AS v FROM u GROUP BY pos)),
cl AS (SELECT own.*, c.c, n_j * list_sum(list_transform(range(1, len(c.c) + 1), lambda i: (c.c[i] - allc.o[i]) * (c.c[i] - allc.o[i]))) AS b_j
  FROM own JOIN c ON own.label = c.label, allc),
pr AS (SELECT a.label, max((a.s_j + b.s_j) / sqrt(list_sum(list_transform(range(1, len(a.c) + 1), lambda i: (a.c[i] - b.c[i]) * (a.c[i] - b.c[i])))))
  AS r_j FROM cl a JOIN cl b ON a.label <> b.label GROUP BY a.label)
SELECT count(*) AS k, CAST(sum(n_j) AS BIGINT) AS n, (sum(b_j) / (count(*) - 1)) / (sum(w_j) / (sum(n_j) - count(*))) AS calinski_harabasz,
  avg(r_j) AS davies_bouldin FROM cl JOIN pr ON cl.label = pr.label""")
def quality(spark, sf_dir):
    """CL10: Calinski-Harabasz and Davies-Bouldin of the given embedding labels."""
    return cs.cluster_quality(read_table(spark, sf_dir, "embeddings"), "embedding", "label")


@register("so3_seeded_sample", with_views("listings") + """SELECT listing_id, city, price_eur FROM listings
QUALIFY row_number() OVER (PARTITION BY city ORDER BY md5('42:' || CAST(listing_id AS VARCHAR)), listing_id) <= 100""")
def sample(spark, sf_dir):
    """SO3: 100 listings per city with the smallest md5(seed:key) (reproducible, partition-stable)."""
    l = fx.listings(spark, sf_dir).select("listing_id", "city", "price_eur")
    return cs.seeded_sample(l, "listing_id", 100, ["city"])


def _scaled_only(spark, sf_dir):
    s = cs.scale_features(_complete(spark, sf_dir), FEATURES)
    return s.select("listing_id", "city", *[f"{c}_z" for c in FEATURES])


_Z = [f"{c}_z" for c in FEATURES]


@register("cl2_kmeans_sweep")
def kmeans_sweep(spark, sf_dir):
    """CL2: k-means k = 2..8: inertia and (squared-Euclidean) silhouette on all scaled rows."""
    return cs.kmeans_sweep(_scaled_only(spark, sf_dir), _Z)


@register("cl3_kmeans_segments")
def kmeans_fit(spark, sf_dir):
    """CL3 + CL4: k = 4 (best of 30 seeds), then the named profile per city."""
    z = _scaled_only(spark, sf_dir)
    fitted = cs.fit_kmeans(z, _Z).select("listing_id", "cluster_id")
    return cs.profile_segments(_complete(spark, sf_dir).join(fitted, "listing_id"), "cluster_id")


@register("cl5_pca_view")
def pca(spark, sf_dir):
    """CL5: PCA(2) fitted on all scaled rows; a seeded 800-row projection with explained variance."""
    return cs.pca_view(_scaled_only(spark, sf_dir), _Z, "listing_id", 800)


@register("cl6_gmm_sweep")
def gmm_sweep(spark, sf_dir):
    """CL6: Gaussian mixtures k = 2..8: log-likelihood, AIC, BIC, membership confidence, silhouette."""
    return cs.gmm_sweep(_scaled_only(spark, sf_dir), _Z)


@register("cl7_gmm_membership")
def gmm_fit(spark, sf_dir):
    """CL7: GMM k = 4 membership probability, low-confidence flag; summary per cluster."""
    g = cs.fit_gmm(_scaled_only(spark, sf_dir), _Z)
    return g.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("listings"),
                                       F.avg("membership_probability").alias("mean_probability"),
                                       F.avg(F.col("low_confidence").cast("double")).alias("low_confidence_share"))


@register("cl8_ward_segments")
def ward(spark, sf_dir):
    """CL8: hierarchical (Ward) segments via 100 micro-clusters and a bounded Ward merge."""
    w = cs.ward_segments(_scaled_only(spark, sf_dir), _Z, k=4, micro_k=100)
    return w.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("listings"))


# ------------------------------------------------ a fit per city, silhouettes of given labels
_SCALED_SQL = _COMPLETE_SQL[:-1] + ", z AS (SELECT listing_id, city, " + ", ".join(
    f"CASE WHEN stddev_pop({c}) OVER w = 0 THEN 0.0 ELSE ({c} - avg({c}) OVER w) / stddev_pop({c}) OVER w END AS {c}_z"
    for c in FEATURES) + " FROM cc WINDOW w AS (PARTITION BY city))\n"


@register("cl2_kmeans_sweep_by_city")
def kmeans_sweep_by_city(spark, sf_dir):
    """CL2: a k-means sweep k = 2..8 of 20 starts in every city: inertia, explained share and silhouette."""
    return cw.kmeans_sweep(_scaled_only(spark, sf_dir), _Z, "listing_id")


@register("cl2_kmeans_sweep_facts", _SCALED_SQL + f""", t AS (SELECT city, count(*) AS rows, {pround_sql(" + ".join(f"sum({c} * {c})" for c in _Z), 3)} AS total_ss
  FROM z GROUP BY city)
SELECT city, CAST(k AS BIGINT) AS k, rows, CAST(k AS BIGINT) AS clusters, total_ss, true AS below_total, true AS falls_with_k, true AS silhouette_in_range
FROM t, range(2, 9) r(k)""")
def kmeans_sweep_facts(spark, sf_dir):
    """CL2: what must hold of the sweep of every city, whatever the starts: all rows in k clusters, the total, inertia that falls with k."""
    sweep = cw.kmeans_sweep(_scaled_only(spark, sf_dir), _Z, "listing_id")
    before = F.lag("inertia").over(Window.partitionBy("city").orderBy("k"))
    return sweep.select("city", "k", "rows", "clusters", pround("total_ss", 3).alias("total_ss"), (F.col("inertia") < F.col("total_ss")).alias("below_total"),
                        F.coalesce(F.col("inertia") < before, F.lit(True)).alias("falls_with_k"), F.col("silhouette").between(-1, 1).alias("silhouette_in_range"))


@register("cl3_kmeans_segments_by_city")
def kmeans_segments_by_city(spark, sf_dir):
    """CL3 + CL4: k = 4 in every city by its own best of 30 starts, then the named profile."""
    fitted = cw.kmeans_segments(_scaled_only(spark, sf_dir), _Z, "listing_id")
    return cs.profile_segments(_complete(spark, sf_dir).join(fitted, "listing_id"), "cluster_id")


def _silhouette_sql(d2: str, by: str) -> str:
    """All pairs: mean squared distance of each row to each label, then the silhouette."""
    part = f"a.{by} = b.{by} AND " if by else ""
    keys = f"{by}, " if by else ""
    group = f" GROUP BY {by}" if by else ""
    return f""", pr AS (SELECT {f"a.{by}, " if by else ""}a.id, a.label, b.label AS other, avg({d2}) AS m FROM p a JOIN p b ON {part}a.id <> b.id GROUP BY ALL),
ab AS (SELECT {keys}id, label, max(m) FILTER (WHERE other = label) AS own, min(m) FILTER (WHERE other <> label) AS near FROM pr GROUP BY ALL)
SELECT {keys}count(*) AS rows, count(DISTINCT label) AS clusters, {pround_sql("avg(CASE WHEN near IS NULL THEN NULL WHEN own IS NULL OR greatest(own, near) = 0 THEN 0 ELSE (near - own) / greatest(own, near) END)", 6)} AS silhouette
FROM ab{group}"""


@register("cl10_silhouette_by_city", _SCALED_SQL + ", p AS (SELECT z.*, listing_id AS id, property_group AS label FROM z JOIN listings USING (listing_id, city))"
          + _silhouette_sql(" + ".join(f"(a.{c} - b.{c}) * (a.{c} - b.{c})" for c in _Z), "city"))
def silhouette_by_city(spark, sf_dir):
    """CL10: squared silhouette of the property groups of every city on the scaled features, without pairs."""
    groups = fx.listings(spark, sf_dir).select("listing_id", F.col("property_group").alias("label"))
    rows = _scaled_only(spark, sf_dir).join(groups, "listing_id").withColumn("x", F.array(*_Z))
    return cw.silhouette(rows, len(_Z), "label", "x", ["city"]).withColumn("silhouette", pround("silhouette", 6))


@register("cl10_silhouette_of_labels", "WITH p AS (SELECT vec_id AS id, label, CAST(embedding AS DOUBLE[]) AS x FROM embeddings)" + _silhouette_sql(
    "list_sum(list_transform(range(1, len(a.x) + 1), lambda i: (a.x[i] - b.x[i]) * (a.x[i] - b.x[i])))", ""))
def silhouette_of_labels(spark, sf_dir):
    """CL10: squared silhouette of the given embedding labels, without pairs."""
    e = read_table(spark, sf_dir, "embeddings")
    d = e.select(F.size("embedding").alias("d")).first()
    return cw.silhouette(e, d.d if d else 0, "label", "embedding").withColumn("silhouette", pround("silhouette", 6))


def _axis_sql(n: int, matrix: str, squarings: int = 16) -> str:
    """Views l{n} (city, lam) and v{n} (city, v): the largest variance of ``matrix`` and its axis, by squaring the matrix again and again."""
    out, last = "", matrix
    for t in range(squarings):
        name = f"m{n}_{t}"
        out += f""", {name} AS MATERIALIZED (SELECT city, i, j, v / sum(CASE WHEN i = j THEN v END) OVER (PARTITION BY city) AS v FROM (
  SELECT a.city, a.i, b.j, sum(a.v * b.v) AS v FROM {last} a JOIN {last} b ON a.city = b.city AND a.j = b.i GROUP BY a.city, a.i, b.j))"""
        last = name
    return out + f""", d{n} AS MATERIALIZED (SELECT city, i, v FROM {last} WHERE i = j QUALIFY row_number() OVER (PARTITION BY city ORDER BY v DESC, i) = 1),
a{n} AS MATERIALIZED (SELECT m.city, m.i, m.v / sqrt(d.v) AS v FROM {last} m JOIN d{n} d ON m.city = d.city AND m.j = d.i),
l{n} AS MATERIALIZED (SELECT c.city, sum(p.v * c.v * q.v) AS lam FROM {matrix} c JOIN a{n} p ON c.city = p.city AND c.i = p.i
  JOIN a{n} q ON c.city = q.city AND c.j = q.i GROUP BY c.city),
v{n} AS (SELECT city, list(v ORDER BY i) AS v FROM a{n} GROUP BY city)"""


_COVARIANCE_SQL = ", ".join(f"{{'i': {i}, 'j': {j}, 'v': covar_pop({a}, {b})}}" for i, a in enumerate(_Z) for j, b in enumerate(_Z))


@register("cl5_pca_by_city", _SCALED_SQL + f""", c1 AS MATERIALIZED (SELECT city, unnest([{_COVARIANCE_SQL}], recursive := true) FROM z GROUP BY city)"""
          + _axis_sql(1, "c1") + """, c2 AS MATERIALIZED (SELECT c.city, c.i, c.j, c.v - l.lam * p.v * q.v AS v FROM c1 c JOIN l1 l ON c.city = l.city
  JOIN a1 p ON c.city = p.city AND c.i = p.i JOIN a1 q ON c.city = q.city AND c.j = q.i)""" + _axis_sql(2, "c2") + f""",
tr AS (SELECT city, sum(v) AS t FROM c1 WHERE i = j GROUP BY city),
s AS (SELECT listing_id, city, [{", ".join(_Z)}] AS x FROM z
  QUALIFY row_number() OVER (PARTITION BY city ORDER BY md5('42:' || CAST(listing_id AS VARCHAR)), listing_id) <= 2500)
SELECT listing_id, s.city, {pround_sql("list_inner_product(s.x, v1.v)", 6)} + 0.0 AS pc1, {pround_sql("list_inner_product(s.x, v2.v)", 6)} + 0.0 AS pc2,
  {pround_sql("l1.lam / tr.t", 6)} AS explained_variance_pc1, {pround_sql("l2.lam / tr.t", 6)} AS explained_variance_pc2
FROM s JOIN v1 USING (city) JOIN v2 USING (city) JOIN l1 USING (city) JOIN l2 USING (city) JOIN tr USING (city)""")
def pca_by_city(spark, sf_dir):
    """CL5: first two components fitted on all scaled rows of each city; a seeded sample of 2500 a city with explained shares."""
    out = pc.pca_view(_scaled_only(spark, sf_dir), _Z, "listing_id")
    return out.select("listing_id", "city", *[(pround(c, 6) + F.lit(0.0)).alias(c) for c in out.columns[2:]])


@register("cl6_gmm_sweep_by_city")
def gmm_sweep_by_city(spark, sf_dir):
    """CL6: Gaussian mixtures k = 2..8 of 5 starts in every city: log-likelihood, AIC, BIC, membership confidence, silhouette."""
    return mx.mixture_sweep(_scaled_only(spark, sf_dir), _Z, "listing_id")


@register("cl7_gmm_segments_by_city")
def gmm_segments_by_city(spark, sf_dir):
    """CL7 + CL4: k = 4 in every city by its own best of 10 mixtures; named segments with membership confidence."""
    rows = written_once(_complete(spark, sf_dir).join(mx.mixture_segments(_scaled_only(spark, sf_dir), _Z, "listing_id"), "listing_id"))
    names = cs.profile_segments(rows, "cluster_id").select("city", "cluster_id", "segment")
    summary = grouped(rows, ["city", "cluster_id"], F.count(F.lit(1)).alias("listings"), pround(F.avg("membership_probability"), 3).alias("avg_probability"),
                      median_of("membership_probability", 3).alias("median_probability"),
                      pround(F.avg(F.col("low_confidence").cast("double")), 3).alias("low_confidence_share"))
    return names.join(summary, ["city", "cluster_id"])


@register("cl7_gmm_moments_by_city", _SCALED_SQL + ", g AS (SELECT city, count(*) AS rows, ["
          + ", ".join(f"{{'feature_a': '{a}', 'feature_b': '{b}', 'covariance': {pround_sql(f'covar_pop({a}, {b})', 6)} + 0.0}}"
                      for i, a in enumerate(_Z) for b in _Z[i:]) + """] AS c FROM z GROUP BY city)
SELECT city, rows, unnest(c, recursive := true) FROM g""")
def gmm_moments_by_city(spark, sf_dir):
    """CL7: covariances that the mixture of every city implies; they are those of its rows, whatever the starts."""
    out = mx.mixture_moments(_scaled_only(spark, sf_dir), _Z, "listing_id")
    return out.withColumn("covariance", pround("covariance", 6) + F.lit(0.0))
