"""Registered profiling queries (AG10-AG34, FI6)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.numeric import erfc_sql, pround
from ..operators import profile as pf
from ..sources import fixtures as fx
from .registry import register
from .sqlkit import pround_sql, with_views

L = with_views("listings")
LX = with_views("listings")[:-1]


@register("ag11_compare_cities", L + f"""
SELECT city, count(*) AS listings, {pround_sql('median(price_eur)', 2)} AS median_price_eur,
  {pround_sql('avg(price_eur)', 2)} AS mean_price_eur, {pround_sql('avg(review_scores_rating)', 2)} AS mean_rating,
  {pround_sql('median(availability_30)', 1)} AS median_availability_30,
  {pround_sql('median(distance_to_center_km)', 2)} AS median_distance_to_center_km
FROM listings GROUP BY city""")
def compare_cities(spark, sf_dir):
    """AG10/AG11: market summary per city."""
    return pf.market_summary(fx.listings(spark, sf_dir))


@register("ag12_executive_overview", LX + f""", c AS (
  SELECT city, count(*) AS listings, {pround_sql('median(price_eur)', 2)} AS m, {pround_sql('avg(review_scores_rating)', 2)} AS r
  FROM listings GROUP BY city)
SELECT count(DISTINCT city) AS cities, CAST(sum(listings) AS BIGINT) AS total_listings,
  avg(m) AS avg_median_price_eur, avg(r) AS avg_rating FROM c""")
def overview(spark, sf_dir):
    """AG12: headline KPIs over the city comparison (unweighted means)."""
    return pf.executive_overview(pf.market_summary(fx.listings(spark, sf_dir)))


@register("ag13_room_type_summary", L + """
SELECT city, room_type, count(*) AS listings, median(price_eur) AS median_price_eur,
  avg(review_scores_rating) AS mean_rating, median(availability_30) AS median_availability_30
FROM listings GROUP BY city, room_type""")
def room_types(spark, sf_dir):
    """AG13: room-type summary per city (null room types form a group)."""
    return pf.room_type_summary(fx.listings(spark, sf_dir))


@register("ag14_price_by_room_type", L + f"""
SELECT city, room_type, count(price_eur) AS count, {pround_sql('median(price_eur)', 3)} AS median,
  {pround_sql('avg(price_eur)', 3)} AS mean, {pround_sql('stddev_samp(price_eur)', 3)} AS std
FROM listings WHERE room_type IS NOT NULL GROUP BY city, room_type""")
def price_by_room(spark, sf_dir):
    """AG14: price count/median/mean/sample std by room type."""
    return pf.price_by_group(fx.listings(spark, sf_dir), "room_type")


@register("ag15_neighbourhood_table", L + f"""
SELECT * FROM (SELECT city, neighbourhood_cleansed, count(*) AS listing_count,
  {pround_sql('median(price_eur)', 3)} AS median_price_eur, {pround_sql('avg(price_eur)', 3)} AS mean_price_eur,
  {pround_sql('median(availability_365)', 3)} AS median_availability_365,
  {pround_sql('avg(review_scores_rating)', 3)} AS mean_rating
FROM listings WHERE neighbourhood_cleansed IS NOT NULL GROUP BY city, neighbourhood_cleansed) WHERE listing_count >= 30""")
def neighbourhoods(spark, sf_dir):
    """AG15: neighbourhood table with >= 30 listings."""
    return pf.neighbourhood_table(fx.listings(spark, sf_dir))


@register("ag16_lowest_median_areas", LX + """, g AS (
  SELECT city, neighbourhood_cleansed, count(*) AS listings, median(price_eur) AS median_price_eur
  FROM listings GROUP BY city, neighbourhood_cleansed HAVING count(*) >= 20)
SELECT city, neighbourhood_cleansed, listings, median_price_eur, CAST(rank AS BIGINT) AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY city ORDER BY median_price_eur, neighbourhood_cleansed) AS rank FROM g)
WHERE rank <= 12""")
def lowest_areas(spark, sf_dir):
    """AG16: the 12 lowest-median areas per city among areas with >= 20 listings."""
    return pf.lowest_median_areas(fx.listings(spark, sf_dir))


_MAP = dict(price_min=50.0, price_max=400.0, min_rating=2.0, include_unrated=True, min_availability=5, min_reviews=1)


@register("ag17_map_area_summary", LX + f""", m AS (
  SELECT * FROM listings WHERE price_eur BETWEEN 50.0 AND 400.0
    AND (review_scores_rating >= 2.0 OR review_scores_rating IS NULL)
    AND coalesce(availability_30, 0) >= 5 AND coalesce(number_of_reviews, 0) >= 1),
g AS (SELECT city, neighbourhood_cleansed, count(*) AS listings, median(price_eur) AS mp, avg(review_scores_rating) AS mr
  FROM m GROUP BY city, neighbourhood_cleansed)
SELECT city, neighbourhood_cleansed, listings, {pround_sql('mp', 2)} AS median_price_eur, {pround_sql('mr', 2)} AS mean_rating,
  CAST(rank AS BIGINT) AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY city ORDER BY listings DESC, mr DESC NULLS LAST, neighbourhood_cleansed) AS rank FROM g)
WHERE rank <= 10""")
def map_areas(spark, sf_dir):
    """FI6 + AG17: map filter then top-10 areas by size and rating."""
    return pf.area_selection_summary(pf.map_filter(fx.listings(spark, sf_dir), **_MAP))


@register("ag18_eda_card", LX + f""", s AS (
  SELECT city, count(*) AS listings, {pround_sql('median(price_eur)', 3)} AS median_price_eur,
    {pround_sql('avg(price_eur)', 3)} AS mean_price_eur, {pround_sql('stddev_samp(price_eur)', 3)} AS price_std_eur,
    {pround_sql('min(price_eur)', 3)} AS min_price_eur, {pround_sql('max(price_eur)', 3)} AS max_price_eur,
    {pround_sql('avg(has_wifi) * 100', 3)} AS has_wifi_rate_pct, {pround_sql('avg(has_kitchen) * 100', 3)} AS has_kitchen_rate_pct,
    {pround_sql('avg(review_scores_rating)', 3)} AS mean_rating, {pround_sql('avg(accommodates)', 3)} AS mean_accommodates,
    {pround_sql('median(availability_365)', 3)} AS median_availability_365
  FROM listings GROUP BY city),
rt AS (SELECT city, room_type AS most_common_room_type FROM (SELECT city, room_type, row_number() OVER
  (PARTITION BY city ORDER BY count(*) DESC, room_type) rn FROM listings WHERE room_type IS NOT NULL GROUP BY city, room_type) WHERE rn = 1),
nb AS (SELECT city, neighbourhood_cleansed AS top_neighbourhood FROM (SELECT city, neighbourhood_cleansed, row_number() OVER
  (PARTITION BY city ORDER BY count(*) DESC, neighbourhood_cleansed) rn FROM listings WHERE neighbourhood_cleansed IS NOT NULL
  GROUP BY city, neighbourhood_cleansed) WHERE rn = 1),
t5 AS (SELECT city, string_agg(coalesce(neighbourhood_cleansed, 'nan') || ': ' || CAST(n AS VARCHAR), '; ' ORDER BY rn) AS top_5_neighbourhoods
  FROM (SELECT city, neighbourhood_cleansed, count(*) n, row_number() OVER (PARTITION BY city ORDER BY count(*) DESC,
    neighbourhood_cleansed NULLS FIRST) rn FROM listings GROUP BY city, neighbourhood_cleansed) WHERE rn <= 5 GROUP BY city)
SELECT s.*, rt.most_common_room_type, nb.top_neighbourhood, t5.top_5_neighbourhoods
FROM s LEFT JOIN rt USING (city) LEFT JOIN nb USING (city) LEFT JOIN t5 USING (city)""")
def eda(spark, sf_dir):
    """AG18: per-city EDA card with modes and top-5 areas."""
    return pf.eda_card(fx.listings(spark, sf_dir), flags=["has_wifi", "has_kitchen"])


@register("ag19_value_counts_top3", LX + """, c AS (
  SELECT city, room_type, count(*) AS count FROM listings WHERE room_type IS NOT NULL GROUP BY city, room_type),
s AS (SELECT *, count * 100.0 / sum(count) OVER (PARTITION BY city) AS share_pct,
  row_number() OVER (PARTITION BY city ORDER BY count DESC, room_type) AS rank FROM c)
SELECT city, room_type, count, count / sum(count) OVER (PARTITION BY city) * 100 AS share_pct, CAST(rank AS BIGINT) AS rank
FROM s QUALIFY rank <= 3""")
def value_counts(spark, sf_dir):
    """AG19: room-type counts, % shares and top 3 per city."""
    return pf.value_counts(fx.listings(spark, sf_dir), "room_type", n=3)


@register("ag20_flag_price_table", LX + """, g AS (
  SELECT city, has_wifi, count(*) AS listings, median(price_eur) AS median_price_eur FROM listings GROUP BY city, has_wifi)
SELECT city, CAST(has_wifi AS BIGINT) AS has_wifi, listings, median_price_eur,
  listings / sum(listings) OVER (PARTITION BY city) * 100 AS share_pct FROM g""")
def flag_price(spark, sf_dir):
    """AG20: flag share % and median price by flag value."""
    return pf.flag_price_table(fx.listings(spark, sf_dir), "has_wifi")


@register("ag21_amenity_prevalence", L + " UNION ALL ".join(
    f"SELECT city, '{f}' AS amenity, avg({f}) * 100 AS prevalence_pct FROM listings GROUP BY city"
    for f in ["has_wifi", "has_kitchen", "has_air_conditioning"]))
def amenities(spark, sf_dir):
    """AG21: amenity prevalence % per city."""
    return pf.amenity_prevalence(fx.listings(spark, sf_dir), ["has_wifi", "has_kitchen", "has_air_conditioning"])


_DESC = ["price_eur", "review_scores_rating", "distance_to_center_km", "accommodates"]


@register("ag22_describe_long", L + " UNION ALL ".join(
    f"""SELECT city, '{c}' AS feature, count({c}) AS count, avg(CAST({c} AS DOUBLE)) AS mean, stddev_samp({c}) AS std,
  CAST(min({c}) AS DOUBLE) AS min, quantile_cont({c}, 0.05) AS p05, quantile_cont({c}, 0.25) AS p25,
  quantile_cont({c}, 0.5) AS p50, quantile_cont({c}, 0.75) AS p75, quantile_cont({c}, 0.95) AS p95,
  CAST(max({c}) AS DOUBLE) AS max FROM listings GROUP BY city""" for c in _DESC))
def describe(spark, sf_dir):
    """AG22: describe() with 5/25/50/75/95 percentiles, long form per city and feature."""
    return pf.describe_long(fx.listings(spark, sf_dir), _DESC)


_CORR = ["distance_to_center_km", "availability_30", "availability_365", "number_of_reviews", "accommodates",
         "amenities_count", "review_scores_rating", "review_scores_value", "has_wifi"]


@register("ag25_target_correlations", L + "SELECT *, abs(correlation) AS abs_correlation FROM (" + " UNION ALL ".join(
    f"SELECT city, '{c}' AS feature, corr(CAST({c} AS DOUBLE), price_eur) AS correlation FROM listings GROUP BY city"
    for c in _CORR) + ")")
def correlations(spark, sf_dir):
    """AG25: correlation of each numeric feature with price, pairwise complete."""
    return pf.target_correlations(fx.listings(spark, sf_dir), _CORR)


_MAT = ["price_eur", "accommodates", "amenities_count", "review_scores_rating"]


@register("ag26_correlation_matrix", L + " UNION ALL ".join(
    f"SELECT city, '{a}' AS feature_a, '{b}' AS feature_b, corr(CAST({a} AS DOUBLE), CAST({b} AS DOUBLE)) AS correlation "
    f"FROM listings GROUP BY city" for i, a in enumerate(_MAT) for b in _MAT[i + 1:]))
def corr_matrix(spark, sf_dir):
    """AG26: pairwise correlations of key features, long form."""
    return pf.correlation_matrix(fx.listings(spark, sf_dir), _MAT)


@register("ag27_skewness", with_views("activity") + """
SELECT city, skewness(price_eur) AS price_skew, skewness(ln(1 + price_eur)) AS log_price_skew, count(*) AS n
FROM activity WHERE price_eur > 0 GROUP BY city""")
def skew(spark, sf_dir):
    """AG27: bias-adjusted skewness of price and log price per city."""
    a = fx.activity(spark, sf_dir).filter(F.col("price_eur") > 0)
    return a.groupBy("city").agg(pf.skewness_adjusted("price_eur").alias("price_skew"),
                                 pf.skewness_adjusted(F.log1p("price_eur")).alias("log_price_skew"),
                                 F.count(F.lit(1)).alias("n"))


@register("ag28_linear_trend", L + """
SELECT city, regr_slope(price_eur, CAST(accommodates AS DOUBLE)) AS slope,
  regr_intercept(price_eur, CAST(accommodates AS DOUBLE)) AS intercept,
  CAST(regr_count(price_eur, CAST(accommodates AS DOUBLE)) AS BIGINT) AS pairs FROM listings GROUP BY city""")
def trend(spark, sf_dir):
    """AG28: least-squares trend of price on capacity per city."""
    return pf.linear_trend(fx.listings(spark, sf_dir), "price_eur", "accommodates")


_MW_SQL = LX + """, x AS (SELECT CAST(price_eur AS DOUBLE) AS v, CASE WHEN has_wifi = 1 THEN 1 ELSE 0 END AS g1
  FROM listings WHERE price_eur IS NOT NULL AND has_wifi IS NOT NULL),
r AS (SELECT g1, CAST(rank() OVER (ORDER BY v) AS DOUBLE) + CAST(count(*) OVER (PARTITION BY v) - 1 AS DOUBLE) / 2.0 AS ar FROM x),
t AS (SELECT CAST(count(*) AS DOUBLE) AS c FROM x GROUP BY v),
s AS (SELECT sum(CASE WHEN g1 = 1 THEN ar ELSE 0 END) AS r1, CAST(sum(g1) AS DOUBLE) AS n1, CAST(sum(1 - g1) AS DOUBLE) AS n2 FROM r),
tt AS (SELECT sum(pow(c, 3) - c) AS tie_term FROM t)
SELECT r1 - n1 * (n1 + 1) / 2.0 AS u_statistic, CAST(n1 AS BIGINT) AS n1, CAST(n2 AS BIGINT) AS n2, tie_term,
  (abs(r1 - n1 * (n1 + 1) / 2.0 - n1 * n2 / 2.0) - 0.5) / sqrt(n1 * n2 / 12.0 * ((n1 + n2 + 1) - tie_term / ((n1 + n2) * (n1 + n2 - 1)))) AS z
FROM s, tt"""


@register("ag29_mann_whitney_u", _MW_SQL)
def mann_whitney(spark, sf_dir):
    """AG29: Mann-Whitney U of price, listings with vs without wifi (p-value in ag29_mann_whitney_p)."""
    return pf.mann_whitney(fx.listings(spark, sf_dir), "price_eur", "has_wifi", 1).drop("p_value")


@register("ag29_mann_whitney_p", "SELECT * EXCLUDE (h), least(1.0, " + erfc_sql("h") + ") AS p_value FROM (SELECT *, z / sqrt(2.0) AS h FROM (" + _MW_SQL + "))")
def mann_whitney_p(spark, sf_dir):
    """AG29: two-sided normal-approximation p-value."""
    return pf.mann_whitney(fx.listings(spark, sf_dir), "price_eur", "has_wifi", 1)


@register("ag30_five_number_summary", L + """
SELECT room_type, min(price_eur) AS min, quantile_cont(price_eur, 0.25) AS q1, quantile_cont(price_eur, 0.5) AS median,
  quantile_cont(price_eur, 0.75) AS q3, max(price_eur) AS max FROM listings GROUP BY room_type""")
def box(spark, sf_dir):
    """AG30: box-plot five-number summary of price per room type."""
    return pf.five_number_summary(fx.listings(spark, sf_dir), "price_eur", ["room_type"])


@register("ag31_price_by_amenity_quartile", LX + """, e AS (
  SELECT city, list_sort(list_distinct([quantile_cont(CAST(amenities_count AS DOUBLE), 0.0), quantile_cont(CAST(amenities_count AS DOUBLE), 0.25),
    quantile_cont(CAST(amenities_count AS DOUBLE), 0.5), quantile_cont(CAST(amenities_count AS DOUBLE), 0.75),
    quantile_cont(CAST(amenities_count AS DOUBLE), 1.0)])) AS e FROM listings GROUP BY city),
j AS (SELECT l.city, l.price_eur, e.e, greatest(len(list_filter(e.e, lambda x: x < CAST(l.amenities_count AS DOUBLE))) - 1, 0) AS bin
  FROM listings l JOIN e ON l.city = e.city WHERE l.amenities_count IS NOT NULL)
SELECT city, CAST(bin AS BIGINT) AS bin, e[bin + 1] AS bin_low, e[bin + 2] AS bin_high, count(*) AS listings,
  median(price_eur) AS median_price_eur FROM j GROUP BY city, bin, e""")
def amenity_quartiles(spark, sf_dir):
    """AG31: median price by amenity-count quartile (qcut edges, duplicates dropped)."""
    return pf.price_by_quantile_bin(fx.listings(spark, sf_dir), "amenities_count")


@register("ag32_price_histogram", LX + """, x AS (SELECT city, CAST(price_eur AS DOUBLE) AS v FROM listings WHERE price_eur IS NOT NULL),
c AS (SELECT city, quantile_cont(v, 0.99) AS cap FROM x GROUP BY city),
y AS (SELECT x.* FROM x JOIN c ON x.city = c.city WHERE x.v <= c.cap),
r AS (SELECT city, min(v) AS lo, max(v) AS hi FROM y GROUP BY city),
b AS (SELECT y.city, r.lo, (r.hi - r.lo) / 30 AS w, CASE WHEN (r.hi - r.lo) / 30 = 0 THEN 0
  ELSE least(CAST(floor((y.v - r.lo) / ((r.hi - r.lo) / 30)) AS BIGINT), 29) END AS bin FROM y JOIN r ON y.city = r.city)
SELECT city, CAST(bin AS BIGINT) AS bin, count(*) AS count, any_value(lo) + bin * any_value(w) AS bin_start FROM b GROUP BY city, bin""")
def hist(spark, sf_dir):
    """AG32: 30-bin price histogram per city after a 99th-percentile cap."""
    return pf.histogram(fx.listings(spark, sf_dir), "price_eur", 30, cap_quantile=0.99)


def _latlon(l):
    return l.select("city", (F.lit(40.3) + (F.col("listing_id") % 1000).cast("double") / F.lit(5000.0)).alias("lat"),
                    (F.lit(-3.8) + F.col("number_of_reviews").cast("double") / F.lit(40.0)).alias("lon"))


@register("ag33_geo_bounds", LX + """, p AS (SELECT city, CAST(40.3 AS DOUBLE) + CAST(listing_id % 1000 AS DOUBLE) / CAST(5000 AS DOUBLE) AS lat,
  CAST(-3.8 AS DOUBLE) + CAST(number_of_reviews AS DOUBLE) / CAST(40 AS DOUBLE) AS lon FROM listings),
g AS (SELECT city, median(lat) AS center_lat, median(lon) AS center_lon, quantile_cont(lat, 0.01) AS la0,
  quantile_cont(lat, 0.99) AS la1, quantile_cont(lon, 0.01) AS lo0, quantile_cont(lon, 0.99) AS lo1 FROM p GROUP BY city)
SELECT city, center_lat, center_lon, la0 - greatest((la1 - la0) * 0.12, 0.02) AS min_lat, la1 + greatest((la1 - la0) * 0.12, 0.02) AS max_lat,
  lo0 - greatest((lo1 - lo0) * 0.12, 0.02) AS min_lon, lo1 + greatest((lo1 - lo0) * 0.12, 0.02) AS max_lon FROM g""")
def geo(spark, sf_dir):
    """AG33: map centre (medians) and padded 1-99 % bounds per city."""
    return pf.geo_bounds(_latlon(fx.listings(spark, sf_dir)), "lat", "lon")


@register("ag34_area_average_distance", L + """
SELECT city, neighbourhood_cleansed, CASE WHEN count(distance_to_center_km) > 0 THEN avg(distance_to_center_km) ELSE 5.0 END AS average_distance_km,
  count(distance_to_center_km) AS rows FROM listings GROUP BY city, neighbourhood_cleansed
UNION ALL
SELECT city, NULL AS neighbourhood_cleansed, CASE WHEN count(distance_to_center_km) > 0 THEN avg(distance_to_center_km) ELSE 5.0 END,
  count(distance_to_center_km) FROM listings GROUP BY city""")
def area_distance(spark, sf_dir):
    """AG34: mean distance per neighbourhood and per city with a fallback value."""
    return pf.area_average_distance(fx.listings(spark, sf_dir))


__all__ = ["pround"]
