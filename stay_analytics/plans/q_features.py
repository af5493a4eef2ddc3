"""Registered feature queries (PR18-PR27, AG23, AG35-AG37, WN2-WN3)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import calendar as cl
from ..operators import features as ft
from ..sources import fixtures as fx
from .registry import register
from .sqlkit import pround_sql, with_views

LISTING_COLUMNS = ["listing_id", "city", "neighbourhood_cleansed", "price_eur", "room_type", "property_group",
                   "distance_to_center_km", "availability_30", "availability_365", "minimum_nights",
                   "number_of_reviews", "accommodates", "amenities_count", "review_scores_rating",
                   "review_scores_value", "has_wifi", "has_kitchen", "has_air_conditioning"]


def _feature_input(spark, sf_dir):
    """Listings with stand-in host/review/bed columns derived from existing ones + calendar gaps."""
    l = fx.listings(spark, sf_dir)
    calf = cl.calendar_rollup(fx.calendar(spark, sf_dir)).select(
        "listing_id", "calendar_unavailable_weekend", "calendar_unavailable_weekday")
    return (l.select("listing_id", "city", "accommodates", "availability_30", "availability_365",
                     "review_scores_rating",
                     F.col("number_of_reviews").alias("beds"),
                     (F.col("has_wifi") + F.col("has_kitchen")).alias("bathrooms"),
                     (F.col("availability_30") % 25).alias("host_listings_count"),
                     (F.col("number_of_reviews") > 0).cast("int").alias("has_reviews"),
                     (F.col("availability_365") * 2).alias("days_since_last_review"),
                     F.when(F.col("number_of_reviews") > 0, F.col("number_of_reviews")).alias("raw_reviews_last_6m"))
            .join(calf, "listing_id", "left"))


def _ratio(n, d):
    return f"(CASE WHEN CAST({d} AS DOUBLE) <> 0 THEN CAST({n} AS DOUBLE) / CAST({d} AS DOUBLE) END)"


_ENG_SQL = with_views("listings", "calendar")[:-1] + f""", calf AS (
  SELECT listing_id,
    sum(CASE WHEN isodow(date) - 1 >= 5 THEN (CASE WHEN available = 't' THEN 0 ELSE 1 END) END)
      / count(CASE WHEN isodow(date) - 1 >= 5 THEN 1 END) AS calendar_unavailable_weekend,
    sum(CASE WHEN NOT coalesce(isodow(date) - 1 >= 5, false) THEN (CASE WHEN available = 't' THEN 0 ELSE 1 END) END)
      / count(CASE WHEN NOT coalesce(isodow(date) - 1 >= 5, false) THEN 1 END) AS calendar_unavailable_weekday
  FROM calendar GROUP BY listing_id),
x AS (SELECT l.listing_id, l.city, l.accommodates, l.availability_30, l.availability_365, l.review_scores_rating,
    l.number_of_reviews AS beds, l.has_wifi + l.has_kitchen AS bathrooms, l.availability_30 % 25 AS host_listings_count,
    CASE WHEN l.number_of_reviews > 0 THEN 1 ELSE 0 END AS has_reviews, l.availability_365 * 2 AS days_since_last_review,
    CASE WHEN l.number_of_reviews > 0 THEN l.number_of_reviews END AS raw_reviews_last_6m,
    c.calendar_unavailable_weekend, c.calendar_unavailable_weekday
  FROM listings l LEFT JOIN calf c ON l.listing_id = c.listing_id)
SELECT listing_id, city, CAST(accommodates AS BIGINT) AS accommodates, CAST(availability_30 AS BIGINT) AS availability_30,
  CAST(availability_365 AS BIGINT) AS availability_365, review_scores_rating, CAST(beds AS BIGINT) AS beds,
  CAST(bathrooms AS BIGINT) AS bathrooms, CAST(host_listings_count AS BIGINT) AS host_listings_count,
  CAST(has_reviews AS BIGINT) AS has_reviews, CAST(days_since_last_review AS BIGINT) AS days_since_last_review,
  CAST(raw_reviews_last_6m AS BIGINT) AS raw_reviews_last_6m, calendar_unavailable_weekend, calendar_unavailable_weekday,
  {pround_sql(_ratio('beds', 'accommodates'), 4)} AS beds_per_guest,
  {pround_sql(_ratio('bathrooms', 'accommodates'), 4)} AS bathrooms_per_guest,
  CASE WHEN accommodates < 0 THEN NULL WHEN accommodates <= 1 THEN 'solo' WHEN accommodates <= 2 THEN 'couple'
    WHEN accommodates <= 4 THEN 'small_group' WHEN accommodates <= 6 THEN 'family_group'
    WHEN accommodates IS NOT NULL THEN 'large_group' END AS capacity_bucket,
  CASE WHEN coalesce(host_listings_count, 0) <= -1 THEN NULL WHEN coalesce(host_listings_count, 0) <= 1 THEN 'single_listing'
    WHEN coalesce(host_listings_count, 0) <= 4 THEN 'small_multi_host' WHEN coalesce(host_listings_count, 0) <= 20 THEN 'professional_host'
    ELSE 'large_operator' END AS host_scale_bucket,
  CAST(coalesce(raw_reviews_last_6m, 0) AS BIGINT) AS reviews_last_6m,
  CAST(CASE WHEN review_scores_rating IS NOT NULL THEN 1 ELSE 0 END AS BIGINT) AS has_rating,
  CASE WHEN coalesce(has_reviews, 0) = 0 OR days_since_last_review IS NULL THEN 'no_reviews'
    WHEN days_since_last_review <= 30 THEN 'reviewed_30d' WHEN days_since_last_review <= 90 THEN 'reviewed_90d'
    WHEN days_since_last_review <= 365 THEN 'reviewed_365d' ELSE 'stale_over_365d' END AS review_recency_bucket,
  CAST(CASE WHEN coalesce(has_reviews, 0) = 1 AND days_since_last_review <= 30 THEN 1 ELSE 0 END AS BIGINT) AS reviewed_last_30d,
  CAST(CASE WHEN coalesce(has_reviews, 0) = 1 AND days_since_last_review <= 90 THEN 1 ELSE 0 END AS BIGINT) AS reviewed_last_90d,
  CAST(CASE WHEN availability_30 <= 7 THEN 1 ELSE 0 END AS BIGINT) AS low_availability_30,
  CAST(CASE WHEN availability_365 >= 270 THEN 1 ELSE 0 END AS BIGINT) AS high_annual_availability,
  {pround_sql(_ratio('availability_30', '30'), 4)} AS availability_30_ratio,
  {pround_sql(_ratio('availability_365', '365'), 4)} AS availability_365_ratio,
  {pround_sql('calendar_unavailable_weekend - calendar_unavailable_weekday', 4)} AS calendar_weekend_unavailable_gap
FROM x"""


@register("pr18_engineered_features", _ENG_SQL)
def engineered(spark, sf_dir):
    """PR18-PR24: per-guest ratios, capacity/host/recency buckets, flags, availability ratios, weekend gap."""
    return ft.add_engineered_features(_feature_input(spark, sf_dir))


def _profile_sql(select: str, where: str = "") -> str:
    parts = []
    for c in LISTING_COLUMNS:
        parts.append(f"SELECT city, '{c}' AS attribute, avg(CASE WHEN {c} IS NULL THEN 1.0 ELSE 0.0 END) * 100 AS mp, "
                     f"count(DISTINCT {c}) AS unique_values FROM listings GROUP BY city")
    return with_views("listings")[:-1] + ", prof AS (" + "\nUNION ALL\n".join(parts) + f")\nSELECT {select} FROM prof {where}"


_IN = lambda xs: "(" + ", ".join(f"'{x}'" for x in xs) + ")"

_DECISION_SQL = _profile_sql(f"""city, attribute,
  CASE WHEN attribute IN {_IN(ft.TARGET_COLUMNS)} THEN 'keep_target' WHEN attribute IN {_IN(ft.DROP_COLUMNS)} THEN 'drop'
    WHEN mp > 35.0 THEN 'drop' WHEN unique_values <= 1 THEN 'drop' ELSE 'keep_feature' END AS decision,
  {pround_sql('mp', 3)} AS missing_pct, unique_values,
  CASE WHEN attribute IN {_IN(ft.TARGET_COLUMNS)} THEN 'Target or target transform.'
    WHEN attribute IN {_IN(ft.DROP_COLUMNS)} THEN 'Identifier, raw date, redundant, constant, or not model-friendly for first pass.'
    WHEN mp > 35.0 THEN 'More than 35% missing in this city.' WHEN unique_values <= 1 THEN 'No useful variation within this city.'
    ELSE 'Usable first-pass predictor.' END AS reason""")


@register("ag35_feature_decisions", _DECISION_SQL)
def decisions(spark, sf_dir):
    """AG35: keep/drop decision per city and attribute with missing % and distinct counts."""
    return ft.feature_decisions(fx.listings(spark, sf_dir))


@register("ag36_recommended_features", _profile_sql(f"""city, attribute,
  CASE WHEN attribute IN {_IN(ft.RECOMMEND_EXCLUDE)} OR mp > 35.0 OR unique_values <= 1 THEN 'exclude' ELSE 'use' END AS recommendation,
  {pround_sql('mp', 3)} AS missing_pct, unique_values,
  CASE WHEN attribute IN {_IN(ft.RECOMMEND_EXCLUDE)} THEN 'Identifier, target, raw date, constant city field, or non-informative calendar length.'
    WHEN mp > 35.0 THEN 'Too sparse for first-pass modelling; revisit only if city-specific handling is needed.'
    WHEN unique_values <= 1 THEN 'No predictive variation within this city.'
    ELSE 'Usable city-specific predictor for first-pass models.' END AS note"""))
def recommended(spark, sf_dir):
    """AG36: recommended model feature list per city."""
    return ft.recommended_features(fx.listings(spark, sf_dir))


_NUMERIC = ["listing_id", "price_eur", "distance_to_center_km", "availability_30", "availability_365", "minimum_nights",
            "number_of_reviews", "accommodates", "amenities_count", "review_scores_rating", "review_scores_value",
            "has_wifi", "has_kitchen", "has_air_conditioning"]


@register("ag37_candidate_features", _profile_sql(
    f"""city, attribute, CASE WHEN attribute IN {_IN(_NUMERIC)} THEN 'numeric' ELSE 'categorical' END AS kind,
  {pround_sql('mp', 3)} AS missing_pct""",
    "WHERE attribute NOT IN ('listing_id', 'city', 'price_eur', 'log_price_eur') AND mp <= 35.0"))
def candidates(spark, sf_dir):
    """AG37: usable candidate features split numeric / categorical."""
    return ft.candidate_features(fx.listings(spark, sf_dir))


@register("ag23_null_profile", _profile_sql(f"city, attribute, {pround_sql('mp', 1)} AS null_pct", "WHERE mp > 0"))
def null_profile(spark, sf_dir):
    """AG23: % null per city and column (columns with any nulls)."""
    from ..functions.numeric import pround
    p = ft.column_profile(fx.listings(spark, sf_dir))
    return p.filter(F.col("missing_pct") > 0).select("city", "attribute", pround("missing_pct", 1).alias("null_pct"))


_FILL = ["review_scores_rating", "review_scores_value", "accommodates", "amenities_count"]


@register("wn2_group_median_fill", with_views("listings") + "SELECT listing_id, city, " + ", ".join(
    f"coalesce(CAST({c} AS DOUBLE), median(CAST({c} AS DOUBLE)) OVER (PARTITION BY city)) AS {c}" for c in _FILL)
    + " FROM listings")
def group_fill(spark, sf_dir):
    """WN2: nulls filled with the city median (nulls only)."""
    l = fx.listings(spark, sf_dir).select("listing_id", "city", *_FILL)
    return ft.fill_group_median(l, _FILL)


_IMPUTE_NUM = ["price_eur", "distance_to_center_km", "availability_30", "number_of_reviews", "accommodates",
               "amenities_count", "review_scores_rating", "review_scores_value"]


@register("wn3_impute_nulls", with_views("listings")[:-1] + ", s AS (SELECT *, " + ", ".join(
    f"avg(CASE WHEN {c} IS NULL THEN 1.0 ELSE 0.0 END) OVER (PARTITION BY city) AS ns_{c}, "
    f"median(CAST({c} AS DOUBLE)) OVER (PARTITION BY city) AS md_{c}" for c in _IMPUTE_NUM)
    + " FROM listings) SELECT listing_id, city, coalesce(room_type, 'Unknown') AS room_type, " + ", ".join(
    f"CASE WHEN ns_{c} > 0 AND ns_{c} <= 0.3 THEN coalesce(CAST({c} AS DOUBLE), md_{c}) ELSE CAST({c} AS DOUBLE) END AS {c}"
    for c in _IMPUTE_NUM) + " FROM s")
def impute(spark, sf_dir):
    """WN3: per-city median imputation for sparse-null numeric columns; 'Unknown' for strings."""
    l = fx.listings(spark, sf_dir).select("listing_id", "city", "room_type", *_IMPUTE_NUM)
    out = ft.impute_nulls(l.withColumn("listing_id", F.col("listing_id").cast("string")))
    return out.withColumn("listing_id", F.col("listing_id").cast("bigint"))
