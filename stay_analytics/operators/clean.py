"""Listing, review and master-table builds (PR1-PR14, PR25, PR32, FI1-FI2, JN1-JN5, AG9, AG38).

Each step is a projection or one aggregate; the master join is three left
equi-joins on ``listing_id`` (AQE picks broadcast or sort-merge from real
sizes). Audits are single-row aggregates over the same lazy inputs.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import clip_upper, pround
from ..functions.parse import (KEY_AMENITIES, amenity_flags, bathroom_type, classify_property_type, haversine_km,
                               parse_amenities, parse_bathrooms, parse_boolean, parse_price, parse_rate)
from .filters import attach_group_values, iqr_bounds
from .ranking import Quantile, grouped

BOOLEAN_COLUMNS = ["host_is_superhost", "host_has_profile_pic", "host_identity_verified", "has_availability",
                   "instant_bookable"]
RATE_COLUMNS = ["host_response_rate", "host_acceptance_rate"]


def select_existing(df: DataFrame, wanted: Sequence[str]) -> tuple[DataFrame, list[str]]:
    """IO1: keep the wanted columns that exist; report the missing ones."""
    have = [c for c in wanted if c in df.columns]
    return df.select(*have), [c for c in wanted if c not in df.columns]


def parse_listing_columns(raw: DataFrame, currency: str | None = "currency",
                          keep_amenity_array: bool = False) -> DataFrame:
    """PR1-PR9 on whatever raw columns are present (price -> price_eur, etc.)."""
    cols = set(raw.columns)
    out = raw
    if "id" in cols and "listing_id" not in cols:
        out = out.withColumnRenamed("id", "listing_id")
    if "price" in cols:
        cur = currency if currency in cols else None
        out = out.withColumn("price_eur", parse_price("price", cur))
    for c in BOOLEAN_COLUMNS:
        if c in cols:
            out = out.withColumn(c, parse_boolean(c))
    for c in RATE_COLUMNS:
        if c in cols:
            out = out.withColumn(c, parse_rate(c))
    if "bathrooms_text" in cols:
        out = out.withColumn("bathrooms", parse_bathrooms("bathrooms_text")) \
                 .withColumn("bathroom_type", bathroom_type("bathrooms_text"))
    arr = parse_amenities("amenities") if "amenities" in cols else F.array().cast("array<string>")
    out = out.withColumn("_amen", arr)
    out = out.select("*", F.size("_amen").alias("amenities_count"), *amenity_flags(F.col("_amen")))
    if keep_amenity_array:
        out = out.withColumnRenamed("_amen", "amenity_list")
    else:
        out = out.drop("_amen")
    if "property_type" in cols:
        out = out.withColumn("property_group", classify_property_type("property_type"))
    return out


def add_location_features(df: DataFrame, centre_lat, centre_lon, lat: str = "latitude",
                          lon: str = "longitude") -> DataFrame:
    """PR10-PR11: distance to centre (4 dp) and central flag (<= 5 km)."""
    d = haversine_km(lat, lon, centre_lat, centre_lon, 4)
    return df.withColumn("distance_to_center_km", d) \
             .withColumn("is_central_5km", (F.col("distance_to_center_km") <= 5).cast("int"))


def add_host_and_date_features(df: DataFrame) -> DataFrame:
    """PR12-PR14, PR25: log price, day differences, capped minimum nights, pro host."""
    cols = set(df.columns)
    out = df
    if "price_eur" in cols:
        out = out.withColumn("log_price_eur", F.log1p("price_eur"))
    d = lambda c: F.col(c).cast("string").try_cast("date") if c in cols else F.lit(None).cast("date")
    if "last_scraped" in cols:
        out = (out.withColumn("host_tenure_days", F.datediff(d("last_scraped"), d("host_since")))
               .withColumn("days_since_last_review", F.datediff(d("last_scraped"), d("last_review"))))
    if "first_review" in cols:
        out = out.withColumn("review_history_days", F.datediff(d("last_review"), d("first_review")))
    if "number_of_reviews" in cols:
        out = out.withColumn("has_reviews", (F.coalesce(F.col("number_of_reviews"), F.lit(0)) > 0).cast("int"))
    if "minimum_nights" in cols:
        out = out.withColumn("minimum_nights_capped", clip_upper("minimum_nights", 30))
    if "host_listings_count" in cols:
        out = out.withColumn("is_professional_host",
                             (F.coalesce(F.col("host_listings_count"), F.lit(0)) >= 5).cast("int"))
    return out


def price_filter_audit(df: DataFrame, price: str = "price_eur", by: Sequence[str] = ("city",),
                       k: float = 1.5) -> DataFrame:
    """FI1+FI2 audit per group: raw rows, missing/zero prices, IQR bounds, outliers, kept rows.

    Two aggregates: bounds over positive prices, then counts against them.
    """
    by = list(by)
    valid = df.filter(F.col(price) > 0)
    bounds = iqr_bounds(valid, price, by, k).select(*by, F.col("lower_bound").alias("price_iqr_lower_eur"),
                                                    F.col("upper_bound").alias("price_iqr_upper_eur"))
    j = df.join(bounds, by, "left")
    ok = F.col(price) > 0
    inside = ok & F.col(price).between(F.col("price_iqr_lower_eur"), F.col("price_iqr_upper_eur"))
    return j.groupBy(*by).agg(
        F.count(F.lit(1)).alias("raw_listing_rows"),
        F.sum(F.when(ok, 0).otherwise(1)).alias("missing_or_zero_price_rows"),
        F.first("price_iqr_lower_eur").alias("price_iqr_lower_eur"),
        F.first("price_iqr_upper_eur").alias("price_iqr_upper_eur"),
        F.sum(F.when(ok & ~F.coalesce(inside, F.lit(False)), 1).otherwise(0)).alias("price_outlier_rows_removed"),
        F.sum(F.when(F.coalesce(inside, F.lit(False)), 1).otherwise(0)).alias("clean_listing_rows_after_price_filter"),
    )


def clip_upper_quantile(df: DataFrame, columns: Sequence[str], q: float = 0.99, by: Sequence[str] = ()) -> DataFrame:
    """PR13: values above their group's exact quantile ``q`` become that quantile; nulls stay null."""
    caps = grouped(df, by, *[Quantile(c, q).alias(f"_cap_{c}") for c in columns])
    out = attach_group_values(df, caps, by)
    for c in columns:
        out = out.withColumn(c, F.when(F.col(c) > F.col(f"_cap_{c}"), F.col(f"_cap_{c}")).otherwise(F.col(c).cast("double")))
    return out.drop(*[f"_cap_{c}" for c in columns])


def day_differences(df: DataFrame, as_of, host_since: str, first_review: str, last_review: str) -> DataFrame:
    """PR14: host tenure, days since the last review and length of the review history, in days; null where a date is missing."""
    ref = F.lit(as_of).cast("date")
    day = lambda c: F.to_date(F.col(c))
    return (df.withColumn("host_tenure_days", F.datediff(ref, day(host_since)))
            .withColumn("days_since_last_review", F.datediff(ref, day(last_review)))
            .withColumn("review_history_days", F.datediff(day(last_review), day(first_review))))


def review_features(reviews: DataFrame, as_of, key: Sequence[str] = ("listing_id",), date: str = "date",
                    recent_months: int = 6) -> DataFrame:
    """AG9: per listing total reviews, days since last, listing age, reviews in the last N months.

    ``as_of`` is an explicit reference date (the reference used "today", Q6).
    The month offset clamps to month end like a calendar month offset.
    """
    ref = F.lit(as_of).cast("date") if not hasattr(as_of, "_jc") else as_of
    d = F.col(date).cast("date")
    cutoff = F.add_months(ref, -recent_months)
    return reviews.groupBy(*key).agg(
        F.count(d).alias("total_reviews"),
        F.datediff(ref, F.max(d)).alias("days_since_last_review"),
        F.datediff(ref, F.min(d)).alias("listing_age_days"),
        F.count(F.when(d >= cutoff, d)).alias(f"reviews_last_{recent_months}m"),
    )


def clean_reviews(reviews: DataFrame, text: str = "comments", date: str = "date",
                  pii: Sequence[str] = ("reviewer_id", "reviewer_name")) -> DataFrame:
    """PR32: lower/trim column names, drop PII, drop null dates and blank texts."""
    out = reviews.toDF(*[c.strip().lower() for c in reviews.columns])
    out = out.drop(*[c for c in pii if c in out.columns])
    return out.filter(F.col(date).isNotNull() & (F.trim(F.coalesce(F.col(text), F.lit(""))) != ""))


def attach_geo(listings: DataFrame, geo: DataFrame, key: str = "neighbourhood_cleansed",
               group: str = "neighbourhood_group", own_group: str = "neighbourhood_group_cleansed") -> DataFrame:
    """JN2: left join a (deduplicated) geo dimension; the listing's own group wins (combine_first)."""
    dim = geo.groupBy(key).agg(F.min(group).alias("_geo_group"))  # one row per key (Q17)
    j = listings.join(dim, key, "left")
    if own_group in j.columns:
        j = j.withColumn(group, F.coalesce(F.col(own_group), F.col("_geo_group"))).drop(own_group)
    else:
        j = j.withColumn(group, F.col("_geo_group"))
    return j.drop("_geo_group")


def build_master(listings: DataFrame, calendar_features: DataFrame, review_feats: DataFrame,
                 geo: DataFrame | None = None, key: str = "listing_id") -> DataFrame:
    """JN1: listings left-joined with calendar and review features (and geo, JN2)."""
    m = listings.join(calendar_features, key, "left").join(review_feats, key, "left")
    return attach_geo(m, geo) if geo is not None else m


def key_match_audit(left: DataFrame, right: DataFrame, left_key: str, right_key: str) -> DataFrame:
    """JN3: distinct keys on each side, matched keys and match % (of the left side)."""
    lk = left.select(F.col(left_key).alias("k")).distinct()
    rk = right.select(F.col(right_key).alias("k")).distinct()
    matched = lk.join(rk, "k", "left_semi")
    return (lk.agg(F.count(F.lit(1)).alias("left_unique_keys"))
            .withColumn("right_unique_keys", rk.agg(F.count(F.lit(1))).scalar())
            .withColumn("matched_keys", matched.agg(F.count(F.lit(1))).scalar())
            .withColumn("match_pct", pround(F.col("matched_keys") / F.col("left_unique_keys") * 100, 4)))


def semi_filter(df: DataFrame, ids: DataFrame, key: str, ids_key: str | None = None) -> DataFrame:
    """JN4: keep rows whose key appears in ``ids`` (left semi join)."""
    ids_key = ids_key or key
    return df.join(ids.select(F.col(ids_key).alias(key)).distinct(), key, "left_semi")


__all__ = ["KEY_AMENITIES"]
