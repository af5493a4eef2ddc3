"""Engineered features, feature audits and imputation (PR18-PR27, AG23, AG35-AG37, WN2-WN3).

Column audits (null share, distinct count) run for every column in two
aggregates: one pass for null shares, and a long ``(group, attribute,
value)`` table deduplicated map-side for distinct counts; no per-column job.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.numeric import col_of, pround, safe_ratio
from .ranking import grouped, median_of

# Columns never used as model features (identifiers, raw dates, redundant).
DROP_COLUMNS = ["listing_id", "city", "last_scraped", "host_since", "first_review", "last_review", "property_type",
                "host_total_listings_count", "minimum_nights", "has_availability", "calendar_days",
                "calendar_available_days", "calendar_unavailable_days", "raw_review_total_reviews",
                "raw_reviews_last_6m"]
TARGET_COLUMNS = ["price_eur", "log_price_eur"]
# Columns excluded from the recommended feature list.
RECOMMEND_EXCLUDE = ["listing_id", "city", "price_eur", "log_price_eur", "last_scraped", "host_since",
                     "first_review", "last_review", "calendar_days"]


def capacity_bucket(c) -> Column:
    """PR20: [0,1] solo, (1,2] couple, (2,4] small_group, (4,6] family_group, (6,inf) large_group."""
    x = col_of(c).cast("double")
    return (F.when(x < 0, None).when(x <= 1, "solo").when(x <= 2, "couple").when(x <= 4, "small_group")
            .when(x <= 6, "family_group").when(x.isNotNull() & ~F.isnan(x), "large_group"))


def host_scale_bucket(c) -> Column:
    """PR21: nulls as 0; (-1,1] single, (1,4] small multi, (4,20] professional, (20,inf) large operator."""
    x = F.coalesce(col_of(c).cast("double"), F.lit(0.0))
    return (F.when(x <= -1, None).when(x <= 1, "single_listing").when(x <= 4, "small_multi_host")
            .when(x <= 20, "professional_host").otherwise("large_operator"))


def review_recency_bucket(has_reviews, days) -> Column:
    """PR22: first matching rule; no reviews or unknown recency -> no_reviews."""
    h, d = F.coalesce(col_of(has_reviews), F.lit(0)), col_of(days)
    return (F.when((h == 0) | d.isNull(), "no_reviews").when(d <= 30, "reviewed_30d")
            .when(d <= 90, "reviewed_90d").when(d <= 365, "reviewed_365d").otherwise("stale_over_365d"))


def add_engineered_features(df: DataFrame) -> DataFrame:
    """PR18-PR24: ratios, buckets, recency flags, availability pressure, weekend gap."""
    cols = set(df.columns)
    c = lambda n: F.col(n) if n in cols else F.lit(None).cast("double")
    has = F.coalesce(c("has_reviews"), F.lit(0))
    days = c("days_since_last_review")
    out = df.select(
        "*",
        pround(safe_ratio(c("beds"), c("accommodates")), 4).alias("beds_per_guest"),
        pround(safe_ratio(c("bathrooms"), c("accommodates")), 4).alias("bathrooms_per_guest"),
        capacity_bucket(c("accommodates")).alias("capacity_bucket"),
        host_scale_bucket(c("host_listings_count")).alias("host_scale_bucket"),
        F.coalesce(c("raw_reviews_last_6m"), F.lit(0)).alias("reviews_last_6m"),
        c("review_scores_rating").isNotNull().cast("int").alias("has_rating"),
        review_recency_bucket(has, days).alias("review_recency_bucket"),
        F.coalesce((has == 1) & (days <= 30), F.lit(False)).cast("int").alias("reviewed_last_30d"),
        F.coalesce((has == 1) & (days <= 90), F.lit(False)).cast("int").alias("reviewed_last_90d"),
        F.coalesce(c("availability_30") <= 7, F.lit(False)).cast("int").alias("low_availability_30"),
        F.coalesce(c("availability_365") >= 270, F.lit(False)).cast("int").alias("high_annual_availability"),
        pround(safe_ratio(c("availability_30"), F.lit(30)), 4).alias("availability_30_ratio"),
        pround(safe_ratio(c("availability_365"), F.lit(365)), 4).alias("availability_365_ratio"),
        pround(c("calendar_unavailable_weekend") - c("calendar_unavailable_weekday"), 4)
        .alias("calendar_weekend_unavailable_gap"),
    )
    return out


def column_profile(df: DataFrame, by: Sequence[str] = ("city",), columns: Sequence[str] | None = None) -> DataFrame:
    """AG23 + distinct counts: ``(by..., attribute, missing_pct, unique_values)`` for every column.

    Null shares come from one aggregate (wide, then unpivoted); distinct
    counts from a long table deduplicated map-side and counted per attribute.
    """
    by = list(by)
    columns = [c for c in (columns or df.columns)]
    nulls = df.groupBy(*by).agg(*[F.avg(F.col(f"`{c}`").isNull().cast("double")).alias(f"n{i}")
                                  for i, c in enumerate(columns)])
    stack = F.inline(F.array(*[F.struct(F.lit(c).alias("attribute"), F.col(f"n{i}").alias("_null_share"))
                               for i, c in enumerate(columns)]))
    nulls = nulls.select(*by, stack)
    cells = F.inline(F.array(*[F.struct(F.lit(c).alias("attribute"), _as_text(df, c).alias("_v"))
                               for c in columns]))
    distinct = (df.select(*[F.col(b).alias(f"_g_{b}") for b in by], cells)
                .filter(F.col("_v").isNotNull())
                .distinct()
                .groupBy(*[f"_g_{b}" for b in by], "attribute").agg(F.count(F.lit(1)).alias("unique_values")))
    for b in by:
        distinct = distinct.withColumnRenamed(f"_g_{b}", b)
    prof = nulls.join(distinct, [*by, "attribute"], "left")
    return prof.select(*by, "attribute", (F.col("_null_share") * 100).alias("missing_pct"),
                       F.coalesce(F.col("unique_values"), F.lit(0)).alias("unique_values"))


def _as_text(df: DataFrame, c: str) -> Column:
    t = df.schema[c].dataType
    x = F.col(f"`{c}`")
    if isinstance(t, (T.DoubleType, T.FloatType)):
        x = F.when(~F.isnan(x), x)  # NaN counts as missing
    if isinstance(t, T.ArrayType):
        return F.to_json(x)
    return x.cast("string")


def feature_decisions(df: DataFrame, by: Sequence[str] = ("city",), drop: Sequence[str] = DROP_COLUMNS,
                      targets: Sequence[str] = TARGET_COLUMNS, max_missing_pct: float = 35.0) -> DataFrame:
    """AG35: keep_target / drop (explicit) / drop (> 35 % missing) / drop (constant) / keep_feature."""
    prof = column_profile(df, by)
    a, miss, uniq = F.col("attribute"), F.col("missing_pct"), F.col("unique_values")
    decision = (F.when(a.isin(*targets), "keep_target").when(a.isin(*drop), "drop")
                .when(miss > max_missing_pct, "drop").when(uniq <= 1, "drop").otherwise("keep_feature"))
    reason = (F.when(a.isin(*targets), "Target or target transform.")
              .when(a.isin(*drop), "Identifier, raw date, redundant, constant, or not model-friendly for first pass.")
              .when(miss > max_missing_pct, f"More than {max_missing_pct:g}% missing in this city.")
              .when(uniq <= 1, "No useful variation within this city.")
              .otherwise("Usable first-pass predictor."))
    return prof.select(*by, "attribute", decision.alias("decision"), pround(miss, 3).alias("missing_pct"),
                       uniq.alias("unique_values"), reason.alias("reason"))


def recommended_features(df: DataFrame, by: Sequence[str] = ("city",),
                         exclude: Sequence[str] = RECOMMEND_EXCLUDE, max_missing_pct: float = 35.0) -> DataFrame:
    """AG36: use / exclude per attribute with the reference's notes."""
    prof = column_profile(df, by)
    a, miss, uniq = F.col("attribute"), F.col("missing_pct"), F.col("unique_values")
    rec = F.when(a.isin(*exclude) | (miss > max_missing_pct) | (uniq <= 1), "exclude").otherwise("use")
    note = (F.when(a.isin(*exclude), "Identifier, target, raw date, constant city field, or non-informative calendar length.")
            .when(miss > max_missing_pct, "Too sparse for first-pass modelling; revisit only if city-specific handling is needed.")
            .when(uniq <= 1, "No predictive variation within this city.")
            .otherwise("Usable city-specific predictor for first-pass models."))
    return prof.select(*by, "attribute", rec.alias("recommendation"), pround(miss, 3).alias("missing_pct"),
                       uniq.alias("unique_values"), note.alias("note"))


def candidate_features(df: DataFrame, by: Sequence[str] = ("city",), target: str = "price_eur",
                       exclude: Sequence[str] = ("listing_id", "city", "price_eur", "log_price_eur"),
                       max_missing_pct: float = 35.0) -> DataFrame:
    """AG37: usable features (<= 35 % missing), tagged numeric or categorical from the schema."""
    numeric = {f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)}
    prof = column_profile(df, by)
    kind = F.when(F.col("attribute").isin(*sorted(numeric)), "numeric").otherwise("categorical")
    return (prof.filter(~F.col("attribute").isin(*exclude) & (F.col("missing_pct") <= max_missing_pct))
            .select(*by, "attribute", kind.alias("kind"), pround("missing_pct", 3).alias("missing_pct")))


def fill_group_median(df: DataFrame, columns: Sequence[str], by: Sequence[str] = ("city",)) -> DataFrame:
    """WN2: fill nulls (only nulls, Q1) with the group median; one aggregate joined back."""
    by = list(by)
    meds = grouped(df, [*by], *[median_of(c).alias(f"_med_{c}") for c in columns])
    out = df.join(meds, by, "left")
    for c in columns:
        out = out.withColumn(c, F.coalesce(F.col(c).cast("double"), F.col(f"_med_{c}")))
    return out.drop(*[f"_med_{c}" for c in columns])


def impute_nulls(df: DataFrame, by: Sequence[str] = ("city",), max_null_share: float = 0.30,
                 categorical_fill: str = "Unknown") -> DataFrame:
    """WN3: numeric columns with a group null share in (0, 0.30] take the group median;
    columns above the share keep their nulls (see ``impute_decisions``); strings get "Unknown"."""
    by = list(by)
    numeric = [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType) and f.name not in by]
    strings = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType) and f.name not in by]
    stats = grouped(df, [*by], *[F.avg(F.col(c).isNull().cast("double")).alias(f"_ns_{c}") for c in numeric],
                                *[median_of(c).alias(f"_med_{c}") for c in numeric])
    out = df.join(stats, by, "left")
    for c in numeric:
        share = F.col(f"_ns_{c}")
        out = out.withColumn(c, F.when((share > 0) & (share <= max_null_share),
                                       F.coalesce(F.col(c).cast("double"), F.col(f"_med_{c}")))
                             .otherwise(F.col(c).cast("double")))
    out = out.drop(*[f"_ns_{c}" for c in numeric], *[f"_med_{c}" for c in numeric])
    return out.fillna(categorical_fill, subset=strings)
