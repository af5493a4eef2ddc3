"""Listing filters (FI1-FI11).

Filters are single conjunctive ``Column`` predicates so Catalyst pushes the
column-only parts into the Parquet scan. Batch forms take a ``requests``
table and become predicate joins (one plan for any number of requests).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Amenity label -> listing flag column.
AMENITY_COLUMNS = {
    "WiFi": "has_wifi",
    "Kitchen": "has_kitchen",
    "Air conditioning": "has_air_conditioning",
    "Washer": "has_washer",
    "Dedicated workspace": "has_dedicated_workspace",
    "TV": "has_tv",
    "Parking": "has_parking",
    "Elevator": "has_elevator",
    "Heating": "has_heating",
    "Self check-in": "has_self_checkin",
}

# Flags counted as luxury amenities.
LUXURY_AMENITY_COLUMNS = [
    "has_air_conditioning",
    "has_washer",
    "has_dedicated_workspace",
    "has_tv",
    "has_parking",
    "has_elevator",
    "has_heating",
    "has_self_checkin",
]

FILTER_PARAMS = ("budget_max", "min_price_eur", "guests", "room_type", "neighbourhood", "amenities",
                 "min_rating", "max_distance_km", "min_available_days_30", "min_reviews",
                 "min_amenities_count", "min_luxury_amenities")


def luxury_amenity_count(columns: Sequence[str]) -> Column:
    """PR30: sum of the luxury flags present, nulls counted as 0."""
    present = [c for c in LUXURY_AMENITY_COLUMNS if c in columns]
    if not present:
        return F.lit(0.0)
    total = F.lit(0.0)
    for c in present:
        total = total + F.coalesce(F.col(c).cast("double"), F.lit(0.0))
    return total


def attach_group_values(df: DataFrame, table: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Join a per-group table back; with no keys the single row becomes scalar subqueries."""
    keys = list(keys)
    if keys:
        return df.join(table, keys)
    out = df
    for c in table.columns:
        out = out.withColumn(c, table.select(c).scalar())
    return out


def _num(c: str) -> Column:
    return F.col(c).cast("double")


def listing_predicate(columns: Sequence[str], budget_max=None, min_price_eur=None, guests=None,
                      room_type=None, neighbourhood=None, amenities=None, min_rating=None,
                      max_distance_km=None, min_available_days_30=None, min_reviews=None,
                      min_amenities_count=None, min_luxury_amenities=None) -> Column:
    """FI3: conjunctive predicate; falsy/"Any" arguments are skipped.

    Minimum rating keeps unrated rows (Q9); every other threshold drops nulls.
    """
    cols = set(columns)
    preds: list[Column] = []
    if budget_max and "price_eur" in cols:
        preds.append(_num("price_eur") <= float(budget_max))
    if min_price_eur and "price_eur" in cols:
        preds.append(_num("price_eur") >= float(min_price_eur))
    if guests and "accommodates" in cols:
        preds.append(_num("accommodates") >= float(guests))
    if room_type and room_type != "Any" and "room_type" in cols:
        preds.append(F.col("room_type").cast("string") == room_type)
    if neighbourhood and neighbourhood != "Any" and "neighbourhood_cleansed" in cols:
        preds.append(F.col("neighbourhood_cleansed").cast("string") == neighbourhood)
    if min_rating and "review_scores_rating" in cols:
        rating = _num("review_scores_rating")
        preds.append((rating >= float(min_rating)) | rating.isNull())
    if max_distance_km and "distance_to_center_km" in cols:
        preds.append(_num("distance_to_center_km") <= float(max_distance_km))
    if min_available_days_30 and "availability_30" in cols:
        preds.append(_num("availability_30") >= float(min_available_days_30))
    if min_reviews and "number_of_reviews" in cols:
        preds.append(_num("number_of_reviews") >= float(min_reviews))
    if min_amenities_count and "amenities_count" in cols:
        preds.append(_num("amenities_count") >= float(min_amenities_count))
    if min_luxury_amenities:
        preds.append(luxury_amenity_count(columns) >= float(min_luxury_amenities))
    for amenity in amenities or []:
        column = AMENITY_COLUMNS.get(amenity)
        if column in cols:
            preds.append(_num(column) == 1.0)
    out = F.lit(True)
    for p in preds:
        out = out & p
    return F.coalesce(out, F.lit(False))


def filter_listings(df: DataFrame, **filters) -> DataFrame:
    return df.filter(listing_predicate(df.columns, **filters))


def request_predicate(listing_cols: Sequence[str], req: str = "r", lst: str = "l") -> Column:
    """Batch FI3: the same predicate with thresholds read from a ``requests`` row.

    ``requests`` columns named like the keyword filters; null/0/"Any" skip.
    ``amenities`` is an ``array<string>`` of labels.
    """
    cols = set(listing_cols)
    r = lambda c: F.col(f"{req}.{c}")
    lc = lambda c: F.col(f"{lst}.{c}").cast("double")

    def skip(c):
        return r(c).isNull() | (r(c).cast("double") == 0)

    preds = []
    if "price_eur" in cols:
        preds.append(skip("budget_max") | (lc("price_eur") <= r("budget_max")))
        preds.append(skip("min_price_eur") | (lc("price_eur") >= r("min_price_eur")))
    if "accommodates" in cols:
        preds.append(skip("guests") | (lc("accommodates") >= r("guests")))
    if "room_type" in cols:
        preds.append(r("room_type").isNull() | (r("room_type") == "Any") | (r("room_type") == "")
                     | (F.col(f"{lst}.room_type") == r("room_type")))
    if "neighbourhood_cleansed" in cols:
        preds.append(r("neighbourhood").isNull() | (r("neighbourhood") == "Any") | (r("neighbourhood") == "")
                     | (F.col(f"{lst}.neighbourhood_cleansed") == r("neighbourhood")))
    if "review_scores_rating" in cols:
        preds.append(skip("min_rating") | lc("review_scores_rating").isNull()
                     | (lc("review_scores_rating") >= r("min_rating")))
    if "distance_to_center_km" in cols:
        preds.append(skip("max_distance_km") | (lc("distance_to_center_km") <= r("max_distance_km")))
    if "availability_30" in cols:
        preds.append(skip("min_available_days_30") | (lc("availability_30") >= r("min_available_days_30")))
    if "number_of_reviews" in cols:
        preds.append(skip("min_reviews") | (lc("number_of_reviews") >= r("min_reviews")))
    if "amenities_count" in cols:
        preds.append(skip("min_amenities_count") | (lc("amenities_count") >= r("min_amenities_count")))
    lux = F.lit(0.0)
    for c in LUXURY_AMENITY_COLUMNS:
        if c in cols:
            lux = lux + F.coalesce(lc(c), F.lit(0.0))
    preds.append(skip("min_luxury_amenities") | (lux >= r("min_luxury_amenities")))
    for label, column in AMENITY_COLUMNS.items():
        if column in cols:
            wants = F.coalesce(F.array_contains(r("amenities"), label), F.lit(False))
            preds.append(~wants | (lc(column) == 1.0))
    out = F.lit(True)
    for p in preds:
        out = out & F.coalesce(p, F.lit(False))
    return out


def drop_bad_prices(df: DataFrame, price: str = "price_eur") -> DataFrame:
    """FI1: keep rows with a positive price."""
    return df.filter(F.col(price) > 0)


def iqr_filter(df: DataFrame, value: str, by: Sequence[str] = (), k: float = 1.5) -> DataFrame:
    """FI2: keep rows inside ``[Q1 - k*IQR, Q3 + k*IQR]`` of their group.

    Quartiles are exact linear quantiles of each group; the bound table (one
    row per group) is joined back.
    """
    by = list(by)
    bounds = iqr_bounds(df, value, by, k).select(*by, F.col("lower_bound").alias("_lo"), F.col("upper_bound").alias("_hi"))
    joined = attach_group_values(df, bounds, by)
    return joined.filter(F.col(value).between(F.col("_lo"), F.col("_hi"))).drop("_lo", "_hi")


def iqr_bounds(df: DataFrame, value: str, by: Sequence[str] = (), k: float = 1.5) -> DataFrame:
    by = list(by)
    from .ranking import Quantile, grouped
    q1, q3 = F.col("q1"), F.col("q3")
    return grouped(df, by, Quantile(value, 0.25).alias("q1"), Quantile(value, 0.75).alias("q3")).select(
        *by, "q1", "q3", (q1 - k * (q3 - q1)).alias("lower_bound"), (q3 + k * (q3 - q1)).alias("upper_bound"))


def complete_cases(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """FI9: map NaN/±inf to null, then drop rows missing any of ``columns``."""
    inf = F.lit(float("inf"))
    fixed = df
    for c in columns:
        x = F.col(c).cast("double")
        fixed = fixed.withColumn(c, F.when(F.isnan(x) | (F.abs(x) == inf), F.lit(None)).otherwise(x))
    return fixed.na.drop(subset=list(columns))


def min_group_size(df: DataFrame, by: Sequence[str], n: int, count_col: str = "listings") -> DataFrame:
    """FI8: keep groups of an aggregate table with at least ``n`` rows."""
    return df.filter(F.col(count_col) >= n)


def with_group_count(df: DataFrame, by: Sequence[str], out: str) -> DataFrame:
    """JN5: attach the group frequency (aggregate + join; no per-group window)."""
    counts = df.groupBy(*by).agg(F.count(F.lit(1)).alias(out))
    return df.join(counts, list(by), "left")


def first_nonempty_level(df: DataFrame, pool: Sequence[str], level_flags: Sequence[str],
                         out: str = "relaxation_level") -> DataFrame:
    """FI10: keep, per pool, the rows of the first relaxation level that is non-empty.

    ``level_flags`` are boolean columns, level 0 strictest. The level is picked
    with one aggregate (no driver ``count()`` loop).
    """
    pool = list(pool)
    lvl = F.lit(None).cast("int")
    for i in reversed(range(len(level_flags))):
        lvl = F.when(F.col(level_flags[i]), F.lit(i)).otherwise(lvl)
    tagged = df.withColumn("_first_level", lvl)
    best = tagged.groupBy(*pool).agg(F.min("_first_level").alias(out))
    joined = attach_group_values(tagged, best, pool)
    keep = F.lit(False)
    for i, f in enumerate(level_flags):
        keep = keep | ((F.col(out) == i) & F.col(f))
    return joined.filter(keep).drop("_first_level")


def distance_cap_or_nearest(df: DataFrame, pool: Sequence[str], distance: str, cap: float,
                            out: str = "within_cap") -> DataFrame:
    """FI11: keep rows within ``cap`` km; a pool with none keeps all rows (nearest-first later)."""
    pool = list(pool)
    within = (F.col(distance) <= cap)
    flags = df.groupBy(*pool).agg(F.max(F.coalesce(within, F.lit(False)).cast("int")).alias("_any"))
    joined = attach_group_values(df, flags, pool)
    return (joined.filter((F.col("_any") == 0) | F.coalesce(within, F.lit(False)))
            .withColumn(out, F.col("_any") == 1).drop("_any"))


def with_window_count(df: DataFrame, by: Sequence[str], out: str) -> DataFrame:
    """Group count as a window (for small, bounded groups only)."""
    return df.withColumn(out, F.count(F.lit(1)).over(Window.partitionBy(*by)))
