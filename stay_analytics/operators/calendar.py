"""Calendar rollups and stay search (AG1-AG8, SV1-SV5).

A calendar has one row per listing-day, so it is the largest table: every
rollup here is a single ``groupBy`` with conditional aggregates (Spark runs
the partial half map-side), never a pivot or a per-listing loop. Stay search
joins stays to calendar rows on ``(listing_id, month)`` with the date range as
a residual predicate; the calendar side is pruned to the stays' overall date
span first, and small stay tables are broadcast behind a row-count check.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.dates import SEASONS, available_flag, is_weekend, months_touched, season_of_month


def clean_calendar(cal: DataFrame, date: str = "date", available: str = "available",
                   strict: bool = False, title_seasons: bool = True) -> DataFrame:
    """PR15-PR17: drop null dates; add month, year, weekday (Mon = 0), weekend, season, quarter, flag."""
    d = F.col(date)
    return (cal.filter(d.isNotNull())
            .withColumn("month", F.month(d))
            .withColumn("year", F.year(d))
            .withColumn("weekday", F.weekday(d))
            .withColumn("is_weekend", (F.weekday(d) >= 5).cast("int"))
            .withColumn("season", season_of_month(F.month(d), title=title_seasons))
            .withColumn("quarter", F.quarter(d))
            .withColumn("is_available", available_flag(available, strict=strict)))


def _rate(unav: Column, cond: Column) -> Column:
    return F.sum(F.when(cond, unav)) / F.count(F.when(cond, F.lit(1)))


def calendar_rollup(cal: DataFrame, key: Sequence[str] = ("listing_id",), date: str = "date",
                    available: str = "available") -> DataFrame:
    """AG1-AG4: per listing days, available/unavailable days and unavailable rates
    overall, by quarter, by season and weekday/weekend, all in one aggregate.

    Strict flag ('t' = available, anything else unavailable); null dates count
    as weekday days and fall outside every quarter/season (reference quirk Q5).
    """
    d = F.col(date).cast("date")
    avail = available_flag(available, strict=True)
    unav = F.lit(1) - avail
    q, season, wk = F.quarter(d), season_of_month(F.month(d)), is_weekend(d)
    aggs = [F.count(F.lit(1)).alias("calendar_days"),
            F.sum(avail).alias("calendar_available_days"),
            F.sum(unav).alias("calendar_unavailable_days")]
    aggs += [_rate(unav, q == k).alias(f"calendar_unavailable_q{k}") for k in range(1, 5)]
    aggs += [_rate(unav, season == s).alias(f"calendar_unavailable_{s}") for s in SEASONS]
    aggs += [_rate(unav, wk == 0).alias("calendar_unavailable_weekday"),
             _rate(unav, wk == 1).alias("calendar_unavailable_weekend")]
    out = cal.groupBy(*key).agg(*aggs)
    return out.withColumn("calendar_unavailable_rate",
                          F.col("calendar_unavailable_days") / F.col("calendar_days"))


def occupancy_features(cal: DataFrame, key: Sequence[str] = ("listing_id",), date: str = "date",
                       available: str = "available") -> DataFrame:
    """AG5: occupancy = 1 - mean(lenient flag) by quarter, season, overall, weekend; nulls ignored."""
    d = F.col(date).cast("date")
    flag = available_flag(available, strict=False)
    q, season, wk = F.quarter(d), season_of_month(F.month(d)), (F.weekday(d) >= 5).cast("int")
    occ = lambda cond: F.lit(1.0) - F.avg(F.when(cond, flag))
    aggs = [occ(q == k).alias(f"occupancy_q{k}") for k in range(1, 5)]
    aggs += [occ(season == s).alias(f"occupancy_{s}") for s in SEASONS]
    aggs += [(F.lit(1.0) - F.avg(flag)).alias("occupancy_rate"),
             occ(wk == 0).alias("occupancy_weekday"), occ(wk == 1).alias("occupancy_weekend")]
    return cal.filter(d.isNotNull()).groupBy(*key).agg(*aggs)


def monthly_occupancy(cal: DataFrame, by: Sequence[str] = ("city",), date: str = "date",
                      available: str = "available") -> DataFrame:
    """AG6: 1 - mean(flag) per group and calendar month."""
    flag = available_flag(available, strict=False)
    return (cal.filter(F.col(date).isNotNull())
            .groupBy(*by, F.month(F.col(date)).alias("month"))
            .agg((F.lit(1.0) - F.avg(flag)).alias("occupancy_rate")))


def calendar_metadata(cal: DataFrame, by: Sequence[str] = ("city",), date: str = "date",
                      available: str = "available", price: str | None = "price",
                      adjusted_price: str | None = "adjusted_price") -> DataFrame:
    """AG7: min/max date and row counts per city, one aggregate."""
    cols = set(cal.columns)
    aggs = [F.min(date).alias("min_date"), F.max(date).alias("max_date"),
            F.count(F.lit(1)).alias("total_rows"),
            F.sum(F.coalesce((F.lower(F.col(available).cast("string")) == "t"), F.lit(False)).cast("int"))
            .alias("available_rows")]
    aggs.append((F.count(price) if price in cols else F.lit(0)).alias("price_rows"))
    aggs.append((F.count(adjusted_price) if adjusted_price in cols else F.lit(0)).alias("adjusted_price_rows"))
    return cal.groupBy(*by).agg(*aggs)


def stay_coverage(bounds: DataFrame, stays: DataFrame, by: Sequence[str] = ("city",),
                  check_in: str = "check_in", check_out: str = "check_out") -> DataFrame:
    """AG8: is each stay inside its calendar's [min_date, max_date]? Status text per reference."""
    by = list(by)
    j = stays.join(bounds, by, "left")
    last = F.date_sub(F.col(check_out), 1)
    inside = (F.col(check_in) >= F.col("min_date")) & (last <= F.col("max_date"))
    status = (F.when(F.col("min_date").isNull(), F.lit("No local calendar snapshot is available for this city."))
              .when(~inside, F.format_string("Local calendar coverage for %s runs from %s to %s.",
                                             F.col(by[0]).cast("string") if by else F.lit("the city"),
                                             F.col("min_date").cast("string"), F.col("max_date").cast("string")))
              .otherwise(F.lit("Requested dates are inside the local calendar snapshot.")))
    return j.withColumn("within_calendar", F.coalesce(inside, F.lit(False))).withColumn("coverage_text", status)


def _available_days(cal: DataFrame, listing: str, date: str, available: str) -> DataFrame:
    lower = F.lower(F.col(available).cast("string"))
    return (cal.filter(lower == "t")
            .select(F.col(listing).alias("listing_id"), F.col(date).cast("date").alias("_day"),
                    F.col("minimum_nights").alias("_minn"), F.col("maximum_nights").alias("_maxn")))


def stay_availability(cal: DataFrame, stays: DataFrame, listing: str = "listing_id", date: str = "date",
                      available: str = "available", stay_key: Sequence[str] = ("stay_id",)) -> DataFrame:
    """SV1: per stay, available nights in [check_in, check_out), strictest min/max nights,
    the availability verdict and the batch status text (SV3).

    ``stays``: ``stay_key`` columns, ``listing_id``, ``check_in``, ``check_out`` (dates).
    Missing listings get 0 nights. Stays are exploded to the months they touch
    (SV5) so the calendar join key is ``(listing_id, month)``.
    """
    key = list(stay_key)
    st = stays.select(*key, "listing_id", F.col("check_in").cast("date").alias("check_in"),
                      F.col("check_out").cast("date").alias("check_out"))
    span = st.agg(F.min("check_in").alias("lo"), F.max("check_out").alias("hi"))
    days = _available_days(cal, listing, date, available)
    # Prune the calendar to the overall stay span (scalar subqueries, pushed to the scan).
    days = days.filter((F.col("_day") >= span.select("lo").scalar()) & (F.col("_day") < span.select("hi").scalar()))
    days = days.withColumn("_month", F.trunc("_day", "MM"))
    st_m = st.select(*key, "listing_id", "check_in", "check_out",
                     F.explode(months_touched("check_in", "check_out")).alias("_month"))
    hit = (days.join(st_m, ["listing_id", "_month"])
           .filter((F.col("_day") >= F.col("check_in")) & (F.col("_day") < F.col("check_out"))))
    agg = hit.groupBy(*key, "listing_id").agg(
        F.countDistinct("_day").alias("available_nights"),
        F.max("_minn").alias("minimum_nights_required"),
        F.min("_maxn").alias("maximum_nights_allowed"))
    res = st.join(agg, [*key, "listing_id"], "left")
    return add_stay_verdict(res)


def add_stay_verdict(res: DataFrame) -> DataFrame:
    """SV1/SV3: verdict columns and batch status wording."""
    nights = F.datediff("check_out", "check_in")
    res = (res.withColumn("nights", nights)
           .withColumn("available_nights", F.coalesce(F.col("available_nights"), F.lit(0)).cast("bigint"))
           .withColumn("minimum_nights_required", F.coalesce(F.col("minimum_nights_required"), F.lit(0)).cast("bigint"))
           .withColumn("maximum_nights_allowed", F.coalesce(F.col("maximum_nights_allowed"), F.lit(0)).cast("bigint")))
    n, a = F.col("nights"), F.col("available_nights")
    mn, mx = F.col("minimum_nights_required"), F.col("maximum_nights_allowed")
    dates_ok = a >= n
    min_ok = (mn == 0) | (n >= mn)
    max_ok = (mx == 0) | (n <= mx)
    res = res.withColumn("is_available", dates_ok & min_ok & max_ok).withColumn("stay_length_ok", min_ok & max_ok)
    status = (F.when(F.col("is_available"), F.lit("Available in local calendar snapshot"))
              .when(a < n, F.format_string("Only %d of %d nights available", a, n))
              .when((mn != 0) & (n < mn), F.format_string("Minimum stay is %d nights", mn))
              .when((mx != 0) & (n > mx), F.format_string("Maximum stay is %d nights", mx))
              .otherwise(F.lit("Unavailable for requested stay")))
    return res.withColumn("calendar_status", status)


def single_stay_status(res: DataFrame) -> DataFrame:
    """SV2/SV3: single-listing wording, with the nights <= 0 guard."""
    n, a = F.col("nights"), F.col("available_nights")
    mn, mx = F.col("minimum_nights_required"), F.col("maximum_nights_allowed")
    status = (F.when(n <= 0, F.lit("Check-out must be after check-in."))
              .when(F.col("is_available"), F.lit("Available in the local calendar snapshot."))
              .when(a < n, F.format_string("Only %d of %d nights are available in the local calendar snapshot.", a, n))
              .when((mn != 0) & (n < mn), F.format_string("Stay is shorter than the listing minimum of %d nights.", mn))
              .otherwise(F.format_string("Stay is longer than the listing maximum of %d nights.", mx)))
    return (res.withColumn("is_available", F.col("is_available") & (n > 0))
            .withColumn("stay_length_ok", F.col("stay_length_ok") & (n > 0))
            .withColumn("status", status))


def candidate_summary(avail: DataFrame, by: Sequence[str]) -> DataFrame:
    """SV4: per candidate pool, candidates, available count and status text.

    Available ids stay as rows of ``avail`` (filter ``is_available``); they
    are not collected into one cell, which would pull a whole pool into a row.
    """
    g = avail.groupBy(*by).agg(
        F.countDistinct("listing_id").alias("candidate_count"),
        F.countDistinct(F.when(F.col("is_available"), F.col("listing_id"))).alias("available_count"),
        F.max("nights").alias("nights"))
    status = F.when(F.col("available_count") > 0, F.format_string(
        "%s of %s matching listings are available for the requested stay.",
        F.format_number(F.col("available_count"), 0), F.format_number(F.col("candidate_count"), 0))
    ).otherwise(F.lit("No matching listings pass the exact calendar availability and stay-length rules."))
    return g.withColumn("is_available", F.col("available_count") > 0).withColumn("status", status)
