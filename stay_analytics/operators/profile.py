"""Market profiling aggregates (AG10-AG34).

Every profile is one ``groupBy`` (partial aggregation map-side) or a
``groupBy`` followed by a window over the *aggregated* table, which is small
(one row per group and value). Exact medians/quantiles use ``percentile``
(value->count map per group); pass an ``accuracy`` to switch to
``percentile_approx`` for very high-cardinality groups.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import col_of, erfc, pround
from .ranking import grouped, median_of, Quantile, running_below, top_n_per_group


def market_summary(df: DataFrame, by: Sequence[str] = ("city",)) -> DataFrame:
    """AG10/AG11: listings, median/mean price, mean rating, median availability and distance."""
    return grouped(df, [*by], F.count(F.lit(1)).alias("listings"),
        median_of("price_eur", 2).alias("median_price_eur"),
        pround(F.avg("price_eur"), 2).alias("mean_price_eur"),
        pround(F.avg("review_scores_rating"), 2).alias("mean_rating"),
        median_of("availability_30", 1).alias("median_availability_30"),
        median_of("distance_to_center_km", 2).alias("median_distance_to_center_km"),
    )


def executive_overview(comparison: DataFrame) -> DataFrame:
    """AG12: cities, total listings, unweighted means of city medians and city ratings."""
    return comparison.agg(
        F.countDistinct("city").alias("cities"),
        F.sum("listings").alias("total_listings"),
        F.avg("median_price_eur").alias("avg_median_price_eur"),
        F.avg("mean_rating").alias("avg_rating"),
    )


def room_type_summary(df: DataFrame, by: Sequence[str] = ("city",), group: str = "room_type") -> DataFrame:
    """AG13: per group value (nulls are a group): listings, median price, mean rating, median availability."""
    return grouped(df, [*by, group], F.count(F.lit(1)).alias("listings"),
        median_of("price_eur").alias("median_price_eur"),
        F.avg("review_scores_rating").alias("mean_rating"),
        median_of("availability_30").alias("median_availability_30"))


def price_by_group(df: DataFrame, group: str, by: Sequence[str] = ("city",), target: str = "price_eur",
                   digits: int = 3) -> DataFrame:
    """AG14: count / median / mean / sample std of the target per group, rounded."""
    return grouped(df.filter(F.col(group).isNotNull()), [*by, group], F.count(target).alias("count"), median_of(target, digits).alias("median"),
        pround(F.avg(target), digits).alias("mean"), pround(F.stddev_samp(target), digits).alias("std"))


def neighbourhood_table(df: DataFrame, by: Sequence[str] = ("city",), area: str = "neighbourhood_cleansed",
                        min_rows: int = 30, digits: int = 3) -> DataFrame:
    """AG15: per area size, median/mean price, median annual availability, mean rating; >= min_rows."""
    g = grouped(df.filter(F.col(area).isNotNull()), [*by, area], F.count(F.lit(1)).alias("listing_count"),
        median_of("price_eur", digits).alias("median_price_eur"),
        pround(F.avg("price_eur"), digits).alias("mean_price_eur"),
        median_of("availability_365", digits).alias("median_availability_365"),
        pround(F.avg("review_scores_rating"), digits).alias("mean_rating"))
    return g.filter(F.col("listing_count") >= min_rows)


def area_dimension(dimension: DataFrame, stats: DataFrame, by: Sequence[str] = ("city",),
                   area: str = "neighbourhood_cleansed") -> DataFrame:
    """JN13: every area of the boundary dimension with its statistics; areas without enough listings keep nulls."""
    keys = [*by, area]
    return dimension.dropDuplicates(keys).join(stats, keys, "left")


def lowest_median_areas(df: DataFrame, by: Sequence[str] = ("city",), area: str = "neighbourhood_cleansed",
                        min_rows: int = 20, n: int = 12) -> DataFrame:
    """AG16: the ``n`` areas with the lowest median price among areas with >= ``min_rows`` listings."""
    g = (grouped(df, [*by, area], F.count(F.lit(1)).alias("listings"),
                                   median_of("price_eur").alias("median_price_eur"))
         .filter(F.col("listings") >= min_rows))
    return top_n_per_group(g, by, [F.col("median_price_eur").asc(), F.col(area).asc()], n)


def map_filter(df: DataFrame, price_min: float, price_max: float, min_rating: float | None = None,
               include_unrated: bool = True, min_availability: int = 0, min_reviews: int = 0,
               room_types: Sequence[str] | None = None) -> DataFrame:
    """FI6: map filter: price window, rating floor (unrated kept on request), null counts as 0."""
    cond = F.col("price_eur").between(price_min, price_max)
    if min_rating is not None:
        rated = F.col("review_scores_rating") >= min_rating
        cond = cond & ((rated | F.col("review_scores_rating").isNull()) if include_unrated else F.coalesce(rated, F.lit(False)))
    cond = cond & (F.coalesce(F.col("availability_30"), F.lit(0)) >= min_availability)
    cond = cond & (F.coalesce(F.col("number_of_reviews"), F.lit(0)) >= min_reviews)
    if room_types:
        cond = cond & F.col("room_type").isin(*room_types)
    return df.filter(F.coalesce(cond, F.lit(False)))


def area_selection_summary(df: DataFrame, by: Sequence[str] = ("city",), area: str = "neighbourhood_cleansed",
                           n: int = 10) -> DataFrame:
    """AG17: top ``n`` areas by listings then mean rating (2-dp medians/ratings)."""
    g = grouped(df, [*by, area], F.count(F.lit(1)).alias("listings"),
                                  median_of("price_eur").alias("median_price_eur"),
                                  F.avg("review_scores_rating").alias("mean_rating"))
    top = top_n_per_group(g, by, [F.col("listings").desc(), F.col("mean_rating").desc_nulls_last(),
                                  F.col(area).asc()], n)
    return top.withColumn("median_price_eur", pround("median_price_eur", 2)) \
              .withColumn("mean_rating", pround("mean_rating", 2))


def mode_table(df: DataFrame, column: str, by: Sequence[str] = ("city",)) -> DataFrame:
    """Deterministic mode (Q16): most frequent non-null value, smallest on ties."""
    counts = df.filter(F.col(column).isNotNull()).groupBy(*by, column).agg(F.count(F.lit(1)).alias("_n"))
    best = top_n_per_group(counts, by, [F.col("_n").desc(), F.col(column).asc()], 1, out=None)
    return best.select(*by, F.col(column).alias(f"mode_{column}"))


def top_n_counts_text(df: DataFrame, column: str, by: Sequence[str] = ("city",), n: int = 5) -> DataFrame:
    """'value: count; ...' for the ``n`` most frequent values (nulls included), count desc then value."""
    counts = df.groupBy(*by, column).agg(F.count(F.lit(1)).alias("_n"))
    top = top_n_per_group(counts, by, [F.col("_n").desc(), F.col(column).asc_nulls_first()], n, out="_r")
    # at most n rows per group are collected, so the cell size is bounded
    items = F.array_sort(F.collect_list(F.struct("_r", F.concat_ws(": ", F.coalesce(F.col(column).cast("string"),
                                                                                   F.lit("nan")),
                                                               F.col("_n").cast("string")).alias("t"))))
    return top.groupBy(*by).agg(F.array_join(F.transform(items, lambda x: x["t"]), "; ").alias(f"top_{n}_{column}"))


def eda_card(df: DataFrame, by: Sequence[str] = ("city",), target: str = "price_eur",
             flags: Sequence[str] = (), digits: int = 3) -> DataFrame:
    """AG18: per-city EDA card: price stats, modes, top-5 areas, flag rates %, means/medians."""
    by = list(by)
    stats = grouped(df, [*by], F.count(F.lit(1)).alias("listings"),
        median_of(target, digits).alias("median_price_eur"),
        pround(F.avg(target), digits).alias("mean_price_eur"),
        pround(F.stddev_samp(target), digits).alias("price_std_eur"),
        pround(F.min(target), digits).alias("min_price_eur"),
        pround(F.max(target), digits).alias("max_price_eur"),
        *[pround(F.avg(f) * 100, digits).alias(f"{f}_rate_pct") for f in flags],
        pround(F.avg("review_scores_rating"), digits).alias("mean_rating"),
        pround(F.avg("accommodates"), digits).alias("mean_accommodates"),
        median_of("availability_365", digits).alias("median_availability_365"))
    room = mode_table(df, "room_type", by).withColumnRenamed("mode_room_type", "most_common_room_type")
    area = mode_table(df, "neighbourhood_cleansed", by).withColumnRenamed("mode_neighbourhood_cleansed",
                                                                         "top_neighbourhood")
    top5 = top_n_counts_text(df, "neighbourhood_cleansed", by, 5).withColumnRenamed(
        "top_5_neighbourhood_cleansed", "top_5_neighbourhoods")
    return stats.join(room, by, "left").join(area, by, "left").join(top5, by, "left")


def value_counts(df: DataFrame, column: str, by: Sequence[str] = ("city",), n: int | None = None) -> DataFrame:
    """AG19: counts and % share per value (nulls dropped, like value_counts), optional top-n."""
    by = list(by)
    counts = df.filter(F.col(column).isNotNull()).groupBy(*by, column).agg(F.count(F.lit(1)).alias("count"))
    tot = counts.groupBy(*by).agg(F.sum("count").alias("_tot"))
    out = (counts.join(tot, by) if by else counts.withColumn("_tot", tot.select("_tot").scalar()))
    out = out.withColumn("share_pct", F.col("count") / F.col("_tot") * 100).drop("_tot")
    if n:
        out = top_n_per_group(out, by, [F.col("count").desc(), F.col(column).asc()], n)
    return out


def flag_price_table(df: DataFrame, flag: str, by: Sequence[str] = ("city",), target: str = "price_eur") -> DataFrame:
    """AG20: per flag value: listings, % of the group, median price."""
    by = list(by)
    g = grouped(df, [*by, flag], F.count(F.lit(1)).alias("listings"), median_of(target).alias("median_price_eur"))
    tot = g.groupBy(*by).agg(F.sum("listings").alias("_tot"))
    return g.join(tot, by).withColumn("share_pct", F.col("listings") / F.col("_tot") * 100).drop("_tot")


def amenity_prevalence(df: DataFrame, flags: Sequence[str], by: Sequence[str] = ("city",)) -> DataFrame:
    """AG21: % of listings with each amenity flag, long form."""
    wide = df.groupBy(*by).agg(*[(F.avg(f) * 100).alias(f) for f in flags])
    return wide.unpivot(list(by), list(flags), "amenity", "prevalence_pct")


def describe_long(df: DataFrame, columns: Sequence[str], by: Sequence[str] = ("city",),
                  percentiles: Sequence[float] = (0.05, 0.25, 0.5, 0.75, 0.95)) -> DataFrame:
    """AG22: describe() in long form: one row per (group, feature), one aggregate for all features."""
    by = list(by)
    long = df.select(*by, F.inline(F.array(*[F.struct(F.lit(c).alias("feature"),
                                                      F.col(c).cast("double").alias("value")) for c in columns])))
    return grouped(long, [*by, "feature"], F.count("value").alias("count"), F.avg("value").alias("mean"),
                   F.stddev_samp("value").alias("std"), F.min("value").alias("min"),
                   *[Quantile("value", p).alias(f"p{int(round(p * 100)):02d}") for p in percentiles], F.max("value").alias("max"))


def target_correlations(df: DataFrame, columns: Sequence[str], target: str = "price_eur",
                        by: Sequence[str] = ("city",)) -> DataFrame:
    """AG25: Pearson r of each column with the target (pairwise complete), long, with |r|."""
    wide = df.groupBy(*by).agg(*[F.corr(F.col(c).cast("double"), F.col(target).cast("double")).alias(c)
                                 for c in columns])
    long = wide.unpivot(list(by), list(columns), "feature", "correlation")
    return long.withColumn("abs_correlation", F.abs("correlation"))


def correlation_matrix(df: DataFrame, columns: Sequence[str], by: Sequence[str] = ("city",)) -> DataFrame:
    """AG26: all pairwise correlations in one aggregate, long form (a, b, r)."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1:]]
    wide = df.groupBy(*by).agg(*[F.corr(F.col(a).cast("double"), F.col(b).cast("double")).alias(f"p{i}")
                                 for i, (a, b) in enumerate(pairs)])
    stack = F.inline(F.array(*[F.struct(F.lit(a).alias("feature_a"), F.lit(b).alias("feature_b"),
                                        F.col(f"p{i}").alias("correlation")) for i, (a, b) in enumerate(pairs)]))
    return wide.select(*by, stack)


def skewness_adjusted(c) -> Column:
    """AG27: sample (bias-adjusted) skewness, as pandas: g1 * sqrt(n(n-1)) / (n-2)."""
    n = F.count(col_of(c)).cast("double")
    return F.when(n > 2, F.skewness(col_of(c)) * F.sqrt(n * (n - 1)) / (n - 2))


def linear_trend(df: DataFrame, y: str, x: str, by: Sequence[str] = ("city",)) -> DataFrame:
    """AG28: least-squares slope and intercept of y ~ x over complete pairs."""
    return df.groupBy(*by).agg(F.regr_slope(F.col(y).cast("double"), F.col(x).cast("double")).alias("slope"),
                               F.regr_intercept(F.col(y).cast("double"), F.col(x).cast("double")).alias("intercept"),
                               F.regr_count(F.col(y).cast("double"), F.col(x).cast("double")).alias("pairs"))


def mann_whitney(df: DataFrame, value: str, group: str, first) -> DataFrame:
    """AG29: two-sided Mann-Whitney U with tie correction and continuity (normal approximation).

    Pooled average ranks come from distinct-value counts with range-split
    running totals (no single-task window). Output is one row: U of the
    ``first`` group, sizes, tie term, z and p.
    """
    x = df.filter(F.col(value).isNotNull() & F.col(group).isNotNull()).select(
        F.col(value).cast("double").alias("v"), (F.col(group) == F.lit(first)).cast("int").alias("g1"))
    counts = x.groupBy("v").agg(F.count(F.lit(1)).alias("cnt"), F.sum("g1").alias("c1"))
    counts = counts.withColumn("_k", F.lit(0))
    cum = running_below(counts, ["_k"], "v", "cnt")
    avg_rank = F.col("_below") + (F.col("cnt") + 1) / 2.0
    s = cum.agg(F.sum(F.col("c1") * avg_rank).alias("r1"), F.sum("c1").alias("n1"),
                F.sum(F.col("cnt") - F.col("c1")).alias("n2"),
                F.sum(F.pow(F.col("cnt").cast("double"), 3) - F.col("cnt")).alias("tie_term"))
    n1, n2 = F.col("n1").cast("double"), F.col("n2").cast("double")
    n = n1 + n2
    u1 = F.col("r1") - n1 * (n1 + 1) / 2.0
    mu = n1 * n2 / 2.0
    sigma = F.sqrt(n1 * n2 / 12.0 * ((n + 1) - F.col("tie_term") / (n * (n - 1))))
    z = (F.abs(u1 - mu) - 0.5) / sigma
    out = s.select(u1.alias("u_statistic"), F.col("n1"), F.col("n2"), F.col("tie_term"), z.alias("z"))
    return out.withColumn("p_value", F.least(F.lit(1.0), erfc(F.col("z") / math.sqrt(2.0))))


def five_number_summary(df: DataFrame, value: str, by: Sequence[str]) -> DataFrame:
    """AG30: min, quartiles and max per group (box-plot data)."""
    return grouped(df, by, F.min(value).alias("min"), *[Quantile(value, q).alias(n) for n, q in (("q1", 0.25), ("median", 0.5), ("q3", 0.75))],
                   F.max(value).alias("max"))


def price_by_quantile_bin(df: DataFrame, column: str, by: Sequence[str] = ("city",), target: str = "price_eur",
                          q: int = 4) -> DataFrame:
    """AG31: qcut-style bins of ``column`` (duplicate edges dropped, right-closed, lowest included);
    listings and median target per bin."""
    by = list(by)
    probs = [i / q for i in range(q + 1)]
    edges = grouped(df, by, *[Quantile(column, p).alias(f"_e{i}") for i, p in enumerate(probs)]).select(
        *by, F.array_distinct(F.array(*[f"_e{i}" for i in range(q + 1)])).alias("_e"))
    j = df.filter(F.col(column).isNotNull()).join(edges, by)
    v = F.col(column).cast("double")
    # bin index = number of edges strictly below v (minus one); the lowest edge joins bin 0
    idx = F.greatest(F.size(F.filter("_e", lambda e: e < v)) - 1, F.lit(0))
    j = j.withColumn("bin", idx).withColumn("bin_low", F.element_at("_e", F.col("bin") + 1)) \
         .withColumn("bin_high", F.element_at("_e", F.col("bin") + 2))
    return grouped(j, [*by, "bin", "bin_low", "bin_high"], F.count(F.lit(1)).alias("listings"),
                                                           median_of(target).alias("median_price_eur"))


def histogram(df: DataFrame, value: str, bins: int = 30, by: Sequence[str] = ("city",),
              cap_quantile: float | None = None) -> DataFrame:
    """AG32: equal-width histogram over [min, max] per group (last bin closed), optionally
    after dropping values above a quantile cap."""
    by = list(by)
    x = df.filter(F.col(value).isNotNull()).select(*by, F.col(value).cast("double").alias("v"))
    if cap_quantile is not None:
        caps = grouped(x, by, Quantile("v", cap_quantile).alias("_cap"))
        x = x.join(caps, by).filter(F.col("v") <= F.col("_cap")).drop("_cap")
    rng = x.groupBy(*by).agg(F.min("v").alias("_lo"), F.max("v").alias("_hi"))
    j = x.join(rng, by)
    w = (F.col("_hi") - F.col("_lo")) / bins
    b = F.when(w == 0, F.lit(0)).otherwise(F.least(F.floor((F.col("v") - F.col("_lo")) / w), F.lit(bins - 1)))
    j = j.withColumn("bin", b.cast("int"))
    return j.groupBy(*by, "bin").agg(F.count(F.lit(1)).alias("count"),
                                     (F.first("_lo") + F.col("bin") * F.first(w)).alias("bin_start"))


def geo_bounds(df: DataFrame, lat: str, lon: str, by: Sequence[str] = ("city",), pad: float = 0.12,
               min_pad: float = 0.02) -> DataFrame:
    """AG33: median centre and a 1-99 % quantile box padded by 12 % (at least 0.02 degrees)."""
    g = grouped(df, [*by], median_of(lat).alias("center_lat"), median_of(lon).alias("center_lon"),
                *[Quantile(c, q).alias(n) for c, q, n in ((lat, 0.01, "_la0"), (lat, 0.99, "_la1"), (lon, 0.01, "_lo0"), (lon, 0.99, "_lo1"))])
    g = g.withColumn("_la", F.array("_la0", "_la1")).withColumn("_lo", F.array("_lo0", "_lo1"))
    pla = F.greatest((F.col("_la")[1] - F.col("_la")[0]) * pad, F.lit(min_pad))
    plo = F.greatest((F.col("_lo")[1] - F.col("_lo")[0]) * pad, F.lit(min_pad))
    return g.select(*by, "center_lat", "center_lon", (F.col("_la")[0] - pla).alias("min_lat"),
                    (F.col("_la")[1] + pla).alias("max_lat"), (F.col("_lo")[0] - plo).alias("min_lon"),
                    (F.col("_lo")[1] + plo).alias("max_lon"))


def area_average_distance(df: DataFrame, by: Sequence[str] = ("city",), area: str = "neighbourhood_cleansed",
                          distance: str = "distance_to_center_km", fallback: float = 5.0) -> DataFrame:
    """AG34: mean distance per area and for the whole city (area null); fallback when no data."""
    by = list(by)
    per_area = df.groupBy(*by, area).agg(F.avg(distance).alias("_m"), F.count(distance).alias("rows"))
    city = df.groupBy(*by).agg(F.avg(distance).alias("_m"), F.count(distance).alias("rows")) \
             .withColumn(area, F.lit(None).cast("string"))
    both = per_area.unionByName(city)
    return both.select(*by, area, F.when(F.col("rows") > 0, F.col("_m")).otherwise(F.lit(fallback))
                       .alias("average_distance_km"), "rows")
