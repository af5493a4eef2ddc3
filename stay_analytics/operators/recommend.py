"""Scoring and recommendations (RC1-RC16, PR28).

Every score is a weighted sum of average percentile ranks (``rank_scores``)
computed over the *filtered pool*; a pool is the grouping ``by`` (e.g. city,
or request id in the batch form). Top-k uses a ``row_number`` window whose
limit Spark applies before the shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import pround
from ..session import written_once
from .filters import filter_listings, luxury_amenity_count, request_predicate
from .ranking import grouped, median_of, Quantile, rank_scores

# Columns shown for a recommendation, in display order.
DISPLAY_COLUMNS = [
    "listing_id",
    "city",
    "neighbourhood_cleansed",
    "room_type",
    "property_group",
    "price_eur",
    "accommodates",
    "bedrooms",
    "bathrooms",
    "review_scores_rating",
    "review_scores_value",
    "number_of_reviews",
    "availability_30",
    "distance_to_center_km",
    "amenities_count",
    "value_score",
    "recommendation_reason",
]

# Value score weights (lower-is-better features marked).
VALUE_WEIGHTS = [("price", 0.35), ("rating", 0.20), ("value_rating", 0.15),
                 ("location", 0.15), ("amenity", 0.10), ("availability", 0.05)]
# Style score weights.
BUDGET_WEIGHTS = [("price", 0.45), ("rating", 0.20), ("location", 0.15),
                  ("value_rating", 0.10), ("availability", 0.10)]
VALUE_STYLE_WEIGHTS = [("value_rating", 0.30), ("rating", 0.22), ("amenity", 0.18),
                       ("location", 0.15), ("availability", 0.10), ("premium_price", 0.05)]
LUXURY_WEIGHTS = [("rating", 0.20), ("value_rating", 0.16), ("luxury", 0.18), ("amenity", 0.12),
                  ("guests", 0.14), ("bedrooms", 0.08), ("availability", 0.04), ("premium_price", 0.08)]


def _feature(df: DataFrame, column: str, default: float = 0.0) -> Column:
    return F.col(column).cast("double") if column in df.columns else F.lit(float(default))


def _base_specs(df: DataFrame) -> dict:
    """Rank features shared by the value score and the budget/value styles."""
    return {
        "_s_price_hi": (_feature(df, "price_eur"), True),
        "_s_rating": (_feature(df, "review_scores_rating", 4.0), True),
        "_s_value_rating": (_feature(df, "review_scores_value", 4.0), True),
        "_s_location": (_feature(df, "distance_to_center_km"), False),
        "_s_amenity": (_feature(df, "amenities_count"), True),
        "_s_availability": (_feature(df, "availability_30"), True),
    }


def _weighted(weights, names: dict) -> Column:
    total = None
    for key, w in weights:
        term = F.lit(w) * F.col(names[key])
        total = term if total is None else total + term
    return total


def _score_names(prefix="_s_") -> dict:
    return {"price": f"{prefix}price", "premium_price": f"{prefix}price_hi", "rating": f"{prefix}rating",
            "value_rating": f"{prefix}value_rating", "location": f"{prefix}location",
            "amenity": f"{prefix}amenity", "availability": f"{prefix}availability",
            "luxury": f"{prefix}luxury", "guests": f"{prefix}guests", "bedrooms": f"{prefix}bedrooms"}


def add_value_score(df: DataFrame, by: Sequence[str] = (), keep_ranks: bool = False) -> DataFrame:
    """RC1: value score in [0, 100], one decimal, ranks over the pool ``by``."""
    scored = rank_scores(df, _base_specs(df), by)
    scored = scored.withColumn("_s_price", F.lit(1.0) - F.col("_s_price_hi"))
    names = _score_names()
    scored = scored.withColumn("value_score", pround(_weighted(VALUE_WEIGHTS, names) * 100, 1))
    if not keep_ranks:
        scored = scored.drop(*[c for c in scored.columns if c.startswith("_s_")])
    return scored


def format_eur(c: Column) -> Column:
    """``EUR 1,234``: whole euros, half to even, thousands separators."""
    return F.concat(F.lit("EUR "), F.format_number(pround(c, 0).cast("bigint"), 0))


def recommendation_reason(df: DataFrame) -> Column:
    """PR28: up to four '; '-joined fragments for the non-null facts."""
    cols = set(df.columns)
    parts = []
    if "price_eur" in cols:
        parts.append(F.when(F.col("price_eur").isNotNull(),
                            F.concat(format_eur(F.col("price_eur")), F.lit(" nightly price"))))
    if "review_scores_rating" in cols:
        rating = F.format_string("%.2f", pround("review_scores_rating", 2))
        with_count = (F.concat(rating, F.lit(" rating from "),
                               F.col("number_of_reviews").cast("bigint").cast("string"), F.lit(" reviews"))
                      if "number_of_reviews" in cols else None)
        frag = F.when(F.col("review_scores_rating").isNull(), F.lit(None).cast("string"))
        if with_count is not None:
            frag = frag.when(F.col("number_of_reviews").isNotNull(), with_count)
        parts.append(frag.otherwise(F.concat(rating, F.lit(" rating"))))
    if "distance_to_center_km" in cols:
        parts.append(F.when(F.col("distance_to_center_km").isNotNull(), F.concat(
            F.format_string("%.1f", pround("distance_to_center_km", 1)), F.lit(" km from centre"))))
    if "availability_30" in cols:
        parts.append(F.when(F.col("availability_30").isNotNull(), F.concat(
            F.col("availability_30").cast("bigint").cast("string"), F.lit(" available days in next 30"))))
    if not parts:
        return F.lit("")
    return F.concat_ws("; ", F.slice(F.filter(F.array(*parts), lambda x: x.isNotNull()), 1, 4))


def _sort_keys(style: str, df: DataFrame) -> list[Column]:
    def d(c):
        return F.col(c).desc_nulls_last() if c in df.columns else None

    def a(c):
        return F.col(c).asc_nulls_last() if c in df.columns else None

    if style == "budget":
        keys = [d("recommendation_style_score"), d("value_score"), d("review_scores_rating"), a("price_eur")]
    elif style == "value":
        keys = [d("recommendation_style_score"), d("review_scores_value"), d("review_scores_rating"),
                a("price_eur")]
    elif style == "luxury":
        keys = [d("recommendation_style_score"), d("review_scores_rating"), d("amenities_count"),
                d("price_eur")]
    else:
        keys = [d("value_score"), d("review_scores_rating"), a("price_eur")]
    return [k for k in keys if k is not None] + [F.col("listing_id").asc()]


def style_scores(scored: DataFrame, style: str, limit: int, by: Sequence[str]) -> DataFrame:
    """RC2-RC5: style score (and narrowing) over pools; ``scored`` has ``_s_*`` ranks."""
    by = list(by)
    style = str(style or "Value").strip().lower()
    names = _score_names()
    if style == "budget":
        # Narrow to price <= q65 when the pool is large enough; scores stay from the full pool.
        scored = written_once(scored)  # read for the cut, the rows inside it and the ranking
        stats = grouped(scored, [*by], Quantile("price_eur", 0.65).alias("_cut"),
                                        F.count("price_eur").alias("_nprice"))
        stats = written_once(stats.withColumn("_cut", F.when(F.col("_nprice") >= max(limit, 8), F.col("_cut"))))
        joined = _attach(scored, stats, by)
        inside = F.coalesce(F.col("price_eur") <= F.col("_cut"), F.lit(False))
        kept = written_once(joined.groupBy(*by).agg(F.sum(inside.cast("int")).alias("_nin")))
        joined = _attach(joined, kept, by)
        narrow = F.col("_cut").isNotNull() & (F.col("_nin") >= min(limit, 3))
        ranked = joined.filter(~narrow | inside).drop("_cut", "_nprice", "_nin")
        return ranked.withColumn("recommendation_style_score", _weighted(BUDGET_WEIGHTS, names))
    if style == "value":
        return scored.withColumn("recommendation_style_score", _weighted(VALUE_STYLE_WEIGHTS, names))
    if style == "luxury":
        scored = ranked = written_once(scored.drop(*[c for c in scored.columns if c.startswith("_s_")]))
        if "room_type" in scored.columns:
            entire = F.coalesce(F.lower(F.col("room_type").cast("string")) == "entire home/apt", F.lit(False))
            cnt = written_once(scored.groupBy(*by).agg(F.sum(entire.cast("int")).alias("_nent")))
            joined = _attach(scored, cnt, by)
            ranked = joined.filter((F.col("_nent") < min(limit, 3)) | entire).drop("_nent")
        specs = {
            "_l_rating": (_feature(ranked, "review_scores_rating", 4.0), True),
            "_l_value_rating": (_feature(ranked, "review_scores_value", 4.0), True),
            "_l_luxury": (luxury_amenity_count(ranked.columns), True),
            "_l_amenity": (_feature(ranked, "amenities_count"), True),
            "_l_guests": (_feature(ranked, "accommodates"), True),
            "_l_bedrooms": (_feature(ranked, "bedrooms"), True),
            "_l_availability": (_feature(ranked, "availability_30"), True),
            "_l_price_hi": (_feature(ranked, "price_eur"), True),
        }
        ranked = rank_scores(ranked, specs, by)
        lux = _weighted(LUXURY_WEIGHTS, _score_names("_l_"))
        return ranked.withColumn("recommendation_style_score", lux)
    return scored.withColumn("recommendation_style_score", F.col("value_score"))


def _attach(df: DataFrame, table: DataFrame, by: Sequence[str]) -> DataFrame:
    from .filters import attach_group_values
    return attach_group_values(df, table, by)


def get_recommendations(df: DataFrame, limit: int = 10, by: Sequence[str] = (),
                        recommendation_style: str = "Value", extra_columns: Sequence[str] = (),
                        **filters) -> DataFrame:
    """RC6: filter -> value score -> reason -> style sort -> top ``limit`` per pool.

    Returns the display columns present plus ``by`` and ``rank`` (1 = best).
    """
    by = list(by)
    pool = filter_listings(df, **filters)
    scored = add_value_score(pool, by, keep_ranks=True)
    style_key = str(recommendation_style or "Value").strip().lower()
    ranked = style_scores(scored, style_key, limit, by)
    order = _sort_keys(style_key, ranked)
    rn = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    top = ranked.withColumn("rank", rn).filter(F.col("rank") <= limit)
    top = top.withColumn("recommendation_reason", recommendation_reason(top))  # of the rows shown alone
    cols = list(dict.fromkeys([*by, "rank", *[c for c in DISPLAY_COLUMNS if c in top.columns], *extra_columns]))
    return top.select(*cols)


def recommend_batch(listings: DataFrame, requests: DataFrame, limit_col: str = "limit",
                    style: str = "Value", default_limit: int = 10) -> DataFrame:
    """RC9: score every request against all listings of its city in one plan.

    ``requests`` holds ``request_id``, ``city`` and the FI3 filter columns.
    The request table joins on city with the filter as a residual predicate,
    so each request becomes its own pool; ranks, scores and the top-k window
    are all partitioned by ``request_id``.
    """
    l = listings.alias("l")
    r = requests.alias("r")
    cond = (F.col("l.city") == F.col("r.city")) & request_predicate(listings.columns, "r", "l")
    pairs = l.join(r, cond).select(F.col("r.request_id").alias("request_id"),
                                   F.coalesce(F.col(f"r.{limit_col}"), F.lit(default_limit)).alias("_limit"),
                                   *[F.col(f"l.{c}") for c in listings.columns])
    scored = add_value_score(pairs, ["request_id"], keep_ranks=True)
    style_key = str(style or "Value").strip().lower()
    ranked = style_scores(scored, style_key, default_limit, ["request_id"])
    order = _sort_keys(style_key, ranked)
    rn = F.row_number().over(Window.partitionBy("request_id").orderBy(*order))
    top = ranked.withColumn("rank", rn).filter(F.col("rank") <= F.col("_limit"))
    top = top.withColumn("recommendation_reason", recommendation_reason(top))
    cols = ["request_id", "rank", *[c for c in DISPLAY_COLUMNS if c in top.columns]]
    return top.select(*cols)


# ------------------------------------------------------------------ RC8 areas
NEIGHBOURHOOD_WEIGHTS = [("price", 0.45), ("rating", 0.30), ("value_rating", 0.15), ("location", 0.10)]


def neighbourhood_value(df: DataFrame, by: Sequence[str] = ("city",), area: str = "neighbourhood_cleansed",
                        min_rows: int = 25) -> DataFrame:
    """RC8: area stats (>= min_rows listings, 2-dp) and an area value score ranked on the rounded stats."""
    by = list(by)
    g = grouped(df, [*by, area], F.count(F.lit(1)).alias("listings"),
        median_of("price_eur", 2).alias("median_price_eur"),
        pround(F.avg("price_eur"), 2).alias("mean_price_eur"),
        pround(F.avg("review_scores_rating"), 2).alias("mean_rating"),
        pround(F.avg("review_scores_value"), 2).alias("mean_value_rating"),
        median_of("distance_to_center_km", 2).alias("median_distance_km"),
        median_of("availability_30", 2).alias("median_availability_30"),
    ).filter(F.col("listings") >= min_rows)
    specs = {"_n_price": ("median_price_eur", False), "_n_rating": ("mean_rating", True),
             "_n_value_rating": ("mean_value_rating", True), "_n_location": ("median_distance_km", False)}
    r = rank_scores(g, specs, by)
    score = _weighted(NEIGHBOURHOOD_WEIGHTS, {"price": "_n_price", "rating": "_n_rating",
                                              "value_rating": "_n_value_rating", "location": "_n_location"})
    return r.withColumn("neighbourhood_value_score", pround(score * 100, 1)).drop(*specs)


# ------------------------------------------------------- RC7/RC9 batch styles
# Per-style quality settings (price-floor quantile, review/rating floors, luxury extras).
STYLE_CONFIG = {
    "Budget": {"price_floor_quantile": 0.10, "min_reviews": 5, "min_rating": None},
    "In Style": {"price_floor_quantile": 0.40, "min_reviews": 10, "min_rating": 4.4},
    "Luxury": {"price_floor_quantile": 0.75, "min_reviews": 20, "min_rating": 4.7, "room_type": "Entire home/apt",
               "min_luxury_amenities": 4, "amenity_floor_quantile": 0.75},
}
# Which ranking each UI style uses ("In Style" has no ranker branch: value-score order, Q4).
STYLE_RANKER = {"Budget": "budget", "In Style": "in style", "Luxury": "luxury"}


def style_requests(base: DataFrame, style: str) -> DataFrame:
    """RC7: one request per base filter row for ``style``: the style's room type,
    rating floor (max of both), review floor, luxury minimum, and at least one
    available day in the next 30 are merged into the filters."""
    cfg = STYLE_CONFIG[style]
    x = base.withColumn("style", F.lit(style))
    if cfg.get("room_type"):
        x = x.withColumn("room_type", F.lit(cfg["room_type"]))
    return (x.withColumn("request_id", F.concat_ws("|", F.col("request_id").cast("string"), F.lit(style)))
            .withColumn("min_rating", F.greatest(F.coalesce(F.col("min_rating").cast("double"), F.lit(0.0)),
                                                 F.lit(float(cfg["min_rating"] or 0))))
            .withColumn("min_reviews", F.lit(int(cfg["min_reviews"])))
            .withColumn("min_luxury_amenities", F.lit(cfg.get("min_luxury_amenities")).cast("int"))
            .withColumn("min_available_days_30",
                        F.greatest(F.coalesce(F.col("min_available_days_30").cast("int"), F.lit(0)), F.lit(1))))


def _pairs(listings: DataFrame, requests: DataFrame) -> DataFrame:
    return listings.alias("l").join(requests.alias("r"), F.col("l.city") == F.col("r.city"))


def _floor_table(pool: DataFrame, value: str, q: float, min_n: int, out: str) -> DataFrame:
    """Per request: exact quantile ``q`` of ``value`` when >= ``min_n`` non-null values (else null)."""
    g = grouped(pool, ["request_id"], Quantile(value, q).alias("_q"), F.count(value).alias("_n"))
    return g.select("request_id", F.when(F.col("_n") >= min_n, F.col("_q")).alias(out))


def styled_recommendations(listings: DataFrame, base_requests: DataFrame, limit: int = 10,
                           min_candidates: int = 30) -> DataFrame:
    """RC7 + RC9 + FI4 + FI5 + FI10 for a whole table of requests in one plan per style.

    Per request: amenity floor (FI5, quantile of the candidates' amenity counts,
    rounded, at least 1) and price floor (FI4, quantile of the candidates'
    prices, kept when > 0), both only with >= 30 candidates; the strict pool
    applies them, and a relaxed pool without the price floor, review, amenity
    and luxury minimums is used only when the strict pool is empty (FI10,
    chosen per request by an aggregate). The chosen pool is ranked with
    ``request_id`` as the pool and sorted by the style's rules.
    """
    from ..session import cut_lineage
    from .filters import first_nonempty_level
    lcols = listings.columns
    flats = []
    for style in STYLE_CONFIG:
        pairs = _pairs(listings, style_requests(base_requests, style))
        base_pred = _request_predicate_without(lcols, [])
        relax_pred = _request_predicate_without(lcols, ["min_reviews", "min_luxury_amenities"])
        flats.append(pairs.filter(relax_pred).select(
            F.col("r.request_id").alias("request_id"), F.col("r.style").alias("style"),
            base_pred.alias("_base_ok"), *[F.col(f"l.{c}") for c in lcols]))
    flat_all = flats[0]
    for f in flats[1:]:
        flat_all = flat_all.unionByName(f)
    # the candidates feed two floors, two levels and the ranking: they are joined once
    flat_all = cut_lineage(flat_all)
    pools = []
    for style, cfg in STYLE_CONFIG.items():
        flat = flat_all.filter(F.col("style") == style)
        cand = flat.filter("_base_ok")
        if cfg.get("amenity_floor_quantile") is not None:
            amen = _floor_table(cand, "amenities_count", cfg["amenity_floor_quantile"], min_candidates, "_qa")
            amen = amen.select("request_id", F.greatest(F.lit(1), F.rint("_qa").cast("int")).alias("amenity_floor"))
        else:
            amen = cand.select("request_id").distinct().withColumn("amenity_floor", F.lit(None).cast("int"))
        flat = flat.join(amen, "request_id", "left")
        amen_ok = F.col("amenity_floor").isNull() | (F.col("amenities_count") >= F.col("amenity_floor"))
        cand2 = flat.filter(F.col("_base_ok") & amen_ok)
        price = _floor_table(cand2, "price_eur", cfg["price_floor_quantile"], min_candidates, "_qp")
        price = price.select("request_id", F.when(F.col("_qp") > 0, F.col("_qp")).alias("price_floor"))
        tagged = (flat.join(price, "request_id", "left")
                  .withColumn("_strict", F.col("_base_ok") & F.coalesce(amen_ok, F.lit(False))
                              & F.coalesce(F.col("price_floor").isNull() | (F.col("price_eur") >= F.col("price_floor")),
                                           F.lit(False)))
                  .withColumn("_relaxed", F.lit(True)))
        pools.append(first_nonempty_level(tagged, ["request_id"], ["_strict", "_relaxed"])
                     .drop("_strict", "_relaxed", "_base_ok"))
    pool = pools[0]
    for p in pools[1:]:
        pool = pool.unionByName(p)
    # the request pools feed several branches (ranks, narrowing, re-ranking):
    # materialise them once in the checkpoint folder instead of recomputing
    pool = cut_lineage(pool)
    # one ranking pass for every request of every style (pool = request_id)
    scored = add_value_score(pool, ["request_id"], keep_ranks=True)
    outs = []
    for style in STYLE_CONFIG:
        ranker = STYLE_RANKER[style]
        ranked = style_scores(scored.filter(F.col("style") == style), ranker, limit, ["request_id"])
        order = _sort_keys(ranker, ranked)
        rn = F.row_number().over(Window.partitionBy("request_id").orderBy(*order))
        top = ranked.withColumn("rank", rn).filter(F.col("rank") <= limit)
        top = top.withColumn("recommendation_reason", recommendation_reason(top))
        outs.append(top.select("request_id", "style", "rank", "relaxation_level", "price_floor", "amenity_floor",
                               *[c for c in DISPLAY_COLUMNS if c in top.columns]))
    res = outs[0]
    for o in outs[1:]:
        res = res.unionByName(o)
    return res


def _request_predicate_without(lcols, drop):
    """request_predicate with some request thresholds treated as absent."""
    from . import filters as fl
    cols = set(lcols)
    r = lambda c: F.lit(None) if c in drop else F.col(f"r.{c}")
    lc = lambda c: F.col(f"l.{c}").cast("double")

    def skip(c):
        return r(c).isNull() | (r(c).cast("double") == 0)

    preds = []
    if "price_eur" in cols:
        preds.append(skip("budget_max") | (lc("price_eur") <= r("budget_max")))
    if "accommodates" in cols:
        preds.append(skip("guests") | (lc("accommodates") >= r("guests")))
    if "room_type" in cols:
        preds.append(r("room_type").isNull() | (r("room_type") == "Any") | (r("room_type") == "")
                     | (F.col("l.room_type") == r("room_type")))
    if "neighbourhood_cleansed" in cols:
        preds.append(r("neighbourhood").isNull() | (r("neighbourhood") == "Any") | (r("neighbourhood") == "")
                     | (F.col("l.neighbourhood_cleansed") == r("neighbourhood")))
    if "review_scores_rating" in cols:
        preds.append(skip("min_rating") | lc("review_scores_rating").isNull()
                     | (lc("review_scores_rating") >= r("min_rating")))
    if "distance_to_center_km" in cols:
        preds.append(skip("max_distance_km") | (lc("distance_to_center_km") <= r("max_distance_km")))
    if "availability_30" in cols:
        preds.append(skip("min_available_days_30") | (lc("availability_30") >= r("min_available_days_30")))
    if "number_of_reviews" in cols:
        preds.append(skip("min_reviews") | (lc("number_of_reviews") >= r("min_reviews")))
    lux = fl.luxury_amenity_count(lcols)
    lux = F.lit(0.0) if "min_luxury_amenities" in drop else lux
    preds.append(skip("min_luxury_amenities") | (lux >= r("min_luxury_amenities")))
    for label, column in fl.AMENITY_COLUMNS.items():
        if column in cols:
            wants = F.coalesce(F.array_contains(F.col("r.amenities"), label), F.lit(False))
            preds.append(~wants | (lc(column) == 1.0))
    out = F.lit(True)
    for p in preds:
        out = out & F.coalesce(p, F.lit(False))
    return out


# ---------------------------------------------------------- RC10-RC16, FI11
def seasonal_recommendations(pool: DataFrame, season_cols: dict, by: Sequence[str] = ("city",),
                             limit: int = 3) -> DataFrame:
    """RC10: per season, 0.70 * value score (null -> 50) + 0.30 * season fit, top ``limit``.

    Season fit = 100 * (1 - average rank of the season's unavailable rate,
    nulls at the pool median), ranked per (pool, season) after unpivoting the
    season columns, so every season is ranked in the same pass.
    """
    by = list(by)
    # the scored pool feeds the season ranks, their probe and the join-back: written once, without what is not shown
    keep = [*by, "listing_id", "price_eur", "review_scores_rating", "value_score"]
    scored = written_once(add_value_score(pool, by).select(*dict.fromkeys(keep), *[F.col(c).alias(f"_u_{i}") for i, c in enumerate(season_cols.values())]))
    long = scored.select(*dict.fromkeys(keep), F.inline(F.array(*[F.struct(F.lit(s).alias("season"),
                                                                       F.col(f"_u_{i}").cast("double").alias("season_unavailable"))
                                                             for i, s in enumerate(season_cols)])))
    known = written_once(grouped(long, [*by, "season"], F.count("season_unavailable").alias("_nk"),
                                 median_of("season_unavailable").alias("_med")))
    long = long.join(known.filter(F.col("_nk") > 0), [*by, "season"])
    ranked = rank_scores(long, {"_fit": ("season_unavailable", False)}, [*by, "season"])
    ranked = (ranked.withColumn("season_fit_score", pround(F.col("_fit") * 100, 1))
              .withColumn("season_adjusted_score", pround(F.lit(0.70) * F.coalesce(F.col("value_score"), F.lit(50.0))
                                                          + F.lit(0.30) * F.col("season_fit_score"), 1))
              .withColumn("season_unavailable_rate", F.coalesce("season_unavailable", "_med")))
    order = [F.col("season_adjusted_score").desc_nulls_last(), F.col("value_score").desc_nulls_last(),
             F.col("review_scores_rating").desc_nulls_last(), F.col("price_eur").asc_nulls_last(),
             F.col("listing_id").asc()]
    rn = F.row_number().over(Window.partitionBy(*by, "season").orderBy(*order))
    top = ranked.withColumn("rank", rn).filter(F.col("rank") <= limit)
    return top.select(*by, "season", "rank", "listing_id", "price_eur", "value_score", "season_fit_score",
                      "season_adjusted_score", "season_unavailable_rate")


def travel_windows(pool: DataFrame, season_cols: dict, by: Sequence[str] = ("city",),
                   min_likely: int = 10) -> DataFrame:
    """RC11: per (pool, season): listings with a signal; price pool = likely-available
    (< 1.0) when >= 10 such rows, else all; count, mean/median price, mean unavailable."""
    by = list(by)
    long = pool.select(*by, "price_eur", F.inline(F.array(*[F.struct(F.lit(s).alias("travel_window"),
                                                                      F.col(c).cast("double").alias("_u"))
                                                            for s, c in season_cols.items()])))
    long = long.filter(F.col("_u").isNotNull())
    likely = F.col("_u") < 1.0
    n_likely = long.groupBy(*by, "travel_window").agg(F.sum(likely.cast("int")).alias("_nl"))
    j = long.join(n_likely, [*by, "travel_window"])
    keep = (F.col("_nl") < min_likely) | likely
    g = grouped(j.filter(keep), [*by, "travel_window"], F.count(F.lit(1)).alias("count"), F.avg("price_eur").alias("mean_price"),
        median_of("price_eur").alias("median_price"), F.avg("_u").alias("mean_unavailable"),
        F.count("price_eur").alias("_np"))
    return g.filter(F.col("_np") > 0).drop("_np")


def window_decision(windows: DataFrame, by: Sequence[str] = ("city",), target_window: str | None = None,
                    nights: int = 3, tie_eur: float = 2.0) -> DataFrame:
    """RC12: cheapest window; if more than one window and the mean-price spread is <= 2 EUR,
    the lowest mean unavailable breaks the tie; saving of the requested window vs the cheapest."""
    by = list(by)
    cheapest = F.min_by(F.struct("travel_window", "mean_price"),
                        F.struct(pround("mean_price", 6), F.col("travel_window")))  # float ties -> name
    calm = F.min_by("travel_window", F.struct(F.coalesce("mean_unavailable", F.lit(float("inf"))), "travel_window"))
    g = windows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("windows"), cheapest.alias("_c"),
        (F.max("mean_price") - F.min("mean_price")).alias("price_spread"), calm.alias("_calm"),
        F.max(F.when(F.col("travel_window") == F.lit(target_window), F.col("mean_price"))).alias("_target"))
    tie = (F.col("windows") > 1) & (F.col("price_spread") <= tie_eur)
    return g.select(*by, "windows", F.col("_c.travel_window").alias("cheapest_window"),
                    F.col("_c.mean_price").alias("cheapest_mean_price"), "price_spread",
                    F.when(tie, F.col("_calm")).alias("tie_break_window"),
                    F.when(tie, F.lit("tie")).when(F.col("_target").isNotNull()
                                                   & (F.lit(target_window) != F.col("_c.travel_window")), F.lit("saving"))
                    .otherwise(F.lit("cheapest")).alias("decision"),
                    (F.col("_target") - F.col("_c.mean_price")).alias("nightly_saving"),
                    ((F.col("_target") - F.col("_c.mean_price")) * nights).alias("stay_saving"))


def shortlist_vs_market(recs: DataFrame, market: DataFrame, by: Sequence[str] = ("city",),
                        shown: int = 5) -> DataFrame:
    """RC13: median price and mean value score of the first ``shown`` recommendations
    vs the market median price."""
    by = list(by)
    s = grouped(recs.filter(F.col("rank") <= shown), [*by], F.count(F.lit(1)).alias("shown"), median_of("price_eur").alias("shortlist_median_price_eur"),
        F.avg("value_score").alias("avg_value_score"))
    m = grouped(market, [*by], median_of("price_eur").alias("market_median_price_eur"))
    return s.join(m, by, "left")


def stay_totals(df: DataFrame, nights: int | str, price: str = "price_eur",
                predicted: str | None = None) -> DataFrame:
    """RC14: stay total = nightly price x nights (2 dp), snapshot and predicted."""
    n = F.col(nights) if isinstance(nights, str) else F.lit(nights)
    out = df.withColumn("estimated_stay_total_eur", pround(F.col(price) * n, 2))
    if predicted:
        out = out.withColumn("predicted_stay_total_eur", pround(F.col(predicted) * n, 2))
    return out


def default_filters(listings: DataFrame) -> DataFrame:
    """RC16: data-driven defaults: price cap = int(clamp(q95, 50, 500)); budget = min(150, max(cap, 100))."""
    q = grouped(listings, [], Quantile("price_eur", 0.95).alias("_q95"))
    cap = F.floor(F.greatest(F.lit(50.0), F.least(F.lit(500.0), F.col("_q95")))).cast("int")
    return q.select(cap.alias("price_max"),
                    F.least(F.lit(150), F.greatest(cap, F.lit(100))).alias("budget_max"),
                    F.lit(2).alias("guests"), F.lit("Any").alias("room_type"), F.lit("Any").alias("neighbourhood"),
                    F.lit(4.0).alias("min_rating"), F.lit(15).alias("max_distance_km"),
                    F.lit(0).alias("min_available_days_30"), F.lit(3).alias("stay_nights"))


def display_with_distance_cap(recs: DataFrame, by: Sequence[str], cap_km: float | None,
                              rank_mode: str = "Best match") -> DataFrame:
    """FI11: keep recommendations within ``cap_km`` when any are; a pool with none keeps all
    and switches to nearest-first; then order by the display mode."""
    by = list(by)
    if cap_km is None:
        within_any = recs.withColumn("_any", F.lit(0)).withColumn("_mode", F.lit(rank_mode))
    else:
        inside = F.coalesce(F.col("distance_to_center_km") <= cap_km, F.lit(False))
        flags = recs.groupBy(*by).agg(F.max(inside.cast("int")).alias("_any"))
        within_any = recs.join(flags, by).filter((F.col("_any") == 0) | inside) \
            .withColumn("_mode", F.when(F.col("_any") == 1, F.lit(rank_mode)).otherwise(F.lit("Closest centre")))
    key1 = (F.when(F.col("_mode") == "Lowest price", F.col("price_eur"))
            .when(F.col("_mode") == "Closest centre", F.col("distance_to_center_km")).otherwise(F.col("rank")))
    order = [key1.asc_nulls_last(), F.when(F.col("_mode") == "Best match", F.lit(0.0))
             .otherwise(-F.col("value_score")).asc_nulls_last(), F.col("rank").asc()]
    rn = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    return (within_any.withColumn("display_rank", rn).withColumn("distance_filter_applied", F.col("_any") == 1)
            .drop("_any").withColumnRenamed("_mode", "rank_mode"))
