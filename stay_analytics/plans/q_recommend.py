"""Registered recommendation queries (FI3, WN1, RC1-RC16, PR28, PR30)."""

from __future__ import annotations

from ..functions.numeric import pround
from ..operators import recommend as rc
from ..operators.ranking import rank_scores
from pyspark.sql import functions as F
from ..sources import fixtures as fx
from .registry import register
from .sqlkit import avg_rank_sql, dbl, filled_sql, pround_sql, with_views

# ---------------------------------------------------------------- oracle text

_RANK_FEATURES = [  # name, column, higher_is_better
    ("price_hi", "price_eur", True),
    ("rating", "review_scores_rating", True),
    ("value_rating", "review_scores_value", True),
    ("location", "distance_to_center_km", False),
    ("amenity", "amenities_count", True),
    ("availability", "availability_30", True),
]


def _weighted_sql(weights) -> str:
    name = {"premium_price": "price_hi"}
    return " + ".join(f"{dbl(w)} * s_{name.get(k, k)}" for k, w in weights)


def _reason_sql() -> str:
    eur = f"'EUR ' || format('{{:,}}', CAST({pround_sql('price_eur', 0)} AS BIGINT))"
    rating = f"printf('%.2f', {pround_sql('review_scores_rating', 2)})"
    return f"""concat_ws('; ',
      CASE WHEN price_eur IS NOT NULL THEN {eur} || ' nightly price' END,
      CASE WHEN review_scores_rating IS NULL THEN NULL
           WHEN number_of_reviews IS NOT NULL THEN {rating} || ' rating from ' || CAST(CAST(number_of_reviews AS BIGINT) AS VARCHAR) || ' reviews'
           ELSE {rating} || ' rating' END,
      CASE WHEN distance_to_center_km IS NOT NULL THEN printf('%.1f', {pround_sql('distance_to_center_km', 1)}) || ' km from centre' END,
      CASE WHEN availability_30 IS NOT NULL THEN CAST(CAST(availability_30 AS BIGINT) AS VARCHAR) || ' available days in next 30' END)"""


_DISPLAY_SQL = """listing_id, city, neighbourhood_cleansed, room_type, property_group, price_eur,
  CAST(accommodates AS BIGINT) AS accommodates, review_scores_rating, review_scores_value,
  CAST(number_of_reviews AS BIGINT) AS number_of_reviews, CAST(availability_30 AS BIGINT) AS availability_30,
  distance_to_center_km, CAST(amenities_count AS BIGINT) AS amenities_count, value_score, recommendation_reason"""


def scored_sql(pool: list[str], source: str, sfx: str = "") -> str:
    """CTEs ``filled``, ``ranked``, ``scored``, ``scored2`` (+ suffix): six pool ranks, value score, reason."""
    fills = ",\n  ".join(filled_sql(col, pool, f"f_{k}") for k, col, _ in _RANK_FEATURES)
    ranks = ",\n  ".join(f"{avg_rank_sql(f'f_{k}', pool, hi)} AS s_{k}" for k, _, hi in _RANK_FEATURES)
    value = _weighted_sql(rc.VALUE_WEIGHTS)
    return f""", filled{sfx} AS (SELECT *,
  {fills}
  FROM {source}),
ranked{sfx} AS (SELECT *,
  {ranks}
  FROM filled{sfx}),
scored{sfx} AS (SELECT *, 1.0 - s_price_hi AS s_price FROM ranked{sfx}),
scored2{sfx} AS (SELECT *,
  {pround_sql(f'({value}) * 100', 1)} AS value_score,
  {_reason_sql()} AS recommendation_reason
  FROM scored{sfx})
"""


def top_sql(pool: list[str], style_expr: str, order: str, limit: int, source: str = "scored2",
            extra_cols: str = "") -> str:
    p = ", ".join(pool)
    extra = "".join(f"{c}, " for c in pool if c != "city") + extra_cols
    return f"""SELECT {extra}CAST(rnk AS BIGINT) AS rank, {_DISPLAY_SQL} FROM (
  SELECT *, row_number() OVER (PARTITION BY {p} ORDER BY {order}, listing_id) AS rnk
  FROM (SELECT *, {style_expr} AS recommendation_style_score FROM {source}) x) y
WHERE rnk <= {limit}"""


def budget_narrow_sql(pool: list[str], src: str, name: str, limit: int) -> str:
    """Budget narrowing: price <= pool q65 when >= max(limit, 8) prices and >= min(limit, 3) remain."""
    p = ", ".join(pool)
    return f""", {name}_a AS (SELECT *, CASE WHEN count(price_eur) OVER (PARTITION BY {p}) >= {max(limit, 8)}
    THEN quantile_cont(price_eur, 0.65) OVER (PARTITION BY {p}) END AS cut FROM {src}),
{name}_b AS (SELECT *, sum(CASE WHEN coalesce(price_eur <= cut, false) THEN 1 ELSE 0 END) OVER (PARTITION BY {p}) AS nin
  FROM {name}_a),
{name} AS (SELECT * FROM {name}_b WHERE NOT (cut IS NOT NULL AND nin >= {min(limit, 3)}) OR coalesce(price_eur <= cut, false))
"""


_LUX_FEATURES = [  # name, sql value, default-when-missing handled by caller
    ("l_rating", "review_scores_rating"), ("l_value_rating", "review_scores_value"),
    ("l_luxury", "CAST(coalesce(has_air_conditioning, 0) AS DOUBLE)"), ("l_amenity", "amenities_count"),
    ("l_guests", "accommodates"), ("l_bedrooms", "CAST(0.0 AS DOUBLE)"), ("l_availability", "availability_30"),
    ("l_price_hi", "price_eur"),
]


def luxury_sql(pool: list[str], src: str, name: str, limit: int) -> str:
    """Luxury: entire-home narrowing (if >= min(limit, 3)), then 8 ranks recomputed on the narrowed pool."""
    p = ", ".join(pool)
    fills = ",\n  ".join(filled_sql(v, pool, f"f_{k}") for k, v in _LUX_FEATURES)
    ranks = ",\n  ".join(f"{avg_rank_sql(f'f_{k}', pool, True)} AS s_{k}" for k, _ in _LUX_FEATURES)
    w = {"rating": 0.20, "value_rating": 0.16, "luxury": 0.18, "amenity": 0.12, "guests": 0.14, "bedrooms": 0.08,
         "availability": 0.04, "price_hi": 0.08}
    expr = " + ".join(f"{dbl(v)} * s_l_{k}" for k, v in w.items())
    return f""", {name}_n AS (SELECT *, sum(CASE WHEN lower(room_type) = 'entire home/apt' THEN 1 ELSE 0 END)
    OVER (PARTITION BY {p}) AS nent FROM {src}),
{name}_k AS (SELECT * EXCLUDE (nent) FROM {name}_n WHERE nent < {min(limit, 3)} OR coalesce(lower(room_type) = 'entire home/apt', false)),
{name}_f AS (SELECT *, {fills} FROM {name}_k),
{name}_r AS (SELECT *, {ranks} FROM {name}_f),
{name} AS (SELECT *, {expr} AS lux_score FROM {name}_r)
"""


LUXURY_ORDER = ("recommendation_style_score DESC NULLS LAST, review_scores_rating DESC NULLS LAST, "
                "amenities_count DESC NULLS LAST, price_eur DESC NULLS LAST")


VALUE_ORDER = ("recommendation_style_score DESC NULLS LAST, review_scores_value DESC NULLS LAST, "
               "review_scores_rating DESC NULLS LAST, price_eur ASC NULLS LAST")
DEFAULT_ORDER = "value_score DESC NULLS LAST, review_scores_rating DESC NULLS LAST, price_eur ASC NULLS LAST"
BUDGET_ORDER = ("recommendation_style_score DESC NULLS LAST, value_score DESC NULLS LAST, "
                "review_scores_rating DESC NULLS LAST, price_eur ASC NULLS LAST")

FLAGSHIP_SQL = (with_views("listings")[:-1] + scored_sql(["city"], "listings")
                + top_sql(["city"], _weighted_sql(rc.VALUE_STYLE_WEIGHTS),
                          VALUE_ORDER, 10))


@register("rc6_top_value_listings_per_city", FLAGSHIP_SQL)
def top_value_listings(spark, sf_dir):
    """RC6 flagship: top 10 listings per city, value style, ranks over each city pool."""
    return rc.get_recommendations(fx.listings(spark, sf_dir), limit=10, by=["city"])


_BUDGET_STYLE = " + ".join(f"{dbl(w)} * s_{k}" for k, w in rc.BUDGET_WEIGHTS)

RC2_SQL = (with_views("listings")[:-1] + scored_sql(["city"], "listings")
           + budget_narrow_sql(["city"], "scored2", "bud", 10)
           + top_sql(["city"], _BUDGET_STYLE, BUDGET_ORDER, 10, source="bud"))


@register("rc2_budget_style_per_city", RC2_SQL)
def budget_style(spark, sf_dir):
    """RC2: budget style: q65 price narrowing (scores kept from the full pool), top 10 per city."""
    return rc.get_recommendations(fx.listings(spark, sf_dir), limit=10, by=["city"], recommendation_style="Budget")


RC4_SQL = (with_views("listings")[:-1] + scored_sql(["city"], "listings")
           + luxury_sql(["city"], "scored2", "lux", 10)
           + top_sql(["city"], "lux_score", LUXURY_ORDER, 10, source="lux"))


@register("rc4_luxury_style_per_city", RC4_SQL)
def luxury_style(spark, sf_dir):
    """RC4: luxury style: entire-home narrowing and eight ranks recomputed on the narrowed pool."""
    return rc.get_recommendations(fx.listings(spark, sf_dir), limit=10, by=["city"], recommendation_style="Luxury")


RC5_SQL = (with_views("listings")[:-1] + scored_sql(["city"], "listings")
           + top_sql(["city"], "value_score", DEFAULT_ORDER, 10))


@register("rc5_default_style_per_city", RC5_SQL)
def default_style(spark, sf_dir):
    """RC5/Q4: an unknown style ("In Style") sorts by value score, rating, price."""
    return rc.get_recommendations(fx.listings(spark, sf_dir), limit=10, by=["city"], recommendation_style="In Style")


_FI3_FILTERS = dict(budget_max=300, guests=2, min_rating=4.5, max_distance_km=8, min_available_days_30=3,
                    min_reviews=2, amenities=["WiFi"])
RC6F_SQL = (with_views("listings")[:-1] + """, pool AS (SELECT * FROM listings WHERE price_eur <= 300 AND accommodates >= 2
  AND (review_scores_rating >= 4.5 OR review_scores_rating IS NULL) AND distance_to_center_km <= 8
  AND availability_30 >= 3 AND number_of_reviews >= 2 AND has_wifi = 1)
""" + scored_sql(["city"], "pool") + top_sql(["city"], _weighted_sql(rc.VALUE_STYLE_WEIGHTS), VALUE_ORDER, 10))


@register("fi3_filtered_recommendations", RC6F_SQL)
def filtered_recs(spark, sf_dir):
    """FI3 + RC6: conjunctive filters (rating keeps unrated rows), ranks over the filtered pool."""
    return rc.get_recommendations(fx.listings(spark, sf_dir), limit=10, by=["city"], **_FI3_FILTERS)


@register("wn1_global_average_rank", with_views("listings")[:-1] + f""", f AS (SELECT listing_id,
  {filled_sql('review_scores_rating', [], 'fr')}, {filled_sql('price_eur', [], 'fp')} FROM listings)
SELECT listing_id, {avg_rank_sql('fr', [], True)} AS rating_rank, {avg_rank_sql('fp', [], False)} AS price_rank FROM f""")
def global_rank(spark, sf_dir):
    """WN1: average percentile ranks over the whole table (no pool key; range-split running counts)."""
    l = fx.listings(spark, sf_dir).select("listing_id", "review_scores_rating", "price_eur")
    r = rank_scores(l, {"rating_rank": ("review_scores_rating", True), "price_rank": ("price_eur", False)})
    return r.select("listing_id", "rating_rank", "price_rank")


@register("rc8_neighbourhood_value_score", with_views("listings")[:-1] + f""", g AS (
  SELECT city, neighbourhood_cleansed, count(*) AS listings, {pround_sql('median(price_eur)', 2)} AS median_price_eur,
    {pround_sql('avg(price_eur)', 2)} AS mean_price_eur, {pround_sql('avg(review_scores_rating)', 2)} AS mean_rating,
    {pround_sql('avg(review_scores_value)', 2)} AS mean_value_rating,
    {pround_sql('median(distance_to_center_km)', 2)} AS median_distance_km,
    {pround_sql('median(availability_30)', 2)} AS median_availability_30
  FROM listings GROUP BY city, neighbourhood_cleansed HAVING count(*) >= 25),
f AS (SELECT *, {filled_sql('median_price_eur', ['city'], 'a')}, {filled_sql('mean_rating', ['city'], 'b')},
  {filled_sql('mean_value_rating', ['city'], 'c')}, {filled_sql('median_distance_km', ['city'], 'd')} FROM g)
SELECT city, neighbourhood_cleansed, listings, median_price_eur, mean_price_eur, mean_rating, mean_value_rating,
  median_distance_km, median_availability_30,
  {pround_sql(f"({dbl(0.45)} * {avg_rank_sql('a', ['city'], False)} + {dbl(0.30)} * {avg_rank_sql('b', ['city'], True)} + {dbl(0.15)} * {avg_rank_sql('c', ['city'], True)} + {dbl(0.10)} * {avg_rank_sql('d', ['city'], False)}) * 100", 1)} AS neighbourhood_value_score
FROM f""")
def area_value(spark, sf_dir):
    """RC8: neighbourhood value score from rounded area stats (>= 25 listings)."""
    return rc.neighbourhood_value(fx.listings(spark, sf_dir))


# ----------------------------------------------------------------- RC7 batch
def _base_requests(listings):
    return listings.select("city").distinct().select(
        F.col("city").alias("request_id"), "city", F.lit(300.0).alias("budget_max"), F.lit(2).alias("guests"),
        F.lit("Any").alias("room_type"), F.lit("Any").alias("neighbourhood"),
        F.array().cast("array<string>").alias("amenities"), F.lit(3.0).alias("min_rating"),
        F.lit(8.0).alias("max_distance_km"), F.lit(0).alias("min_available_days_30"))


def _styled_sql() -> str:
    parts = [with_views("listings")[:-1] + ", req AS (SELECT DISTINCT city FROM listings)\n"]
    selects = []
    for style, cfg in rc.STYLE_CONFIG.items():
        t = style.replace(" ", "").lower()
        rating = max(3.0, float(cfg["min_rating"] or 0))
        room = cfg.get("room_type")
        relax = [f"coalesce(l.price_eur <= 300.0, false)", "coalesce(l.accommodates >= 2, false)",
                 f"coalesce(l.review_scores_rating IS NULL OR l.review_scores_rating >= {rating}, false)",
                 "coalesce(l.distance_to_center_km <= 8.0, false)", "coalesce(l.availability_30 >= 1, false)"]
        if room:
            relax.append(f"coalesce(l.room_type = '{room}', false)")
        base = [f"coalesce(l.number_of_reviews >= {int(cfg['min_reviews'])}, false)"]
        if cfg.get("min_luxury_amenities"):
            base.append(f"coalesce(CAST(coalesce(l.has_air_conditioning, 0) AS DOUBLE) >= {cfg['min_luxury_amenities']}, false)")
        aq = cfg.get("amenity_floor_quantile")
        amen = (f"""SELECT request_id, CASE WHEN count(amenities_count) >= 30 THEN greatest(1, CAST({pround_sql(f'quantile_cont(amenities_count, {aq})', 0)} AS BIGINT)) END AS amenity_floor
  FROM flat_{t} WHERE base_ok GROUP BY request_id""" if aq is not None else
                f"SELECT DISTINCT request_id, CAST(NULL AS BIGINT) AS amenity_floor FROM flat_{t} WHERE base_ok")
        parts.append(f""", flat_{t} AS (SELECT r.city || '|{style}' AS request_id, '{style}' AS style, l.*,
    {' AND '.join(base)} AS base_ok
  FROM listings l JOIN req r ON l.city = r.city WHERE {' AND '.join(relax)}),
amen_{t} AS ({amen}),
f2_{t} AS (SELECT f.*, a.amenity_floor, (a.amenity_floor IS NULL OR f.amenities_count >= a.amenity_floor) AS amen_ok
  FROM flat_{t} f LEFT JOIN amen_{t} a ON f.request_id = a.request_id),
pf_{t} AS (SELECT request_id, CASE WHEN count(price_eur) >= 30 AND quantile_cont(price_eur, {cfg['price_floor_quantile']}) > 0
    THEN quantile_cont(price_eur, {cfg['price_floor_quantile']}) END AS price_floor
  FROM f2_{t} WHERE base_ok AND coalesce(amen_ok, false) GROUP BY request_id),
tag_{t} AS (SELECT f.*, p.price_floor, base_ok AND coalesce(amen_ok, false)
    AND coalesce(p.price_floor IS NULL OR f.price_eur >= p.price_floor, false) AS strict_ok
  FROM f2_{t} f LEFT JOIN pf_{t} p ON f.request_id = p.request_id),
lvl_{t} AS (SELECT *, CASE WHEN max(CASE WHEN strict_ok THEN 1 ELSE 0 END) OVER (PARTITION BY request_id) = 1 THEN 0 ELSE 1 END AS relaxation_level
  FROM tag_{t}),
pool_{t} AS (SELECT * EXCLUDE (base_ok, amen_ok, strict_ok) FROM lvl_{t} WHERE relaxation_level = 1 OR strict_ok)
""")
        parts.append(scored_sql(["request_id"], f"pool_{t}", f"_{t}"))
        extra = "style, CAST(relaxation_level AS BIGINT) AS relaxation_level, price_floor, CAST(amenity_floor AS BIGINT) AS amenity_floor, "
        if style == "Budget":
            parts.append(budget_narrow_sql(["request_id"], f"scored2_{t}", f"bud_{t}", 10))
            selects.append(top_sql(["request_id"], _BUDGET_STYLE, BUDGET_ORDER, 10, f"bud_{t}", extra))
        elif style == "Luxury":
            parts.append(luxury_sql(["request_id"], f"scored2_{t}", f"lux_{t}", 10))
            selects.append(top_sql(["request_id"], "lux_score", LUXURY_ORDER, 10, f"lux_{t}", extra))
        else:
            selects.append(top_sql(["request_id"], "value_score", DEFAULT_ORDER, 10, f"scored2_{t}", extra))
    return "".join(parts) + "\nUNION ALL\n".join(f"({s_})" for s_ in selects)


@register("rc7_styled_requests_batch", _styled_sql())
def styled(spark, sf_dir):
    """RC7+RC9+FI4+FI5+FI10: one request per city x style with floors and the relaxation fallback."""
    l = fx.listings(spark, sf_dir)
    return rc.styled_recommendations(l, _base_requests(l))


# ------------------------------------------------------ seasonal / timing
_SEASONS = ["winter", "spring", "summer", "autumn"]
SEASON_COLS = {s.title(): f"calendar_unavailable_{s}" for s in _SEASONS}


def _listings_with_seasons(spark, sf_dir):
    """Listings with the seasonal unavailable rates of their own calendar listing."""
    from ..operators import calendar as cl
    calr = cl.calendar_rollup(fx.calendar(spark, sf_dir)).select(
        F.col("listing_id").alias("_sk"), *[F.col(c) for c in SEASON_COLS.values()])
    l = fx.listings(spark, sf_dir)
    l = l.join(fx.listing_calendar(spark, sf_dir), "listing_id", "left")
    return l.join(calr, F.col("calendar_id") == calr._sk, "left").drop("_sk", "calendar_id")


def _seasons_sql() -> str:
    un = "(CASE WHEN available = 't' THEN 0 ELSE 1 END)"
    from .q_calendar import season_sql
    rates = ", ".join(f"sum(CASE WHEN {season_sql('date')} = '{s}' THEN {un} END) / "
                      f"count(CASE WHEN {season_sql('date')} = '{s}' THEN 1 END) AS calendar_unavailable_{s}"
                      for s in _SEASONS)
    return (with_views("listings", "calendar", "listing_calendar")[:-1] + f""", calr AS (SELECT listing_id AS sk, {rates} FROM calendar GROUP BY listing_id),
ls AS (SELECT l.*, {', '.join(f'c.calendar_unavailable_{s}' for s in _SEASONS)}
  FROM listings l LEFT JOIN listing_calendar lc ON lc.listing_id = l.listing_id LEFT JOIN calr c ON c.sk = lc.calendar_id)
""")


def _rc10_sql() -> str:
    long = " UNION ALL ".join(f"SELECT *, '{s.title()}' AS season, CAST(calendar_unavailable_{s} AS DOUBLE) AS su FROM scored2"
                              for s in _SEASONS)
    return (_seasons_sql() + scored_sql(["city"], "ls") + f""", lg AS ({long}),
lk AS (SELECT * FROM lg QUALIFY count(su) OVER (PARTITION BY city, season) > 0),
lf AS (SELECT *, {filled_sql('su', ['city', 'season'], 'fs')} FROM lk),
lr AS (SELECT *, {pround_sql(avg_rank_sql('fs', ['city', 'season'], False) + ' * 100', 1)} AS season_fit_score FROM lf),
la AS (SELECT *, {pround_sql(f'{dbl(0.70)} * coalesce(value_score, 50.0) + {dbl(0.30)} * season_fit_score', 1)} AS season_adjusted_score FROM lr)
SELECT city, season, CAST(rank AS BIGINT) AS rank, listing_id, price_eur, value_score, season_fit_score, season_adjusted_score,
  fs AS season_unavailable_rate FROM (
  SELECT *, row_number() OVER (PARTITION BY city, season ORDER BY season_adjusted_score DESC NULLS LAST, value_score DESC NULLS LAST,
    review_scores_rating DESC NULLS LAST, price_eur ASC NULLS LAST, listing_id) AS rank FROM la) WHERE rank <= 3""")


@register("rc10_seasonal_recommendations", _rc10_sql())
def seasonal(spark, sf_dir):
    """RC10: per city and season, value score blended with the season-availability fit, top 3."""
    return rc.seasonal_recommendations(_listings_with_seasons(spark, sf_dir), SEASON_COLS)


def _windows_sql_body() -> str:
    long = " UNION ALL ".join(f"SELECT city, price_eur, '{s.title()}' AS travel_window, CAST(calendar_unavailable_{s} AS DOUBLE) AS u FROM ls"
                              for s in _SEASONS)
    return f""", wl AS (SELECT * FROM ({long}) WHERE u IS NOT NULL),
wn AS (SELECT *, sum(CASE WHEN u < 1.0 THEN 1 ELSE 0 END) OVER (PARTITION BY city, travel_window) AS nl FROM wl),
win AS (SELECT city, travel_window, count(*) AS count, avg(price_eur) AS mean_price, median(price_eur) AS median_price,
  avg(u) AS mean_unavailable FROM wn WHERE nl < 10 OR u < 1.0 GROUP BY city, travel_window HAVING count(price_eur) > 0)
"""


@register("rc11_travel_windows", _seasons_sql()[:-1] + _windows_sql_body() + "SELECT * FROM win")
def windows(spark, sf_dir):
    """RC11: per city and season travel_window: count, mean/median price, mean unavailable (likely-available pool)."""
    return rc.travel_windows(_listings_with_seasons(spark, sf_dir), SEASON_COLS)


@register("rc12_window_decision", _seasons_sql()[:-1] + _windows_sql_body() + """,
ch AS (SELECT city, travel_window AS cheapest_window, mean_price AS cheapest_mean_price FROM win
  QUALIFY row_number() OVER (PARTITION BY city ORDER BY """ + pround_sql('mean_price', 6) + """, travel_window) = 1),
ca AS (SELECT city, travel_window AS calm FROM win
  QUALIFY row_number() OVER (PARTITION BY city ORDER BY coalesce(mean_unavailable, 'inf'::DOUBLE), travel_window) = 1),
g AS (SELECT city, count(*) AS windows, max(mean_price) - min(mean_price) AS price_spread,
  max(CASE WHEN travel_window = 'Summer' THEN mean_price END) AS target FROM win GROUP BY city)
SELECT g.city, g.windows, ch.cheapest_window, ch.cheapest_mean_price, g.price_spread,
  CASE WHEN g.windows > 1 AND g.price_spread <= 2.0 THEN ca.calm END AS tie_break_window,
  CASE WHEN g.windows > 1 AND g.price_spread <= 2.0 THEN 'tie'
       WHEN g.target IS NOT NULL AND ch.cheapest_window <> 'Summer' THEN 'saving' ELSE 'cheapest' END AS decision,
  g.target - ch.cheapest_mean_price AS nightly_saving, (g.target - ch.cheapest_mean_price) * 3 AS stay_saving
FROM g JOIN ch ON g.city = ch.city JOIN ca ON g.city = ca.city""")
def decision(spark, sf_dir):
    """RC12: cheapest travel_window, availability tie-break within 2 EUR, saving vs a requested Summer stay."""
    return rc.window_decision(rc.travel_windows(_listings_with_seasons(spark, sf_dir), SEASON_COLS),
                              target_window="Summer", nights=3)


_RECS_CTE = (with_views("listings")[:-1] + scored_sql(["city"], "listings") + ", recs AS ("
             + top_sql(["city"], _weighted_sql(rc.VALUE_STYLE_WEIGHTS), VALUE_ORDER, 10) + ")\n")


def _flagship(spark, sf_dir):
    return rc.get_recommendations(fx.listings(spark, sf_dir), limit=10, by=["city"])


@register("rc13_shortlist_vs_market", _RECS_CTE + """,
s AS (SELECT city, count(*) AS shown, median(price_eur) AS shortlist_median_price_eur, avg(value_score) AS avg_value_score
  FROM recs WHERE rank <= 5 GROUP BY city),
m AS (SELECT city, median(price_eur) AS market_median_price_eur FROM listings GROUP BY city)
SELECT s.*, m.market_median_price_eur FROM s LEFT JOIN m ON s.city = m.city""")
def shortlist(spark, sf_dir):
    """RC13: shortlist (first 5) median price and mean score vs the market median."""
    return rc.shortlist_vs_market(_flagship(spark, sf_dir), fx.listings(spark, sf_dir))


@register("rc14_stay_totals", _RECS_CTE + f"""SELECT city, rank, listing_id, price_eur,
  {pround_sql('price_eur * 3', 2)} AS estimated_stay_total_eur FROM recs""")
def stay_totals(spark, sf_dir):
    """RC14: nightly price x 3 nights for the recommended listings."""
    r = _flagship(spark, sf_dir).select("city", "rank", "listing_id", "price_eur")
    return rc.stay_totals(r, 3)


@register("rc16_default_filters", L16 := with_views("listings") + """
SELECT CAST(floor(greatest(50.0, least(500.0, quantile_cont(price_eur, 0.95)))) AS BIGINT) AS price_max,
  CAST(least(150, greatest(CAST(floor(greatest(50.0, least(500.0, quantile_cont(price_eur, 0.95)))) AS BIGINT), 100)) AS BIGINT) AS budget_max,
  CAST(2 AS BIGINT) AS guests, 'Any' AS room_type, 'Any' AS neighbourhood, 4.0::DOUBLE AS min_rating,
  CAST(15 AS BIGINT) AS max_distance_km, CAST(0 AS BIGINT) AS min_available_days_30, CAST(3 AS BIGINT) AS stay_nights
FROM listings""")
def defaults(spark, sf_dir):
    """RC16: data-driven default filters (price cap from the 95th percentile)."""
    return rc.default_filters(fx.listings(spark, sf_dir))


@register("fi11_distance_cap_display", _RECS_CTE + """,
fl AS (SELECT city, max(CASE WHEN coalesce(distance_to_center_km <= 1.0, false) THEN 1 ELSE 0 END) AS anyin FROM recs GROUP BY city),
k AS (SELECT r.*, fl.anyin FROM recs r JOIN fl ON r.city = fl.city
  WHERE fl.anyin = 0 OR coalesce(r.distance_to_center_km <= 1.0, false)),
m AS (SELECT *, CASE WHEN anyin = 1 THEN 'Lowest price' ELSE 'Closest centre' END AS rank_mode FROM k)
SELECT city, rank, listing_id, price_eur, distance_to_center_km, value_score, rank_mode, anyin = 1 AS distance_filter_applied,
  CAST(row_number() OVER (PARTITION BY city ORDER BY
    CASE WHEN rank_mode = 'Lowest price' THEN price_eur WHEN rank_mode = 'Closest centre' THEN distance_to_center_km ELSE rank END ASC NULLS LAST,
    -value_score ASC NULLS LAST, rank) AS BIGINT) AS display_rank
FROM m""")
def distance_display(spark, sf_dir):
    """FI11: 1 km cap with nearest-first fallback, then lowest-price display order."""
    r = _flagship(spark, sf_dir).select("city", "rank", "listing_id", "price_eur", "distance_to_center_km",
                                         "value_score")
    return rc.display_with_distance_cap(r, ["city"], 1.0, "Lowest price")


def _room_requests(listings):
    """One request per (city, room type) present in the data: budget 300, that room type, top 5."""
    req = listings.select("city", "room_type").distinct().filter(F.col("room_type").isNotNull())
    req = req.select(F.concat_ws("|", "city", "room_type").alias("request_id"), "city", "room_type",
                     F.lit(300.0).alias("budget_max"), F.array().cast("array<string>").alias("amenities"),
                     F.lit(5).alias("limit"))
    for c, t in [("min_price_eur", "double"), ("guests", "int"), ("neighbourhood", "string"),
                 ("min_rating", "double"), ("max_distance_km", "double"), ("min_available_days_30", "int"),
                 ("min_reviews", "int"), ("min_amenities_count", "int"), ("min_luxury_amenities", "int")]:
        req = req.withColumn(c, F.lit(None).cast(t))
    return req


RC9_SQL = (with_views("listings")[:-1] + """, req AS (SELECT DISTINCT city, room_type FROM listings WHERE room_type IS NOT NULL),
pool AS (SELECT l.*, r.city || '|' || r.room_type AS request_id FROM listings l
  JOIN req r ON l.city = r.city AND l.room_type = r.room_type WHERE l.price_eur <= 300.0)
""" + scored_sql(["request_id"], "pool") + top_sql(["request_id"], _weighted_sql(rc.VALUE_STYLE_WEIGHTS), VALUE_ORDER, 5))


@register("rc9_request_batch", RC9_SQL)
def request_batch(spark, sf_dir):
    """RC9: a table of requests (one per city and room type) scored against all listings in one plan."""
    l = fx.listings(spark, sf_dir)
    return rc.recommend_batch(l, _room_requests(l))
