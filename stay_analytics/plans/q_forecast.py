"""Registered prediction-cache queries (FC1-FC9, JN6-JN9, PR26, PR27).

Predictions come from median predictors so the whole cache is SQL-checkable:
property-group segments with >= 600 listings in a city get a segment median
(property group + room type); every other listing falls back to the city
room-type median (anti join on the segment predictions).
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import calendar as cl
from ..operators import forecast as fc
from ..session import spread, written_once
from ..sources import fixtures as fx
from .registry import register
from .sqlkit import pround_sql, with_views
from ..operators.ranking import grouped, median_of

AS_OF = "2024-07-20"
_SEASONS = ["winter", "spring", "summer", "autumn"]
CONTEXT = ["listing_id", "city", "neighbourhood_cleansed", "property_group", "room_type", "accommodates",
           "distance_to_center_km", "review_scores_rating", "review_scores_value", "availability_30", "has_wifi",
           "has_kitchen", "has_air_conditioning", "price_eur"]


def _master(spark, sf_dir):
    calr = cl.calendar_rollup(fx.calendar(spark, sf_dir)).select(
        F.col("listing_id").alias("_sk"), *[F.col(f"calendar_unavailable_{s}") for s in _SEASONS])
    l = fx.listings(spark, sf_dir)
    l = l.join(fx.listing_calendar(spark, sf_dir), "listing_id", "left")
    return l.join(calr, F.col("calendar_id") == calr._sk, "left").drop("_sk", "calendar_id")


def _predictions(spark, sf_dir):
    # listings feed the counts, both medians and both sets of rows; the small tables are written so that they are copied to the rows
    l = written_once(fx.listings(spark, sf_dir).select("listing_id", "city", "property_group", "room_type", "price_eur"))
    ok = written_once(l.groupBy("city", "property_group").agg(F.count(F.lit(1)).alias("n")).filter("n >= 600").drop("n"))
    segm = written_once(grouped(l, ["city", "property_group", "room_type"], median_of("price_eur").alias("predicted_price_eur")))
    citym = written_once(grouped(l, ["city", "room_type"], median_of("price_eur").alias("predicted_price_eur")))
    seg = l.join(ok, ["city", "property_group"]).join(segm, ["city", "property_group", "room_type"])
    seg = fc.scored_predictions(seg, "property_group", "property_group", "Segment median (property group + room)")
    city = l.join(citym, ["city", "room_type"])
    city = fc.scored_predictions(city, "city_fallback", None, "City room-type median")
    return seg, city


def _cache(spark, sf_dir):
    seg, city = _predictions(spark, sf_dir)
    ctx = CONTEXT + [f"calendar_unavailable_{s}" for s in _SEASONS]
    return fc.listing_cache(seg, city, _master(spark, sf_dir), ctx)


def _cache_sql() -> str:
    un = "(CASE WHEN available = 't' THEN 0 ELSE 1 END)"
    from .q_calendar import season_sql
    rates = ", ".join(f"sum(CASE WHEN {season_sql('date')} = '{s}' THEN {un} END) / "
                      f"count(CASE WHEN {season_sql('date')} = '{s}' THEN 1 END) AS calendar_unavailable_{s}"
                      for s in _SEASONS)
    band = ("CASE WHEN p IS NULL OR isnan(p) THEN 'Unknown' ELSE printf('EUR %d-%d', CAST(floor(p / 25) * 25 AS BIGINT), "
            "CAST(floor(p / 25) * 25 AS BIGINT) + 25) END")
    ctx = ", ".join(f"l.{c}" for c in CONTEXT if c != "price_eur")
    return with_views("listings", "calendar", "listing_calendar")[:-1] + f""", calr AS (SELECT listing_id AS sk, {rates} FROM calendar GROUP BY listing_id),
ms AS (SELECT l.*, {', '.join(f'c.calendar_unavailable_{s}' for s in _SEASONS)} FROM listings l LEFT JOIN listing_calendar lc ON lc.listing_id = l.listing_id LEFT JOIN calr c ON c.sk = lc.calendar_id),
ok AS (SELECT city, property_group FROM listings GROUP BY ALL HAVING count(*) >= 600),
segm AS (SELECT city, property_group, room_type, median(price_eur) AS p FROM listings GROUP BY ALL),
citym AS (SELECT city, room_type, median(price_eur) AS p FROM listings GROUP BY ALL),
sp AS (SELECT l.listing_id, l.city, s.p, 'property_group' AS prediction_model_scope, l.property_group AS prediction_model_segment,
    'Segment median (property group + room)' AS prediction_model_name
  FROM listings l JOIN ok ON l.city = ok.city AND l.property_group = ok.property_group
  JOIN segm s ON l.city = s.city AND l.property_group = s.property_group AND l.room_type = s.room_type),
cp AS (SELECT l.listing_id, l.city, c.p, 'city_fallback' AS prediction_model_scope, 'All property groups' AS prediction_model_segment,
    'City room-type median' AS prediction_model_name
  FROM listings l JOIN citym c ON l.city = c.city AND l.room_type = c.room_type),
preds AS (SELECT * FROM sp UNION ALL SELECT * FROM cp WHERE NOT EXISTS (SELECT 1 FROM sp WHERE sp.listing_id = cp.listing_id AND sp.city = cp.city)),
pr AS (SELECT listing_id, city, {pround_sql('p', 2)} AS predicted_nightly_price_eur, {band} AS predicted_price_band,
  prediction_model_scope, prediction_model_segment, prediction_model_name FROM preds),
cache AS (SELECT {ctx}, l.price_eur AS snapshot_price_eur, {', '.join(f'l.calendar_unavailable_{s}' for s in _SEASONS)},
  pr.predicted_nightly_price_eur, pr.predicted_price_band, pr.prediction_model_scope, pr.prediction_model_segment, pr.prediction_model_name
  FROM ms l JOIN pr ON l.listing_id = pr.listing_id AND l.city = pr.city)
"""


def _label_sql(x):
    return (f"CASE WHEN {x} IS NULL OR isnan({x}) THEN 'unknown' WHEN {x} <= 0.25 THEN 'strong availability signal' "
            f"WHEN {x} <= 0.50 THEN 'moderate availability signal' WHEN {x} <= 0.75 THEN 'limited availability signal' "
            f"ELSE 'very limited availability signal' END")


_MONTHLY_SQL = f""", mon AS (SELECT c.listing_id, c.city, c.predicted_nightly_price_eur, c.predicted_price_band, c.prediction_model_scope,
    c.prediction_model_segment, c.prediction_model_name, CAST(m AS DATE) AS month_start,
    CASE WHEN month(m) IN (12, 1, 2) THEN 'winter' WHEN month(m) IN (3, 4, 5) THEN 'spring' WHEN month(m) IN (6, 7, 8) THEN 'summer'
      ELSE 'autumn' END AS season,
    c.calendar_unavailable_winter AS uw, c.calendar_unavailable_spring AS usp, c.calendar_unavailable_summer AS usu,
    c.calendar_unavailable_autumn AS ua
  FROM cache c, unnest(generate_series(TIMESTAMP '2024-08-01', TIMESTAMP '2025-07-01', INTERVAL 1 MONTH)) AS t(m)),
monthly AS (SELECT * EXCLUDE (uw, usp, usu, ua), strftime(month_start, '%Y-%m') AS prediction_month,
  CASE season WHEN 'winter' THEN uw WHEN 'spring' THEN usp WHEN 'summer' THEN usu ELSE ua END AS month_unavailable_signal FROM mon)
"""


@register("fc1_scored_predictions", _cache_sql() + "SELECT * FROM pr")
def scored(spark, sf_dir):
    """FC1+PR26: segment and fallback predictions with 2-dp price, EUR-25 band and model lineage."""
    seg, city = _predictions(spark, sf_dir)
    fallback = city.join(seg.select("listing_id", "city"), ["listing_id", "city"], "left_anti")
    return seg.unionByName(fallback)


@register("fc2_listing_cache", _cache_sql() + "SELECT * FROM cache")
def listing_cache(spark, sf_dir):
    """FC2 (JN6+JN7): segment predictions + city fallbacks (anti join) inner-joined to master context."""
    return _cache(spark, sf_dir)


@register("fc3_monthly_cache", _cache_sql() + _MONTHLY_SQL + f"""SELECT *, {_label_sql('month_unavailable_signal')} AS month_availability_label
FROM monthly""")
def monthly(spark, sf_dir):
    """FC3+JN9+PR16+PR27: listing x 12 month starts after the as-of month, season signal and label."""
    return fc.monthly_cache(_cache(spark, sf_dir), AS_OF)


@register("fc4_window_summary", _cache_sql() + _MONTHLY_SQL + """, w AS (
  SELECT *, CASE month(month_start) WHEN 6 THEN 'June' ELSE 'December' END AS win FROM monthly WHERE month(month_start) IN (6, 12)
  UNION ALL SELECT *, 'Autumn' AS win FROM monthly WHERE season = 'autumn')
SELECT city, win AS "window", count(DISTINCT listing_id) AS count, avg(predicted_nightly_price_eur) AS mean_price,
  median(predicted_nightly_price_eur) AS median_price, avg(month_unavailable_signal) AS mean_unavailable,
  CASE win WHEN 'Autumn' THEN 'September, October, November' ELSE win END AS months,
  'precomputed model prediction cache' AS price_source
FROM w GROUP BY city, win""")
def window_summary(spark, sf_dir):
    """FC4: June + December + seasons (Summer/Winter dropped as their months were asked, 'fall' = Autumn)."""
    return fc.window_summary(fc.monthly_cache(written_once(_cache(spark, sf_dir)), AS_OF), months=["june", "December"],
                             seasons=["Summer", "winter", "fall"])


_STAYS = [(0, "2024-08-30", "2024-09-03"), (1, "2026-01-01", "2026-01-05")]


@register("fc5_stay_estimate", _cache_sql() + _MONTHLY_SQL + """, st AS (
  SELECT c.listing_id, s.stay_id, s.ci, s.co FROM cache c,
    (VALUES (0, DATE '2024-08-30', DATE '2024-09-03'), (1, DATE '2026-01-01', DATE '2026-01-05')) AS s(stay_id, ci, co)),
need AS (SELECT listing_id, stay_id, CAST(m AS DATE) AS month_start FROM st,
  unnest(generate_series(CAST(date_trunc('month', ci) AS TIMESTAMP), CAST(date_trunc('month', co - 1) AS TIMESTAMP), INTERVAL 1 MONTH)) AS t(m)),
nn AS (SELECT listing_id, stay_id, count(*) AS months_needed FROM need GROUP BY ALL),
hit AS (SELECT n.stay_id, m.* FROM need n JOIN monthly m ON n.listing_id = m.listing_id AND n.month_start = m.month_start),
g AS (SELECT stay_id, listing_id, count(DISTINCT month_start) AS have, median(predicted_nightly_price_eur) AS est FROM hit GROUP BY ALL),
md AS (SELECT stay_id, listing_id, prediction_model_name AS modal_model FROM (SELECT stay_id, listing_id, prediction_model_name,
  row_number() OVER (PARTITION BY stay_id, listing_id ORDER BY count(*) DESC, prediction_model_name) r FROM hit
  WHERE prediction_model_name IS NOT NULL GROUP BY stay_id, listing_id, prediction_model_name) WHERE r = 1),
bd AS (SELECT stay_id, listing_id, predicted_price_band AS modal_band FROM (SELECT stay_id, listing_id, predicted_price_band,
  row_number() OVER (PARTITION BY stay_id, listing_id ORDER BY count(*) DESC, predicted_price_band) r FROM hit
  WHERE predicted_price_band IS NOT NULL GROUP BY stay_id, listing_id, predicted_price_band) WHERE r = 1),
sg AS (SELECT stay_id, listing_id, prediction_model_segment AS modal_segment FROM (SELECT stay_id, listing_id, prediction_model_segment,
  row_number() OVER (PARTITION BY stay_id, listing_id ORDER BY count(*) DESC, prediction_model_segment) r FROM hit
  WHERE prediction_model_segment IS NOT NULL GROUP BY stay_id, listing_id, prediction_model_segment) WHERE r = 1)
SELECT CAST(nn.stay_id AS BIGINT) AS stay_id, nn.listing_id, nn.months_needed, coalesce(g.have = nn.months_needed, false) AS covered,
  CASE WHEN coalesce(g.have = nn.months_needed, false) THEN g.est END AS estimated_nightly_price_eur,
  CASE WHEN coalesce(g.have = nn.months_needed, false) THEN md.modal_model END AS modal_model,
  CASE WHEN coalesce(g.have = nn.months_needed, false) THEN bd.modal_band END AS modal_band,
  CASE WHEN coalesce(g.have = nn.months_needed, false) THEN sg.modal_segment END AS modal_segment
FROM nn LEFT JOIN g USING (stay_id, listing_id) LEFT JOIN md USING (stay_id, listing_id) LEFT JOIN bd USING (stay_id, listing_id)
LEFT JOIN sg USING (stay_id, listing_id)""")
def stay_estimate(spark, sf_dir):
    """FC5: stay estimate from the monthly cache (all months covered, else null) with modal lineage."""
    cache = _cache(spark, sf_dir)
    mon = fc.monthly_cache(cache, AS_OF)
    stays = cache.select("listing_id", F.inline(F.array(*[
        F.struct(F.lit(i).alias("stay_id"), F.lit(a).cast("date").alias("check_in"), F.lit(b).cast("date").alias("check_out"))
        for i, a, b in _STAYS])))
    est = fc.stay_estimate(mon, stays)
    return est.select("stay_id", "listing_id", "months_needed", "covered", "estimated_nightly_price_eur",
                      "modal_model", "modal_band", "modal_segment")


@register("fc6_price_source_cascade", _cache_sql() + """SELECT listing_id, city,
  coalesce(CASE WHEN availability_30 >= 20 THEN snapshot_price_eur END,
    CASE WHEN prediction_model_scope = 'property_group' THEN predicted_nightly_price_eur END, predicted_nightly_price_eur) AS nightly_price_eur,
  CASE WHEN availability_30 >= 20 AND snapshot_price_eur IS NOT NULL THEN 'verified calendar snapshot'
    WHEN prediction_model_scope = 'property_group' AND predicted_nightly_price_eur IS NOT NULL THEN 'precomputed model prediction cache'
    WHEN predicted_nightly_price_eur IS NOT NULL THEN 'live model prediction' ELSE 'unavailable' END AS price_source
FROM cache""")
def cascade(spark, sf_dir):
    """FC6: verified snapshot (>= 20 free days) -> segment cache estimate -> fallback model price."""
    c = _cache(spark, sf_dir).withColumn("_verified", F.col("availability_30") >= 20).withColumn(
        "_cached", F.when(F.col("prediction_model_scope") == "property_group", F.col("predicted_nightly_price_eur")))
    out = fc.price_source_cascade(c, "snapshot_price_eur", "_verified", "_cached", "predicted_nightly_price_eur")
    return out.select("listing_id", "city", "nightly_price_eur", "price_source")


@register("fc8_cache_manifest", _cache_sql() + """SELECT city, prediction_model_scope, prediction_model_segment, prediction_model_name,
  count(*) AS rows, median(predicted_nightly_price_eur) AS median_predicted_price_eur FROM cache GROUP BY ALL""")
def manifest(spark, sf_dir):
    """FC8: cache manifest: rows and median predicted price per city / scope / segment / model."""
    return fc.cache_manifest(_cache(spark, sf_dir))


_NUM = ["accommodates", "distance_to_center_km", "review_scores_rating"]
_CAT = ["room_type", "property_group", "neighbourhood_cleansed"]


@register("fc9_feature_defaults", with_views("listings") + " UNION ALL ".join(
    [f"SELECT city, '{c}' AS feature, CAST(median({c}) AS VARCHAR) AS \"default\" FROM listings GROUP BY city" for c in _NUM]
    + [f"""SELECT c.city, '{c}' AS feature, coalesce(m.v, 'Unknown') AS "default" FROM (SELECT DISTINCT city FROM listings) c
  LEFT JOIN (SELECT city, {c} AS v FROM listings WHERE {c} IS NOT NULL GROUP BY city, {c}
    QUALIFY row_number() OVER (PARTITION BY city ORDER BY count(*) DESC, {c}) = 1) m ON c.city = m.city""" for c in _CAT]))
def defaults(spark, sf_dir):
    """FC9: per-city feature defaults: numeric medians and categorical modes ('Unknown' if none)."""
    l = fx.listings(spark, sf_dir)
    return fc.feature_defaults(l, _NUM, _CAT)


@register("fc9_feature_options", with_views("listings") + " UNION ALL ".join(
    f"""SELECT city, '{c}' AS feature, string_agg(v, '|' ORDER BY v) AS options, count(*) AS option_count FROM (
  SELECT * FROM (SELECT DISTINCT city, CAST({c} AS VARCHAR) AS v FROM listings WHERE {c} IS NOT NULL)
  QUALIFY row_number() OVER (PARTITION BY city ORDER BY v) <= 500) GROUP BY city""" for c in _CAT))
def options(spark, sf_dir):
    """FC9: sorted category options per city (first 500 by design)."""
    return fc.feature_options(fx.listings(spark, sf_dir), _CAT)


@register("jn8_enrich_with_cache", _cache_sql() + """SELECT l.listing_id, l.city, l.price_eur, c.room_type, c.predicted_nightly_price_eur,
  c.predicted_price_band FROM listings l LEFT JOIN (SELECT listing_id, room_type, predicted_nightly_price_eur, predicted_price_band FROM cache) c
  ON l.listing_id = c.listing_id""")
def enrich(spark, sf_dir):
    """JN8: listings enriched from the cache, same-named columns replaced by the cache's."""
    cache = _cache(spark, sf_dir).select("listing_id", "room_type", "predicted_nightly_price_eur",
                                         "predicted_price_band")
    l = fx.listings(spark, sf_dir).select("listing_id", "city", "price_eur", "room_type")
    return fc.enrich(l, cache)


@register("pr38_price_scenarios", with_views("listings") + """, s AS (
  SELECT DISTINCT city, accommodates, CAST(2 AS DOUBLE) AS bathrooms, 3.0 AS distance_to_center_km, 4.5 AS min_rating,
    CAST(accommodates * 2 AS INTEGER) AS min_available_days_30 FROM listings WHERE accommodates IS NOT NULL),
d AS (SELECT city, median(review_scores_value) AS dv FROM listings GROUP BY city)
SELECT s.city, CAST(s.accommodates AS BIGINT) AS accommodates, CAST(greatest(CAST(round_even(s.accommodates / 2.0, 0) AS BIGINT), 1) AS BIGINT) AS beds,
  s.bathrooms / greatest(CAST(s.accommodates AS DOUBLE), 1.0) AS bathrooms_per_guest,
  greatest(CAST(round_even(s.accommodates / 2.0, 0) AS BIGINT), 1) / greatest(CAST(s.accommodates AS DOUBLE), 1.0) AS beds_per_guest,
  CAST(CASE WHEN s.distance_to_center_km <= 5 THEN 1 ELSE 0 END AS BIGINT) AS is_central_5km, s.min_rating AS review_scores_rating,
  coalesce(d.dv, s.min_rating) AS review_scores_value, CAST(s.min_available_days_30 AS BIGINT) AS availability_30,
  CAST(least(60, s.min_available_days_30 * 2) AS BIGINT) AS availability_60, CAST(least(90, s.min_available_days_30 * 3) AS BIGINT) AS availability_90,
  CAST(least(365, greatest(least(90, s.min_available_days_30 * 3) * 4, s.min_available_days_30)) AS BIGINT) AS availability_365,
  s.min_available_days_30 / 30.0 AS availability_30_ratio,
  least(365, greatest(least(90, s.min_available_days_30 * 3) * 4, s.min_available_days_30)) / 365.0 AS availability_365_ratio
FROM s LEFT JOIN d ON s.city = d.city""")
def scenarios(spark, sf_dir):
    """PR38: host-side scenario features for every (city, guests) combination in the data."""
    l = fx.listings(spark, sf_dir)
    d = grouped(l, ["city"], median_of("review_scores_value").alias("default_review_scores_value"))
    s = (l.filter(F.col("accommodates").isNotNull()).select("city", "accommodates").distinct()
         .withColumn("bathrooms", F.lit(2.0)).withColumn("distance_to_center_km", F.lit(3.0))
         .withColumn("min_rating", F.lit(4.5)).withColumn("min_available_days_30", F.col("accommodates") * 2)
         .withColumn("default_availability_30", F.lit(None).cast("int")).join(d, "city", "left"))
    out = fc.scenario_overrides(s)
    return out.select("city", "accommodates", "beds", "bathrooms_per_guest", "beds_per_guest", "is_central_5km",
                      "review_scores_rating", "review_scores_value", "availability_30", "availability_60",
                      "availability_90", "availability_365", "availability_30_ratio", "availability_365_ratio")


@register("fi7_price_scenario_candidates", with_views("listings") + """
SELECT listing_id, city, property_group, price_eur FROM listings WHERE price_eur <= 400 AND accommodates >= 4
  AND property_group = 'BUILDING' AND (review_scores_rating >= 4.5 OR review_scores_rating IS NULL)""")
def scenario_candidates(spark, sf_dir):
    """FI7: comparable listings for a price scenario: FI3 filters + property group."""
    from ..operators.filters import filter_listings
    l = fx.listings(spark, sf_dir)
    c = filter_listings(l, budget_max=400, guests=4, min_rating=4.5).filter(F.col("property_group") == "BUILDING")
    return c.select("listing_id", "city", "property_group", "price_eur")


@register("fc7_scenario_scoring")
def scenario_scoring(spark, sf_dir):
    """FC7: scenario rows completed with per-city defaults (coalesce) and scored by a pipeline model."""
    from ..operators import ml
    l = spread(fx.listings(spark, sf_dir).filter(F.col("price_eur") > 0))
    model = ml.fit_price_model(l, "gbt", maxIter=10, maxDepth=4)
    num = [c for c in ml.NUMERIC_FEATURES if c in l.columns]
    defaults = grouped(l, ["city"], *[median_of(c).alias(c) for c in num],
                                     *[F.mode(c).alias(c) for c in ml.CATEGORICAL_FEATURES])
    rows = l.select("city").distinct().select("city", F.lit(4).alias("accommodates"),
                                              F.lit("Entire home/apt").alias("room_type"))
    full = fc.apply_defaults(rows, defaults, num + ml.CATEGORICAL_FEATURES)
    return ml.predict_prices(model, full).select("city", "accommodates", "room_type", "predicted_price_eur")
