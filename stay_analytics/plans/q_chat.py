"""Registered chat-log queries (CH1-CH11, WN7, WN8) over the ``prompts`` fixture."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import chatlog as ch
from ..sources import fixtures as fx
from ..sources.tables import read_table
from .registry import register
from .sqlkit import with_views


def _cities(spark, sf_dir):
    """City names = region names (a bounded dimension: the region table)."""
    return sorted(r[0] for r in read_table(spark, sf_dir, "region").select("r_name").distinct().collect())


def _slots(spark, sf_dir):
    return ch.turn_slots(fx.prompts(spark, sf_dir), _cities(spark, sf_dir))


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _any(text: str, terms) -> str:
    return "(" + " OR ".join(f"contains({text}, {_q(x)})" for x in terms) + ")"


def _pos(t: str, term: str) -> str:
    pat = r"\b" + term + r"\b"
    return (f"(CASE WHEN regexp_matches({t}, {_q(pat)}) THEN length(regexp_extract({t}, {_q('(?s)^(.*?)' + pat)}, 1)) + 1 "
            f"ELSE 0 END)")


def _ordered(t: str, hits) -> str:
    vals = ", ".join(f"({_pos(t, term)}, {_q(label)})" for term, label in hits)
    return (f"coalesce((SELECT string_agg(l, ',' ORDER BY p) FROM (SELECT l, min(p) AS p FROM (VALUES {vals}) v(p, l) "
            f"WHERE p > 0 GROUP BY l)), '')")


def _slots_sql() -> str:
    t = "t"
    months = "concat_ws(',', " + ", ".join(f"CASE WHEN regexp_matches({t}, {_q(chr(92) + 'b' + m + chr(92) + 'b')}) "
                                            f"THEN {_q(m.title())} END" for m in ch.MONTH_NAMES) + ")"
    n_months = " + ".join(f"(CASE WHEN regexp_matches({t}, {_q(chr(92) + 'b' + m + chr(92) + 'b')}) THEN 1 ELSE 0 END)"
                          for m in ch.MONTH_NAMES)
    month_hits = [(m, ch.MONTH_TO_SEASON[m]) for m in ch.MONTH_NAMES]
    amen = "concat_ws(',', " + ", ".join(f"CASE WHEN {_any('padded', terms)} THEN {_q(label)} END"
                                         for label, terms in ch.AMENITY_TERMS) + ")"
    money = (f"TRY_CAST(replace(coalesce(nullif(regexp_extract(text, {_q(ch.MONEY_PATTERN)}, 1), ''), "
             f"nullif(regexp_extract(text, {_q(ch.MONEY_PATTERN)}, 2), '')), ',', '') AS DOUBLE)")
    nights = f"TRY_CAST(nullif(regexp_extract(text, {_q(ch.NIGHTS_PATTERN)}, 1), '') AS INTEGER)"
    guests = f"TRY_CAST(nullif(regexp_extract({t}, {_q(ch.GUESTS_PATTERN)}, 1), '') AS INTEGER)"
    explicit = _ordered(t, ch.SEASON_TERMS)
    is_rec = _any(t, ch.RECOMMEND_TRIGGERS)
    seasonal = f"({is_rec} AND ({explicit} <> '' OR (({n_months}) >= 2 AND {_any(t, ch.COMPARISON_TERMS)})))"
    timing = f"({_any(t, ch.TIMING_TERMS)} AND {_any(t, ch.BUDGET_TERMS + ch.PROJECTION_TERMS)})"
    return with_views("prompts")[:-1] + f""", p AS (SELECT conv_id, turn, text, lower(text) AS t, ' ' || lower(text) || ' ' AS padded
  FROM prompts),
cn AS (SELECT p.conv_id, p.turn, count(r.r_name) AS cities_named, min(r.r_name) AS one_city
  FROM p LEFT JOIN (SELECT DISTINCT r_name FROM region) r ON contains(p.t, lower(r.r_name)) GROUP BY p.conv_id, p.turn),
slots AS (SELECT p.conv_id, p.turn, {months} AS months, {_ordered(t, ch.SEASON_TERMS + month_hits)} AS seasons,
  {explicit} AS explicit_seasons, {money} AS money_amount,
  CASE WHEN {nights} IS NOT NULL THEN greatest({nights}, 1) END AS nights_explicit,
  CASE WHEN {_any(t, ch.COUPLE_TERMS)} THEN 2 WHEN {guests} IS NOT NULL THEN greatest({guests}, 1) END AS guests_explicit,
  CASE WHEN contains({t}, 'private room') THEN 'Private room' WHEN {_any(t, ch.ENTIRE_TERMS)} THEN 'Entire home/apt'
    WHEN contains({t}, 'flat') OR contains({t}, 'apartment') THEN 'Entire home/apt'
    WHEN contains({t}, 'shared room') THEN 'Shared room' END AS room_type,
  CASE WHEN {_any(t, ch.RATING_47)} THEN 4.7 WHEN {_any(t, ch.RATING_45)} THEN 4.5 ELSE 4.0 END::DOUBLE AS min_rating,
  CASE WHEN {_any(t, ch.DIST_5)} THEN 5.0 WHEN {_any(t, ch.DIST_7)} THEN 7.0 ELSE 15.0 END::DOUBLE AS max_distance_km,
  {amen} AS amenities, CASE WHEN cn.cities_named = 1 THEN cn.one_city END AS city_named, cn.cities_named,
  CASE WHEN {_any(t, ch.PRICE_TERMS)} AND {_any(t, ch.FACTOR_TERMS)} THEN 'price_factors'
    WHEN {_any(t, ch.MODEL_TERMS)} THEN 'model_info' WHEN {seasonal} THEN 'seasonal_recommendation'
    WHEN {timing} THEN 'timing' WHEN {is_rec} THEN 'recommendation' ELSE 'general_question' END AS intent_base,
  {_any(t, ch.FOLLOW_UP_TERMS)} AS follow_up, {_any(t, ch.CHEAPEST_TERMS)} AS wants_cheapest
FROM p JOIN cn ON p.conv_id = cn.conv_id AND p.turn = cn.turn)
"""


_SLOT_COLS = ["conv_id", "turn", "months", "seasons", "explicit_seasons", "money_amount", "nights_explicit",
              "guests_explicit", "room_type", "min_rating", "max_distance_km", "amenities", "city_named",
              "cities_named", "intent_base", "follow_up", "wants_cheapest"]


def _flat(df):
    return df.select(*[F.array_join(c, ",").alias(c) if c in ("months", "seasons", "explicit_seasons", "amenities")
                       else F.col(c) for c in _SLOT_COLS])


@register("ch_slots_per_turn", _slots_sql() + "SELECT * FROM slots")
def slots(spark, sf_dir):
    """CH1-CH10: months, seasons by position, money, nights, guests, room, rating, distance,
    amenities, named city and base intent for every user turn."""
    return _flat(_slots(spark, sf_dir))


_WIN = "OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"


@register("wn7_conversation_context", _slots_sql() + f""", c1 AS (SELECT *,
  last_value(city_named IGNORE NULLS) {_WIN} AS context_city,
  coalesce(last_value(nights_explicit IGNORE NULLS) {_WIN}, 3) AS context_nights,
  coalesce(last_value(guests_explicit IGNORE NULLS) {_WIN}, 2) AS context_guests,
  last_value(money_amount IGNORE NULLS) {_WIN} AS context_total_budget,
  last_value(room_type IGNORE NULLS) {_WIN} AS context_room_type,
  last_value(nullif(months, '') IGNORE NULLS) {_WIN} AS context_months,
  array_to_string(list_sort(list_distinct(flatten(list(CASE WHEN amenities = '' THEN [] ELSE string_split(amenities, ',') END) {_WIN}))), ',')
    AS context_amenities,
  (intent_base = 'general_question' AND follow_up) AS carried,
  sum(CASE WHEN intent_base = 'general_question' AND follow_up THEN 0 ELSE 1 END) {_WIN} AS anchor FROM slots),
c2 AS (SELECT *, first_value(intent_base) OVER (PARTITION BY conv_id, anchor ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS ai FROM c1),
c3 AS (SELECT *, CASE WHEN NOT carried THEN intent_base WHEN ai IN ('recommendation', 'seasonal_recommendation') THEN ai
  ELSE 'general_question' END AS intent,
  coalesce(CASE WHEN coalesce(money_amount, context_total_budget) IS NOT NULL AND coalesce(money_amount, context_total_budget) <> 0
    THEN coalesce(money_amount, context_total_budget) / coalesce(nights_explicit, context_nights) END, 150.0) AS per_night_budget_eur FROM c2)
SELECT conv_id, turn, context_city, CAST(context_nights AS BIGINT) AS context_nights, CAST(context_guests AS BIGINT) AS context_guests,
  context_total_budget, context_room_type, context_months, context_amenities, intent, per_night_budget_eur,
  CASE WHEN per_night_budget_eur IS NULL THEN 'practical' WHEN per_night_budget_eur >= 180 THEN 'generous'
    WHEN per_night_budget_eur >= 120 THEN 'comfortable' WHEN per_night_budget_eur >= 80 THEN 'value' ELSE 'smart_value' END AS budget_tier
FROM c3""")
def context(spark, sf_dir):
    """WN7+WN8+CH10+CH11: carried slots per conversation turn, effective intent, nightly budget, tier."""
    c = ch.conversation_context(_slots(spark, sf_dir))
    return c.select("conv_id", "turn", "context_city", "context_nights", "context_guests", "context_total_budget",
                    "context_room_type", F.array_join("context_months", ",").alias("context_months"),
                    F.array_join("context_amenities", ",").alias("context_amenities"), "intent",
                    "per_night_budget_eur", "budget_tier")
