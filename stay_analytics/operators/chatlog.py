"""Chat-log slot extraction re-aimed as a Spark job (CH1-CH11, WN7, WN8).

One row per user turn becomes typed slots with Column expressions only
(regex, ``exists``/``filter`` over fixed term arrays). Conversation context
(last non-null slot, accumulated amenities, intent carry-over) uses windows
partitioned by conversation, ordered by turn.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Slot vocabularies used by the rules below.
MONTH_NAMES = ["january", "february", "march", "april", "may", "june", "july", "august", "september", "october",
               "november", "december"]
MONTH_TO_SEASON = {"january": "Winter", "february": "Winter", "march": "Spring", "april": "Spring", "may": "Spring",
                   "june": "Summer", "july": "Summer", "august": "Summer", "september": "Autumn",
                   "october": "Autumn", "november": "Autumn", "december": "Winter"}
SEASON_TERMS = [("winter", "Winter"), ("spring", "Spring"), ("summer", "Summer"), ("autumn", "Autumn"),
                ("fall", "Autumn")]
MONEY_PATTERN = r"(?i)(?:eur|euro|euros|€)\s*([0-9][0-9,.]*)|([0-9][0-9,.]*)\s*(?:eur|euro|euros|€)"
NIGHTS_PATTERN = r"(?i)\b(\d{1,2})\s*(?:night|nights)\b"
GUESTS_PATTERN = r"\b(\d{1,2})\s*(?:guest|guests|people|person|traveller|travellers|travelers)\b"
COUPLE_TERMS = ["girlfriend", "boyfriend", "partner", "couple", "two people", "two guests"]
ENTIRE_TERMS = ["entire flat", "entire apartment", "entire apt", "entire home", "whole place"]
RATING_47 = ["excellent reviews", "best reviews", "great reviews", "high rating", "top rated"]
RATING_45 = ["good reviews", "good rating", "well reviewed", "well-reviewed"]
DIST_5 = ["as close to the center", "as close to the centre", "closest to the center", "closest to the centre"]
DIST_7 = ["city center", "city centre", "central", "near the center", "near the centre"]
AMENITY_TERMS = [
    ("WiFi", ["wifi", "wi-fi", "wireless internet"]),
    ("Air conditioning", ["air conditioning", "aircon", "air con", " a/c", " ac "]),
    ("Kitchen", ["kitchen"]),
    ("Washer", ["washer", "washing machine"]),
    ("Parking", ["parking"]),
    ("Elevator", ["elevator", "lift"]),
    ("Dedicated workspace", ["workspace", "desk"]),
    ("Self check-in", ["self check", "self-check"]),
]
RECOMMEND_TRIGGERS = ["recommend", "best", "holiday", "stay", "property", "listing", "option", "where should",
                      "good value", "best value"]
TIMING_TERMS = [*MONTH_NAMES, "winter", "spring", "summer", "autumn", "fall", "june", "july", "august", "september",
                "month", "season", "time of year", "another time", "when should", "when would", "dates", "date"]
BUDGET_TERMS = ["cheap", "cheaper", "budget", "price", "cost", "best"]
PROJECTION_TERMS = ["projection", "projections", "forecast", "forecasting", "future", "availability", "calendar",
                    "compare"]
COMPARISON_TERMS = ["compare", "compared", "versus", "vs", "between", "rather than"]
PRICE_TERMS = ["price", "prices", "cost", "nightly rate", "expensive", "cheap"]
FACTOR_TERMS = ["factor", "factors", "impact", "affect", "influence", "drive", "drives", "important", "importance"]
MODEL_TERMS = ["model", "prediction", "xgboost", "lightgbm", "random forest", "rmse", "mae", "r2"]
FOLLOW_UP_TERMS = ["show me", "give me", "what about", "another", "more options", "recommendations", "properties",
                   "listings"]
CHEAPEST_TERMS = ["cheapest", "lowest price", "lowest cost", "as cheap as possible", "absolute cheapest"]


def any_contains(text: Column, terms: Sequence[str]) -> Column:
    cond = F.lit(False)
    for t in terms:
        cond = cond | text.contains(t)
    return cond


def _word(term: str) -> str:
    return r"\b" + term + r"\b"


def first_position(text: Column, term: str) -> Column:
    """1-based start of the first whole-word match (0 when absent)."""
    return F.regexp_instr(text, F.lit(_word(term)))


def turn_slots(prompts: DataFrame, cities: Sequence[str], text: str = "text", min_rating: float = 4.0,
               max_distance: float = 15.0) -> DataFrame:
    """CH1-CH9 + CH10 base intent + cheapest wish, one row per turn (typed slot columns)."""
    raw = F.col(text)
    t = F.lower(raw)
    months = F.filter(F.array(*[F.when(t.rlike(_word(m)), F.lit(m.title())) for m in MONTH_NAMES]),
                      lambda m: m.isNotNull())
    month_labels = months
    season_hits = [F.struct(first_position(t, term).alias("p"), F.lit(label).alias("l")) for term, label in SEASON_TERMS]
    month_hits = [F.struct(first_position(t, m).alias("p"), F.lit(MONTH_TO_SEASON[m]).alias("l")) for m in MONTH_NAMES]

    def ordered(hits):
        found = F.filter(F.array(*hits), lambda h: h["p"] > 0)
        return F.array_distinct(F.transform(F.array_sort(found), lambda h: h["l"]))

    g1 = F.nullif(F.regexp_extract(raw, MONEY_PATTERN, 1), F.lit(""))
    g2 = F.nullif(F.regexp_extract(raw, MONEY_PATTERN, 2), F.lit(""))
    money = F.regexp_replace(F.coalesce(g1, g2), ",", "").try_cast("double")
    nights = F.nullif(F.regexp_extract(raw, NIGHTS_PATTERN, 1), F.lit("")).cast("int")
    guests_num = F.nullif(F.regexp_extract(t, GUESTS_PATTERN, 1), F.lit("")).cast("int")
    guests = F.when(any_contains(t, COUPLE_TERMS), F.lit(2)).when(guests_num.isNotNull(),
                                                                   F.greatest(guests_num, F.lit(1)))
    room = (F.when(t.contains("private room"), "Private room")
            .when(any_contains(t, ENTIRE_TERMS), "Entire home/apt")
            .when(t.contains("flat") | t.contains("apartment"), "Entire home/apt")
            .when(t.contains("shared room"), "Shared room"))
    rating = (F.when(any_contains(t, RATING_47), F.greatest(F.lit(min_rating), F.lit(4.7)))
              .when(any_contains(t, RATING_45), F.greatest(F.lit(min_rating), F.lit(4.5))).otherwise(F.lit(min_rating)))
    dist = (F.when(any_contains(t, DIST_5), F.least(F.lit(max_distance), F.lit(5.0)))
            .when(any_contains(t, DIST_7), F.least(F.lit(max_distance), F.lit(7.0))).otherwise(F.lit(max_distance)))
    padded = F.concat(F.lit(" "), t, F.lit(" "))
    amen = F.filter(F.array(*[F.when(any_contains(padded, terms), F.lit(label)) for label, terms in AMENITY_TERMS]),
                    lambda x: x.isNotNull())
    named = F.filter(F.array(*[F.when(t.contains(c.lower()), F.lit(c)) for c in cities]), lambda x: x.isNotNull())
    city = F.when(F.size(named) == 1, named[0])
    explicit_seasons = ordered(season_hits)
    is_rec = any_contains(t, RECOMMEND_TRIGGERS)
    seasonal = is_rec & ((F.size(explicit_seasons) >= 1)
                         | ((F.size(months) >= 2) & any_contains(t, COMPARISON_TERMS)))
    timing = any_contains(t, TIMING_TERMS) & any_contains(t, BUDGET_TERMS + PROJECTION_TERMS)
    intent = (F.when(any_contains(t, PRICE_TERMS) & any_contains(t, FACTOR_TERMS), "price_factors")
              .when(any_contains(t, MODEL_TERMS), "model_info")
              .when(seasonal, "seasonal_recommendation")
              .when(timing, "timing")
              .when(is_rec, "recommendation")
              .otherwise("general_question"))
    return prompts.select(
        "conv_id", "turn", text,
        month_labels.alias("months"), ordered(season_hits + month_hits).alias("seasons"),
        explicit_seasons.alias("explicit_seasons"), money.alias("money_amount"),
        F.when(nights.isNotNull(), F.greatest(nights, F.lit(1))).alias("nights_explicit"), guests.alias("guests_explicit"),
        room.alias("room_type"), rating.alias("min_rating"), dist.alias("max_distance_km"),
        amen.alias("amenities"), city.alias("city_named"), F.size(named).alias("cities_named"),
        intent.alias("intent_base"), any_contains(t, FOLLOW_UP_TERMS).alias("follow_up"),
        any_contains(t, CHEAPEST_TERMS).alias("wants_cheapest"))


def conversation_context(slots: DataFrame, default_nights: int = 3, default_guests: int = 2,
                         default_budget: float = 150.0) -> DataFrame:
    """WN7 + WN8 + CH10 carry-over + CH11: slots carried along each conversation.

    Last non-null value up to each turn (city, nights, guests, budget, room,
    months), amenities accumulated as a sorted set, the effective intent (a
    general follow-up inherits a previous recommendation intent), nightly
    budget and budget tier.
    """
    upto = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, 0)
    last = lambda c: F.last(F.col(c), ignorenulls=True).over(upto)
    months_or_null = F.when(F.size("months") > 0, F.col("months"))
    x = slots.withColumn("_months", months_or_null)
    x = (x.withColumn("context_city", last("city_named"))
         .withColumn("context_nights", F.coalesce(last("nights_explicit"), F.lit(default_nights)))
         .withColumn("context_guests", F.coalesce(last("guests_explicit"), F.lit(default_guests)))
         .withColumn("context_total_budget", last("money_amount"))
         .withColumn("context_room_type", last("room_type"))
         .withColumn("context_months", last("_months"))
         .withColumn("context_amenities", F.array_sort(F.array_distinct(F.flatten(
             F.collect_list("amenities").over(upto))))))
    # effective intent: a run of general follow-ups inherits the anchor turn's intent
    carried = (F.col("intent_base") == "general_question") & F.col("follow_up")
    x = x.withColumn("_anchor", F.sum(F.when(carried, 0).otherwise(1)).over(upto))
    grp = Window.partitionBy("conv_id", "_anchor").orderBy("turn").rowsBetween(Window.unboundedPreceding, 0)
    anchor_intent = F.first("intent_base").over(grp)
    eff = F.when(~carried, F.col("intent_base")).when(
        anchor_intent.isin("recommendation", "seasonal_recommendation"), anchor_intent).otherwise("general_question")
    x = x.withColumn("intent", eff)
    total = F.coalesce(F.col("money_amount"), F.col("context_total_budget"))
    n = F.coalesce(F.col("nights_explicit"), F.col("context_nights"))
    per_night = F.when(total.isNotNull() & (total != 0) & n.isNotNull(), total / n)
    x = x.withColumn("per_night_budget_eur", F.coalesce(per_night, F.lit(default_budget)))
    pn = F.col("per_night_budget_eur")
    tier = (F.when(pn.isNull(), "practical").when(pn >= 180, "generous")
            .when(pn >= 120, "comfortable").when(pn >= 80, "value").otherwise("smart_value"))
    return x.withColumn("budget_tier", tier).drop("_months", "_anchor")
