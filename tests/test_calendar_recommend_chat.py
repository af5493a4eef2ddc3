import datetime as dt

from pyspark.sql import functions as F

from small_data import SF_SMALL
from stay_analytics.operators import calendar as cl
from stay_analytics.operators import chatlog as ch
from stay_analytics.operators import recommend as rc
from stay_analytics.operators.filters import filter_listings
from stay_analytics.sources import fixtures as fx
from stay_analytics.streaming.calendar_stream import streaming_calendar_rollup


def test_rollup_invariants_and_stream_equals_batch(spark):
    batch = cl.calendar_rollup(fx.calendar(spark, SF_SMALL))
    bad = batch.filter((F.col("calendar_available_days") + F.col("calendar_unavailable_days") != F.col("calendar_days"))
                       | ~F.col("calendar_unavailable_rate").between(0, 1)).count()
    assert bad == 0
    stream = streaming_calendar_rollup(spark, SF_SMALL)
    cols = batch.columns
    assert stream.select(*cols).exceptAll(batch.select(*cols)).count() == 0
    assert batch.count() == stream.count()


def test_stay_verdicts(spark):
    cal = spark.createDataFrame(
        [(1, dt.date(2024, 1, d), "t", 2, 5) for d in (1, 2, 3)] + [(1, dt.date(2024, 1, 2), "t", 3, 4)],
        "listing_id long, date date, available string, minimum_nights int, maximum_nights int")
    stays = spark.createDataFrame([(0, 1, dt.date(2024, 1, 1), dt.date(2024, 1, 4)),
                                   (1, 1, dt.date(2024, 1, 1), dt.date(2024, 1, 2)),
                                   (2, 9, dt.date(2024, 1, 1), dt.date(2024, 1, 3))],
                                  "stay_id int, listing_id long, check_in date, check_out date")
    r = {x["stay_id"]: x for x in cl.stay_availability(cal, stays).collect()}
    assert r[0]["available_nights"] == 3 and r[0]["minimum_nights_required"] == 3 and r[0]["is_available"]
    assert not r[1]["is_available"] and r[1]["calendar_status"] == "Minimum stay is 2 nights"
    assert r[2]["available_nights"] == 0 and r[2]["calendar_status"] == "Only 0 of 2 nights available"


def test_min_rating_keeps_unrated(spark):
    df = spark.createDataFrame([(1, 4.9), (2, None), (3, 3.0)], "listing_id long, review_scores_rating double")
    assert sorted(r[0] for r in filter_listings(df, min_rating=4.5).collect()) == [1, 2]


def test_batch_request_equals_single(spark):
    l = fx.listings(spark, SF_SMALL)
    single = rc.get_recommendations(l.filter(F.col("city") == "EUROPE"), limit=5, by=["city"], budget_max=300)
    req = spark.createDataFrame([("r1", "EUROPE", 300.0)], "request_id string, city string, budget_max double")
    for c, t in [("min_price_eur", "double"), ("guests", "int"), ("room_type", "string"), ("neighbourhood", "string"),
                 ("min_rating", "double"), ("max_distance_km", "double"), ("min_available_days_30", "int"),
                 ("min_reviews", "int"), ("min_amenities_count", "int"), ("min_luxury_amenities", "int")]:
        req = req.withColumn(c, F.lit(None).cast(t))
    req = req.withColumn("amenities", F.array().cast("array<string>")).withColumn("limit", F.lit(5))
    batch = rc.recommend_batch(l, req)
    a = [(r["listing_id"], r["value_score"], r["rank"]) for r in single.orderBy("rank").collect()]
    b = [(r["listing_id"], r["value_score"], r["rank"]) for r in batch.orderBy("rank").collect()]
    assert a == b and len(a) == 5


def test_chat_slots(spark):
    prompts = spark.createDataFrame([
        (1, 1, "3 nights in Madrid under EUR 450 in June or winter, best value"),
        (1, 2, "show me more"),
        (2, 1, "for 4 guests, private room, wifi and a desk near the centre"),
        (2, 2, "what affects the price for a couple?")], "conv_id long, turn long, text string")
    s = {(r["conv_id"], r["turn"]): r for r in ch.turn_slots(prompts, ["Madrid", "Tokyo"]).collect()}
    a = s[(1, 1)]
    assert a["nights_explicit"] == 3 and a["money_amount"] == 450.0 and a["city_named"] == "Madrid"
    assert a["months"] == ["June"] and a["seasons"] == ["Summer", "Winter"]
    assert a["intent_base"] == "seasonal_recommendation"
    b = s[(2, 1)]
    assert b["guests_explicit"] == 4 and b["room_type"] == "Private room"
    assert b["amenities"] == ["WiFi", "Dedicated workspace"] and b["max_distance_km"] == 7.0
    assert s[(2, 2)]["intent_base"] == "price_factors" and s[(2, 2)]["guests_explicit"] == 2
    ctx = {(r["conv_id"], r["turn"]): r for r in ch.conversation_context(ch.turn_slots(prompts, ["Madrid"])).collect()}
    assert ctx[(1, 2)]["intent"] == "seasonal_recommendation" and ctx[(1, 2)]["context_city"] == "Madrid"
    assert ctx[(1, 2)]["context_nights"] == 3 and ctx[(1, 2)]["per_night_budget_eur"] == 150.0


def test_batch_predicate_luxury_minimum(spark):
    from stay_analytics.operators.filters import request_predicate
    l = spark.createDataFrame([(1, "X", 1, 1), (2, "X", 0, 1), (3, "X", None, None)],
                              "listing_id long, city string, has_air_conditioning int, has_tv int")
    r = spark.createDataFrame([("q", "X", 2)], "request_id string, city string, min_luxury_amenities int")
    for c, t in [("budget_max", "double"), ("min_price_eur", "double"), ("guests", "int"), ("room_type", "string"),
                 ("neighbourhood", "string"), ("min_rating", "double"), ("max_distance_km", "double"),
                 ("min_available_days_30", "int"), ("min_reviews", "int"), ("min_amenities_count", "int")]:
        r = r.withColumn(c, F.lit(None).cast(t))
    r = r.withColumn("amenities", F.array().cast("array<string>"))
    cond = (F.col("l.city") == F.col("r.city")) & request_predicate(l.columns, "r", "l")
    got = [x["listing_id"] for x in l.alias("l").join(r.alias("r"), cond).select("l.listing_id").collect()]
    assert got == [1]
