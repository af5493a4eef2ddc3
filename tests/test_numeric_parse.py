import numpy as np
from pyspark.sql import functions as F

from stay_analytics.functions import parse as P
from stay_analytics.functions.numeric import clip_upper, pround, safe_ratio


def test_pround_matches_numpy(spark):
    vals = [1.005, 0.285, 2.5, -2.5, 0.125, 3.14159, -0.0049, 1234.5678, 2.675]
    df = spark.createDataFrame([(v,) for v in vals], "v double")
    for d in (0, 1, 2, 3):
        got = [r[0] for r in df.select(pround("v", d)).collect()]
        assert got == [float(np.round(v, d)) for v in vals]


def test_safe_ratio_and_clip(spark):
    df = spark.createDataFrame([(1.0, 0.0), (3.0, 2.0), (None, 2.0)], "n double, d double")
    assert [r[0] for r in df.select(safe_ratio("n", "d")).collect()] == [None, 1.5, None]
    df2 = spark.createDataFrame([(None,), (45,), (10,)], "m int")
    assert [r[0] for r in df2.select(clip_upper("m", 30)).collect()] == [None, 30, 10]


def test_listing_parsers(spark):
    rows = [("$1,234.00", "EUR", "95%", "t", "1.5 shared baths", '["Wifi", " Dishwasher ", "Smart lock"]', "Entire guesthouse"),
            ("N/A", "JPY", None, "f", "Half-bath", "TV, 'Kitchen'", "Room in hotel"),
            ("$100.00", "JPY", "40%", None, None, None, "Boat")]
    df = spark.createDataFrame(rows, "price string, cur string, rate string, sh string, bath string, am string, pt string")
    out = df.select(P.parse_price("price", "cur").alias("p"), P.parse_rate("rate").alias("r"),
                    P.parse_boolean("sh").alias("b"), P.parse_bathrooms("bath").alias("bn"),
                    P.bathroom_type("bath").alias("bt"), F.size(P.parse_amenities("am")).alias("na"),
                    *P.amenity_flags(P.parse_amenities("am")), P.classify_property_type("pt").alias("pg")).collect()
    assert out[0]["p"] == 1234.0 and out[1]["p"] is None and abs(out[2]["p"] - 0.62) < 1e-12
    assert out[0]["r"] == 0.95 and out[1]["r"] is None
    assert [r["b"] for r in out] == [1.0, 0.0, None]
    assert [r["bn"] for r in out] == [1.5, 0.5, None]
    assert [r["bt"] for r in out] == ["Shared", "Half", "Unknown"]
    assert [r["na"] for r in out] == [3, 2, 0]
    # substring semantics: "dishwasher" sets has_washer (quirk Q2); smart lock -> self check-in
    assert out[0]["has_washer"] == 1 and out[0]["has_self_checkin"] == 1 and out[1]["has_tv"] == 1
    # ordered rules: guesthouse is a house (Q3)
    assert [r["pg"] for r in out] == ["House/villa", "Hotel/serviced", "Other"]


def test_slugify(spark):
    df = spark.createDataFrame([("Entire home/apt",), ("  ",), ("__Hotel--Room__",)], "s string")
    assert [r[0] for r in df.select(P.slugify("s")).collect()] == ["entire_home_apt", "unknown", "hotel_room"]


def test_payload_rates(spark):
    payload = '{"future_rates": [{"day": "2025-01-02", "price": "120.5", "is_available": "Yes"}, ' \
              '{"date": "2025-01-03", "nightly_rate": 99, "available": false, "minimum_nights": 2}]}'
    df = spark.createDataFrame([(payload,)], "p string")
    r = df.select(F.inline(P.payload_rates("p"))).collect()
    assert str(r[0]["date"]) == "2025-01-02" and r[0]["nightly_rate"] == 120.5 and r[0]["available"] is True
    assert r[1]["nightly_rate"] == 99.0 and r[1]["available"] is False and r[1]["minimum_nights"] == 2


def test_erfc_equals_the_library(spark):
    import math

    from stay_analytics.functions.numeric import erfc

    xs = [k / 16 for k in range(-96, 400)] + [2.5, -2.5, 0.0]
    rows = spark.createDataFrame([(x,) for x in xs] + [(None,)], "x double").select("x", erfc("x").alias("y")).collect()
    for r in rows:
        assert r.y is None if r.x is None else math.isclose(r.y, math.erfc(r.x), rel_tol=1e-11)
