"""Registered cleaning / master-build queries (PR1-PR12, PR32, FI1-FI2, JN1-JN5, AG9, IO7)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import calendar as cl
from ..operators import clean as cn
from ..operators.filters import iqr_filter, with_group_count
from ..operators.ranking import grouped, median_of
from ..sources import fixtures as fx
from ..sources.tables import read_table
from .registry import register
from .sqlkit import pround_sql, with_views

_FLAG_SQL = {
    "has_wifi": ["wifi"], "has_kitchen": ["kitchen"],
    "has_air_conditioning": ["air conditioning", "ac - split type ductless system"], "has_washer": ["washer"],
    "has_dedicated_workspace": ["dedicated workspace"], "has_tv": ["tv", "hdtv"],
    "has_parking": ["free parking", "paid parking", "parking"], "has_elevator": ["elevator"],
    "has_heating": ["heating"], "has_self_checkin": ["self check-in", "lockbox", "keypad", "smart lock"],
}


def _raw_clean_sql() -> str:
    flags = ",\n  ".join(
        f"CAST(CASE WHEN len(list_filter(am, lambda x: {' OR '.join(f'contains(x, {w!r})' for w in ws)})) > 0 "
        f"THEN 1 ELSE 0 END AS BIGINT) AS {name}" for name, ws in _FLAG_SQL.items())
    b = "lower(bathrooms_text)"
    p = "lower(coalesce(property_type, 'nan'))"
    return with_views("raw_listings")[:-1] + f""", parsed AS (
  SELECT *, TRY_CAST(trim(replace(replace(price, ',', ''), '$', '')) AS DOUBLE) AS pv,
    CASE WHEN amenities IS NULL THEN CAST([] AS VARCHAR[])
      ELSE list_filter(list_transform(string_split(trim(amenities, '[]'), ','),
        lambda x: lower(trim(trim(trim(x), '"'), ''''))), lambda x: x <> '') END AS am
  FROM raw_listings)
SELECT id AS listing_id, neighbourhood_cleansed, currency, property_type,
  CASE WHEN currency = 'JPY' THEN pv * 0.0062 ELSE pv END AS price_eur,
  TRY_CAST(trim(replace(host_response_rate, '%', '')) AS DOUBLE) / 100 AS host_response_rate,
  CASE WHEN host_is_superhost IN ('t', 'true') THEN 1.0 WHEN host_is_superhost IN ('f', 'false') THEN 0.0 END AS host_is_superhost,
  CASE WHEN contains({b}, 'half') AND NOT regexp_matches({b}, '\\d') THEN 0.5
       ELSE TRY_CAST(nullif(regexp_extract({b}, '(\\d+\\.?\\d*)', 1), '') AS DOUBLE) END AS bathrooms,
  CASE WHEN {b} IS NULL OR {b} IN ('nan', '') THEN 'Unknown' WHEN contains({b}, 'shared') THEN 'Shared'
       WHEN contains({b}, 'private') THEN 'Private' WHEN contains({b}, 'half') THEN 'Half' ELSE 'Standard' END AS bathroom_type,
  CAST(len(am) AS BIGINT) AS amenities_count,
  {flags},
  CASE WHEN contains({p}, 'hotel') OR contains({p}, 'serviced') OR contains({p}, 'aparthotel') THEN 'Hotel/serviced'
       WHEN contains({p}, 'rental unit') OR contains({p}, 'apartment') OR contains({p}, 'condo') OR contains({p}, 'loft') THEN 'Apartment/condo'
       WHEN contains({p}, 'home') OR contains({p}, 'house') OR contains({p}, 'townhouse') OR contains({p}, 'villa') THEN 'House/villa'
       WHEN contains({p}, 'hostel') OR contains({p}, 'guesthouse') OR contains({p}, 'bed and breakfast') THEN 'Guesthouse/hostel'
       WHEN contains({p}, 'room') THEN 'Room' ELSE 'Other' END AS property_group
FROM parsed"""


_RAW_OUT = ["listing_id", "neighbourhood_cleansed", "currency", "property_type", "price_eur", "host_response_rate",
            "host_is_superhost", "bathrooms", "bathroom_type", "amenities_count", *_FLAG_SQL, "property_group"]


@register("pr1_parse_raw_listings", _raw_clean_sql())
def parse_raw(spark, sf_dir):
    """PR1-PR9: price to EUR, booleans, rates, bathrooms, amenities, flags, property group."""
    return cn.parse_listing_columns(fx.raw_listings(spark, sf_dir)).select(*_RAW_OUT)


@register("fi1_fi2_price_filter_audit", with_views("activity")[:-1] + """, b AS (
  SELECT city, quantile_cont(price_eur, 0.25) AS q1, quantile_cont(price_eur, 0.75) AS q3
  FROM activity WHERE price_eur > 0 GROUP BY city),
j AS (SELECT a.*, b.q1 - 1.5 * (b.q3 - b.q1) AS lo, b.q3 + 1.5 * (b.q3 - b.q1) AS hi
  FROM activity a LEFT JOIN b ON a.city = b.city)
SELECT city, count(*) AS raw_listing_rows,
  CAST(sum(CASE WHEN price_eur > 0 THEN 0 ELSE 1 END) AS BIGINT) AS missing_or_zero_price_rows,
  any_value(lo) AS price_iqr_lower_eur, any_value(hi) AS price_iqr_upper_eur,
  CAST(sum(CASE WHEN price_eur > 0 AND NOT coalesce(price_eur BETWEEN lo AND hi, false) THEN 1 ELSE 0 END) AS BIGINT) AS price_outlier_rows_removed,
  CAST(sum(CASE WHEN price_eur > 0 AND coalesce(price_eur BETWEEN lo AND hi, false) THEN 1 ELSE 0 END) AS BIGINT) AS clean_listing_rows_after_price_filter
FROM j GROUP BY city""")
def price_audit(spark, sf_dir):
    """FI1+FI2+AG38: per-city missing/zero prices, IQR bounds and outliers removed."""
    return cn.price_filter_audit(fx.activity(spark, sf_dir), by=["city"])


@register("fi2_iqr_filtered_rows", with_views("activity")[:-1] + """, v AS (SELECT * FROM activity WHERE price_eur > 0),
b AS (SELECT city, quantile_cont(price_eur, 0.25) AS q1, quantile_cont(price_eur, 0.75) AS q3 FROM v GROUP BY city)
SELECT v.listing_id, v.city, v.date, v.price_eur FROM v JOIN b ON v.city = b.city
WHERE v.price_eur BETWEEN b.q1 - 1.5 * (b.q3 - b.q1) AND b.q3 + 1.5 * (b.q3 - b.q1)""")
def iqr_rows(spark, sf_dir):
    """FI1+FI2: rows kept by the positive-price and per-city IQR filters."""
    return iqr_filter(fx.activity(spark, sf_dir).filter(F.col("price_eur") > 0), "price_eur", ["city"])


AS_OF = "2024-07-20"


@register("ag9_review_features", with_views("activity") + f"""
SELECT listing_id, count(date) AS total_reviews,
  CAST(DATE '{AS_OF}' - max(date) AS BIGINT) AS days_since_last_review,
  CAST(DATE '{AS_OF}' - min(date) AS BIGINT) AS listing_age_days,
  count(CASE WHEN date >= DATE '{AS_OF}' - INTERVAL 6 MONTH THEN date END) AS reviews_last_6m
FROM activity GROUP BY listing_id""")
def review_feats(spark, sf_dir):
    """AG9: review activity per listing with an explicit as-of date."""
    return cn.review_features(fx.activity(spark, sf_dir), AS_OF)


def _geo(spark, sf_dir):
    n = read_table(spark, sf_dir, "nation")
    r = read_table(spark, sf_dir, "region")
    return n.join(r, n.n_regionkey == r.r_regionkey).select(
        F.col("n_name").alias("neighbourhood_cleansed"), F.col("r_name").alias("neighbourhood_group"))


@register("jn1_master_build", with_views("listings", "calendar", "activity")[:-1] + f""",
cal AS (SELECT listing_id, count(*) AS calendar_days,
  sum(CASE WHEN available = 't' THEN 0 ELSE 1 END) / count(*) AS calendar_unavailable_rate
  FROM calendar GROUP BY listing_id),
rev AS (SELECT listing_id, count(date) AS total_reviews,
  count(CASE WHEN date >= DATE '{AS_OF}' - INTERVAL 6 MONTH THEN date END) AS reviews_last_6m
  FROM activity GROUP BY listing_id),
geo AS (SELECT n.n_name AS neighbourhood_cleansed, min(r.r_name) AS neighbourhood_group
  FROM nation n JOIN region r ON n.n_regionkey = r.r_regionkey GROUP BY n.n_name),
nb AS (SELECT neighbourhood_cleansed, count(*) AS neighbourhood_listing_count FROM listings GROUP BY 1)
SELECT l.listing_id, l.city, l.neighbourhood_cleansed, g.neighbourhood_group, l.price_eur,
  nb.neighbourhood_listing_count, c.calendar_days, c.calendar_unavailable_rate, r.total_reviews, r.reviews_last_6m
FROM listings l LEFT JOIN cal c ON l.listing_id = c.listing_id LEFT JOIN rev r ON l.listing_id = r.listing_id
LEFT JOIN geo g ON l.neighbourhood_cleansed = g.neighbourhood_cleansed
LEFT JOIN nb ON l.neighbourhood_cleansed = nb.neighbourhood_cleansed""")
def master(spark, sf_dir):
    """JN1+JN2+JN5: listings + calendar rollup + review features + geo group + area frequency."""
    lst = fx.listings(spark, sf_dir).select("listing_id", "city", "neighbourhood_cleansed", "price_eur")
    lst = with_group_count(lst, ["neighbourhood_cleansed"], "neighbourhood_listing_count")
    calf = cl.calendar_rollup(fx.calendar(spark, sf_dir)).select(
        "listing_id", "calendar_days", "calendar_unavailable_rate")
    rev = cn.review_features(fx.activity(spark, sf_dir), AS_OF).select(
        "listing_id", "total_reviews", "reviews_last_6m")
    return cn.build_master(lst, calf, rev, _geo(spark, sf_dir))


@register("jn3_key_match_audit", """
WITH lk AS (SELECT DISTINCT o_orderkey AS k FROM orders), rk AS (SELECT DISTINCT l_orderkey AS k FROM lineitem),
m AS (SELECT count(*) AS matched_keys FROM lk WHERE k IN (SELECT k FROM rk))
SELECT (SELECT count(*) FROM lk) AS left_unique_keys, (SELECT count(*) FROM rk) AS right_unique_keys,
  m.matched_keys, """ + pround_sql("m.matched_keys / (SELECT count(*) FROM lk) * 100", 4) + """ AS match_pct FROM m""")
def key_match(spark, sf_dir):
    """JN3: orders vs lineitem key-match audit (matched ids, match %)."""
    return cn.key_match_audit(read_table(spark, sf_dir, "orders"), read_table(spark, sf_dir, "lineitem"),
                              "o_orderkey", "l_orderkey")


@register("jn4_semi_filter_matched", """
SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem)""")
def semi(spark, sf_dir):
    """JN4: orders restricted to keys present in lineitem (left semi join)."""
    o = read_table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    return cn.semi_filter(o, read_table(spark, sf_dir, "lineitem"), "o_orderkey", "l_orderkey")


_DIST = ("2 * 6371.0 * asin(sqrt(pow(sin((radians(lat) - radians(40.4168)) / 2), 2) + "
         "cos(radians(lat)) * cos(radians(40.4168)) * pow(sin((radians(lon) - radians(-3.7038)) / 2), 2)))")


@register("pr10_haversine_distance", with_views("listings")[:-1] + f""", p AS (
  SELECT listing_id, CAST(40.3 AS DOUBLE) + CAST(listing_id % 1000 AS DOUBLE) / CAST(5000 AS DOUBLE) AS lat,
    CAST(-3.8 AS DOUBLE) + CAST(number_of_reviews AS DOUBLE) / CAST(40 AS DOUBLE) AS lon FROM listings),
d AS (SELECT listing_id, lat, lon, {pround_sql(_DIST, 4)} AS distance_to_center_km FROM p)
SELECT *, CAST(CASE WHEN distance_to_center_km <= 5 THEN 1 ELSE 0 END AS BIGINT) AS is_central_5km FROM d""")
def haversine(spark, sf_dir):
    """PR10-PR11: distance to the Madrid centre for coordinates derived from each listing."""
    l = fx.listings(spark, sf_dir)
    p = l.select("listing_id",
                 (F.lit(40.3) + (F.col("listing_id") % 1000).cast("double") / F.lit(5000.0)).alias("lat"),
                 (F.lit(-3.8) + F.col("number_of_reviews").cast("double") / F.lit(40.0)).alias("lon"))
    return cn.add_location_features(p, 40.4168, -3.7038, "lat", "lon")


@register("pr12_listing_derived_columns", with_views("listings") + """
SELECT listing_id, ln(1 + price_eur) AS log_price_eur,
  CAST(CASE WHEN minimum_nights > 30 THEN 30 ELSE minimum_nights END AS BIGINT) AS minimum_nights_capped,
  CAST(CASE WHEN coalesce(number_of_reviews, 0) > 0 THEN 1 ELSE 0 END AS BIGINT) AS has_reviews
FROM listings""")
def derived(spark, sf_dir):
    """PR12, PR13, PR23: log price, minimum nights clipped at 30, has-reviews flag."""
    l = fx.listings(spark, sf_dir).select("listing_id", "price_eur", "minimum_nights", "number_of_reviews")
    return cn.add_host_and_date_features(l).select("listing_id", "log_price_eur", "minimum_nights_capped",
                                                   "has_reviews")


@register("pr32_clean_reviews", """
SELECT doc_id, lang, n_chars FROM documents WHERE trim(coalesce(text, '')) <> ''""")
def reviews_clean(spark, sf_dir):
    """PR32: drop PII-like columns and blank texts from review-like documents."""
    d = read_table(spark, sf_dir, "documents").withColumn("date", F.lit("2024-01-01"))
    return cn.clean_reviews(d, text="text", pii=["source"]).select("doc_id", "lang", "n_chars")


@register("io7_union_cities", with_views("listings") + """
SELECT listing_id, city, price_eur, NULL::DOUBLE AS review_scores_rating FROM listings WHERE city < 'EUROPE'
UNION ALL
SELECT listing_id, city, price_eur, review_scores_rating FROM listings WHERE city >= 'EUROPE'""")
def union_cities(spark, sf_dir):
    """IO7: per-city tables with different columns unioned by name."""
    l = fx.listings(spark, sf_dir)
    a = l.filter(F.col("city") < "EUROPE").select("listing_id", "city", "price_eur")
    b = l.filter(F.col("city") >= "EUROPE").select("listing_id", "city", "price_eur", "review_scores_rating")
    return a.unionByName(b, allowMissingColumns=True)


# ------------------------------------------------------------------ IO, misc
from ..functions.parse import slugify  # noqa: E402
from ..session import ensure_checkpoint_dir  # noqa: E402
from ..sources import io as sio  # noqa: E402


def _scratch(spark, name):
    import os
    import uuid
    return os.path.join(ensure_checkpoint_dir(spark), f"{name}-{uuid.uuid4().hex[:8]}")


_RAW_COLS = ["id", "price", "host_response_rate", "host_is_superhost", "bathrooms_text", "amenities", "property_type",
             "neighbourhood_cleansed", "currency"]


@register("io1_csv_scan_existing_columns", with_views("raw_listings") + """
SELECT id, price, amenities, property_type FROM raw_listings""")
def csv_scan(spark, sf_dir):
    """IO1: raw listings round-tripped through CSV; read with an explicit string schema keeping the
    wanted columns that exist (host_acceptance_rate is reported missing)."""
    path = _scratch(spark, "raw-listings-csv")
    sio.write_csv(fx.raw_listings(spark, sf_dir), path)
    df, missing = sio.read_csv_columns(spark, path, _RAW_COLS, ["id", "price", "amenities", "host_acceptance_rate",
                                                                 "property_type"])
    assert missing == ["host_acceptance_rate"]
    return df.withColumn("id", F.col("id").cast("bigint"))


@register("io5_partitioned_layer_readback", with_views("listings") + """
SELECT listing_id, city, price_eur FROM listings WHERE city IN ('EUROPE', 'ASIA')""")
def layer_readback(spark, sf_dir):
    """IO5+IO6: write listings partitioned by city, read two cities back (partition pruning)."""
    path = _scratch(spark, "listings-layer")
    sio.write_table(fx.listings(spark, sf_dir).select("listing_id", "city", "price_eur"), path)
    return sio.read_table_layer(spark, path, ["EUROPE", "ASIA"]).select("listing_id", "city", "price_eur")


@register("io8_table_row_counts", " UNION ALL ".join(
    f"SELECT '{t}' AS \"table\", count(*) AS rows FROM {t}" for t in
    ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings",
     "pages", "benchmark", "labels", "conversations"]))
def inventory_rows(spark, sf_dir):
    """IO8: loaded rows per table (one small aggregate each, unioned)."""
    from ..sources.tables import TABLES
    counts = sio.row_counts({t: read_table(spark, sf_dir, t) for t in TABLES})
    return counts.select("table", "rows")


@register("io8_file_inventory")
def inventory_files(spark, sf_dir):
    """IO8: parquet files with size in MB (binaryFile source, path/length only)."""
    return sio.file_inventory(spark, sf_dir)


@register("io9_available_cities", with_views("listings") + "SELECT DISTINCT city FROM listings")
def cities(spark, sf_dir):
    """IO9: cities available in the listings layer."""
    return sio.available_cities(fx.listings(spark, sf_dir))


@register("so5_first_seen_distinct", with_views("listings") + """
SELECT city, neighbourhood_cleansed, min(listing_id) AS first_seen_listing_id,
  CAST(row_number() OVER (PARTITION BY city ORDER BY min(listing_id)) AS BIGINT) AS first_seen_order
FROM listings GROUP BY city, neighbourhood_cleansed""")
def first_seen(spark, sf_dir):
    """SO5: distinct neighbourhoods per city in first-seen order (by smallest listing id)."""
    from pyspark.sql import Window
    g = fx.listings(spark, sf_dir).groupBy("city", "neighbourhood_cleansed").agg(
        F.min("listing_id").alias("first_seen_listing_id"))
    return g.withColumn("first_seen_order", F.row_number().over(
        Window.partitionBy("city").orderBy("first_seen_listing_id")))


@register("ag38_build_audit", with_views("listings", "calendar")[:-1] + """, m AS (
  SELECT l.*, c.n AS cal_days FROM listings l LEFT JOIN (SELECT listing_id, count(*) AS n FROM calendar GROUP BY 1) c
  ON l.listing_id = c.listing_id)
SELECT city, count(*) AS final_rows, count(DISTINCT listing_id) AS listing_ids,
  CAST(sum(CASE WHEN cal_days IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS rows_missing_calendar_features,
  """ + pround_sql("sum(CASE WHEN cal_days IS NULL THEN 0 ELSE 1 END) * 100.0 / count(*)", 4) + """ AS calendar_match_pct,
  """ + pround_sql("median(price_eur)", 4) + """ AS price_median_eur, """ + pround_sql("avg(price_eur)", 4) + """ AS price_mean_eur
FROM m GROUP BY city""")
def build_audit(spark, sf_dir):
    """AG38: build audit per city (rows, ids, calendar match %, price median/mean) in one aggregate."""
    from ..functions.numeric import pround
    cal = fx.calendar(spark, sf_dir).groupBy("listing_id").agg(F.count(F.lit(1)).alias("cal_days"))
    m = fx.listings(spark, sf_dir).join(cal, "listing_id", "left")
    return grouped(m, ["city"], F.count(F.lit(1)).alias("final_rows"), F.countDistinct("listing_id").alias("listing_ids"),
        F.sum(F.col("cal_days").isNull().cast("int")).alias("rows_missing_calendar_features"),
        pround(F.sum(F.col("cal_days").isNotNull().cast("int")) * 100.0 / F.count(F.lit(1)), 4).alias("calendar_match_pct"),
        median_of("price_eur", 4).alias("price_median_eur"), pround(F.avg("price_eur"), 4).alias("price_mean_eur"))


@register("pr36_slugify", """SELECT p_partkey, CASE WHEN coalesce(regexp_replace(regexp_replace(lower(trim(p_type)), '[^a-z0-9]+', '_', 'g'),
  '^_+|_+$', '', 'g'), '') = '' THEN 'unknown' ELSE regexp_replace(regexp_replace(lower(trim(p_type)), '[^a-z0-9]+', '_', 'g'),
  '^_+|_+$', '', 'g') END AS slug FROM part""")
def slugs(spark, sf_dir):
    """PR36: slugs of part types (segment artifact names)."""
    return read_table(spark, sf_dir, "part").select("p_partkey", slugify("p_type").alias("slug"))


@register("pr35_json_payload_values", """SELECT event_type, count(*) AS events,
  sum(TRY_CAST(json_extract_string(props, '$.k') AS DOUBLE)) AS k_sum, max(TRY_CAST(json_extract_string(props, '$.k') AS DOUBLE)) AS k_max
FROM events GROUP BY event_type""")
def json_payloads(spark, sf_dir):
    """PR35 (JSON side): event payloads parsed with from_json and aggregated per event type."""
    e = read_table(spark, sf_dir, "events")
    k = F.from_json("props", "map<string,string>").getItem("k").try_cast("double")
    return e.groupBy("event_type").agg(F.count(F.lit(1)).alias("events"), F.sum(k).alias("k_sum"),
                                       F.max(k).alias("k_max"))


@register("pr25_professional_host", """SELECT o_custkey AS host_id, count(*) AS host_listings_count,
  CAST(CASE WHEN coalesce(count(*), 0) >= 5 THEN 1 ELSE 0 END AS BIGINT) AS is_professional_host FROM orders GROUP BY o_custkey""")
def professional_host(spark, sf_dir):
    """PR25: hosts (customers) with their listing count and the professional flag (>= 5 listings)."""
    o = read_table(spark, sf_dir, "orders")
    hosts = o.groupBy(F.col("o_custkey").alias("host_id")).agg(F.count(F.lit(1)).alias("host_listings_count"))
    out = cn.add_host_and_date_features(hosts)
    return out.select("host_id", "host_listings_count", "is_professional_host")
