"""Registered clipping, day-difference and dimension-join queries (PR13, PR14, JN13, JN15)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import clean, cluster, profile
from ..operators.ranking import grouped, median_of
from ..sources import fixtures as fx
from ..sources.tables import read_table
from .registry import register
from .sqlkit import pround_sql, with_views

AS_OF = "2024-07-20"


@register("pr13_quantile_clip", with_views("listings")[:-1] + """, cap AS (SELECT city, quantile_cont(price_eur, 0.95) AS p,
  quantile_cont(CAST(minimum_nights AS DOUBLE), 0.95) AS m FROM listings GROUP BY city)
SELECT l.listing_id, l.city, CASE WHEN price_eur > p THEN p ELSE price_eur END AS price_eur,
  CASE WHEN minimum_nights > m THEN m ELSE CAST(minimum_nights AS DOUBLE) END AS minimum_nights
FROM listings l JOIN cap ON l.city = cap.city""")
def quantile_clip(spark, sf_dir):
    """PR13: price and minimum nights clipped at the city's 95 % quantile."""
    l = fx.listings(spark, sf_dir).select("listing_id", "city", "price_eur", "minimum_nights")
    return clean.clip_upper_quantile(l, ["price_eur", "minimum_nights"], 0.95, ["city"])


@register("pr14_day_differences", f"""WITH h AS (SELECT o_custkey AS listing_id, min(CAST(o_orderdate AS DATE)) AS host_since FROM orders GROUP BY o_custkey),
r AS (SELECT user_id AS listing_id, min(CAST(ts AS DATE)) AS first_review, max(CAST(ts AS DATE)) AS last_review FROM events GROUP BY user_id)
SELECT h.listing_id, date_diff('day', host_since, DATE '{AS_OF}') AS host_tenure_days,
  date_diff('day', last_review, DATE '{AS_OF}') AS days_since_last_review, date_diff('day', first_review, last_review) AS review_history_days
FROM h LEFT JOIN r ON h.listing_id = r.listing_id""")
def day_differences(spark, sf_dir):
    """PR14: host tenure (first order of a customer), days since the last review, review history."""
    hosts = read_table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("listing_id")).agg(F.min("o_orderdate").alias("host_since"))
    reviews = fx.activity(spark, sf_dir).groupBy("listing_id").agg(F.min("date").alias("first_review"), F.max("date").alias("last_review"))
    joined = hosts.join(reviews, "listing_id", "left")
    return clean.day_differences(joined, AS_OF, "host_since", "first_review", "last_review").select(
        "listing_id", "host_tenure_days", "days_since_last_review", "review_history_days")


@register("jn13_area_dimension", with_views("listings") + f"""SELECT r.r_name AS city, n.n_name AS neighbourhood_cleansed, listing_count, median_price_eur,
  mean_price_eur, median_availability_365, mean_rating
FROM nation n JOIN region r ON n.n_regionkey = r.r_regionkey LEFT JOIN (SELECT city, neighbourhood_cleansed, count(*) AS listing_count,
  {pround_sql('median(price_eur)', 3)} AS median_price_eur, {pround_sql('avg(price_eur)', 3)} AS mean_price_eur,
  {pround_sql('median(availability_365)', 3)} AS median_availability_365, {pround_sql('avg(review_scores_rating)', 3)} AS mean_rating
  FROM listings GROUP BY ALL HAVING count(*) >= 600) s ON s.city = r.r_name AND s.neighbourhood_cleansed = n.n_name""")
def area_dimension(spark, sf_dir):
    """JN13: all areas of the nation dimension with statistics of those that have 600 listings or more."""
    n, r = read_table(spark, sf_dir, "nation"), read_table(spark, sf_dir, "region")
    dimension = n.join(r, n.n_regionkey == r.r_regionkey).select(F.col("r_name").alias("city"), F.col("n_name").alias("neighbourhood_cleansed"))
    return profile.area_dimension(dimension, profile.neighbourhood_table(fx.listings(spark, sf_dir), min_rows=600))


@register("jn15_segment_labels", with_views("listings")[:-1] + """, m AS (SELECT city, property_group, median(price_eur) AS p FROM listings GROUP BY ALL),
lab AS (SELECT city, property_group, CASE row_number() OVER (PARTITION BY city ORDER BY p, property_group) WHEN 1 THEN 'Budget' WHEN 2 THEN 'Mid-range'
  WHEN 3 THEN 'Upscale' END AS segment FROM m)
SELECT l.listing_id, l.city, l.property_group, segment FROM listings l LEFT JOIN lab ON l.city = lab.city AND l.property_group = lab.property_group""")
def segment_labels(spark, sf_dir):
    """JN15: property groups in order of median price give a segment label; the fourth and later have none."""
    from pyspark.sql import Window
    l = fx.listings(spark, sf_dir).select("listing_id", "city", "property_group", "price_eur")
    order = Window.partitionBy("city").orderBy("p", "property_group")
    names = F.array(*[F.lit(x) for x in ("Budget", "Mid-range", "Upscale")])
    labels = grouped(l, ["city", "property_group"], median_of("price_eur").alias("p")).withColumn("_o", F.row_number().over(order)) \
        .withColumn("segment", F.when(F.col("_o") <= 3, F.element_at(names, F.col("_o"))))
    return cluster.with_segment_labels(l.drop("price_eur"), labels, "property_group")
