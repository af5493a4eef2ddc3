"""Registered calendar queries (PR15-PR17, AG1-AG8, SV1-SV5, ST1)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.dates import months_touched
from ..operators import calendar as cl
from ..sources import fixtures as fx
from ..sources.tables import read_table
from ..streaming.calendar_stream import streaming_calendar_rollup
from .registry import register
from .sqlkit import with_views

# Stay windows searched by the stay queries (check-in, check-out).
STAY_WINDOWS = [("1998-01-01", "1998-01-08"), ("1996-03-28", "1996-04-03"), ("2000-12-30", "2001-01-02")]


def _calendar_city(spark, sf_dir):
    """Calendar rows tagged with the supplier's region as city."""
    s = read_table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    n = read_table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey")
    r = read_table(spark, sf_dir, "region").select("r_regionkey", "r_name")
    geo = s.join(n, s.s_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey) \
        .select(F.col("s_suppkey").alias("listing_id"), F.col("r_name").alias("city"))
    return fx.calendar(spark, sf_dir).join(geo, "listing_id")


_CAL_CITY_SQL = """, calendar_city AS (SELECT c.*, r.r_name AS city FROM calendar c
  JOIN supplier s ON c.listing_id = s.s_suppkey JOIN nation n ON s.s_nationkey = n.n_nationkey
  JOIN region r ON n.n_regionkey = r.r_regionkey)
"""


def _windows_sql() -> str:
    rows = ", ".join(f"({i}, DATE '{a}', DATE '{b}')" for i, (a, b) in enumerate(STAY_WINDOWS))
    return f"(VALUES {rows}) AS w(window_id, check_in, check_out)"


def _stays(spark, sf_dir):
    """Every calendar listing x every stay window."""
    ids = fx.calendar(spark, sf_dir).select("listing_id").distinct()
    return ids.select("listing_id", F.inline(F.array(*[F.struct(F.lit(i).alias("window_id"),
                                                               F.lit(a).cast("date").alias("check_in"),
                                                               F.lit(b).cast("date").alias("check_out"))
                                                      for i, (a, b) in enumerate(STAY_WINDOWS)])))


_SEASON_SQL = """CASE WHEN month({d}) IN (12, 1, 2) THEN '{w}' WHEN month({d}) IN (3, 4, 5) THEN '{sp}'
  WHEN month({d}) IN (6, 7, 8) THEN '{su}' WHEN month({d}) IN (9, 10, 11) THEN '{au}' END"""


def season_sql(d: str, title: bool = False) -> str:
    names = ["winter", "spring", "summer", "autumn"]
    if title:
        names = [n.title() for n in names]
    return _SEASON_SQL.format(d=d, w=names[0], sp=names[1], su=names[2], au=names[3])


@register("pr15_calendar_parts", with_views("calendar") + f"""
SELECT listing_id, date, available, CAST(minimum_nights AS BIGINT) AS minimum_nights,
  CAST(maximum_nights AS BIGINT) AS maximum_nights, CAST(month(date) AS BIGINT) AS month,
  CAST(year(date) AS BIGINT) AS year, CAST(isodow(date) - 1 AS BIGINT) AS weekday,
  CAST(CASE WHEN isodow(date) - 1 >= 5 THEN 1 ELSE 0 END AS BIGINT) AS is_weekend,
  {season_sql('date', True)} AS season, CAST(quarter(date) AS BIGINT) AS quarter,
  CAST(CASE available WHEN 't' THEN 1 WHEN 'f' THEN 0 END AS BIGINT) AS is_available
FROM calendar WHERE date IS NOT NULL""")
def calendar_parts(spark, sf_dir):
    """PR15-PR17: calendar cleaning with date parts, season and lenient flag."""
    return cl.clean_calendar(fx.calendar(spark, sf_dir))


def _rollup_sql() -> str:
    un = "(CASE WHEN available = 't' THEN 0 ELSE 1 END)"
    rate = lambda cond: f"(sum(CASE WHEN {cond} THEN {un} END) / count(CASE WHEN {cond} THEN 1 END))"
    qs = ",\n  ".join(f"{rate(f'quarter(date) = {k}')} AS calendar_unavailable_q{k}" for k in range(1, 5))
    ss = ",\n  ".join(f"{rate(f'({season_sql('date')}) = ' + repr(s))} "
                      f"AS calendar_unavailable_{s}" for s in ["winter", "spring", "summer", "autumn"])
    wk = "coalesce(isodow(date) - 1 >= 5, false)"
    return f"""SELECT listing_id, count(*) AS calendar_days,
  CAST(sum(CASE WHEN available = 't' THEN 1 ELSE 0 END) AS BIGINT) AS calendar_available_days,
  CAST(sum({un}) AS BIGINT) AS calendar_unavailable_days,
  {qs},
  {ss},
  {rate(f'NOT {wk}')} AS calendar_unavailable_weekday,
  {rate(wk)} AS calendar_unavailable_weekend,
  sum({un}) / count(*) AS calendar_unavailable_rate
FROM calendar GROUP BY listing_id"""


@register("ag1_calendar_rollup", with_views("calendar") + _rollup_sql())
def calendar_rollup(spark, sf_dir):
    """AG1-AG4: per-listing calendar days and unavailable rates (overall, quarter, season, weekend)."""
    return cl.calendar_rollup(fx.calendar(spark, sf_dir))


@register("st1_streaming_calendar_rollup", with_views("calendar") + _rollup_sql())
def streaming_rollup(spark, sf_dir):
    """ST1: the AG1 rollup computed incrementally by Structured Streaming (AvailableNow)."""
    return streaming_calendar_rollup(spark, sf_dir)


def _occ_sql() -> str:
    flag = "(CASE available WHEN 't' THEN 1.0 WHEN 'f' THEN 0.0 END)"
    occ = lambda cond: f"(1.0 - avg(CASE WHEN {cond} THEN {flag} END))"
    qs = ",\n  ".join(f"{occ(f'quarter(date) = {k}')} AS occupancy_q{k}" for k in range(1, 5))
    ss = ",\n  ".join(f"{occ(season_sql('date') + ' = ' + repr(s))} AS occupancy_{s}"
                      for s in ["winter", "spring", "summer", "autumn"])
    return f"""SELECT listing_id, {qs}, {ss}, 1.0 - avg({flag}) AS occupancy_rate,
  {occ('isodow(date) - 1 < 5')} AS occupancy_weekday, {occ('isodow(date) - 1 >= 5')} AS occupancy_weekend
FROM calendar WHERE date IS NOT NULL GROUP BY listing_id"""


@register("ag5_occupancy_features", with_views("calendar") + _occ_sql())
def occupancy(spark, sf_dir):
    """AG5: 1 - mean(lenient availability) by quarter, season, overall and weekend."""
    return cl.occupancy_features(fx.calendar(spark, sf_dir))


@register("ag6_monthly_occupancy", with_views("calendar")[:-1] + _CAL_CITY_SQL + """
SELECT city, CAST(month(date) AS BIGINT) AS month,
  1.0 - avg(CASE available WHEN 't' THEN 1.0 WHEN 'f' THEN 0.0 END) AS occupancy_rate
FROM calendar_city WHERE date IS NOT NULL GROUP BY city, month(date)""")
def monthly(spark, sf_dir):
    """AG6: monthly occupancy per city."""
    return cl.monthly_occupancy(_calendar_city(spark, sf_dir))


@register("ag7_calendar_metadata", with_views("calendar")[:-1] + _CAL_CITY_SQL + """
SELECT city, min(date) AS min_date, max(date) AS max_date, count(*) AS total_rows,
  CAST(sum(CASE WHEN lower(available) = 't' THEN 1 ELSE 0 END) AS BIGINT) AS available_rows,
  CAST(0 AS BIGINT) AS price_rows, CAST(0 AS BIGINT) AS adjusted_price_rows
FROM calendar_city GROUP BY city""")
def metadata(spark, sf_dir):
    """AG7: calendar metadata per city (no price columns in this calendar -> 0 rows)."""
    return cl.calendar_metadata(_calendar_city(spark, sf_dir))


def _coverage_sql() -> str:
    return with_views("calendar")[:-1] + _CAL_CITY_SQL + f""", bounds AS (
  SELECT city, min(date) AS min_date, max(date) AS max_date FROM calendar_city GROUP BY city),
stays AS (SELECT DISTINCT c.city, w.window_id, w.check_in, w.check_out FROM calendar_city c, {_windows_sql()})
SELECT s.city, CAST(s.window_id AS BIGINT) AS window_id, s.check_in, s.check_out, b.min_date, b.max_date,
  coalesce(s.check_in >= b.min_date AND s.check_out - 1 <= b.max_date, false) AS within_calendar,
  CASE WHEN b.min_date IS NULL THEN 'No local calendar snapshot is available for this city.'
       WHEN NOT (s.check_in >= b.min_date AND s.check_out - 1 <= b.max_date)
       THEN 'Local calendar coverage for ' || s.city || ' runs from ' || CAST(b.min_date AS VARCHAR) || ' to ' || CAST(b.max_date AS VARCHAR) || '.'
       ELSE 'Requested dates are inside the local calendar snapshot.' END AS coverage_text
FROM stays s LEFT JOIN bounds b ON s.city = b.city"""


@register("ag8_stay_coverage", _coverage_sql())
def coverage(spark, sf_dir):
    """AG8: calendar date bounds per city and whether each stay window is covered."""
    cal = _calendar_city(spark, sf_dir)
    bounds = cal.groupBy("city").agg(F.min("date").alias("min_date"), F.max("date").alias("max_date"))
    win = F.inline(F.array(*[F.struct(F.lit(i).alias("window_id"), F.lit(a).cast("date").alias("check_in"),
                                      F.lit(b).cast("date").alias("check_out"))
                             for i, (a, b) in enumerate(STAY_WINDOWS)]))
    stays = cal.select("city").distinct().select("city", win)
    return cl.stay_coverage(bounds, stays)


def _sv1_sql(select_tail: str = "") -> str:
    return with_views("calendar")[:-1] + f""", stays AS (
  SELECT DISTINCT c.listing_id, w.window_id, w.check_in, w.check_out FROM calendar c, {_windows_sql()}),
agg AS (
  SELECT s.window_id, s.listing_id, count(DISTINCT c.date) AS available_nights,
    max(c.minimum_nights) AS minimum_nights_required, min(c.maximum_nights) AS maximum_nights_allowed
  FROM stays s JOIN calendar c ON c.listing_id = s.listing_id AND lower(c.available) = 't'
    AND c.date >= s.check_in AND c.date < s.check_out
  GROUP BY s.window_id, s.listing_id),
res AS (
  SELECT s.window_id, s.listing_id, s.check_in, s.check_out,
    CAST(s.check_out - s.check_in AS BIGINT) AS nights,
    CAST(coalesce(a.available_nights, 0) AS BIGINT) AS available_nights,
    CAST(coalesce(a.minimum_nights_required, 0) AS BIGINT) AS minimum_nights_required,
    CAST(coalesce(a.maximum_nights_allowed, 0) AS BIGINT) AS maximum_nights_allowed
  FROM stays s LEFT JOIN agg a ON s.window_id = a.window_id AND s.listing_id = a.listing_id),
verdict AS (
  SELECT *, available_nights >= nights
      AND (minimum_nights_required = 0 OR nights >= minimum_nights_required)
      AND (maximum_nights_allowed = 0 OR nights <= maximum_nights_allowed) AS is_available,
    (minimum_nights_required = 0 OR nights >= minimum_nights_required)
      AND (maximum_nights_allowed = 0 OR nights <= maximum_nights_allowed) AS stay_length_ok
  FROM res),
final AS (
  SELECT *, CASE WHEN is_available THEN 'Available in local calendar snapshot'
    WHEN available_nights < nights THEN printf('Only %d of %d nights available', available_nights, nights)
    WHEN minimum_nights_required <> 0 AND nights < minimum_nights_required THEN printf('Minimum stay is %d nights', minimum_nights_required)
    WHEN maximum_nights_allowed <> 0 AND nights > maximum_nights_allowed THEN printf('Maximum stay is %d nights', maximum_nights_allowed)
    ELSE 'Unavailable for requested stay' END AS calendar_status
  FROM verdict)
{select_tail or 'SELECT window_id, listing_id, check_in, check_out, nights, available_nights, minimum_nights_required, maximum_nights_allowed, is_available, stay_length_ok, calendar_status FROM final'}"""


def _sv1(spark, sf_dir):
    stays = _stays(spark, sf_dir)
    res = cl.stay_availability(fx.calendar(spark, sf_dir), stays, stay_key=["window_id"])
    return res.select("window_id", "listing_id", "check_in", "check_out", "nights", "available_nights",
                      "minimum_nights_required", "maximum_nights_allowed", "is_available", "stay_length_ok",
                      "calendar_status")


@register("sv1_stay_availability_batch", _sv1_sql())
def stay_batch(spark, sf_dir):
    """SV1+SV3: every calendar listing x three stay windows: nights, limits, verdict, status."""
    return _sv1(spark, sf_dir)


@register("sv4_candidate_summary", _sv1_sql("""SELECT window_id, count(DISTINCT listing_id) AS candidate_count,
  count(DISTINCT CASE WHEN is_available THEN listing_id END) AS available_count, max(nights) AS nights,
  count(DISTINCT CASE WHEN is_available THEN listing_id END) > 0 AS is_available,
  CASE WHEN count(DISTINCT CASE WHEN is_available THEN listing_id END) > 0 THEN
    format('{:,}', count(DISTINCT CASE WHEN is_available THEN listing_id END)) || ' of ' || format('{:,}', count(DISTINCT listing_id)) || ' matching listings are available for the requested stay.'
  ELSE 'No matching listings pass the exact calendar availability and stay-length rules.' END AS status
FROM final GROUP BY window_id"""))
def candidates(spark, sf_dir):
    """SV4: per stay window, candidate and available listing counts with status."""
    return cl.candidate_summary(_sv1(spark, sf_dir), ["window_id"])


@register("sv2_single_listing_stay", with_views("calendar")[:-1] + """, stays AS (
  SELECT * FROM (VALUES (0, DATE '1998-01-01', DATE '1998-01-08'), (1, DATE '1998-01-05', DATE '1998-01-05'),
    (2, DATE '1995-06-01', DATE '1995-07-15')) AS t(stay_id, check_in, check_out)),
ids AS (SELECT min(listing_id) AS listing_id FROM calendar),
agg AS (
  SELECT s.stay_id, count(DISTINCT c.date) AS a, max(c.minimum_nights) AS mn, min(c.maximum_nights) AS mx
  FROM stays s, ids JOIN calendar c ON c.listing_id = ids.listing_id AND lower(c.available) = 't'
  WHERE c.date >= s.check_in AND c.date < s.check_out GROUP BY s.stay_id),
r AS (
  SELECT s.stay_id, ids.listing_id, s.check_in, s.check_out, CAST(s.check_out - s.check_in AS BIGINT) AS nights,
    CAST(coalesce(a.a, 0) AS BIGINT) AS available_nights, CAST(coalesce(a.mn, 0) AS BIGINT) AS minimum_nights_required,
    CAST(coalesce(a.mx, 0) AS BIGINT) AS maximum_nights_allowed
  FROM stays s CROSS JOIN ids LEFT JOIN agg a ON s.stay_id = a.stay_id),
v AS (SELECT *, (minimum_nights_required = 0 OR nights >= minimum_nights_required)
    AND (maximum_nights_allowed = 0 OR nights <= maximum_nights_allowed) AS lok FROM r)
SELECT CAST(stay_id AS BIGINT) AS stay_id, listing_id, check_in, check_out, nights, available_nights,
  minimum_nights_required, maximum_nights_allowed,
  available_nights >= nights AND lok AND nights > 0 AS is_available, lok AND nights > 0 AS stay_length_ok,
  CASE WHEN nights <= 0 THEN 'Check-out must be after check-in.'
    WHEN available_nights >= nights AND lok THEN 'Available in the local calendar snapshot.'
    WHEN available_nights < nights THEN printf('Only %d of %d nights are available in the local calendar snapshot.', available_nights, nights)
    WHEN minimum_nights_required <> 0 AND nights < minimum_nights_required THEN printf('Stay is shorter than the listing minimum of %d nights.', minimum_nights_required)
    ELSE printf('Stay is longer than the listing maximum of %d nights.', maximum_nights_allowed) END AS status
FROM v""")
def single_stay(spark, sf_dir):
    """SV2: one listing (smallest id) and three stays incl. an empty one, single-check wording."""
    cal = fx.calendar(spark, sf_dir)
    first = cal.agg(F.min("listing_id").alias("listing_id"))
    stays = first.select("listing_id", F.inline(F.array(
        F.struct(F.lit(0).alias("stay_id"), F.lit("1998-01-01").cast("date").alias("check_in"),
                 F.lit("1998-01-08").cast("date").alias("check_out")),
        F.struct(F.lit(1).alias("stay_id"), F.lit("1998-01-05").cast("date").alias("check_in"),
                 F.lit("1998-01-05").cast("date").alias("check_out")),
        F.struct(F.lit(2).alias("stay_id"), F.lit("1995-06-01").cast("date").alias("check_in"),
                 F.lit("1995-07-15").cast("date").alias("check_out")))))
    res = cl.single_stay_status(cl.stay_availability(cal, stays, stay_key=["stay_id"]))
    return res.select("stay_id", "listing_id", "check_in", "check_out", "nights", "available_nights",
                      "minimum_nights_required", "maximum_nights_allowed", "is_available", "stay_length_ok",
                      "status")


@register("sv5_months_touched", with_views("calendar") + """
SELECT listing_id, d AS check_in, d + 40 AS check_out, CAST(m AS DATE) AS month_start
FROM (SELECT listing_id, min(date) AS d FROM calendar GROUP BY listing_id) x,
  unnest(generate_series(CAST(date_trunc('month', d) AS TIMESTAMP), CAST(date_trunc('month', d + 39) AS TIMESTAMP),
    INTERVAL 1 MONTH)) AS t(m)""")
def months(spark, sf_dir):
    """SV5: months touched by a 40-night stay starting at each listing's first calendar day."""
    first = fx.calendar(spark, sf_dir).groupBy("listing_id").agg(F.min("date").alias("check_in"))
    stays = first.withColumn("check_out", F.date_add("check_in", 40))
    return stays.select("listing_id", "check_in", "check_out",
                        F.explode(months_touched("check_in", "check_out")).alias("month_start"))
