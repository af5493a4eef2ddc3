"""Prediction caches and price answers (FC1-FC9, JN6-JN9, PR26, PR27).

The listing cache is segment-level predictions plus city-level fallbacks for
listings no segment model covers (left anti join), inner-joined to the master
context. The monthly cache is a ``sequence`` of month starts exploded per
listing (no driver loop over months). Window summaries and stay estimates are
joins and aggregates over that cache.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.dates import SEASONS, months_touched, season_of_month
from ..functions.numeric import col_of, pround
from .ranking import grouped, median_of

# Month name -> number, and season -> month names.
MONTHS = ["January", "February", "March", "April", "May", "June", "July", "August", "September", "October",
          "November", "December"]
SEASON_TO_MONTHS = {"Winter": "December, January, February", "Spring": "March, April, May",
                    "Summer": "June, July, August", "Autumn": "September, October, November"}


def price_band(c, width: int = 25) -> Column:
    """PR26: 'EUR lo-hi' band of width 25 (lo = floor(v / w) * w); null -> 'Unknown'."""
    v = col_of(c)
    lo = (F.floor(v / width) * width).cast("bigint")
    return F.when(v.isNull() | F.isnan(v), F.lit("Unknown")).otherwise(
        F.format_string("EUR %d-%d", lo, lo + width))


def availability_label(c) -> Column:
    """PR27: label of an unavailable-rate signal."""
    s = col_of(c).cast("double")
    return (F.when(s.isNull() | F.isnan(s), "unknown").when(s <= 0.25, "strong availability signal")
            .when(s <= 0.50, "moderate availability signal").when(s <= 0.75, "limited availability signal")
            .otherwise("very limited availability signal"))


def scored_predictions(pred: DataFrame, scope: str, segment_col: str | None, model_name: Column | str,
                       metrics: DataFrame | None = None, join_keys: Sequence[str] = ()) -> DataFrame:
    """FC1: prediction rows with 2-dp price, band and model lineage (+ metric columns when given)."""
    seg = F.col(segment_col) if segment_col else F.lit("All property groups")
    out = pred.select("listing_id", "city", pround("predicted_price_eur", 2).alias("predicted_nightly_price_eur"),
                      price_band("predicted_price_eur").alias("predicted_price_band"),
                      F.lit(scope).alias("prediction_model_scope"), seg.alias("prediction_model_segment"),
                      (F.lit(model_name) if isinstance(model_name, str) else model_name).alias("prediction_model_name"))
    if metrics is not None:
        out = out.join(metrics, list(join_keys), "left")
    return out


def listing_cache(segment_preds: DataFrame, city_preds: DataFrame, master: DataFrame,
                  context: Sequence[str]) -> DataFrame:
    """FC2 (JN6 + JN7): segment predictions, plus city fallbacks for uncovered listings,
    joined (inner) to the master context; listing price renamed to the snapshot price."""
    fallback = city_preds.join(segment_preds.select("listing_id", "city"), ["listing_id", "city"], "left_anti")
    preds = segment_preds.unionByName(fallback, allowMissingColumns=True)
    ctx = master.select(*[c for c in context if c in master.columns])
    if "price_eur" in ctx.columns:
        ctx = ctx.withColumnRenamed("price_eur", "snapshot_price_eur")
    return ctx.join(preds, ["listing_id", "city"], "inner")


def monthly_cache(cache: DataFrame, as_of: str, horizon: int = 12,
                  signal_cols: dict | None = None) -> DataFrame:
    """FC3 + JN9: listing x the ``horizon`` month starts after ``as_of``'s month, with season,
    that season's unavailable signal and its label (as-of is explicit, Q6)."""
    signal_cols = signal_cols or {s: f"calendar_unavailable_{s}" for s in SEASONS}
    first = F.add_months(F.trunc(F.lit(as_of).cast("date"), "MM"), 1)
    months = F.sequence(first, F.add_months(first, horizon - 1), F.expr("INTERVAL 1 MONTH"))
    base = ["listing_id", "city", "predicted_nightly_price_eur", "predicted_price_band", "prediction_model_scope",
            "prediction_model_segment", "prediction_model_name"]
    base = [c for c in base if c in cache.columns]
    sig = [c for c in signal_cols.values() if c in cache.columns]
    x = cache.select(*base, *sig, F.explode(months).alias("month_start"))
    season = season_of_month(F.month("month_start"))
    signal = None
    for s, c in signal_cols.items():
        v = F.col(c).cast("double") if c in cache.columns else F.lit(None).cast("double")
        signal = F.when(season == s, v) if signal is None else signal.when(season == s, v)
    x = (x.withColumn("prediction_month", F.date_format("month_start", "yyyy-MM"))
         .withColumn("season", season).withColumn("month_unavailable_signal", signal)
         .withColumn("month_availability_label", availability_label("month_unavailable_signal")))
    return x.drop(*sig)


def window_summary(monthly: DataFrame, by: Sequence[str] = ("city",), months: Sequence[str] = (),
                   seasons: Sequence[str] = ()) -> DataFrame:
    """FC4: per requested month and/or season window: distinct listings, mean/median price,
    mean unavailable. A season containing a requested month is dropped; with nothing
    requested, the four seasons are summarised."""
    by = list(by)
    months = list(dict.fromkeys(m.strip().title() for m in months if m.strip().title() in MONTHS))
    seasons = [("Autumn" if s.strip().title() == "Fall" else s.strip().title()) for s in seasons]
    seasons = list(dict.fromkeys(s for s in seasons if s in SEASON_TO_MONTHS))
    month_num = {m: i + 1 for i, m in enumerate(MONTHS)}
    month_seasons = {season_label(month_num[m]) for m in months}
    seasons = [s for s in seasons if s not in month_seasons]
    if not months and not seasons:
        seasons = list(SEASON_TO_MONTHS)
    season_title = F.initcap("season")
    parts = []
    if months:
        label = F.element_at(F.array(*[F.lit(m) for m in MONTHS]), F.month("month_start"))
        parts.append(monthly.filter(F.month("month_start").isin(*[month_num[m] for m in months]))
                     .withColumn("window", label))
    if seasons:
        parts.append(monthly.filter(season_title.isin(*seasons)).withColumn("window", season_title))
    win = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    g = grouped(win, [*by, "window"], F.countDistinct("listing_id").alias("count"), F.avg("predicted_nightly_price_eur").alias("mean_price"),
        median_of("predicted_nightly_price_eur").alias("median_price"),
        F.avg("month_unavailable_signal").alias("mean_unavailable"))
    lookup = F.create_map(*[x for k, v in SEASON_TO_MONTHS.items() for x in (F.lit(k), F.lit(v))])
    return g.withColumn("months", F.coalesce(F.element_at(lookup, F.col("window")), F.col("window"))) \
            .withColumn("price_source", F.lit("precomputed model prediction cache"))


def season_label(month: int) -> str:
    return {12: "Winter", 1: "Winter", 2: "Winter", 3: "Spring", 4: "Spring", 5: "Spring", 6: "Summer",
            7: "Summer", 8: "Summer"}.get(month, "Autumn")


def _mode(col: str, by: Sequence[str], df: DataFrame, out: str) -> DataFrame:
    c = df.filter(F.col(col).isNotNull()).groupBy(*by, col).agg(F.count(F.lit(1)).alias("_n"))
    w = Window.partitionBy(*by).orderBy(F.col("_n").desc(), F.col(col).asc())
    return c.withColumn("_r", F.row_number().over(w)).filter("_r = 1").select(*by, F.col(col).alias(out))


def stay_estimate(monthly: DataFrame, stays: DataFrame, key: Sequence[str] = ("stay_id",)) -> DataFrame:
    """FC5: for each stay, every touched month must be in the cache; then the median
    predicted price and the modal model / band / segment over those months (else null)."""
    key = list(key)
    need = stays.select(*key, "listing_id", F.explode(months_touched("check_in", "check_out")).alias("month_start"))
    n_need = need.groupBy(*key, "listing_id").agg(F.count(F.lit(1)).alias("_need"))
    hit = need.join(monthly, ["listing_id", "month_start"])
    ids = [*key, "listing_id"]
    g = grouped(hit, [*ids], F.countDistinct("month_start").alias("_have"),
                              median_of("predicted_nightly_price_eur").alias("estimated_nightly_price_eur"))
    est = (n_need.join(g, ids, "left")
           .withColumn("covered", F.coalesce(F.col("_have") == F.col("_need"), F.lit(False))))
    est = est.withColumn("estimated_nightly_price_eur",
                         F.when(F.col("covered"), F.col("estimated_nightly_price_eur")))
    for c, out in (("prediction_model_name", "modal_model"), ("predicted_price_band", "modal_band"),
                   ("prediction_model_segment", "modal_segment")):
        est = est.join(_mode(c, ids, hit, out), ids, "left").withColumn(
            out, F.when(F.col("covered"), F.col(out)))
    return est.drop("_have").withColumnRenamed("_need", "months_needed")


def price_source_cascade(df: DataFrame, snapshot: str, verified: str, cached: str, model: str) -> DataFrame:
    """FC6: verified snapshot price -> cached estimate -> model prediction, with the source label."""
    snap = F.when(F.col(verified), F.col(snapshot))
    return df.withColumn("nightly_price_eur", F.coalesce(snap, F.col(cached), F.col(model))) \
             .withColumn("price_source", F.when(snap.isNotNull(), "verified calendar snapshot")
                         .when(F.col(cached).isNotNull(), "precomputed model prediction cache")
                         .when(F.col(model).isNotNull(), "live model prediction").otherwise("unavailable"))


def cache_manifest(cache: DataFrame) -> DataFrame:
    """FC8: rows and median predicted price per city / scope / segment / model."""
    return grouped(cache, ["city", "prediction_model_scope", "prediction_model_segment", "prediction_model_name"], F.count(F.lit(1)).alias("rows"), median_of("predicted_nightly_price_eur").alias("median_predicted_price_eur"))


def feature_defaults(df: DataFrame, numeric: Sequence[str], categorical: Sequence[str],
                     by: Sequence[str] = ("city",)) -> DataFrame:
    """FC9: per group, median of each numeric feature and the mode ('Unknown' if none) of each
    categorical one, long form (feature, default)."""
    by = list(by)
    med = grouped(df, by, *[median_of(c).alias(c) for c in numeric]).select(*by, *[F.col(c).cast("string").alias(c) for c in numeric])
    out = med.unpivot(by, list(numeric), "feature", "default") if numeric else None
    for c in categorical:
        m = _mode(c, by, df, "default").withColumn("feature", F.lit(c))
        full = df.select(*by).distinct().join(m, by, "left").withColumn(
            "default", F.coalesce(F.col("default").cast("string"), F.lit("Unknown"))).withColumn("feature", F.lit(c))
        out = full if out is None else out.unionByName(full)
    return out


def feature_options(df: DataFrame, categorical: Sequence[str], by: Sequence[str] = ("city",),
                    limit: int = 500) -> DataFrame:
    """FC9: sorted distinct option values per categorical feature, first ``limit`` (the
    option list is capped by design). Distinct values are found distributed; only the
    first ``limit`` per group (ranked before the shuffle) are collected."""
    by = list(by)
    long = df.select(*by, F.inline(F.array(*[F.struct(F.lit(c).alias("feature"),
                                                      F.col(c).cast("string").alias("value")) for c in categorical])))
    d = long.filter(F.col("value").isNotNull()).distinct()
    w = Window.partitionBy(*by, "feature").orderBy("value")
    top = d.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= limit)
    return top.groupBy(*by, "feature").agg(
        F.array_join(F.array_sort(F.collect_list("value")), "|").alias("options"),
        F.count(F.lit(1)).alias("option_count"))


def enrich(df: DataFrame, cache: DataFrame, key: Sequence[str] = ("listing_id",)) -> DataFrame:
    """JN8: left join the cache, replacing same-named columns of ``df``."""
    key = list(key)
    same = [c for c in cache.columns if c in df.columns and c not in key]
    return df.drop(*same).join(cache, key, "left")


def scenario_overrides(scenarios: DataFrame) -> DataFrame:
    """PR38: host-side feature values for a price scenario (beds = max(round(guests / 2), 1),
    availability expanded from the 30-day minimum, ratios), one row per scenario."""
    g = F.col("accommodates").cast("double")
    beds = F.greatest(F.rint(g / 2).cast("int"), F.lit(1))
    a30 = F.col("min_available_days_30").cast("int")
    has_min = a30 > 0
    av30 = F.when(has_min, a30).otherwise(F.least(F.greatest(F.coalesce(F.col("default_availability_30").cast("int"),
                                                                          F.lit(15)), F.lit(0)), F.lit(30)))
    av60 = F.when(has_min, F.least(F.lit(60), a30 * 2)).otherwise(F.lit(30))
    av90 = F.when(has_min, F.least(F.lit(90), a30 * 3)).otherwise(F.lit(45))
    av365 = F.when(has_min, F.least(F.lit(365), F.greatest(F.least(F.lit(90), a30 * 3) * 4, a30))).otherwise(F.lit(180))
    return scenarios.select(
        "*", beds.alias("beds"), (F.col("bathrooms") / F.greatest(g, F.lit(1.0))).alias("bathrooms_per_guest"),
        (beds / F.greatest(g, F.lit(1.0))).alias("beds_per_guest"),
        (F.col("distance_to_center_km") <= 5).cast("int").alias("is_central_5km"),
        F.col("min_rating").alias("review_scores_rating"),
        F.coalesce(F.col("default_review_scores_value"), F.col("min_rating")).alias("review_scores_value"),
        av30.alias("availability_30"), av60.alias("availability_60"), av90.alias("availability_90"),
        av365.alias("availability_365"), (av30 / 30.0).alias("availability_30_ratio"),
        (av365 / 365.0).alias("availability_365_ratio"))


def apply_defaults(rows: DataFrame, defaults: DataFrame, features: Sequence[str], key: Sequence[str] = ("city",)) -> DataFrame:
    """FC7: each feature = coalesce(override, per-city default) so a model can score the row."""
    d = defaults.select(*key, *[F.col(c).alias(f"_d_{c}") for c in features])
    j = rows.join(d, list(key), "left")
    for c in features:
        j = j.withColumn(c, F.coalesce(F.col(c), F.col(f"_d_{c}")) if c in rows.columns else F.col(f"_d_{c}"))
    return j.drop(*[f"_d_{c}" for c in features])
