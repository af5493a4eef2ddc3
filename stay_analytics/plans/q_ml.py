"""Registered model-evaluation queries (ML2-ML17, JN11, JN12, JN16, WN4, WN5, WN10, TX8).

SQL-checkable ones use the median-baseline predictor (JN11); the pyspark.ml
families are registered rows-only (their fits are not SQL-expressible).
"""

from __future__ import annotations

from pyspark.ml.feature import StringIndexer
from pyspark.sql import functions as F

from ..operators import features as ft
from ..operators import ml
from ..session import spread, written_once
from ..sources import fixtures as fx
from .registry import register
from .sqlkit import pround_sql, with_views

_T = ml.hash_fraction_threshold(0.2)
_SPLIT = f"(substr(md5('42:' || CAST(listing_id AS VARCHAR)), 1, 8) < '{_T}')"


def _model_input(spark, sf_dir):
    l = fx.listings(spark, sf_dir).select("listing_id", "city", "neighbourhood_cleansed", "room_type",
                                          "property_group", "accommodates", "price_eur")
    return l.withColumn("is_test", ml.split_column("listing_id"))


def _baseline_frame(spark, sf_dir):
    return ml.prediction_frame(ml.baseline_predictions(_model_input(spark, sf_dir)))


_BASE_CTE = with_views("listings")[:-1] + f""", d AS (SELECT listing_id, city, neighbourhood_cleansed, room_type, property_group,
    accommodates, price_eur, {_SPLIT} AS is_test FROM listings WHERE price_eur IS NOT NULL),
tr AS (SELECT * FROM d WHERE NOT is_test), te AS (SELECT * FROM d WHERE is_test),
m0 AS (SELECT city, median(price_eur) AS m0 FROM tr GROUP BY city),
m1 AS (SELECT city, room_type, median(price_eur) AS m1 FROM tr GROUP BY city, room_type),
m2 AS (SELECT city, neighbourhood_cleansed, room_type, median(price_eur) AS m2 FROM tr GROUP BY ALL),
m3 AS (SELECT city, neighbourhood_cleansed, room_type, accommodates, median(price_eur) AS m3 FROM tr GROUP BY ALL),
j AS (SELECT te.*, m0.m0, m1.m1, m2.m2, m3.m3 FROM te
  LEFT JOIN m0 ON te.city = m0.city
  LEFT JOIN m1 ON te.city = m1.city AND te.room_type = m1.room_type
  LEFT JOIN m2 ON te.city = m2.city AND te.neighbourhood_cleansed = m2.neighbourhood_cleansed AND te.room_type = m2.room_type
  LEFT JOIN m3 ON te.city = m3.city AND te.neighbourhood_cleansed = m3.neighbourhood_cleansed AND te.room_type = m3.room_type
    AND te.accommodates = m3.accommodates),
p AS (
  SELECT *, 'City median baseline' AS model, m0 AS predicted_price_eur FROM j UNION ALL
  SELECT *, 'Room type median baseline', coalesce(m1, m0) FROM j UNION ALL
  SELECT *, 'Neighbourhood + room median baseline', coalesce(m2, m1, m0) FROM j UNION ALL
  SELECT *, 'Neighbourhood + room + size median baseline', coalesce(m3, m2, m1, m0) FROM j),
fr AS (SELECT listing_id, city, neighbourhood_cleansed, room_type, property_group, accommodates, model,
  price_eur AS actual_price_eur, predicted_price_eur, price_eur - predicted_price_eur AS residual_eur,
  abs(price_eur - predicted_price_eur) AS abs_error_eur FROM p)
"""


def _metrics_sql(by: str) -> str:
    return f"""SELECT {by}, count(*) AS test_rows,
  {pround_sql('sqrt(avg(residual_eur * residual_eur))', 4)} AS rmse_eur, {pround_sql('avg(abs_error_eur)', 4)} AS mae_eur,
  {pround_sql('1.0 - sum(residual_eur * residual_eur) / (var_pop(actual_price_eur) * count(actual_price_eur))', 4)} AS r2
FROM fr GROUP BY {by}"""


@register("ml3_split_counts", with_views("listings") + f"""
SELECT city, CAST(sum(CASE WHEN {_SPLIT} THEN 0 ELSE 1 END) AS BIGINT) AS train_rows,
  CAST(sum(CASE WHEN {_SPLIT} THEN 1 ELSE 0 END) AS BIGINT) AS test_rows FROM listings GROUP BY city""")
def split_counts(spark, sf_dir):
    """ML3: md5-keyed 80/20 split sizes per city (stable under repartitioning)."""
    d = _model_input(spark, sf_dir)
    return d.groupBy("city").agg(F.sum((~F.col("is_test")).cast("int")).alias("train_rows"),
                                 F.sum(F.col("is_test").cast("int")).alias("test_rows"))


@register("ml7_baseline_metrics", _BASE_CTE + _metrics_sql("city, model"))
def baseline_metrics(spark, sf_dir):
    """JN11+ML15+ML7: four median baselines per city with EUR RMSE/MAE/R^2."""
    return ml.regression_metrics(_baseline_frame(spark, sf_dir), ["city", "model"])


@register("ml8_residual_summary", _BASE_CTE + """SELECT city, model, avg(residual_eur) AS residual_mean,
  stddev_samp(residual_eur) AS residual_std, avg(abs_error_eur) AS mae_eur FROM fr GROUP BY city, model""")
def residuals(spark, sf_dir):
    """ML8: residual mean / std / MAE per city and model."""
    return ml.residual_summary(_baseline_frame(spark, sf_dir), ["city", "model"])


def _cap_sql(c):
    return (f"CASE WHEN {c} < 0 THEN NULL WHEN {c} <= 1 THEN 'solo' WHEN {c} <= 2 THEN 'couple' WHEN {c} <= 4 "
            f"THEN 'small_group' WHEN {c} <= 6 THEN 'family_group' WHEN {c} IS NOT NULL THEN 'large_group' END")


_SEGS = ["room_type", "property_group", "capacity_bucket", "neighbourhood_cleansed"]


@register("ml10_error_segments", _BASE_CTE + f""", met AS ({_metrics_sql('city, model')}),
best AS (SELECT city, model FROM met QUALIFY row_number() OVER (PARTITION BY city ORDER BY rmse_eur, mae_eur, model) = 1),
bf AS (SELECT fr.*, {_cap_sql('fr.accommodates')} AS capacity_bucket FROM fr JOIN best ON fr.city = best.city AND fr.model = best.model),
e AS (SELECT city, model, quantile_cont(actual_price_eur, 0.25) AS e0, quantile_cont(actual_price_eur, 0.5) AS e1,
  quantile_cont(actual_price_eur, 0.75) AS e2 FROM bf GROUP BY city, model),
bb AS (SELECT bf.*, CASE WHEN actual_price_eur <= e0 THEN 'low' WHEN actual_price_eur <= e1 THEN 'mid-low'
  WHEN actual_price_eur <= e2 THEN 'mid-high' ELSE 'high' END AS actual_price_band FROM bf JOIN e USING (city, model)),
lg AS ({' UNION ALL '.join(f"SELECT city, model, abs_error_eur, actual_price_eur, '{c}' AS segment_type, CAST({c} AS VARCHAR) AS segment FROM bb" for c in [*_SEGS, 'actual_price_band'])})
SELECT city, model, segment_type, segment, count(*) AS rows, {pround_sql('avg(abs_error_eur)', 4)} AS mae_eur,
  {pround_sql('median(abs_error_eur)', 4)} AS median_abs_error_eur, {pround_sql('quantile_cont(abs_error_eur, 0.9)', 4)} AS p90_abs_error_eur,
  {pround_sql('avg(actual_price_eur)', 4)} AS mean_actual_price_eur
FROM lg GROUP BY city, model, segment_type, segment HAVING count(*) >= 30""")
def error_segments(spark, sf_dir):
    """ML10: where the best baseline per city errs: MAE / median / p90 by five segmentations."""
    frame = written_once(_baseline_frame(spark, sf_dir).withColumn("capacity_bucket", ft.capacity_bucket("accommodates")))
    met = ml.regression_metrics(frame, ["city", "model"])
    best = written_once(ml.leaderboard(met, ["city"], top=1).select("city", "model"))
    return ml.error_segments(frame.join(best, ["city", "model"]), _SEGS)


@register("ml13_segment_audit", with_views("listings") + f"""
SELECT city, property_group, count(*) AS rows, CAST(sum(CASE WHEN {_SPLIT} THEN 0 ELSE 1 END) AS BIGINT) AS train_rows,
  CAST(sum(CASE WHEN {_SPLIT} THEN 1 ELSE 0 END) AS BIGINT) AS test_rows, {pround_sql('median(price_eur)', 2)} AS median_price_eur,
  {pround_sql('avg(price_eur)', 2)} AS mean_price_eur,
  CASE WHEN count(*) >= 300 AND sum(CASE WHEN {_SPLIT} THEN 1 ELSE 0 END) >= 60 THEN 'Modelled' ELSE 'Skipped - too few rows' END AS model_status
FROM listings GROUP BY city, property_group""")
def audit(spark, sf_dir):
    """ML13: property-group segment audit (rows, split sizes, medians, modelled/skipped)."""
    return ml.segment_audit(_model_input(spark, sf_dir), "property_group")


@register("ml12_room_type_model_status", with_views("listings") + """
SELECT city, room_type, count(*) AS rows, CASE WHEN count(*) >= 600 THEN 'Trained' ELSE 'Skipped' END AS status
FROM listings GROUP BY city, room_type""")
def room_status(spark, sf_dir):
    """ML12: which room types get their own model (>= 600 rows)."""
    return ml.segment_status(fx.listings(spark, sf_dir), "room_type")


_LB = f""", met AS ({_metrics_sql('city, model')})
SELECT *, CAST(rank AS BIGINT) AS rank2 FROM (SELECT *, row_number() OVER (PARTITION BY city ORDER BY rmse_eur NULLS LAST, mae_eur NULLS LAST, model) AS rank,
  CAST(dense_rank() OVER (PARTITION BY city ORDER BY rmse_eur) AS BIGINT) AS rmse_dense_rank FROM met)"""


@register("wn10_model_leaderboard", _BASE_CTE + f""", met AS ({_metrics_sql('city, model')}),
lb AS (SELECT *, row_number() OVER (PARTITION BY city ORDER BY rmse_eur NULLS LAST, mae_eur NULLS LAST, model) AS rank,
  dense_rank() OVER (PARTITION BY city ORDER BY rmse_eur) AS rmse_dense_rank FROM met)
SELECT city, model, test_rows, rmse_eur, mae_eur, r2, CAST(rank AS BIGINT) AS rank, CAST(rmse_dense_rank AS BIGINT) AS rmse_dense_rank,
  rank = 1 AS is_best FROM lb WHERE rank <= 3""")
def leaderboard(spark, sf_dir):
    """WN10+WN4+WN5: top-3 models per city with rank, dense rank and best flag."""
    return ml.leaderboard(ml.regression_metrics(_baseline_frame(spark, sf_dir), ["city", "model"]))


@register("ml11_compare_with_reference", _BASE_CTE + f""", met AS ({_metrics_sql('city, model')}),
ref AS (SELECT city, rmse_eur AS reference_rmse_eur, mae_eur AS reference_mae_eur FROM met WHERE model = 'City median baseline')
SELECT met.*, ref.reference_rmse_eur, ref.reference_mae_eur, rmse_eur - reference_rmse_eur AS rmse_delta_eur,
  (reference_rmse_eur - rmse_eur) / reference_rmse_eur * 100 AS rmse_improvement_pct, mae_eur - reference_mae_eur AS mae_delta_eur
FROM met LEFT JOIN ref ON met.city = ref.city""")
def vs_reference(spark, sf_dir):
    """ML11: every model against the stored city-median reference model."""
    met = ml.regression_metrics(_baseline_frame(spark, sf_dir), ["city", "model"])
    return ml.compare_with_reference(met, "City median baseline")


@register("jn12_segment_vs_benchmark", _BASE_CTE + f""", seg AS ({_metrics_sql('city, property_group, model')}),
cm AS ({_metrics_sql('city, model')})
SELECT seg.*, cm.rmse_eur AS benchmark_rmse_eur, cm.mae_eur AS benchmark_mae_eur, seg.rmse_eur - cm.rmse_eur AS rmse_delta_eur,
  coalesce(seg.rmse_eur < cm.rmse_eur, false) AS helped
FROM seg LEFT JOIN cm ON seg.city = cm.city AND seg.model = cm.model""")
def seg_vs_bench(spark, sf_dir):
    """JN12: property-group metrics vs the city benchmark with deltas and 'helped'."""
    frame = _baseline_frame(spark, sf_dir)
    seg = ml.regression_metrics(frame, ["city", "property_group", "model"])
    city = ml.regression_metrics(frame, ["city", "model"])
    return ml.segment_vs_benchmark(seg, city)


@register("jn16_replace_refreshed_rows", _BASE_CTE + f""", met AS ({_metrics_sql('city, model')}),
new AS (SELECT city, model, test_rows, {pround_sql('rmse_eur', 2)} AS rmse_eur, {pround_sql('mae_eur', 2)} AS mae_eur,
  {pround_sql('r2', 2)} AS r2 FROM met WHERE model = 'Room type median baseline')
SELECT * FROM met WHERE NOT EXISTS (SELECT 1 FROM new WHERE new.city = met.city AND new.model = met.model)
UNION ALL SELECT * FROM new""")
def replace(spark, sf_dir):
    """JN16: refreshed result rows replace old ones (anti join + union)."""
    met = ml.regression_metrics(_baseline_frame(spark, sf_dir), ["city", "model"])
    new = met.filter(F.col("model") == "Room type median baseline").select(
        "city", "model", "test_rows", *[F.rint(F.col(c) * 100.0).alias(c) for c in ("rmse_eur", "mae_eur", "r2")])
    new = new.select("city", "model", "test_rows", *[(F.col(c) / 100.0).alias(c) for c in ("rmse_eur", "mae_eur", "r2")])
    return ml.replace_rows(met, new, ["city", "model"])


@register("tx8_model_summary_text", _BASE_CTE + f""", met AS ({_metrics_sql('city, model')}),
best AS (SELECT * FROM met QUALIFY row_number() OVER (PARTITION BY city ORDER BY rmse_eur NULLS LAST, mae_eur NULLS LAST, model) = 1)
SELECT city, printf('Best model for %s: %s (RMSE EUR %.2f, MAE EUR %.2f, R2 %.3f).', city, model,
  {pround_sql('rmse_eur', 2)}, {pround_sql('mae_eur', 2)}, {pround_sql('r2', 3)}) AS summary FROM best""")
def summary_text(spark, sf_dir):
    """TX8: best-model sentence per city."""
    return ml.model_summary_text(ml.regression_metrics(_baseline_frame(spark, sf_dir), ["city", "model"]))


@register("ml2_label_encoding", with_views("listings") + """
SELECT listing_id, room_type, CAST(dense_rank() OVER (ORDER BY room_type) - 1 AS BIGINT) AS room_type_index
FROM listings WHERE room_type IS NOT NULL""")
def label_encoding(spark, sf_dir):
    """ML2: alphabetical label encoding of room type (StringIndexer, alphabetAsc)."""
    l = fx.listings(spark, sf_dir).select("listing_id", "room_type").filter(F.col("room_type").isNotNull())
    idx = StringIndexer(inputCol="room_type", outputCol="_i", stringOrderType="alphabetAsc").fit(l)
    return idx.transform(l).select("listing_id", "room_type", F.col("_i").cast("bigint").alias("room_type_index"))


# ------------------------------------------------ supervised (rows-only)
def _ml_table(spark, sf_dir):
    return fx.listings(spark, sf_dir).filter(F.col("price_eur") > 0)


_SMALL = {"decision_tree": {"maxDepth": 6}, "random_forest": {"numTrees": 20, "maxDepth": 6},
          "gbt": {"maxIter": 20, "maxDepth": 4}}


@register("ml4_model_families")
def families(spark, sf_dir):
    """ML1+ML3+ML4+ML7: linear, ridge, lasso, elastic net, tree, forest, extra trees and GBT on log price; EUR metrics."""
    return ml.train_and_score(_ml_table(spark, sf_dir),
                              ["linear", "ridge", "lasso", "elastic_net", "decision_tree", "random_forest",
                               "extra_trees", "gbt"],
                              **_SMALL, extra_trees={"numTrees": 20, "maxDepth": 6})


@register("ml5_cross_validation")
def cv(spark, sf_dir):
    """ML5: 3-fold CV (md5 folds) of a random forest; mean/std of EUR metrics."""
    return ml.cross_validate(_ml_table(spark, sf_dir), "random_forest", k=3, numTrees=20, maxDepth=6)


@register("ml6_random_search")
def search(spark, sf_dir):
    """ML6: seeded random search over a GBT grid, 3-fold CV each, ranked."""
    return ml.random_search(_ml_table(spark, sf_dir), "gbt", {"maxDepth": [3, 5], "maxIter": [10, 20],
                                                              "stepSize": [0.1, 0.2]}, n_iter=4, k=3)


@register("ml9_feature_importance")
def importance(spark, sf_dir):
    """ML9: top-10 forest importances with readable (one-hot expanded) feature names."""
    t = spread(_ml_table(spark, sf_dir))
    model = ml.fit_price_model(t, "random_forest", numTrees=20, maxDepth=6)
    return ml.feature_importance(model, t, top=10)


@register("ml14_segment_models")
def segment_models(spark, sf_dir):
    """ML14: a model per property group with enough rows; metrics per segment."""
    return ml.segment_models(_ml_table(spark, sf_dir), "property_group", "random_forest", numTrees=10, maxDepth=5)


@register("ml16_model_artifact_manifest")
def artifact(spark, sf_dir):
    """ML16: fit, persist under the shared checkpoint folder, and return the manifest row."""
    t = spread(_ml_table(spark, sf_dir))
    model = ml.fit_price_model(t, "gbt", maxIter=10, maxDepth=4)
    return ml.save_model(model, "gbt_city_price", spark, {"train_rows": t.count()})


@register("ml17_baseline_vs_supervised")
def baseline_vs_supervised(spark, sf_dir):
    """ML17: baselines and supervised models in one leaderboard with dense rank and best flag."""
    base = ml.regression_metrics(_baseline_frame(spark, sf_dir), ["city", "model"])
    sup = ml.train_and_score(_ml_table(spark, sf_dir), ["random_forest"], **_SMALL)
    return ml.leaderboard(base.unionByName(sup), ["city"], top=None)
