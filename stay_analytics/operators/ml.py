"""Price models and their evaluation (ML1-ML17, JN11, JN12, JN16, WN4, WN5, WN10, TX8).

* Splits and folds are *columns* derived from an md5 of the key, so they are
  stable under repartitioning and reproducible in any engine.
* Median baselines (JN11/ML15) are aggregates joined back with a coalesce
  cascade, so they are SQL-checkable.
* Supervised models are ``pyspark.ml`` pipelines trained on the whole table
  (distributed fit); only per-model metric rows reach the driver.
"""

from __future__ import annotations

import math
import os
import random
import uuid
from collections.abc import Sequence

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.evaluation import RegressionEvaluator
from pyspark.ml.feature import Imputer, OneHotEncoder, StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import (DecisionTreeRegressor, GBTRegressor, LinearRegression,
                                   RandomForestRegressor)
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import from_log_target, pround
from ..session import at_once, ensure_checkpoint_dir, spread, written_once
from .ranking import grouped, median_of, Quantile

# ----------------------------------------------------------------- splits


def hash_fraction_threshold(fraction: float) -> str:
    """Hex prefix bound: md5 prefix (8 hex) < bound  <=>  uniform in [0,1) < fraction."""
    return format(min(math.ceil(fraction * 2 ** 32), 2 ** 32 - 1), "08x")


def split_column(key, test_fraction: float = 0.2, seed: int = 42) -> Column:
    """ML3: True for test rows; md5 of (seed, key) so the split is stable and engine-independent."""
    k = F.col(key) if isinstance(key, str) else key
    prefix = F.substring(F.md5(F.concat(F.lit(f"{seed}:"), k.cast("string"))), 1, 8)
    return prefix < F.lit(hash_fraction_threshold(test_fraction))


def fold_column(key, k: int = 3, seed: int = 42) -> Column:
    """ML5: fold id in [0, k) from md5 of (seed, key)."""
    kk = F.col(key) if isinstance(key, str) else key
    h = F.conv(F.substring(F.md5(F.concat(F.lit(f"fold{seed}:"), kk.cast("string"))), 1, 8), 16, 10)
    return (h.cast("bigint") % k).cast("int")


# -------------------------------------------------------- baselines / metrics
BASELINE_GRAINS = [
    ("City median baseline", []),
    ("Room type median baseline", ["room_type"]),
    ("Neighbourhood + room median baseline", ["neighbourhood_cleansed", "room_type"]),
    ("Neighbourhood + room + size median baseline", ["neighbourhood_cleansed", "room_type", "accommodates"]),
]


def baseline_predictions(df: DataFrame, target: str = "price_eur", city: str = "city",
                         is_test: str = "is_test") -> DataFrame:
    """JN11/ML15: test rows with predictions from four median baselines (long form).

    Each grain's train medians are one aggregate; a test row takes the finest
    grain's median, then the next coarser, then the city median (cascade).
    """
    df = written_once(df)  # read by every grain's medians and by the test rows
    train = df.filter(~F.col(is_test) & F.col(target).isNotNull())
    test = df.filter(F.col(is_test) & F.col(target).isNotNull())
    preds = test
    names = []
    for i, (_, grain) in enumerate(BASELINE_GRAINS):
        keys = [city, *grain]
        med = written_once(grouped(train, [*keys], median_of(target).alias(f"_m{i}")))
        preds = preds.join(med, keys, "left")
        names.append(f"_m{i}")
    cascade = []
    for i in range(len(BASELINE_GRAINS)):
        # grain i falls back to grain i-1's prediction (room -> city, neighbourhood+room -> room ...)
        chain = [F.col(names[j]) for j in range(i, -1, -1)]
        cascade.append(F.coalesce(*chain) if i else F.col(names[0]))
    cells = F.array(*[F.struct(F.lit(n).alias("model"), c.alias("predicted_price_eur"))
                      for (n, _), c in zip(BASELINE_GRAINS, cascade)])
    keep = [c for c in df.columns if c != is_test]
    return preds.select(*keep, F.inline(cells)).withColumnRenamed(target, "actual_price_eur")


def regression_metrics(pred: DataFrame, by: Sequence[str], actual: str = "actual_price_eur",
                       predicted: str = "predicted_price_eur", digits: int | None = 4) -> DataFrame:
    """ML7: RMSE, MAE, R^2 per group in one aggregate (R^2 from the population variance)."""
    err = F.col(actual) - F.col(predicted)
    g = pred.groupBy(*by).agg(
        F.count(F.lit(1)).alias("test_rows"),
        F.sqrt(F.avg(err * err)).alias("rmse_eur"),
        F.avg(F.abs(err)).alias("mae_eur"),
        (F.sum(err * err) / (F.var_pop(actual) * F.count(actual))).alias("_rel"))
    g = g.withColumn("r2", F.when(F.col("_rel").isNotNull(), F.lit(1.0) - F.col("_rel"))).drop("_rel")
    if digits is not None:
        for c in ("rmse_eur", "mae_eur", "r2"):
            g = g.withColumn(c, pround(c, digits))
    return g


def prediction_frame(pred: DataFrame, actual: str = "actual_price_eur",
                     predicted: str = "predicted_price_eur") -> DataFrame:
    """ML8: residual and absolute error columns."""
    return pred.withColumn("residual_eur", F.col(actual) - F.col(predicted)) \
               .withColumn("abs_error_eur", F.abs(F.col(actual) - F.col(predicted)))


def residual_summary(frame: DataFrame, by: Sequence[str]) -> DataFrame:
    """ML8: residual mean / sample std / MAE per group."""
    return frame.groupBy(*by).agg(F.avg("residual_eur").alias("residual_mean"),
                                  F.stddev_samp("residual_eur").alias("residual_std"),
                                  F.avg("abs_error_eur").alias("mae_eur"))


def error_segments(frame: DataFrame, segment_cols: Sequence[str], by: Sequence[str] = ("city", "model"),
                   min_rows: int = 30, price_band_quartiles: bool = True) -> DataFrame:
    """ML10: rows, MAE, median and p90 absolute error, mean actual per segment, for several
    segmentations at once (unpivoted), groups with >= ``min_rows``. The price band segmentation
    uses the group's actual-price quartile edges."""
    by = list(by)
    x = written_once(frame)
    cols = list(segment_cols)
    if price_band_quartiles:
        edges = written_once(grouped(x, by, *[Quantile("actual_price_eur", q).alias(f"_e{i}") for i, q in enumerate((0.25, 0.5, 0.75))]).select(
            *by, F.array("_e0", "_e1", "_e2").alias("_e")))
        x = x.join(edges, by)
        a = F.col("actual_price_eur")
        band = (F.when(a <= F.col("_e")[0], "low").when(a <= F.col("_e")[1], "mid-low")
                .when(a <= F.col("_e")[2], "mid-high").otherwise("high"))
        x = x.withColumn("actual_price_band", band).drop("_e")
        cols.append("actual_price_band")
    long = x.select(*by, "abs_error_eur", "actual_price_eur", F.inline(F.array(*[
        F.struct(F.lit(c).alias("segment_type"), F.col(c).cast("string").alias("segment")) for c in cols])))
    g = grouped(long, [*by, "segment_type", "segment"], F.count(F.lit(1)).alias("rows"), pround(F.avg("abs_error_eur"), 4).alias("mae_eur"),
        median_of("abs_error_eur", 4).alias("median_abs_error_eur"),
        Quantile("abs_error_eur", 0.9, 4).alias("p90_abs_error_eur"),
        pround(F.avg("actual_price_eur"), 4).alias("mean_actual_price_eur"))
    return g.filter(F.col("rows") >= min_rows)


def segment_audit(df: DataFrame, segment: str, by: Sequence[str] = ("city",), target: str = "price_eur",
                  is_test: str = "is_test", min_rows: int = 300, min_test: int = 60) -> DataFrame:
    """ML13: rows, train/test rows, medians and modelled/skipped status per segment."""
    t = F.col(is_test)
    g = grouped(df, [*by, segment], F.count(F.lit(1)).alias("rows"), F.sum((~t).cast("int")).alias("train_rows"),
        F.sum(t.cast("int")).alias("test_rows"), median_of(target, 2).alias("median_price_eur"),
        pround(F.avg(target), 2).alias("mean_price_eur"))
    ok = (F.col("rows") >= min_rows) & (F.col("test_rows") >= min_test)
    return g.withColumn("model_status", F.when(ok, "Modelled").otherwise("Skipped - too few rows"))


def segment_status(df: DataFrame, segment: str, by: Sequence[str] = ("city",), min_rows: int = 600) -> DataFrame:
    """ML12: which segments get their own model (>= ``min_rows``) and which are 'Skipped'."""
    g = df.groupBy(*by, segment).agg(F.count(F.lit(1)).alias("rows"))
    return g.withColumn("status", F.when(F.col("rows") >= min_rows, "Trained").otherwise("Skipped"))


def leaderboard(metrics: DataFrame, by: Sequence[str] = ("city",), top: int | None = 3) -> DataFrame:
    """WN10/WN4/WN5/ML17: rank models per group by RMSE (ties: MAE, name), dense rank and best flag."""
    w = Window.partitionBy(*by).orderBy(F.col("rmse_eur").asc_nulls_last(), F.col("mae_eur").asc_nulls_last(),
                                        F.col("model").asc())
    out = (metrics.withColumn("rank", F.row_number().over(w))
           .withColumn("rmse_dense_rank", F.dense_rank().over(Window.partitionBy(*by).orderBy("rmse_eur")))
           .withColumn("is_best", F.col("rank") == 1))
    return out.filter(F.col("rank") <= top) if top else out


def compare_with_reference(metrics: DataFrame, reference_model: str, by: Sequence[str] = ("city",)) -> DataFrame:
    """ML11: each model vs a stored reference model: RMSE/MAE deltas and % improvement."""
    by = list(by)
    ref = metrics.filter(F.col("model") == reference_model).select(
        *by, F.col("rmse_eur").alias("reference_rmse_eur"), F.col("mae_eur").alias("reference_mae_eur"))
    j = metrics.join(ref, by, "left")
    return j.withColumn("rmse_delta_eur", F.col("rmse_eur") - F.col("reference_rmse_eur")) \
            .withColumn("rmse_improvement_pct", (F.col("reference_rmse_eur") - F.col("rmse_eur"))
                        / F.col("reference_rmse_eur") * 100) \
            .withColumn("mae_delta_eur", F.col("mae_eur") - F.col("reference_mae_eur"))


def segment_vs_benchmark(segment_metrics: DataFrame, city_metrics: DataFrame,
                         by: Sequence[str] = ("city", "model")) -> DataFrame:
    """JN12: segment metrics joined to the city-level benchmark; deltas and 'helped' flag."""
    by = list(by)
    bench = city_metrics.select(*by, F.col("rmse_eur").alias("benchmark_rmse_eur"),
                                F.col("mae_eur").alias("benchmark_mae_eur"))
    j = segment_metrics.join(bench, by, "left")
    return (j.withColumn("rmse_delta_eur", F.col("rmse_eur") - F.col("benchmark_rmse_eur"))
            .withColumn("helped", F.coalesce(F.col("rmse_eur") < F.col("benchmark_rmse_eur"), F.lit(False))))


def replace_rows(existing: DataFrame, new_rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """JN16: drop existing rows whose key is being refreshed, append the new rows."""
    return existing.join(new_rows.select(*keys).distinct(), list(keys), "left_anti") \
                   .unionByName(new_rows, allowMissingColumns=True)


def model_summary_text(metrics: DataFrame, by: Sequence[str] = ("city",)) -> DataFrame:
    """TX8: one sentence per group naming the best model and its errors."""
    best = leaderboard(metrics, by, top=1)
    return best.select(*by, F.format_string("Best model for %s: %s (RMSE EUR %.2f, MAE EUR %.2f, R2 %.3f).",
                                            F.col(by[0]), F.col("model"), pround("rmse_eur", 2),
                                            pround("mae_eur", 2), pround("r2", 3)).alias("summary"))


# ------------------------------------------------------------ supervised ML
NUMERIC_FEATURES = ["distance_to_center_km", "availability_30", "availability_365", "minimum_nights",
                    "number_of_reviews", "accommodates", "amenities_count", "review_scores_rating",
                    "review_scores_value", "has_wifi", "has_kitchen", "has_air_conditioning"]
CATEGORICAL_FEATURES = ["room_type", "property_group", "neighbourhood_cleansed"]


def preprocessing_stages(numeric: Sequence[str], categorical: Sequence[str], scale: bool = False) -> list:
    """ML1: median imputation, "Unknown" fill via indexer keep, one-hot (unknowns ignored), assembly."""
    stages = []
    num_out = [f"{c}__imp" for c in numeric]
    if numeric:
        stages.append(Imputer(strategy="median", inputCols=list(numeric), outputCols=num_out))
    idx_out = [f"{c}__idx" for c in categorical]
    oh_out = [f"{c}__oh" for c in categorical]
    if categorical:
        stages.append(StringIndexer(inputCols=list(categorical), outputCols=idx_out, handleInvalid="keep",
                                    stringOrderType="frequencyDesc"))
        stages.append(OneHotEncoder(inputCols=idx_out, outputCols=oh_out, handleInvalid="keep", dropLast=False))
    assembled = "features_raw" if scale else "features"
    stages.append(VectorAssembler(inputCols=num_out + oh_out, outputCol=assembled, handleInvalid="keep"))
    if scale:
        stages.append(StandardScaler(inputCol="features_raw", outputCol="features", withMean=True, withStd=True))
    return stages


def model_family(name: str, **params):
    """ML4: estimator per family (GBT stands in for the boosting libraries)."""
    fams = {
        "linear": lambda: LinearRegression(labelCol="label", maxIter=50, **params),
        "ridge": lambda: LinearRegression(labelCol="label", maxIter=50, elasticNetParam=0.0,
                                          regParam=params.get("regParam", 0.1)),
        "lasso": lambda: LinearRegression(labelCol="label", maxIter=50, elasticNetParam=1.0,
                                          regParam=params.get("regParam", 0.01)),
        "elastic_net": lambda: LinearRegression(labelCol="label", maxIter=50, elasticNetParam=0.5,
                                                regParam=params.get("regParam", 0.05)),
        "decision_tree": lambda: DecisionTreeRegressor(labelCol="label", seed=42, **params),
        "random_forest": lambda: RandomForestRegressor(labelCol="label", seed=42, **params),
        "extra_trees": lambda: RandomForestRegressor(labelCol="label", seed=42, bootstrap=False,
                                                     featureSubsetStrategy="sqrt", **params),
        "gbt": lambda: GBTRegressor(labelCol="label", seed=42, **params),
    }
    return fams[name]()


LINEAR_FAMILIES = ("linear", "ridge", "lasso", "elastic_net")


def fit_preprocessing(train: DataFrame, scale: bool = False, numeric=NUMERIC_FEATURES, categorical=CATEGORICAL_FEATURES) -> PipelineModel:
    """ML1: the fitted preprocessing of a training table; models on the same rows share it."""
    numeric = [c for c in numeric if c in train.columns]
    categorical = [c for c in categorical if c in train.columns]
    return Pipeline(stages=preprocessing_stages(numeric, categorical, scale)).fit(_with_doubles(train, numeric))


def fit_price_model(train: DataFrame, family: str = "random_forest", numeric=NUMERIC_FEATURES,
                    categorical=CATEGORICAL_FEATURES, target: str = "price_eur", prepared: PipelineModel | None = None, **params) -> PipelineModel:
    """ML1+ML4: pipeline on the log1p target (distributed fit over the whole training table).

    ``prepared`` is the preprocessing fitted on ``train``, if it is there already.
    """
    prepared = prepared or fit_preprocessing(train, family in LINEAR_FAMILIES, numeric, categorical)
    data = _with_doubles(train, [c for c in numeric if c in train.columns]).withColumn("label", F.log1p(F.col(target)))
    return PipelineModel(stages=[*prepared.stages, model_family(family, **params).fit(prepared.transform(data))])


def _with_doubles(df: DataFrame, numeric: Sequence[str]) -> DataFrame:
    out = df
    for c in numeric:
        out = out.withColumn(c, F.col(c).cast("double"))
    return out


def predict_prices(model: PipelineModel, df: DataFrame, numeric=NUMERIC_FEATURES) -> DataFrame:
    """Score rows; prediction back-transformed to EUR (``max(expm1, 0)``)."""
    numeric = [c for c in numeric if c in df.columns]
    out = model.transform(_with_doubles(df, numeric))
    return out.withColumn("predicted_price_eur", from_log_target("prediction"))


def train_and_score(df: DataFrame, families: Sequence[str] = ("linear", "random_forest", "gbt"),
                    key: str = "listing_id", target: str = "price_eur", by: Sequence[str] = ("city",),
                    **params) -> DataFrame:
    """ML3+ML4+ML7: fit each family on the 80 % split and score the 20 % in EUR (metric rows)."""
    data = spread(df.filter(F.col(target).isNotNull()).withColumn("is_test", split_column(key)))
    train, test = data.filter(~F.col("is_test")), data.filter(F.col("is_test"))
    prepared = {scale: fit_preprocessing(train, scale) for scale in {fam in LINEAR_FAMILIES for fam in families}}
    models = at_once(df.sparkSession, [lambda fam=fam: fit_price_model(train, fam, target=target, prepared=prepared[fam in LINEAR_FAMILIES], **params.get(fam, {}))
                                       for fam in families])
    rows = None
    for fam, model in zip(families, models, strict=True):
        pred = predict_prices(model, test).select(*by, F.col(target).alias("actual_price_eur"),
                                                  "predicted_price_eur").withColumn("model", F.lit(fam))
        m = regression_metrics(pred, [*by, "model"])
        rows = m if rows is None else rows.unionByName(m)
    return rows


def fold_models(df: DataFrame, family: str, candidates: Sequence[dict], k: int = 3, key: str = "listing_id",
                target: str = "price_eur") -> tuple[DataFrame, list[list[PipelineModel]]]:
    """(rows with ``_fold``, per candidate the model of each left-out fold). Rows are written once, a fold's preprocessing is fitted once."""
    data = spread(df.filter(F.col(target).isNotNull()).withColumn("_fold", fold_column(key, k)))
    trains = [data.filter(F.col("_fold") != f) for f in range(k)]
    prepared = at_once(df.sparkSession, [lambda t=t: fit_preprocessing(t, family in LINEAR_FAMILIES) for t in trains])
    models = at_once(df.sparkSession, [lambda t=t, p=p, params=params: fit_price_model(t, family, target=target, prepared=p, **params)
                                       for params in candidates for t, p in zip(trains, prepared, strict=True)])
    return data, [models[i:i + k] for i in range(0, len(models), k)]


def fold_scores(data: DataFrame, models: Sequence[PipelineModel], family: str, target: str = "price_eur") -> DataFrame:
    """ML5: EUR metrics of each fold by the model that left it out, and their mean / std (one row)."""
    allp = None
    for f, model in enumerate(models):
        pred = predict_prices(model, data.filter(F.col("_fold") == f)).select(
            F.col(target).alias("actual_price_eur"), "predicted_price_eur").withColumn("fold", F.lit(f))
        allp = pred if allp is None else allp.unionByName(pred)
    per_fold = regression_metrics(allp, ["fold"], digits=None)
    return per_fold.agg(F.lit(family).alias("model"), F.avg("rmse_eur").alias("cv_rmse_mean"),
                        F.stddev_samp("rmse_eur").alias("cv_rmse_std"), F.avg("mae_eur").alias("cv_mae_mean"),
                        F.avg("r2").alias("cv_r2_mean"), F.count(F.lit(1)).alias("folds"))


def cross_validate(df: DataFrame, family: str, k: int = 3, key: str = "listing_id", target: str = "price_eur",
                   **params) -> DataFrame:
    """ML5: k folds from a key hash; per-fold EUR metrics and their mean / std (one row)."""
    data, models = fold_models(df, family, [params], k, key, target)
    return fold_scores(data, models[0], family, target)


def random_search(df: DataFrame, family: str, grid: dict, n_iter: int = 4, k: int = 3, seed: int = 42,
                  key: str = "listing_id", target: str = "price_eur", **params) -> DataFrame:
    """ML6: seeded sample of a parameter grid, each scored by k-fold CV; ranked result table."""
    keys = sorted(grid)
    combos = [{}]
    for kname in keys:
        combos = [{**c, kname: v} for c in combos for v in grid[kname]]
    rng = random.Random(seed)
    picks = rng.sample(combos, min(n_iter, len(combos)))
    data, models = fold_models(df, family, [{**params, **pick} for pick in picks], k, key, target)
    rows = None
    for i, (pick, fitted) in enumerate(zip(picks, models, strict=True)):
        r = fold_scores(data, fitted, family, target).withColumn("candidate", F.lit(i)).withColumn("params", F.lit(str(pick)))
        rows = r if rows is None else rows.unionByName(r)
    return rows.withColumn("rank", F.rank().over(Window.orderBy("cv_rmse_mean")))


def feature_importance(model: PipelineModel, df: DataFrame, top: int | None = 10) -> DataFrame:
    """ML9: importances (trees) or |coef| (linear) with readable names from the vector metadata."""
    est = model.stages[-1]
    scored = model.transform(_with_doubles(df, [c for c in NUMERIC_FEATURES if c in df.columns]))
    meta = scored.schema["features"].metadata.get("ml_attr", {}).get("attrs", {})
    names = {}
    for group in meta.values():
        for a in group:
            names[a["idx"]] = a["name"]
    if hasattr(est, "featureImportances"):
        vals = est.featureImportances.toArray().tolist()
    else:
        vals = [abs(v) for v in est.coefficients.toArray().tolist()]
    spark = df.sparkSession
    rows = [(names.get(i, f"f{i}"), float(v)) for i, v in enumerate(vals)]
    out = spark.createDataFrame(rows, "feature string, importance double")
    w = Window.orderBy(F.col("importance").desc(), F.col("feature"))
    out = out.withColumn("rank", F.row_number().over(w))
    return out.filter(F.col("rank") <= top) if top else out


def segment_models(df: DataFrame, segment: str, family: str = "random_forest", min_rows: int = 300,
                   min_test: int = 60, key: str = "listing_id", target: str = "price_eur", **params) -> DataFrame:
    """ML14: a model per qualifying segment (few segments, each fit distributed); metrics per segment."""
    data = spread(df.filter(F.col(target).isNotNull()).withColumn("is_test", split_column(key)))
    audit = segment_audit(data, segment, by=[], target=target, min_rows=min_rows, min_test=min_test)
    # only the (few) qualifying segment names reach the driver
    keep = [r[segment] for r in audit.filter(F.col("model_status") == "Modelled").select(segment).collect()]
    parts = [data.filter(F.col(segment) == value) for value in keep]
    models = at_once(df.sparkSession, [lambda part=part: fit_price_model(part.filter(~F.col("is_test")), family, target=target, **params) for part in parts])
    rows = None
    for value, part, model in zip(keep, parts, models, strict=True):
        pred = predict_prices(model, part.filter(F.col("is_test"))).select(
            F.lit(value).alias(segment), F.col(target).alias("actual_price_eur"), "predicted_price_eur")
        m = regression_metrics(pred.withColumn("model", F.lit(family)), [segment, "model"])
        rows = m if rows is None else rows.unionByName(m)
    return rows


def save_model(model: PipelineModel, name: str, spark, metrics: dict | None = None,
               base_dir: str | None = None) -> DataFrame:
    """ML16: persist the pipeline under the shared checkpoint folder; return a manifest row."""
    base = base_dir or os.path.join(ensure_checkpoint_dir(spark), "models")
    path = os.path.join(base, f"{name}-{uuid.uuid4().hex[:8]}")
    model.write().overwrite().save(path)
    row = {"model": name, "artifact": path, **{k: float(v) for k, v in (metrics or {}).items()}}
    return spark.createDataFrame([row])


def vector_max(c) -> Column:
    return F.array_max(vector_to_array(F.col(c) if isinstance(c, str) else c))


__all__ = ["RegressionEvaluator"]
