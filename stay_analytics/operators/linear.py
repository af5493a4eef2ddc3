"""Linear and ridge price models of many segments from one pass (ML1, ML4, ML5, ML6, ML12, ML14).

A least-squares fit needs only the Gram matrix of its features, and Gram
matrices add up. So the data are read once: rows become cells of (city, fold,
categories), each with the sums of products of the numeric features, which
aggregate map-side. Cells are merged into the Gram matrix of a city or a
segment of it, of a training fold (all parts less one), and every penalty is
solved from there in closed form. The number of fits does not change the number
of passes, and a task of a segment holds cells and matrices, never rows.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import from_log_target, pround
from ..session import cut_lineage
from .ml import CATEGORICAL_FEATURES, NUMERIC_FEATURES, fold_column, regression_metrics, split_column
from .ranking import grouped, median_of

#: 0 is least squares; the others are ridge penalties on standardised features.
PENALTIES = (0.0, 0.1, 1.0, 10.0, 100.0)
#: A feature is left out (coefficient 0) if elimination leaves at most this share of its sum of squares: it follows from those before it.
DEPENDENT = 1e-9
#: The fold of rows that are tested and never trained on, and the left-out fold of a fit on all training rows.
TEST = -1
WHOLE = "city"


def fill_features(df: DataFrame, numeric: Sequence[str] = NUMERIC_FEATURES, categorical: Sequence[str] = CATEGORICAL_FEATURES,
                  by: str = "city", fold: str = "fold") -> DataFrame:
    """ML1: nulls become the city's median (numeric) or most frequent level (categories; ties to the smallest) over training rows.

    A feature without any value in a city is 0, or the level "Unknown".
    """
    train = df.filter(F.col(fold) != TEST)
    out = df.join(grouped(train, [by], *[median_of(c).alias(f"_med_{c}") for c in numeric]), by, "left")
    for c in numeric:
        out = out.withColumn(c, F.coalesce(F.col(c).cast("double"), F.col(f"_med_{c}"), F.lit(0.0)))
    for c in categorical:
        counts = train.filter(F.col(c).isNotNull()).groupBy(by, c).agg(F.count(F.lit(1)).alias("_n"))
        out = out.join(counts.groupBy(by).agg(F.min(F.struct(-F.col("_n"), F.col(c).alias("level")))["level"].alias(f"_mode_{c}")), by, "left")
        out = out.withColumn(c, F.coalesce(c, f"_mode_{c}", F.lit("Unknown")))
    return out.drop(*[f"_med_{c}" for c in numeric], *[f"_mode_{c}" for c in categorical])


def model_table(df: DataFrame, key: str = "listing_id", target: str = "price_eur", folds: int = 3, numeric: Sequence[str] = NUMERIC_FEATURES,
                categorical: Sequence[str] = CATEGORICAL_FEATURES, by: str = "city") -> DataFrame:
    """Rows with a positive target, filled features, ``label`` (log1p) and ``fold``: ``TEST`` or the part of the training rows.

    Written once, as fits and scores read it several times; so are the rows before filling, which the medians and levels read.
    """
    rows = df.filter(F.col(target) > 0).select(key, by, target, *numeric, *categorical).withColumn(
        "fold", F.when(split_column(key), TEST).otherwise(fold_column(key, folds)))
    return cut_lineage(fill_features(cut_lineage(rows), numeric, categorical, by).withColumn("label", F.log1p(F.col(target))))


def moment_cells(rows: DataFrame, numeric: Sequence[str] = NUMERIC_FEATURES, categorical: Sequence[str] = CATEGORICAL_FEATURES,
                 by: str = "city") -> DataFrame:
    """One row per (city, fold, categories) of the training rows: sums of products of 1, the numeric features and the label (upper triangle)."""
    z = [F.lit(1.0), *[F.col(c) for c in numeric], F.col("label")]
    sums = [F.sum(z[i] * z[j]) for i in range(len(z)) for j in range(i, len(z))]
    return rows.filter(F.col("fold") != TEST).groupBy(by, "fold", *categorical).agg(F.array(*sums).alias("moments"))


def eliminate(gram: np.ndarray, moment: np.ndarray) -> np.ndarray:
    """Solution of ``gram @ x = moment`` by Gauss-Jordan elimination in feature order; dependent features get 0."""
    m = np.column_stack((gram, moment))
    diagonal = np.diag(gram).copy()
    used = np.zeros(len(gram), dtype=bool)
    for k in range(len(gram)):
        if m[k, k] > DEPENDENT * diagonal[k]:
            used[k] = True
            factors = m[:, k] / m[k, k]
            factors[k] = 0.0
            m -= np.outer(factors, m[k])
    out = np.zeros(len(gram))
    out[used] = m[used, -1] / np.diag(m[:, :-1])[used]
    return out


def segment_column(segments: Sequence[str]) -> Column:
    """One (segment_type, segment) for the whole city and for each of the columns ``segments``."""
    return F.array(F.struct(F.lit(WHOLE).alias("segment_type"), F.lit(WHOLE).alias("segment")),
                   *[F.struct(F.lit(c).alias("segment_type"), F.col(c).alias("segment")) for c in segments])


def fit_segments(cells: DataFrame, segments: Sequence[str] = (), penalties: Sequence[float] = PENALTIES, folds: bool = False,
                 numeric: Sequence[str] = NUMERIC_FEATURES, categorical: Sequence[str] = CATEGORICAL_FEATURES, by: str = "city") -> DataFrame:
    """(city, segment_type, segment, left_out, penalty, base, levels): coefficients of every fit.

    ``base`` has the intercept and the numeric coefficients, ``levels`` a map
    of "category=level" to coefficients. left_out is ``TEST`` for the fit on
    all training rows; with ``folds`` there is one more for each fold, on the
    others. Merged cells make the matrices: a fold's is the whole less its part.
    """
    n_base, size = len(numeric) + 1, len(numeric) + 2
    upper = np.triu_indices(size)

    def fit(key, cells):
        moments = np.zeros((len(cells), size, size))
        moments[:, upper[0], upper[1]] = np.stack(cells["moments"].to_numpy())
        moments[:, upper[1], upper[0]] = moments[:, upper[0], upper[1]]
        told = [[f"{c}={v}" for v in cells[c]] for c in categorical]
        names = [name for c in told for name in sorted(set(c), key=str.encode)]
        place = {name: k for k, name in enumerate(names)}
        levels = np.zeros((len(cells), len(names)))
        for c in told:
            levels[np.arange(len(cells)), [place[x] for x in c]] = 1.0

        def merged(some):
            m, d = moments[some], levels[some]
            gram = np.zeros((n_base + len(names), n_base + len(names)))
            gram[:n_base, :n_base] = m[:, :n_base, :n_base].sum(axis=0)
            gram[n_base:, :n_base] = d.T @ m[:, 0, :n_base]
            gram[:n_base, n_base:] = gram[n_base:, :n_base].T
            gram[n_base:, n_base:] = (d * m[:, 0, :1]).T @ d
            return gram, np.concatenate((m[:, :n_base, -1].sum(axis=0), d.T @ m[:, 0, -1]))

        fold = cells["fold"].to_numpy()
        whole = merged(np.ones(len(cells), dtype=bool))
        fits = [(TEST, *whole)]
        for f in np.unique(fold) if folds else []:
            part = merged(fold == f)
            fits.append((int(f), whole[0] - part[0], whole[1] - part[1]))
        out = []
        for left_out, gram, moment in fits:
            n = gram[0, 0]
            if n <= 0:
                continue
            variance = np.maximum(np.diag(gram) / n - (gram[0] / n) ** 2, 0.0)
            for penalty in penalties:
                x = eliminate(gram + np.diag(penalty * variance), moment)
                out.append((*key, left_out, penalty, x[:n_base].tolist(), names, x[n_base:].tolist()))
        return pd.DataFrame(out, columns=[by, "segment_type", "segment", "left_out", "penalty", "base", "names", "weights"])

    parts = cells.select("*", F.inline(segment_column(segments)))
    fitted = parts.groupBy(by, "segment_type", "segment").applyInPandas(
        fit, f"{by} string, segment_type string, segment string, left_out int, penalty double, base array<double>, names array<string>, weights array<double>")
    return cut_lineage(fitted.withColumn("levels", F.map_from_arrays("names", "weights")).drop("names", "weights"))


def predict(rows: DataFrame, fits: DataFrame, segments: Sequence[str] = (), numeric: Sequence[str] = NUMERIC_FEATURES,
            categorical: Sequence[str] = CATEGORICAL_FEATURES, target: str = "price_eur", by: str = "city", keep: Sequence[str] = ()) -> DataFrame:
    """Every row by every fit of its segments that did not see it: actual and predicted EUR. A level that a fit has not seen counts 0."""
    models = fits.groupBy(by, "segment_type", "segment", "left_out").agg(F.collect_list(F.struct("penalty", "base", "levels")).alias("models"))
    shown = rows.select(by, *[c for c in keep if c != by], F.col(target).alias("actual_price_eur"), F.col("fold").alias("left_out"),
                        F.array(F.lit(1.0), *numeric).alias("x"),
                        F.array(*[F.concat(F.lit(f"{c}="), F.col(c)) for c in categorical]).alias("told"), F.inline(segment_column(segments)))
    met = shown.join(models, [by, "segment_type", "segment", "left_out"]).withColumn("model", F.explode("models"))
    base = F.aggregate(F.zip_with("x", F.col("model.base"), lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)
    levels = sum((F.coalesce(F.try_element_at(F.col("model.levels"), F.col("told")[k]), F.lit(0.0)) for k in range(len(categorical))), F.lit(0.0))
    return met.withColumn("prediction", base + levels).select(
        by, *[c for c in keep if c != by], "segment_type", "segment", "left_out", F.col("model.penalty").alias("penalty"),
        "actual_price_eur", from_log_target("prediction").alias("predicted_price_eur"))


def with_model(df: DataFrame) -> DataFrame:
    return df.withColumn("model", F.when(F.col("penalty") == 0, "linear").otherwise(F.format_string("ridge %s", F.regexp_replace(
        F.col("penalty").cast("string"), r"\.0$", ""))))


def test_scores(table: DataFrame, segments: Sequence[str] = (), penalties: Sequence[float] = PENALTIES, digits: int | None = 4) -> DataFrame:
    """ML4/ML7: (city, segment_type, segment, penalty, model) with EUR metrics over the test rows, for all fits on the training rows."""
    fits = fit_segments(moment_cells(table), segments, penalties)
    pred = predict(table.filter(F.col("fold") == TEST), fits, segments)
    return with_model(regression_metrics(pred, ["city", "segment_type", "segment", "penalty"], digits=digits))


def cross_validated(table: DataFrame, segments: Sequence[str] = (), penalties: Sequence[float] = PENALTIES) -> DataFrame:
    """ML5: mean and sample deviation over the folds of EUR metrics, per segment and penalty; each fold is scored by the fit on the others."""
    fits = fit_segments(moment_cells(table), segments, penalties, folds=True)
    pred = predict(table.filter(F.col("fold") != TEST), fits, segments)
    per_fold = regression_metrics(pred, ["city", "segment_type", "segment", "penalty", "left_out"], digits=None)
    measures = [(c, f"cv_{c.removesuffix('_eur')}") for c in ("rmse_eur", "mae_eur", "r2")]
    return with_model(per_fold.groupBy("city", "segment_type", "segment", "penalty").agg(
        F.count(F.lit(1)).alias("folds"), F.sum("test_rows").alias("rows"),
        *[pround(F.avg(c), 4).alias(f"{name}_mean") for c, name in measures], *[pround(F.stddev_samp(c), 4).alias(f"{name}_std") for c, name in measures]))


def penalty_search(scores: DataFrame) -> DataFrame:
    """ML6: candidates of each segment ranked by cross-validated RMSE, ties to the smaller penalty; the first is the best."""
    order = Window.partitionBy("city", "segment_type", "segment").orderBy("cv_rmse_mean", "penalty")
    return scores.withColumn("rank", F.row_number().over(order)).withColumn("is_best", F.col("rank") == 1)


def segment_sizes(table: DataFrame, segments: Sequence[str]) -> DataFrame:
    """(city, segment_type, segment, rows, n_test): training and test rows of every segment."""
    return table.select("city", "fold", F.inline(segment_column(segments))).groupBy("city", "segment_type", "segment").agg(
        F.count(F.lit(1)).alias("rows"), F.sum((F.col("fold") == TEST).cast("int")).alias("n_test"))


def segment_model_report(table: DataFrame, segment: str, min_rows: int, min_test: int = 1, penalties: Sequence[float] = PENALTIES) -> DataFrame:
    """ML12/ML14/WN5/JN12: each segment's best model by test RMSE beside the city's best, or why it has none.

    Segments with fewer than ``min_rows`` rows or ``min_test`` test rows are
    "Skipped" with null metrics. helped tells whether the segment's own model
    beats the city's model on the segment's own test rows.
    """
    sizes = segment_sizes(table, [segment]).filter(F.col("segment_type") == segment)
    large = sizes.filter((F.col("rows") >= min_rows) & (F.col("n_test") >= min_test)).select("city", "segment_type", "segment")
    cells = moment_cells(table)
    test = table.filter(F.col("fold") == TEST)
    fits = fit_segments(cells, [segment], penalties)
    own = regression_metrics(predict(test, fits, [segment]).join(large, ["city", "segment_type", "segment"], "left_semi"),
                             ["city", "segment_type", "segment", "penalty"])
    best = Window.partitionBy("city", "segment_type", "segment").orderBy("rmse_eur", "mae_eur", "penalty")
    own = with_model(own.withColumn("_at", F.row_number().over(best)).filter(F.col("_at") == 1)).drop("_at", "penalty")
    city = regression_metrics(predict(test, fits.filter(F.col("segment_type") == WHOLE), keep=[segment]), ["city", segment, "penalty"])
    at_city = Window.partitionBy("city", segment).orderBy("rmse_eur", "mae_eur", "penalty")
    city = city.withColumn("_at", F.row_number().over(at_city)).filter(F.col("_at") == 1).select(
        "city", F.col(segment).alias("segment"), F.col("rmse_eur").alias("city_rmse_eur"), F.col("mae_eur").alias("city_mae_eur"))
    out = sizes.join(own, ["city", "segment_type", "segment"], "left").join(city, ["city", "segment"], "left")
    modelled = F.col("model").isNotNull()
    return out.select("city", F.col("segment").alias(segment), "rows", "n_test", F.when(modelled, "Modelled").otherwise("Skipped").alias("status"),
                      "model", "rmse_eur", "mae_eur", "r2", F.when(modelled, F.col("city_rmse_eur")).alias("city_rmse_eur"),
                      F.when(modelled, F.col("city_mae_eur")).alias("city_mae_eur"), (F.col("rmse_eur") < F.col("city_rmse_eur")).alias("helped"))
