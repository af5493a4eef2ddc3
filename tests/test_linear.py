"""Linear models from merged moments against plain numpy fits of the same rows."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from stay_analytics.operators import linear


@pytest.fixture(scope="module")
def rows(spark):
    r = random.Random(3)
    data = []
    for k in range(900):
        city, room, group, area = r.choice("AAB"), r.choice(["x", "y", "z"]), r.choice(["p", "q", None]), r.choice(["n1", "n2", "n3", "n4"])
        x = [r.gauss(3, 2) if r.random() > 0.1 else None, float(r.randrange(9)), 5.0]
        price = math.exp(1 + 0.1 * (x[0] or 3) + 0.05 * x[1] + (room == "x") * 0.4 + (group == "p") * 0.2 + r.gauss(0, 0.2))
        data.append((k, city, room, group, area, *x, price if r.random() > 0.02 else None))
    return spark.createDataFrame(data, "listing_id long, city string, room_type string, property_group string, neighbourhood_cleansed string, "
                                       "n1 double, n2 double, n3 double, price_eur double")


NUMERIC, CATEGORICAL = ["n1", "n2", "n3"], ["room_type", "property_group", "neighbourhood_cleansed"]


def plain_fit(train, test, penalty):
    """Ridge on standardised one-hot features; predictions of the test rows."""
    columns = [("n", c) for c in NUMERIC] + [(c, v) for c in CATEGORICAL for v in sorted(train[c].unique())]
    design = lambda d: np.column_stack([d[c] if kind == "n" else (d[kind] == c).astype(float) for kind, c in columns])
    a, y = design(train), np.log1p(train["price_eur"].to_numpy())
    mean, sd = a.mean(axis=0), a.std(axis=0)
    sd[sd < 1e-9] = 1.0
    s = (a - mean) / sd
    beta = np.linalg.pinv(s.T @ s + penalty * np.eye(s.shape[1]), rcond=1e-10, hermitian=True) @ (s.T @ (y - y.mean()))
    return np.maximum(np.expm1((design(test) - mean) / sd @ beta + y.mean()), 0)


@pytest.fixture(scope="module")
def table(rows):
    return linear.model_table(rows, numeric=NUMERIC, categorical=CATEGORICAL).cache()


def test_filling(table, rows):
    filled, raw = table.toPandas(), rows.filter("price_eur is not null").toPandas().set_index("listing_id")
    assert not filled[NUMERIC + CATEGORICAL].isna().any().any() and len(filled) == len(raw)
    for city, part in filled.groupby("city"):
        train = raw.loc[part.loc[part.fold != linear.TEST, "listing_id"]]
        gaps = raw.loc[part.listing_id]["n1"].isna().to_numpy()
        assert np.allclose(part["n1"][gaps], train["n1"].median())
        counts = train["property_group"].value_counts()
        gaps = raw.loc[part.listing_id]["property_group"].isna().to_numpy()
        assert set(part["property_group"][gaps]) == {min(counts[counts == counts.max()].index)}


@pytest.mark.parametrize("left_out", [linear.TEST, 0, 2])
def test_fits_equal_plain_ones(table, left_out):
    fits = linear.fit_segments(linear.moment_cells(table, NUMERIC, CATEGORICAL), ["room_type"], (0.0, 1.0, 50.0), True, NUMERIC, CATEGORICAL)
    got = linear.predict(table.filter(F.col("fold") == left_out), fits, ["room_type"], NUMERIC, CATEGORICAL, keep=["listing_id"]).toPandas()
    data = table.toPandas()
    assert set(got.left_out) == {left_out} and set(got.penalty) == {0.0, 1.0, 50.0}
    for (city, kind, segment, penalty), part in got.groupby(["city", "segment_type", "segment", "penalty"]):
        own = data[(data.city == city) & ((kind == "city") | (data.room_type == segment))]
        train = own[(own.fold != linear.TEST) & (own.fold != left_out)]
        test = own[own.fold == left_out].sort_values("listing_id")
        part = part.sort_values("listing_id")
        assert list(part.listing_id) == list(test.listing_id)
        assert np.allclose(part.predicted_price_eur, plain_fit(train, test, penalty), rtol=1e-6)


def test_cross_validation_search_and_report(rows, monkeypatch):
    more = rows
    for c in linear.NUMERIC_FEATURES:
        more = more.withColumn(c, F.col("n1") * (len(c) % 5) + F.col("n2"))
    table = linear.model_table(more)
    found = linear.penalty_search(linear.cross_validated(table)).collect()
    assert {r.folds for r in found} == {3} and {r["rank"] for r in found} == set(range(1, 6))
    for city in "AB":
        ranked = sorted((r for r in found if r.city == city), key=lambda r: r["rank"])
        assert [r.cv_rmse_mean for r in ranked] == sorted(r.cv_rmse_mean for r in ranked) and ranked[0].is_best
    report = linear.segment_model_report(table, "room_type", min_rows=150).collect()
    assert {r.status for r in report} == {"Modelled", "Skipped"}
    assert all((r.status == "Modelled") == (r.rows >= 150) == (r.rmse_eur is not None) for r in report)


def test_no_rows(rows):
    table = linear.model_table(rows.filter("false"), numeric=NUMERIC, categorical=CATEGORICAL)
    assert linear.fit_segments(linear.moment_cells(table, NUMERIC, CATEGORICAL), [], (0.0,), False, NUMERIC, CATEGORICAL).collect() == []
