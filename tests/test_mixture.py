"""Mixtures per group against plain expectation maximisation, and principal axes against numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from stay_analytics.operators import citywise as cw
from stay_analytics.operators import mixture as mx
from stay_analytics.operators import pca

FEATURES = ["a", "b", "c"]
D = len(FEATURES)


@pytest.fixture(scope="module")
def points(spark):
    rng = np.random.default_rng(5)
    rows = []
    for k in range(900):
        centre, width = [((0, 0, 0), 1.0), ((5, 0, 0), 0.5), ((0, 5, 1), 0.3)][int(rng.integers(3))]
        rows.append((k, "A" if k % 3 else "B", *[float(c + v) for c, v in zip(centre, width * rng.normal(size=3), strict=True)]))
    rows += [(1000 + k, "C", 1.0, 2.0, 3.0) for k in range(6)]  # repeated rows: no variance at all
    return spark.createDataFrame(rows, "id long, city string, a double, b double, c double").repartition(4)


def density(x, weight, mean, cov):
    spread, axes = np.linalg.eigh(cov + mx.RIDGE * np.eye(D))
    spread = np.maximum(spread, mx.RIDGE)
    cov = axes @ np.diag(spread) @ axes.T
    y = x - mean
    return weight * np.exp(-0.5 * np.einsum("ni,ij,nj->n", y, np.linalg.inv(cov), y)) / np.sqrt((2 * np.pi) ** D * np.linalg.det(cov))


def plain(x, centres):
    shares = np.eye(len(centres))[((x[:, None] - centres[None]) ** 2).sum(axis=2).argmin(axis=1)]
    before = None
    for _ in range(mx.MOST_STEPS):
        mass = shares.sum(axis=0)
        means = [(shares[:, c] @ x) / mass[c] for c in range(len(centres))]
        covs = [((x - means[c]).T * shares[:, c]) @ (x - means[c]) / mass[c] for c in range(len(centres))]
        joint = np.column_stack([density(x, mass[c] / len(x), means[c], covs[c]) for c in range(len(centres))])
        ll = np.log(joint.sum(axis=1)).sum()
        shares = joint / joint.sum(axis=1, keepdims=True)
        if before is not None:
            assert ll > before - 1e-6 * len(x)
            if abs(ll - before) < mx.SETTLED * len(x):
                return ll
        before = ll
    return ll


def test_runs_equal_plain_expectation_maximisation(points):
    data = points.filter("city <> 'C'")
    blocks = cw.feature_blocks(data, FEATURES, "id")
    centres = cw.kmeans_runs(blocks, cw.starting_centres(data, FEATURES, "id", [2, 3], 1), mx.WARM_STEPS)
    first = {(r.group, r.k, r.start): np.array(r.centres) for r in centres.collect()}
    got = mx.fit_runs(blocks, mx.first_mixtures(blocks, centres, D), D).collect()
    rows = data.toPandas()
    assert len(got) == len(first) == 4
    for r in got:
        assert np.isclose(r.log_likelihood, plain(rows[rows.city == r.group][FEATURES].to_numpy(), first[r.group, r.k, r.start]), rtol=1e-6)


def test_sweep_segments_and_moments(points):
    data = points.filter("city <> 'C'")
    sweep = mx.mixture_sweep(data, FEATURES, "id", [2, 3, 4], 2).toPandas().sort_values(["city", "k"])
    assert sweep["rows"].tolist() == [600] * 3 + [300] * 3
    for _, part in sweep.groupby("city"):
        assert part.k.iloc[part.bic.argmin()] == 3 and part.silhouette.between(-1, 1).all()
    assert np.allclose(sweep.aic, 2 * (sweep.k * 10 - 1) - 2 * sweep.log_likelihood)
    segments = mx.mixture_segments(points, FEATURES, "id", 3, 2).toPandas()
    assert sorted(segments["id"]) == sorted(r.id for r in points.select("id").collect())
    assert (segments.low_confidence == (segments.membership_probability < 0.6)).all() and segments.membership_probability.between(1 / 3, 1 + 1e-9).all()
    rows = data.toPandas()
    for r in mx.mixture_moments(data, FEATURES, "id", 3, 2).collect():
        part = rows[rows.city == r.city]
        assert r.rows == len(part) and np.isclose(r.covariance, np.cov(part[r.feature_a], part[r.feature_b], bias=True)[0, 1])


def test_mixtures_too_large_to_copy_meet_by_salt(points, monkeypatch):
    blocks, best = mx.fit(points.filter("city = 'B'"), FEATURES, "id", [2], 1)
    want = mx.em_step(blocks, best, D, copy=True).first()
    got = mx.em_step(blocks, best, D, copy=False).first()
    assert np.allclose(want.sums, got.sums) and np.isclose(want.log_likelihood, got.log_likelihood)
    monkeypatch.setattr(mx, "COPIED_BYTES", 0)
    assert not mx.copied(best, D) and mx.scored_rows(blocks, best, D).count() == 300


def test_no_rows(points):
    none = points.filter("id < 0")
    assert mx.mixture_sweep(none, FEATURES, "id", [2], 1).count() == 0
    assert mx.mixture_segments(none, FEATURES, "id", 2, 1).count() == 0
    assert pca.pca_view(none, FEATURES, "id").count() == 0


def test_axes_equal_numpy(points):
    far = points.withColumn("a", F.col("a") + 1e6)
    view = pca.pca_view(far, FEATURES, "id", 5000).toPandas()
    assert len(view) == far.count()
    rows = far.toPandas()
    for r in pca.principal_axes(far, FEATURES).collect():
        x = rows[rows.city == r.city][FEATURES].to_numpy()
        cov = np.cov(x.T, bias=True)
        assert np.isclose(sum(r.variances), np.trace(cov), atol=1e-9)
        for lam, axis in zip(r.variances, r.axes, strict=True):
            assert np.allclose(cov @ axis, lam * np.array(axis), atol=1e-6) and max(axis, key=abs) > 0
        mine = view[view.city == r.city]
        assert np.isclose(mine.pc1.var(ddof=0), r.variances[0], atol=1e-6) and np.isclose(mine.pc2.var(ddof=0), r.variances[1], atol=1e-6)
        assert np.allclose(mine.explained_variance_pc1, r.variances[0] / sum(r.variances) if sum(r.variances) > 1e-12 else mine.explained_variance_pc1)


def test_coefficients_give_the_log_density():
    rng = np.random.default_rng(8)
    x = rng.normal(size=(40, D))
    x[:, 2] = x[:, 1]  # no variance along one direction
    sums = np.stack([mx.product_rows(x[:25]).sum(axis=0), mx.product_rows(x[25:]).sum(axis=0), np.zeros(mx.sums_width(D))])
    got = mx.coefficients(sums, D) @ mx.product_rows(x).T
    for c, part in enumerate((x[:25], x[25:])):
        assert np.allclose(got[c], np.log(density(x, len(part) / 40, part.mean(axis=0), np.cov(part.T, bias=True))), atol=1e-6)
    ll, shares = mx.memberships(x, sums)
    assert np.isfinite(ll).all() and (shares[:, 2] == 0).all() and np.allclose(shares.sum(axis=1), 1)


def test_sweep_makes_no_row_per_row_and_run(points, monkeypatch):
    blocks, best = mx.fit(points, FEATURES, "id", [2, 3], 1)
    rows = mx.scored_rows(blocks, best, D).join(points.select(F.col("id").alias("key"), F.array(*FEATURES).alias("x")), "key")
    want = {(r.group, r.k): r for r in cw.silhouette(rows, D, "component", "x", ["group", "k"]).collect()}
    low = {(r.group, r.k): r for r in rows.groupBy("group", "k").agg(F.avg("probability").alias("p"), F.avg((F.col("probability") < 0.6).cast("int")).alias("low")).collect()}
    monkeypatch.setattr(mx, "scored_rows", None)
    got = mx.mixture_sweep(points, FEATURES, "id", [2, 3], 1).collect()
    assert len(got) == len(want) == 6
    for r in got:
        w, p = want[r.city, r.k], low[r.city, r.k]
        assert r.rows == w.rows and (r.silhouette is None) == (w.silhouette is None)
        assert r.silhouette is None or np.isclose(r.silhouette, w.silhouette)
        assert np.isclose(r.mean_max_probability, p.p) and np.isclose(r.low_confidence_share, p.low)
