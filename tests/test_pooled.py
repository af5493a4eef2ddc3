"""Mixtures of all starts take their steps in one pass, and are those that pyspark.ml fits."""

import numpy as np
import pytest
from pyspark.ml.clustering import GaussianMixture, KMeans
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from stay_analytics.operators import cluster as cs
from stay_analytics.operators import pooled


@pytest.fixture(scope="module")
def points(spark):
    rng = np.random.default_rng(5)
    x = np.concatenate([rng.normal(at, 1.0, (150, 2)) for at in (0.0, 3.0, 7.0)])
    rows = [(i, float(a), float(b), float(i * 7 % 5)) for i, (a, b) in enumerate(x)]
    return spark.createDataFrame(rows, "id long, x double, y double, z double").repartition(3).localCheckpoint()


def jobs_of(spark, group, call):
    spark.sparkContext.setJobGroup(group, group)
    try:
        return call(), len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))
    finally:
        spark.sparkContext._jsc.clearJobGroup()


def test_mixtures_are_those_of_the_estimator(spark, points):
    data = cs._vectors(points, ["x", "y", "z"]).select("features")
    runs = [(2, 42), (3, 42), (3, 43)]
    _, got = pooled.fit_mixtures(data, 3, runs)
    for (k, seed), m in zip(runs, got, strict=True):
        want = GaussianMixture(k=k, seed=seed).fit(data)
        assert m.log_likelihood == pytest.approx(want.summary.logLikelihood) and m.weights == pytest.approx(want.weights, abs=1e-6)
        assert m.means == pytest.approx(np.array([r["mean"].toArray() for r in want.gaussiansDF.collect()]), abs=1e-6)


def test_a_sweep_takes_one_pass_for_the_step_of_all_its_runs(spark, points):
    got, jobs = jobs_of(spark, "sweep", lambda: cs.gmm_sweep(points, ["x", "y", "z"], ks=[2, 3], starts=3).collect())
    assert jobs < 100 + 3 * 6 + 12  # 100 steps at most, what the draws take, and what is done once; each fit by itself had its own steps
    assert [r.k for r in got] == [2, 3]
    best = pooled.best_by_k(pooled.fit_mixtures(cs.spread(cs._vectors(points, ["x", "y", "z"]).select("features")), 3, [(k, s) for k in (2, 3) for s in (42, 43, 44)])[1])
    assert [r.log_likelihood for r in got] == pytest.approx([best[k].log_likelihood for k in (2, 3)])


def test_members_and_silhouettes_are_those_of_the_estimator(spark, points):
    data = cs.spread(cs._vectors(points, ["x", "y", "z"]))
    model = GaussianMixture(k=3, seed=42).fit(data)
    want = model.transform(data).withColumn("p", F.array_max(vector_to_array("probability"))).toPandas().set_index("id")
    got = cs.fit_gmm(points, ["x", "y", "z"], k=3, starts=1).toPandas().set_index("id").loc[want.index]
    assert (got.cluster_id == want.prediction).all() and got.membership_probability.to_numpy() == pytest.approx(want.p.to_numpy(), abs=1e-6)
    assert list(got.columns) == ["x", "y", "z", "cluster_id", "membership_probability", "low_confidence"]
    one = cs.gmm_sweep(points, ["x", "y", "z"], ks=[3], starts=1).first()
    assert one.silhouette == pytest.approx(ClusteringEvaluator().evaluate(model.transform(data)), abs=1e-6)


def test_sums_of_many_tasks_meet_in_fewer(spark, points, monkeypatch):
    data = cs._vectors(points, ["x", "y", "z"]).select("features")
    one = pooled.fit_mixtures(data, 3, [(2, 42)], 3)[1][0].log_likelihood
    monkeypatch.setattr(pooled, "MANY_TASKS", 0)
    monkeypatch.setattr(pooled, "enough_partitions", lambda *a: 9)
    assert pooled.fit_mixtures(data, 3, [(2, 42)], 3)[1][0].log_likelihood == pytest.approx(one)


def test_a_table_without_rows_or_spread_is_refused(spark, points):
    with pytest.raises(Exception):
        cs.gmm_sweep(points.filter("id < 0"), ["x", "y"], ks=[2], starts=1)
    with pytest.raises(ValueError, match="no non-zero singular values"):
        cs.gmm_sweep(points.select(F.lit(1.0).alias("x"), F.lit(2.0).alias("y")), ["x", "y"], ks=[2], starts=1)


def test_kmeans_of_all_starts_is_that_of_the_estimator(spark, points):
    data = cs.spread(cs._vectors(points, ["x", "y"]))
    fits = [KMeans(k=4, seed=s).fit(data) for s in range(42, 50)]
    starts = [KMeans(k=4, seed=s, maxIter=0).fit(data).clusterCenters() for s in range(42, 50)]
    got = pooled.fit_kmeans(data, 2, starts)
    assert [r.cost for r in got] == pytest.approx([m.summary.trainingCost for m in fits])
    for r, m in zip(got, fits, strict=True):
        assert r.centres == pytest.approx(np.array(m.clusterCenters()))
    rows, jobs = jobs_of(spark, "kmeans", lambda: cs.fit_kmeans(points, ["x", "y"], k=4, seeds=range(42, 50)).collect())
    assert jobs < 8 * 12 + 20 + 8  # the draws of 8 starts, 20 steps at most, and what is done once
    want = {r.id: r.prediction for r in min(fits, key=lambda m: m.summary.trainingCost).transform(data).collect()}
    assert {r.id: r.cluster_id for r in rows} == want and set(rows[0].asDict()) == {"id", "x", "y", "z", "cluster_id"}


def test_a_centre_without_rows_stays(spark, points):
    data = cs._vectors(points, ["x", "y"]).select("features")
    (run,) = pooled.fit_kmeans(data, 2, [[np.array([0.0, 0.0]), np.array([1e6, 1e6])]])
    assert run.still and run.centres[1].tolist() == [1e6, 1e6]
