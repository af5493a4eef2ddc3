import inspect
import random

from pyspark.ml.clustering import GaussianMixture

from stay_analytics.operators import cluster as cs
from stay_analytics.operators import ml
from stay_analytics.plans import q_cluster, q_ml


def test_mixture_sweep_keeps_the_best_start_and_has_silhouettes(spark):
    r = random.Random(7)
    rows = [(i, *(r.gauss(4 * (i % 3), 1) for _ in range(2))) for i in range(120)]
    df = spark.createDataFrame(rows, "id int, x double, y double").coalesce(1)
    data = cs._vectors(df, ["x", "y"])
    got = cs.gmm_sweep(df, ["x", "y"], ks=[3], starts=3).first()
    each = [GaussianMixture(k=3, seed=s, featuresCol="features").fit(data).summary.logLikelihood for s in (42, 43, 44)]
    assert abs(got.log_likelihood - max(each)) < 1e-6 and -1 <= got.silhouette <= 1


def test_queries_ask_for_the_whole_search(monkeypatch):
    asked = {}

    def record(name):
        return lambda *a, **k: asked.setdefault(name, (a, k))

    monkeypatch.setattr(q_cluster, "_scaled_only", lambda spark, sf_dir: None)
    monkeypatch.setattr(q_ml, "_ml_table", lambda spark, sf_dir: None)
    monkeypatch.setattr(ml, "train_and_score", record("ml4"))
    monkeypatch.setattr(ml, "random_search", record("ml6"))
    defaults = {f: inspect.signature(f).parameters for f in (cs.gmm_sweep, cs.fit_gmm, cs.fit_kmeans)}
    assert list(defaults[cs.gmm_sweep]["ks"].default) == list(range(2, 9)) and defaults[cs.gmm_sweep]["starts"].default == 5
    assert defaults[cs.fit_gmm]["starts"].default == 10 and len(defaults[cs.fit_kmeans]["seeds"].default) == 30
    monkeypatch.setattr(cs, "gmm_sweep", record("cl6"))
    q_cluster.gmm_sweep(None, "")
    q_ml.families(None, "")
    q_ml.search(None, "")
    assert len(asked["cl6"][0]) == 2 and not asked["cl6"][1]
    assert {"lasso", "elastic_net"} <= set(asked["ml4"][0][1]) and len(asked["ml4"][0][1]) == 8
    assert asked["ml6"][1]["n_iter"] >= 4
