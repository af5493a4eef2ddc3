"""Fits share one written table, in enough partitions, and one preprocessing per training table."""

from pyspark.sql import functions as F

from stay_analytics.operators import cluster as cs
from stay_analytics.operators import ml
from stay_analytics.session import LEAST_ROWS, at_once, spread


def test_spread_deals_a_table_of_one_partition_over_the_cores(spark):
    n = 2 * LEAST_ROWS
    out = spread(spark.range(n).coalesce(1))
    assert out.rdd.getNumPartitions() > 1 and out.agg(F.sum("id")).first()[0] == n * (n - 1) // 2
    assert spread(spark.range(10).coalesce(1)).rdd.getNumPartitions() == 1


def test_results_come_in_order(spark):
    assert at_once(spark, [lambda i=i: spark.range(i).count() for i in range(6)]) == list(range(6))


def test_a_search_fits_the_preprocessing_of_a_fold_once(spark, monkeypatch):
    df = spark.range(300).select(F.col("id").alias("listing_id"), (F.col("id") % 17 + 5.0).alias("price_eur"), (F.col("id") % 5).cast("int").alias("accommodates"),
                                 F.concat(F.lit("r"), F.col("id") % 3).alias("room_type"))
    seen, whole = [], ml.fit_preprocessing
    monkeypatch.setattr(ml, "fit_preprocessing", lambda *a, **k: seen.append(1) or whole(*a, **k))
    rows = ml.random_search(df, "decision_tree", {"maxDepth": [1, 2, 3]}, n_iter=3, k=2).collect()
    assert len(seen) == 2 and sorted(r.candidate for r in rows) == [0, 1, 2] and all(r.folds == 2 for r in rows)


def test_kmeans_reads_its_rows_once(spark):
    reads = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            reads.add(batch.num_rows)
            yield batch

    df = spark.range(40).select((F.col("id") % 2 * 10.0 + F.col("id") / 100).alias("x"), F.col("id").cast("double").alias("y")).mapInArrow(count, "x double, y double")
    assert [r.k for r in cs.kmeans_sweep(df, ["x", "y"], ks=[2, 3]).collect()] == [2, 3]
    assert reads.value == 40
