"""Rows that several steps read are written once; small tables meet them without a shuffle of the rows."""

import datetime

import pytest
from pyspark.sql import functions as F

from stay_analytics.operators import ranking
from stay_analytics.operators.recommend import get_recommendations, seasonal_recommendations
from stay_analytics.session import written_once


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def no_planner_broadcast(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_only_features_of_many_values_shuffle_the_rows(spark, no_planner_broadcast, monkeypatch):
    monkeypatch.setattr(ranking, "COPIED_RANKS", 20, raising=False)
    df = spark.range(200).selectExpr("id", "id % 2 AS g", "cast(id % 7 AS double) AS few", "if(id % 10 = 3, null, cast(id * 7 % 200 AS double)) AS many")
    out = ranking.rank_scores(df, {"a": ("few", True), "b": ("many", False), "c": ("few", False)}, ["g"])
    assert plan_of(out).count("SortMergeJoin") == 1 and out.columns == ["g", "id", "few", "many", "a", "b", "c"]
    rows = out.toPandas()
    filled = rows.many.fillna(rows.groupby("g").many.transform("median"))
    assert (abs(rows.a - rows.groupby("g").few.rank(pct=True)) < 1e-12).all() and (abs(rows.c + rows.a - 1) < 1e-12).all()
    assert (abs(rows.b - (1 - filled.groupby(rows.g).rank(pct=True))) < 1e-12).all()


def test_ranking_reads_its_input_once(spark):
    read = spark.sparkContext.accumulator(0)

    def seen(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    rows = spark.range(60).selectExpr("id AS listing_id", "if(id % 2 = 0, 'A', 'B') AS city", "cast(id % 11 AS double) AS price_eur",
                                      "cast(id % 5 AS double) AS review_scores_rating", "cast(id % 3 AS double) / 3 AS u",
                                      "if(id % 3 = 0, 'Entire home/apt', 'Private room') AS room_type")
    for style in ("Value", "Budget", "Luxury"):
        read.value = 0
        top = get_recommendations(rows.mapInArrow(seen, rows.schema), limit=4, by=["city"], recommendation_style=style).collect()
        assert read.value == 60 and len(top) == 8 and all(r.recommendation_reason.startswith("EUR ") for r in top)
    read.value = 0
    assert len(seasonal_recommendations(rows.mapInArrow(seen, rows.schema), {"Winter": "u", "Summer": "u"}).collect()) == 12
    assert read.value == 60


def test_groups_that_differ_by_microseconds_or_nulls(spark):
    at = datetime.datetime(2024, 1, 1)
    keys = [(at, None), (at + datetime.timedelta(microseconds=1), None), (None, "x"), (None, None)]
    df = spark.createDataFrame([(*k, float(i + 10 * n)) for n, k in enumerate(keys) for i in range(3)], "t timestamp, s string, v double")
    got = {(r.t, r.s): r.m for r in ranking.grouped(df, ["t", "s"], ranking.median_of("v").alias("m")).collect()}
    assert got == {k: 1.0 + 10 * n for n, k in enumerate(keys)}


def test_columns_without_a_type_are_kept(spark):
    df = written_once(spark.range(3).withColumn("nothing", F.lit(None)))
    assert df.count() == 3 and df.columns == ["id", "nothing"]
    assert written_once(spark.range(0)).count() == 0


def test_baselines_and_error_segments_read_their_input_once(spark):
    from stay_analytics.operators import ml
    read = spark.sparkContext.accumulator(0)

    def seen(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    rows = spark.range(240).selectExpr("id AS listing_id", "'A' AS city", "'N' AS neighbourhood_cleansed", "if(id % 2 = 0, 'x', 'y') AS room_type",
                                       "cast(id % 3 AS int) AS accommodates", "cast(id % 17 AS double) AS price_eur", "id % 4 = 0 AS is_test")
    frame = ml.prediction_frame(ml.baseline_predictions(rows.mapInArrow(seen, rows.schema)))
    assert frame.count() == 4 * 60 and read.value == 240
    read.value = 0
    out = ml.error_segments(frame.mapInArrow(seen, frame.schema), ["room_type"]).collect()
    assert read.value == 240 and {r.segment_type for r in out} == {"room_type"}  # the price bands have fewer than 30 rows each


def test_segment_medians_meet_the_rows_without_a_shuffle_by_segment(spark, tmp_path):
    from stay_analytics.plans import q_forecast
    one = lambda name, row: spark.range(700).selectExpr(*row).write.parquet(str(tmp_path / f"{name}.parquet"))
    one("orders", ["id AS o_orderkey", "id % 9 AS o_custkey", "cast(id * 1000 AS double) AS o_totalprice", "if(id % 2 = 0, '2-HIGH', '5-LOW') AS o_orderpriority"])
    spark.range(9).selectExpr("id AS c_custkey", "0 AS c_nationkey", "'M' AS c_mktsegment", "1.0 AS c_acctbal").write.parquet(str(tmp_path / "customer.parquet"))
    spark.range(1).selectExpr("0 AS n_nationkey", "'N' AS n_name", "0 AS n_regionkey").write.parquet(str(tmp_path / "nation.parquet"))
    spark.range(1).selectExpr("0 AS r_regionkey", "'R' AS r_name").write.parquet(str(tmp_path / "region.parquet"))
    one("lineitem", ["id AS l_orderkey", "1 AS l_linenumber", "2.0 AS l_quantity", "0.1 AS l_discount", "0.1 AS l_tax", "'A' AS l_returnflag"])
    seg, city = q_forecast._predictions(spark, str(tmp_path))
    for rows, price in ((seg, {349.0, 350.0}), (city, {349.0, 350.0})):
        assert rows.count() == 700 and {r[0] for r in rows.select("predicted_nightly_price_eur").distinct().collect()} == price
        assert "SortMergeJoin" not in plan_of(rows) and "Exchange hashpartitioning" not in plan_of(rows)
