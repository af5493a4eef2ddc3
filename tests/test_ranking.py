import pandas as pd
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from stay_analytics.operators.ranking import Quantile, grouped, median_of, rank_scores, value_bucket


def pandas_rank(values, higher=True):
    s = pd.Series(values, dtype="float64")
    if s.notna().sum() == 0:
        return [0.5] * len(s)
    r = s.fillna(s.median()).rank(pct=True, method="average")
    return list(r if higher else 1 - r)


def _check(spark, groups):
    rows = [(g, i, v) for g, vals in groups.items() for i, v in enumerate(vals)]
    df = spark.createDataFrame(rows, "g string, i int, v double")
    out = rank_scores(df, {"hi": ("v", True), "lo": ("v", False)}, ["g"]).collect()
    got = {(r["g"], r["i"]): (r["hi"], r["lo"]) for r in out}
    for g, vals in groups.items():
        hi, lo = pandas_rank(vals, True), pandas_rank(vals, False)
        for i in range(len(vals)):
            assert abs(got[(g, i)][0] - hi[i]) < 1e-12
            assert abs(got[(g, i)][1] - lo[i]) < 1e-12


def test_rank_ties_nulls_and_all_null(spark):
    _check(spark, {"a": [3.0, 1.0, None, 3.0, 2.0, None], "b": [None, None], "c": [5.0], "d": [1.0, 1.0, 1.0, 7.0]})


@settings(max_examples=8, deadline=None)
@given(st.lists(st.one_of(st.none(), st.integers(0, 6).map(float)), min_size=1, max_size=12))
def test_rank_matches_pandas(spark, vals):
    _check(spark, {"x": vals})


def test_global_pool_rank_in_unit_interval(spark):
    df = spark.range(0, 500).selectExpr("id", "cast(id % 37 as double) as v")
    out = rank_scores(df, {"r": ("v", True)}).collect()
    assert all(0 < r["r"] <= 1 for r in out)
    by_v = {}
    for r in out:
        by_v.setdefault(r["v"], set()).add(r["r"])
    assert all(len(s) == 1 for s in by_v.values())  # equal values, equal ranks


def test_rank_equals_pandas_per_pool(spark):
    vals = {"a": [3.0, 1.0, None, 3.0, 2.0, None, 7.5, 7.5, -2.0, 0.0, -0.5, 1e300], "b": [None, None], "c": [4.0, 1.0, 4.0],
            "d": [x * 0.37 - 40 for x in range(300)] + [None] * 7}
    rows = [(g, i, v) for g, vs in vals.items() for i, v in enumerate(vs)]
    df = spark.createDataFrame(rows, "g string, i int, v double")
    got = {(r["g"], r["i"]): r["s"] for r in rank_scores(df, {"s": ("v", True)}, ["g"]).collect()}
    for g, vs in vals.items():
        exp = pandas_rank(vs)
        for i in range(len(vs)):
            assert abs(got[(g, i)] - exp[i]) < 1e-12


def test_grouped_quantiles_equal_percentile_and_spread(spark):
    """One group with three quarters of the rows: the same numbers as ``percentile``, and no group in one task."""
    df = spark.range(4000).selectExpr("if(id % 4 < 3, 'hot', if(id % 8 = 3, 'cold', null)) as g", "id",
                                      "if(id % 13 = 0, null, (id * 7919 % 4001 - 900) / 7D) as v", "cast(null as double) as e")
    qs = (0.0, 0.01, 0.25, 0.5, 0.9, 1.0)
    got = grouped(df, ["g"], F.count("id").alias("n"), *[Quantile("v", q).alias(f"q{i}") for i, q in enumerate(qs)], median_of("e").alias("e"))
    exp = df.groupBy("g").agg(F.count("id").alias("n"), F.percentile("v", list(qs)).alias("q"))
    want = {r.g: (r.n, *r.q) for r in exp.collect()}
    assert {r.g for r in got.collect()} == set(want) == {"hot", "cold", None}
    for r in got.collect():
        assert r.e is None and r.n == want[r.g][0]
        assert all(abs(r[f"q{i}"] - want[r.g][i + 1]) < 1e-9 for i in range(len(qs)))
    assert grouped(df, [], median_of("v", 3).alias("m")).first().m == df.agg(F.round(F.median("v"), 3)).first()[0]
    assert grouped(df.where("id < 0"), [], median_of("v").alias("m")).first().m is None
    counts = df.where("g = 'hot' and v is not null").groupBy("g", "v").agg(F.count("*").alias("c"))
    buckets = counts.select(value_bucket("v").alias("b")).groupBy("b").count()
    assert buckets.agg(F.max("count")).first()[0] < 0.05 * counts.count()


def test_value_buckets_keep_the_order(spark):
    values = [float("-inf"), -1.7e308, -3.0, -1.0, -1e-5, -5e-324, 0.0, 5e-324, 1e-9, 0.99, 1.0, 1.01, 2.0, 150.0, 1.7e308, float("inf"), float("nan")]
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v double").select("i", value_bucket("v").alias("b")).orderBy("i").collect()
    assert [r.b for r in rows] == sorted(r.b for r in rows) and len({r.b for r in rows}) == len(values)
