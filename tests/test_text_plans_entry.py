import math

import pytest
from pyspark.sql import functions as F

from small_data import SF_SMALL
from stay_analytics.operators import text as tx


def reference_tfidf(docs, stop):
    import re
    toks = [[t for t in re.findall(r"\w\w+", d.lower()) if t not in stop] for d in docs]
    terms = [t + [f"{a} {b}" for a, b in zip(t, t[1:])] for t in toks]
    n = len(docs)
    df = {}
    for ts in terms:
        for t in set(ts):
            df[t] = df.get(t, 0) + 1
    out = []
    for i, ts in enumerate(terms):
        w = {}
        for t in ts:
            w[t] = w.get(t, 0) + 1
        w = {t: c * (math.log((1 + n) / (1 + df[t])) + 1) for t, c in w.items()}
        norm = math.sqrt(sum(v * v for v in w.values()))
        out += [(i, t, v / norm) for t, v in w.items()]
    return sorted(out)


def test_tfidf_matches_reference_weighting(spark):
    docs = ["The cheap flat near the centre", "Quiet flat, cheap and quiet", "a b", ""]
    df = spark.createDataFrame(list(enumerate(docs)), "doc_id int, text string")
    index, _ = tx.tfidf_index(df, "doc_id", "text", stop_words=["the", "and"])
    got = sorted((r["doc_id"], r["term"], r["weight"]) for r in index.collect())
    exp = reference_tfidf(docs, {"the", "and"})
    assert [(a, b) for a, b, _ in got] == [(a, b) for a, b, _ in exp]
    assert all(abs(x[2] - y[2]) < 1e-12 for x, y in zip(got, exp))


def test_keyword_sentiment(spark):
    df = spark.createDataFrame([(1, "Great clean flat, not noisy"), (2, ""), (3, "ok")], "id int, t string")
    r = {x["id"]: x for x in tx.keyword_sentiment(df, "t").collect()}
    assert r[1]["sentiment_score"] == 0.0 and r[1]["sentiment_label"] == "Neutral"
    assert r[2]["sentiment_score"] == 0.0 and r[3]["sentiment_label"] == "Neutral"


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["rc6_top_value_listings_per_city", "ag1_calendar_rollup", "tx2_tfidf_index",
                                  "sv1_stay_availability_batch", "ch_slots_per_turn", "cl9_nearest_centroid"])
def test_hot_paths_stay_in_jvm_without_products(spark, name):
    from stay_analytics.plans.registry import load_all
    plan = _plan(load_all()[name].build(spark, SF_SMALL))
    for bad in ("BatchEvalPython", "ArrowEvalPython", "CartesianProduct", "BroadcastNestedLoopJoin"):
        assert bad not in plan, f"{name}: {bad}"


def test_filters_and_columns_reach_the_scan(spark):
    from stay_analytics.plans.registry import load_all
    plan = load_all()["jn4_semi_filter_matched"].build(spark, SF_SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<o_orderkey:bigint,o_totalprice:double>" in plan
    cal = load_all()["sv1_stay_availability_batch"].build(spark, SF_SMALL)
    assert "PushedFilters" in _plan(cal)


def test_entry_contract(spark):
    import __spark_entry__ as e
    df = e.entry(spark)
    assert df.count() > 0
    q, o = e.queries(), e.oracle_sql()
    assert set(o) <= set(q) and len(q) >= 100


ORACLE_SUBSET = ["rc6_top_value_listings_per_city", "ag1_calendar_rollup", "pr1_parse_raw_listings", "jn1_master_build",
                 "ag35_feature_decisions", "rc7_styled_requests_batch", "ml7_baseline_metrics", "fc3_monthly_cache",
                 "tx3_retrieval_top_k", "ch_slots_per_turn", "cl10_cluster_quality", "sv1_stay_availability_batch"]


@pytest.mark.parametrize("name", ORACLE_SUBSET)
def test_queries_match_duckdb_oracle(spark, name):
    import duckdb

    from scripts.oracle_check import canon
    from stay_analytics.plans.registry import load_all
    from stay_analytics.sources.tables import TABLES
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    q = load_all()[name]
    got = canon(q.build(spark, SF_SMALL).toPandas())
    exp = canon(con.sql(q.oracle).df())
    assert got == exp
