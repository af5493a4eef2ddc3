"""Benchmark the headline registered queries.

Runs each query on ``$BENCH_SF_DIR`` (default /root/testdata/sf0.1) with
``local[$BENCH_CPUS]``. Every query is fully executed through the ``noop``
sink (no collect to the driver): one cold run, then ``$BENCH_WARM`` warm
runs; the per-query figure is the median warm time. Prints ONE JSON line.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from stay_analytics.plans.registry import load_all  # noqa: E402
from stay_analytics.session import local_session  # noqa: E402

HEADLINE = [
    "rc6_top_value_listings_per_city",
    "rc7_styled_requests_batch",
    "wn1_global_average_rank",
    "ag1_calendar_rollup",
    "sv1_stay_availability_batch",
    "pr1_parse_raw_listings",
    "jn1_master_build",
    "ag35_feature_decisions",
    "ag11_compare_cities",
    "ag22_describe_long",
    "rc8_neighbourhood_value_score",
    "rc10_seasonal_recommendations",
    "tx2_tfidf_index",
    "tx3_retrieval_top_k",
    "ch_slots_per_turn",
    "cl9_nearest_centroid",
    "ml7_baseline_metrics",
]


def run(spark, q, sf_dir):
    t0 = time.perf_counter()
    q.build(spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - t0


def main():
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = os.environ.get("BENCH_CPUS", "8")
    warm = int(os.environ.get("BENCH_WARM", "2"))
    names = sys.argv[1:] or HEADLINE
    spark = local_session(cpus, int(os.environ.get("BENCH_SHUFFLE_PARTITIONS", "16")), app="stay_bench")
    reg = load_all()
    out, cold = {}, {}
    for name in names:
        if name not in reg:
            continue
        q = reg[name]
        cold[name] = round(run(spark, q, sf_dir), 3)
        times = [run(spark, q, sf_dir) for _ in range(warm)]
        out[name] = round(statistics.median(times) if times else cold[name], 3)
    sf = os.path.basename(sf_dir).replace("sf", "")
    print(json.dumps({"metric": "sum_median_warm_query_seconds", "value": round(sum(out.values()), 3),
                      "unit": "sec", "queries": out, "cold": cold, "sf": sf, "cpus": cpus}))


if __name__ == "__main__":
    main()
