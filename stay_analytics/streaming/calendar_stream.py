"""ST1: incremental calendar rollup with Structured Streaming.

The reference reads a large calendar in chunks, keeps partial per-listing
sums and re-sums them at the end. Here the calendar files are a streaming
file source; each micro-batch's partial sums go to a state store keyed by
listing (stateful ``groupBy`` in ``update`` mode), and ``foreachBatch``
appends the changed per-listing totals to a table in the checkpoint folder.
The latest version of each listing is the rollup, equal to the batch AG1.
``Trigger.AvailableNow`` processes every file present and stops, so the same
job serves backfills and incremental runs (new calendar files are picked up
next time; the streaming checkpoint remembers what was read).
"""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.dates import SEASONS, available_flag, is_weekend, season_of_month
from ..session import ensure_checkpoint_dir

def _partial_sums(cal: DataFrame) -> DataFrame:
    d = F.col("date").cast("date")
    avail = available_flag("available", strict=True)
    unav = F.lit(1) - avail
    q, season, wk = F.quarter(d), season_of_month(F.month(d)), is_weekend(d)

    def pair(cond, name):
        return [F.sum(F.when(cond, unav).otherwise(0)).alias(f"{name}_u"),
                F.sum(F.when(cond, 1).otherwise(0)).alias(f"{name}_d")]

    aggs = [F.count(F.lit(1)).alias("days"), F.sum(avail).alias("avail"), F.sum(unav).alias("unav")]
    for k in range(1, 5):
        aggs += pair(q == k, f"q{k}")
    for s in SEASONS:
        aggs += pair(season == s, s)
    aggs += pair(wk == 0, "wd") + pair(wk == 1, "we")
    return cal.groupBy("listing_id").agg(*aggs)


def rollup_from_sums(sums: DataFrame) -> DataFrame:
    """Final AG1 columns from per-listing running sums (null rate when a bucket has no days)."""
    rate = lambda n: F.when(F.col(f"{n}_d") > 0, F.col(f"{n}_u") / F.col(f"{n}_d"))
    cols = [F.col("listing_id"), F.col("days").alias("calendar_days"),
            F.col("avail").alias("calendar_available_days"), F.col("unav").alias("calendar_unavailable_days")]
    cols += [rate(f"q{k}").alias(f"calendar_unavailable_q{k}") for k in range(1, 5)]
    cols += [rate(s).alias(f"calendar_unavailable_{s}") for s in SEASONS]
    cols += [rate("wd").alias("calendar_unavailable_weekday"), rate("we").alias("calendar_unavailable_weekend"),
             (F.col("unav") / F.col("days")).alias("calendar_unavailable_rate")]
    return sums.select(*cols)


def streaming_calendar_rollup(spark: SparkSession, sf_dir: str, out_dir: str | None = None,
                              files_per_trigger: int = 1, state_partitions: int | None = None) -> DataFrame:
    """Run the incremental rollup over ``lineitem`` (the calendar fixture) and return AG1.

    The state store's partition count is fixed by the first run of a streaming
    checkpoint; it defaults to the cluster's parallelism instead of the batch
    shuffle setting.
    """
    base = out_dir or os.path.join(ensure_checkpoint_dir(spark), f"calendar-stream-{uuid.uuid4().hex}")
    sink, ckpt = os.path.join(base, "totals"), os.path.join(base, "_checkpoint")
    schema = spark.read.parquet(f"{sf_dir}/lineitem.parquet").schema
    src = (spark.readStream.schema(schema).option("pathGlobFilter", "lineitem.parquet")
           .option("maxFilesPerTrigger", files_per_trigger).parquet(sf_dir))
    cal = src.select(F.col("l_suppkey").alias("listing_id"), F.col("l_shipdate").cast("date").alias("date"),
                     F.when(F.col("l_returnflag") == "N", "t").otherwise("f").alias("available"))
    sums = _partial_sums(cal)

    def write_batch(batch: DataFrame, batch_id: int) -> None:
        batch.withColumn("_batch", F.lit(batch_id)).write.mode("append").parquet(sink)

    previous = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(state_partitions or spark.sparkContext.defaultParallelism))
    try:
        query = (sums.writeStream.outputMode("update").foreachBatch(write_batch)
                 .option("checkpointLocation", ckpt).trigger(availableNow=True).start())
        query.awaitTermination()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", previous)
    totals = spark.read.parquet(sink)
    latest = Window.partitionBy("listing_id").orderBy(F.col("_batch").desc())
    current = totals.withColumn("_rn", F.row_number().over(latest)).filter("_rn = 1").drop("_rn", "_batch")
    return rollup_from_sums(current)
