"""Spark session helpers.

Library functions never create sessions; they take DataFrames. These helpers
exist for tests, the bench and command-line use. On a cluster the session is
built by the launcher and ``checkpoint_dir`` reads whatever shared folder the
cluster configured in ``spark.checkpoint.dir``.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession

DEFAULT_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # 128 MB splits keep scan tasks in memory at any scale factor.
    "spark.sql.files.maxPartitionBytes": str(128 * 1024 * 1024),
}


def local_session(cores: int | str = "*", shuffle_partitions: int = 8,
                  app: str = "stay_analytics", extra: dict | None = None) -> SparkSession:
    """A local session for tests and the bench (UI off, AQE on, UTC)."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName(app)
    conf = dict(DEFAULT_CONF)
    conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf["spark.driver.memory"] = os.environ.get("STAY_DRIVER_MEMORY", "12g")
    conf.update(extra or {})
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the checkpoint folder, setting a scratch one only when unset.

    A cluster names a shared folder in ``spark.checkpoint.dir``; we never
    override it. Only a local session without one gets a fresh temp folder; a
    cluster without one is an error, as executors could not read each
    other's files.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir() or sc.getConf().get("spark.checkpoint.dir", None)
    if current:
        if not sc.getCheckpointDir():
            sc.setCheckpointDir(current)
        return current
    if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    path = tempfile.mkdtemp(prefix="stay-ckpt-")
    sc.setCheckpointDir(path)
    return path


def cut_lineage(df):
    """Reliable checkpoint into the shared checkpoint folder (never local)."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def written_once(df, partition: str | None = None):
    """``df`` written once as parquet into the checkpoint folder and read back.

    Unlike a checkpoint, which holds whole rows uncompressed, a use reads only
    the columns it needs, and the planner knows the table's size, so small
    tables are broadcast without a shuffle of the large side.
    """
    if any("void" in f.dataType.simpleString() for f in df.schema):  # parquet has no such type
        return cut_lineage(df)
    path = f"{ensure_checkpoint_dir(df.sparkSession)}/table-{uuid.uuid4().hex}"
    writer = df.write.partitionBy(partition) if partition else df.write
    writer.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Rows that one task of a fit reads: at least so many (fewer would cost more tasks than they save), and at most.
LEAST_ROWS, MOST_ROWS = 1 << 13, 1 << 18


def enough_partitions(spark, rows: int) -> int:
    """Partitions of ``rows`` rows that keep all cores busy and tasks of a bounded size."""
    return max(min(-(-rows // LEAST_ROWS), 3 * spark.sparkContext.defaultParallelism), -(-rows // MOST_ROWS))


def spread(df):
    """``df`` written once, for fits that read it many times, in partitions that keep all cores busy at any size.

    The partitions of a shuffle follow its bytes: a small table would be fitted
    by one task, and a task of a large one would hold a million rows.
    """
    written = cut_lineage(df)
    rows, have = written.count(), written.rdd.getNumPartitions()
    wanted = enough_partitions(df.sparkSession, rows)
    return cut_lineage(written.repartition(wanted)) if wanted > have else written


def at_once(spark, calls, threads: int = 4) -> list:
    """Results of the functions ``calls`` in order, ``threads`` of them at a time; their Spark jobs share the cores."""
    from multiprocessing.pool import ThreadPool

    from pyspark import inheritable_thread_target

    calls = list(calls)
    if len(calls) < 2:
        return [call() for call in calls]
    pool = ThreadPool(min(threads, len(calls)))
    try:
        return pool.map(inheritable_thread_target(spark)(lambda call: call()), calls, chunksize=1)
    finally:
        pool.close()
