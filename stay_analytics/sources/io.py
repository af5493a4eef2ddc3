"""Sources and sinks (IO1, IO4-IO9).

CSV is read with an explicit all-string schema (dirty fields are parsed
later by Column expressions), never ``inferSchema``. Writers partition by
city so readers prune partitions; the dataset inventory lists files with the
``binaryFile`` source selecting only ``path`` and ``length`` (no content is
read).
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

CSV_OPTIONS = {"header": "true", "multiLine": "true", "escape": '"', "quote": '"'}


def read_csv_columns(spark: SparkSession, path: str, header_columns: Sequence[str], wanted: Sequence[str],
                     partitions: int | None = None) -> tuple[DataFrame, list[str]]:
    """IO1: read a CSV (gz allowed) with an explicit string schema; keep wanted columns that exist.

    Returns the frame and the wanted columns that are missing. A gzip file is
    one split, so ``partitions`` repartitions right after the read.
    """
    schema = T.StructType([T.StructField(c, T.StringType(), True) for c in header_columns])
    df = spark.read.options(**CSV_OPTIONS).schema(schema).csv(path)
    have = [c for c in wanted if c in header_columns]
    out = df.select(*have)
    if partitions:
        out = out.repartition(partitions)
    return out, [c for c in wanted if c not in header_columns]


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").options(**CSV_OPTIONS).csv(path)


def write_table(df: DataFrame, path: str, partition_by: Sequence[str] = ("city",), fmt: str = "parquet") -> None:
    """IO5/IO6: overwrite a layer, one folder per city (partition pruning on read)."""
    w = df.write.mode("overwrite")
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.format(fmt).save(path)


def read_table_layer(spark: SparkSession, path: str, cities: Sequence[str] | None = None) -> DataFrame:
    """Read a layer written by ``write_table``; a city filter prunes partitions."""
    df = spark.read.parquet(path)
    return df.filter(F.col("city").isin(*cities)) if cities else df


def union_cities(frames: Mapping[str, DataFrame]) -> DataFrame:
    """IO7: tag each per-city frame with its city and union by name (missing columns -> null)."""
    out = None
    for city, df in frames.items():
        tagged = df.withColumn("city", F.lit(city))
        out = tagged if out is None else out.unionByName(tagged, allowMissingColumns=True)
    return out


def file_inventory(spark: SparkSession, folder: str, glob: str = "*.parquet") -> DataFrame:
    """IO8: files of a folder with size in MB; only path/length are read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(folder).select("path", "length")
    return files.select(F.regexp_extract("path", r"([^/]+)$", 1).alias("file"),
                        F.col("length").alias("bytes"), F.round(F.col("length") / (1024 * 1024), 3).alias("size_mb"))


def row_counts(tables: Mapping[str, DataFrame]) -> DataFrame:
    """IO8: rows and columns per loaded table (one small aggregate per table, unioned)."""
    out = None
    for name, df in tables.items():
        part = df.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(name).alias("table"), "rows",
                                                              F.lit(len(df.columns)).alias("columns"))
        out = part if out is None else out.unionByName(part)
    return out


def available_cities(df: DataFrame, city: str = "city") -> DataFrame:
    """IO9: distinct cities present in a layer."""
    return df.select(city).distinct()
