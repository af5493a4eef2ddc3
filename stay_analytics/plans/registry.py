"""Registry of named queries: a Spark builder plus, where SQL can express it,
an independent oracle written for DuckDB over the same parquet tables.

Each builder takes ``(spark, sf_dir)`` and returns a lazy DataFrame. Integer
outputs are widened to BIGINT and floats to DOUBLE on both sides so schemas
compare equal.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


@dataclass
class Query:
    name: str
    build: Callable[[SparkSession, str], DataFrame]
    oracle: str | None
    doc: str


REGISTRY: dict[str, Query] = {}


def register(name: str, oracle: str | None = None):
    """Decorator: register ``fn(spark, sf_dir) -> DataFrame`` under ``name``."""

    def deco(fn):
        if name in REGISTRY:
            raise ValueError(f"duplicate query {name}")

        def build(spark: SparkSession, sf_dir: str) -> DataFrame:
            return widen(fn(spark, sf_dir))

        REGISTRY[name] = Query(name, build, oracle, (fn.__doc__ or "").strip())
        return fn

    return deco


def widen(df: DataFrame) -> DataFrame:
    """Cast small integers to bigint and floats/decimals to double."""
    out = []
    for f in df.schema.fields:
        t = f.dataType
        if isinstance(t, (T.ByteType, T.ShortType, T.IntegerType)):
            out.append(F.col(f"`{f.name}`").cast("bigint").alias(f.name))
        elif isinstance(t, (T.FloatType, T.DecimalType)):
            out.append(F.col(f"`{f.name}`").cast("double").alias(f.name))
        else:
            out.append(F.col(f"`{f.name}`"))
    return df.select(*out)


def load_all() -> dict[str, Query]:
    """Import every plan module so its queries register."""
    from . import (q_calendar, q_chat, q_cleaning, q_cluster, q_dimensions, q_features, q_forecast,  # noqa: F401
                   q_linear, q_ml, q_profile, q_recommend, q_text)
    return REGISTRY
