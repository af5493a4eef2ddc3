"""Corpus pipeline: from raw documents to packed training sequences.

``STAGES`` lists (name, function); each function takes (spark, docs, sf_dir)
and returns a DataFrame that is written as Parquet and read again as the next
one's ``docs``. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stay_analytics.llm import langid, mixing, neardup, packing, suffix
from stay_analytics.llm.common import free_name
from stay_analytics.session import ensure_checkpoint_dir
from stay_analytics.sources.tables import read_table

#: A document goes if no language reaches this probability, or if it has no letter at all.
LEAST_LANGUAGE_SCORE = 0.3


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in some language: those without a letter, or like no language learned, go."""
    lang, score = free_name(docs, "lang_pred"), free_name(docs, "lang_score")
    said = langid.identify(docs, langid.learn(docs.select("doc_id", "text", "lang")), lang, score)
    return said.where((F.col(lang) != langid.UNKNOWN) & (F.col(score) >= LEAST_LANGUAGE_SCORE)).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of every group of near duplicates."""
    gone = neardup.near_duplicates(docs).where(~F.col("kept")).select(F.col("doc_id").alias("gone_id")).distinct()
    return docs.join(gone, docs.doc_id == gone.gone_id, "left_anti").select(*docs.columns)


def remove_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their texts without byte strings that start earlier; whole characters stay. Null texts stay null."""
    left = suffix.remove_repeated_bytes(docs.withColumn(free_name(docs, "was_null"), F.col("text").isNull()))
    was_null = F.col("row")[free_name(docs, "was_null")]
    text = F.when(~was_null, F.col("kept_text"))
    new = {"text": text, "n_chars": F.length(text).cast("long")}
    return left.select(*[(new[c] if c in new else F.col("row")[c]).alias(c) for c in docs.columns])


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of the sources takes them."""
    return mixing.mixed_documents(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of 2048 tokens."""
    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("language_id", identify_language),
    ("near_duplicates", drop_near_duplicates),
    ("suffix_array_dedup", remove_repeats),
    ("mix_sources", mix_sources),
    ("pack", pack),
]

#: SQL can't express the language model, the tokenizer or the packing.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what each returns is written to the shared checkpoint folder and read again."""
    ensure_checkpoint_dir(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/pipeline-{uuid.uuid4()}"
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
