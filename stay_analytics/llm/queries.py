"""Queries of this package: name -> builder, and DuckDB SQL where SQL can express one."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stay_analytics.sources.tables import read_table

from . import extract, fim, fingerprint, langid, linededup, merkle, mixing, neardup, packing, passages, suffix, tokencount, topk


def op1_extract_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page and its length in code points."""
    pages = read_table(spark, sf_dir, "pages").select("page_id", "url", "html")
    texts = extract.extract_text(pages, extract.learn_weights(pages))
    return texts.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op2_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate group of every document, and whether it is the one that stays."""
    return neardup.near_duplicates(read_table(spark, sf_dir, "documents"))


def op3_remove_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document, those removed as repeats, and a digest of the rest."""
    left = passages.remove_repeated_passages(read_table(spark, sf_dir, "documents"))
    return left.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op4_count_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words, unigram tokens and score of every document."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return tokencount.count_tokens(docs, public_tokenizers.path("piece_bpe_32k.model")).drop("text")


def op5_pack_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of 2048 tokens."""
    return packing.pack_documents(read_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op6_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that a mix of the sources takes from each document."""
    return mixing.mix_copies(read_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op7_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint of every document, of its edited text, and their likeness."""
    return fingerprint.compare_with_edits(read_table(spark, sf_dir, "documents"))


def op8_remove_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of every document, those removed as repeats, and a digest of the rest."""
    left = suffix.remove_repeated_bytes(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return left.select("row.doc_id", "n_bytes", (F.col("n_bytes") - F.length("kept")).alias("n_removed"),
                       F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op9_identify_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted language of every document, and whether it was held out from training."""
    docs = read_table(spark, sf_dir, "documents")
    said = langid.identify(docs.select("doc_id", "text"), langid.learn(docs.select("doc_id", "text", "lang")))
    return said.select("doc_id", F.coalesce(langid.remainder(F.col("doc_id")) == 1, F.lit(False)).alias("held_out"), "lang_pred", "score")


def op10_top_k_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 best inner products for every 50th embedding."""
    return topk.top_k(read_table(spark, sf_dir, "embeddings"))


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Form, cuts and digests of the fill-in-middle output of every document."""
    cut = fim.fill_in_middle(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return cut.select("doc_id", "fim.n", "fim.form", "fim.prefix_chars", "fim.middle_chars", F.sha2("fim.output", 256).alias("output_sha256"),
                      F.sha2(fim.restored(F.col("fim.output"), F.col("fim.form")), 256).alias("restored_sha256"))


def op12_dedup_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of every document, those dropped as repeats, and a digest of the rest."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    left = linededup.drop_repeated_lines(docs, linededup.insert(linededup.empty_index(docs), docs))
    return left.select("row.doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaf, roots, proof digest and check of every document in the manifest."""
    return merkle.verified_manifest(read_table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_extract_text": op1_extract_text,
    "op2_near_duplicates": op2_near_duplicates,
    "op3_remove_passages": op3_remove_passages,
    "op4_count_tokens": op4_count_tokens,
    "op5_pack_documents": op5_pack_documents,
    "op6_mix_sources": op6_mix_sources,
    "op7_fingerprints": op7_fingerprints,
    "op8_remove_repeats": op8_remove_repeats,
    "op9_identify_language": op9_identify_language,
    "op10_top_k_search": op10_top_k_search,
    "op11_fill_in_middle": op11_fill_in_middle,
    "op12_dedup_lines": op12_dedup_lines,
    "op13_merkle_manifest": op13_merkle_manifest,
}

ORACLES: dict[str, str] = {
    "op6_mix_sources": mixing.ORACLE,
    "op10_top_k_search": topk.ORACLE,
    "op11_fill_in_middle": fim.ORACLE,
    "op12_dedup_lines": linededup.ORACLE,
}
