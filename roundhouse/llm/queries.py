"""The registered queries of the training-data operators, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (ann, jaccard, merkle, mixing, neardup, oracle, packing, pii, pseudo, quality, substring, suffix,
               tiers, variants)
from .common import table


def op1_adaptive_scan_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    """5 nearest by cosine of every 50th vector (recall against brute force >= 0.9)."""
    return ann.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, 5)


def op2_super_kmer_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """50-word windows that start in a smaller document are removed."""
    return substring.deduplicate(table(spark, sf_dir, "documents"))


def op3_subspace_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors linked by cosine >= 0.95, their classes and kept rows."""
    return neardup.near_duplicates(table(spark, sf_dir, "embeddings"))


def op4_subset_sum_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents mixed to 5:2:1 source weights over 150 % of all words."""
    return mixing.mix(table(spark, sf_dir, "documents")).select(
        "doc_id", "size", "source_size", "target", "taken", "source")


def op5_ftrl_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document."""
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_pseudo_likelihood(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Masked pseudo-log-likelihood of every document."""
    return pseudo.score(table(spark, sf_dir, "documents"))


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token pieces of all documents packed into sequences of at most 4096 tokens."""
    return packing.pack_documents(table(spark, sf_dir, "documents")).select(
        "doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op8_difference_cover_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """200-byte strings that start anywhere else too are removed."""
    return suffix.deduplicate(table(spark, sf_dir, "documents"))


def op9_bootstrapped_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base and learned personal-data spans of every document."""
    found = pii.find(table(spark, sf_dir, "documents"))
    number = lambda k: F.size(F.filter("base", lambda x: x["kind"] == k)).cast("long")
    return found.select("doc_id", *[number(i).alias(f"n_{k}") for i, k in enumerate(pii.KINDS)],
                        F.sha2(pii.told(F.col("base")), 256).alias("base_sha256"),
                        pii.told(F.col("spans")).alias("spans"))


def op10_partitioned_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes of documents linked by Jaccard >= 0.8 of their 5-word shingles."""
    return jaccard.similar_components(table(spark, sf_dir, "documents"))


def op11_pivotal_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spelling variants of all words of 7 code points and 2 occurrences, with their forms and roots."""
    return variants.group_variants(variants.count_words(table(spark, sf_dir, "documents"), delete_every=31))


def op12_tiered_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token pieces of all documents packed into full windows of 2048 tokens and of lower powers of two."""
    return tiers.pack_documents(table(spark, sf_dir, "documents")).select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "tier", "step_id")


def op13_butterfly_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Merkle manifest of all documents and the check of a tampered copy against it."""
    return merkle.manifest_digests(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (
        op1_adaptive_scan_ann, op2_super_kmer_dedup, op3_subspace_near_dedup, op4_subset_sum_mix,
        op5_ftrl_quality, op6_pseudo_likelihood, op7_best_fit_packing, op8_difference_cover_dedup, op9_bootstrapped_pii,
        op10_partitioned_jaccard, op11_pivotal_variants, op12_tiered_packing, op13_butterfly_manifest)
}

ORACLE_SQL: dict[str, str] = oracle.SQL
