"""Corpus pipeline: quality, near duplicates, personal data, mixing, packing.

``STAGES`` holds the (name, function) stages; each takes (spark, docs,
sf_dir) and returns a DataFrame that is written as Parquet and read again as
the next stage's docs. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from roundhouse.llm import jaccard, mixing, packing, pii, quality
from roundhouse.llm.common import Written, table


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts. Null and empty texts are judged by the bias.

    Extra columns stay, whatever their names.
    """
    weights = quality.train(docs.select("doc_id", "text"), table(spark, sf_dir, "labels"))
    mine = [f"u_{i}" for i in range(len(docs.columns))]
    named = docs.select(*[F.col(c).alias(u) for c, u in zip(docs.columns, mine)], "text")
    scored = quality.score(named, weights, keep=mine).filter(F.col("score") >= quality.THRESHOLD)
    return scored.select(*[F.col(u).alias(c) for c, u in zip(docs.columns, mine)])


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of smallest doc_id of each class of n-gram Jaccard >= 0.8.

    Texts without a word are in no class and stay; so do rows without a doc_id
    that are in no class. Rows that repeat a kept doc_id all stay.
    """
    found = jaccard.similar_components(docs).filter(F.col("doc_id").isNotNull())
    gone = found.filter(F.col("component_id") < F.col("doc_id")).select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document with personal data replaced by its kind; n_chars follows the text."""
    out = pii.redact(docs)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it (0, 1 or 2 times)."""
    return mixing.apply(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces packed into sequences."""
    return packing.pack_documents(docs).select(
        "doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


STAGES = [
    ("quality", keep_quality),
    ("near_duplicates", drop_near_duplicates),
    ("personal_data", redact_personal_data),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

ORACLE_SQL = None  # training, packing and the mix's subset sums are beyond SQL


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies all stages to ``documents``, each written and read again."""
    docs = table(spark, sf_dir, "documents")
    scratch = Written(spark, "pipeline")
    for i, (name, stage) in enumerate(STAGES):
        docs = scratch.put(stage(spark, docs, sf_dir), f"{i}-{name}")
    return docs
