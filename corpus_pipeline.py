"""Corpus pipeline: five of the dealt operators as stages over ``documents``.

``STAGES`` lists (name, function) pairs.  A function takes (spark, docs,
sf_dir) and returns a DataFrame; ``run`` writes each result as Parquet under
``spark.checkpoint.dir`` and reads it back as the next stage's documents.  All
stages but the last return the columns of documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from errata.llm import jaccard, mixing, packing, pii, quality
from errata.session import materialize


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 2: documents that the quality rules reject go."""
    return quality.keep_quality(docs)


def near_copy_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 1: of each group of linked documents the first stays."""
    return jaccard.drop_near_copies(docs)


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 4: personal data gives way to its kind in brackets."""
    clean = pii.redact_pii(docs)
    return clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 5: the documents become the mix, dealt over its shards."""
    return mixing.mixed_documents(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 6: the mix becomes pieces of sequences of 4096 tokens."""
    return packing.pack(docs).drop("row_key")


STAGES = [("quality", quality_stage), ("near_copies", near_copy_stage), ("pii", pii_stage), ("mixing", mixing_stage),
          ("packing", packing_stage)]

# run()'s rows need the tokenizer's ids and hash draws, which SQL cannot express
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, one after the other, over the documents table."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
