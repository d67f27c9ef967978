"""The corpus pipeline: quality classifier, quality rules, near-duplicate removal, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from glyphsieve.llm import cotrain, neardup, packing, rules, tokens
from glyphsieve.llm.common import materialize


def classify_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the co-trained classifier keeps; it learns from the labels of those given."""
    return cotrain.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def apply_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the thresholds of their language and source."""
    return rules.keep_good(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest doc_id, of each group of near copies."""
    return neardup.keep_one(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in sequences of at most 4096 ids; see packing.pack."""
    # workers still hold what the stages before took, so this one takes little
    return packing.pack(docs, tokens.default_tokenizer(), batch_rows=1000, encode_chars=1 << 20, cached=100_000)


STAGES = [
    ("quality_classifier", classify_quality),
    ("quality_rules", apply_rules),
    ("near_duplicates", drop_near_copies),
    ("best_fit_packing", pack_sequences),
]

#: A trained classifier, quantile sketches, signatures and a genetic search have no SQL form; tests hold each against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows over documents; every stage's result is written in the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
