"""A corpus pipeline: documents without toxic ones, near-duplicates and repeated passages, mixed and packed.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written and
read again as the next one's docs.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from zonedeck.llm import common, mixing, packing, simhash_dedup, substring_dedup, toxicity


def toxicity_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity network rejects go."""
    return toxicity.reject_toxic(docs, common.table(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (0.8 of 5-word shingles in common) stays."""
    return simhash_dedup.without_near_copies(docs)


def substring_cut(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Word windows that start earlier in the corpus are cut from the texts."""
    return substring_dedup.without_repeats(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    return mixing.mixed_documents(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences, a row a piece."""
    return packing.pack_documents(docs)


STAGES = [
    ("toxicity", toxicity_filter),
    ("simhash_near_dedup", near_dedup),
    ("substring_dedup", substring_cut),
    ("source_mixing", mix),
    ("best_fit_packing", pack),
]

#: Hashes, a trained network and a tokenizer: SQL can't express the stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to documents; what each returns is written to the shared folder and read again, and goes when the next one is done.

    The last stage has its pieces in a checkpoint of its own when it returns, so nothing stays behind.
    """
    docs = common.table(spark, sf_dir, "documents")
    folder = f"{common.shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs.write.parquet(f"{folder}/{k}-{name}")
            docs = spark.read.parquet(f"{folder}/{k}-{name}")
        if k:
            common.remove(spark, f"{folder}/{k - 1}-{STAGES[k - 1][0]}")
    common.remove(spark, folder)
    return docs
