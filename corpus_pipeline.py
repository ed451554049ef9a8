"""The corpus pipeline: quality classifier, near-dedup, benchmark decontamination, best-fit packing.

Each stage is (name, function); a function takes (spark, docs, sf_dir), works on all rows that the stage before it
kept, and returns a DataFrame. All but the last return the columns of `documents`. `run` writes each stage's rows to
the shared folder and reads them again as the next one's docs.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lotstack.llm import decontaminate, neardup, packing, quality
from lotstack.llm.common import free_name, materialize

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts, as they are, whatever columns they have."""
    trees = quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    own = free_name("_quality", docs)
    return quality.score(docs, trees, name=own).where(F.col(own) >= quality.THRESHOLD).drop(own)


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, the one with the smallest id; texts without words all stay.

    Rows are told apart by a number of their own, so rows with equal or null ids are documents like others. The numbers are
    written before they are used, so that a task that runs again can't number rows otherwise.
    """
    key = free_name("_row", docs)
    rows = materialize(docs.withColumn(key, F.monotonically_increasing_id()), "numbered")
    found = neardup.near_duplicates(rows.select(F.col(key).alias("doc_id"), "text"), neardup.PIPELINE_PERCENT)
    groups = found.select(F.col("doc_id").alias(key), "component_id").join(rows.select(key, "doc_id"), key)
    first = groups.groupBy("component_id").agg(F.min(F.struct("doc_id", key)).alias("first")).select(F.col(f"first.{key}").alias(key))
    return rows.join(first, key, "left_semi").select(*docs.columns)


def keep_clean_of_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark passage."""
    return decontaminate.decontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document goes in the training sequences."""
    return packing.pack(packing.token_pieces(docs, TOKENIZER)).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


STAGES = [
    ("quality", keep_quality),
    ("near_dedup", keep_one_of_each_group),
    ("decontamination", keep_clean_of_benchmark),
    ("packing", pack_sequences),
]

#: SQL cannot express the classifier, the sketches or the tokenizer; tests hold the stages against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
