"""From raw documents to packed training sequences, in four stages.

1. toxicity: the tagger of toxic words is fitted on labelled rows; documents it rejects go.
2. SimHash near-duplicates: one document of each group stays, that with the smallest doc_id.
3. curriculum mixing: documents that the mix takes come once per copy, sorted by position.
4. best-fit packing: the mixed documents' token pieces with their sequence and place.

Every stage works on all that the one before it kept. The first three return the columns
of their input; each result is written as Parquet and read back by the next stage, so a
lost executor never costs more than the stage that was running. Nulls, repeated rows and
empty tables are handled as the operators' docstrings say.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from adlens.llm import curriculum, packing, simhash, toxicity
from adlens.llm.common import written
from adlens.llm.queries import tokenizer_path


def toxicity_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity.clean_rows(docs, toxicity.train(docs, labels))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.representatives(docs, shingle=3, max_bits=2)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return curriculum.training_order(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs, tokenizer_path(), end_id=0, capacity=2048)


STAGES = [
    ("toxicity", toxicity_filter),
    ("simhash_near_dedup", near_dedup),
    ("curriculum_mixing", mixing),
    ("best_fit_packing", best_fit_packing),
]

#: No SQL can fit the tagger or run the tokenizer; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
