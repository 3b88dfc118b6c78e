"""A training corpus in five stages, each of which calls one operator of ``vertexloom.llm``.

A stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame. Its result is written as Parquet in
the shared checkpoint folder and read again as the next one's ``docs``, so a lost executor costs at
most a stage. All but the last return the columns of ``documents``.

In every stage a null text counts as empty and an empty table gives no rows; very long texts are read
whole; repeated rows are judged alike, and only the two stages that look for copies make one of them.
Other columns of ``docs`` are kept whatever they are called, but by the last stage, which returns pieces.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from vertexloom.files import discard
from vertexloom.llm import op2_exact_dedup, op6_quality, op7_simhash, op9_decontaminate, op10_packing
from vertexloom.session import ensure_checkpoint_dir, spread, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not reject."""
    return op6_quality.keep_good(docs, table(spark, sf_dir, "labels"))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents with equal text the one with the largest id."""
    return op2_exact_dedup.drop_copies(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of near copies, by fingerprints within two bits or by four fifths of their five-word shingles, the one with the smallest id."""
    return op7_simhash.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that do not hold benchmark passages."""
    return op9_decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document's token pieces with their sequence and offset."""
    return op10_packing.pack_documents(docs, public_tokenizers.path(op10_packing.MODEL))


STAGES = [
    ("quality", quality),
    ("exact_dedup", exact_dedup),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("packing", packing),
]

#: SQL can express neither the classifier nor the packing; the tests hold the result against the operators' own rules.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``. A stage's table goes when the next one has been written."""
    docs = spread(table(spark, sf_dir, "documents"))
    folder = f"{ensure_checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    before = None
    for name, stage in STAGES:
        path = f"{folder}/{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before is not None:
            discard(before)
        before = path
    return docs
