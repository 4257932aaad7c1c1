"""Corpus pipeline: stages over documents, each written as Parquet and reread by the next.

Quality rules drop documents that repeat themselves or have too few words; the n-gram join leaves
one document of each group of near copies; decontamination drops documents that contain a test
item; the secret scan masks secrets in the texts; mixing leaves the documents that the target
weights use, in tokens, with their rate and copies. An empty table passes every stage empty; nulls, ties and
repeated rows are as each operator defines.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vectrail.llm import decontaminate, mixing, ngram_join, quality_rules, secrets
from vectrail.llm.common import table
from vectrail.llm.queries import PIECES
from vectrail.sources.scratch import Tables
from vectrail.sources.shipping import ship


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return quality_rules.accepted(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return ngram_join.deduplicated(docs)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def masked(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secrets.redact(docs).withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs, table(spark, sf_dir, "labels"), pieces=PIECES)


STAGES = [
    ("quality_rules", quality),
    ("ngram_jaccard_join", near_copies),
    ("decontamination", benchmark),
    ("secret_scans", masked),
    ("mixing", mixed),
]

#: Similarity components and a trained classifier have no SQL form; tests/llm/test_pipeline.py holds
#: every stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, last = table(spark, sf_dir, "documents"), None
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            own = Tables()
            docs = own.written(docs, f"pipeline-{k}")
            if last:
                last.drop()  # the stage before has been read
            last = own
    return docs
