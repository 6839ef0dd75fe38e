"""The cleaning pipeline of a training corpus: five stages over ``documents``, each written and read again.

Columns other than doc_id, text, lang, source and n_chars are carried through all stages, whatever their names; null
texts fail the quality rules, null ids are kept by all stages. An empty table stays empty.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from lemmata.llm import decontaminate, line_dedup, mixing, near_dedup, quality
from lemmata.llm.common import shared_folder, table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 7: documents that the base rule or an adaptive threshold rejects go."""
    return quality.keep_quality(docs)


def line_chunks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 9: repeated passages go from all texts but the first."""
    return line_dedup.drop_repeated_lines(docs)


def minhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 2: one document of each near-duplicate group stays."""
    return near_dedup.drop_near_duplicates(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 4: documents into which a benchmark item leaked go."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 3: documents are emitted as often as the mix takes them."""
    return mixing.mix_documents(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_chunks),
    ("minhash_near_dedup", minhash_near_dedup),
    ("benchmark_decontamination", benchmark_decontamination),
    ("source_mixing", source_mixing),
]

#: Line chunks, MinHash and spaced seeds aren't SQL; tests/llm/test_brute.py holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``. What a stage wrote is emptied once the next one's output is written."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
        stage(spark, docs, sf_dir).write.parquet(path)
        if before:
            spark.createDataFrame([], docs.schema).write.mode("overwrite").parquet(before)
        docs, before = spark.read.parquet(path), path
    return docs
