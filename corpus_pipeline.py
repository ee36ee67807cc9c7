"""A corpus pipeline of the training-data operators.

Language identification drops texts without a language, exact and near
de-duplication keep one document of each group, decontamination drops documents
that hold benchmark items, and packing lays the rest out in sequences. Every
stage works on all rows that its predecessor kept.

Defined results: null text, empty text and text without a letter have no language
and go first; of equal texts the row with the largest id stays, of rows with one id
and text one; of near copies the smallest id; an id with several texts stays while
one of them does; texts have any length; an empty table gives no pieces; further
columns pass all stages but the last, whatever their names. Ties are decided by the
operators, whose docstrings say how.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from auditlake.llm import decontamination, exact_dedup, language, near_dedup, packing
from auditlake.llm.common import documents, ship, written


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return language.keep_identified(docs)


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.drop_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dedup.one_of_each(docs)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontamination.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces with their sequence: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    return packing.pack(written(packing.tokenised(docs), "pieces"))


STAGES = [
    ("language", identify_language),
    ("exact_dedup", drop_exact_copies),
    ("near_dedup", drop_near_copies),
    ("decontamination", drop_benchmark),
    ("packing", pack),
]

#: Suffix automata, alignment and packing have no SQL; tests/llm compares the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
