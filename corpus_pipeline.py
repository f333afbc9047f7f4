"""Training corpus in five stages: quality, line deduplication, near-duplicates, decontamination, mixing.

Each stage takes (spark, docs, sf_dir), works on all rows its predecessor kept, and returns the columns of ``documents``;
the last returns what the mix takes of each document that is left.  Nulls, empty and very long texts, repeated rows, empty
tables and extra columns follow the rules that each operator states.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from loadlens.llm.common import cut, table
from loadlens.llm.decontamination import decontaminate
from loadlens.llm.lines import drop_boilerplate
from loadlens.llm.mixing import mix
from loadlens.llm.neardups import drop_near_duplicates
from loadlens.llm.quality import drop_rejected


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    return drop_rejected(docs, table(spark, sf_dir, "labels"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that many sources share go, but for their first occurrence."""
    return drop_boilerplate(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of copies stays."""
    return drop_near_duplicates(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words that the mix takes of each document."""
    return mix(docs)[0]


STAGES = [
    ("quality", quality),
    ("line dedup", line_dedup),
    ("near dedup", near_dedup),
    ("decontamination", decontamination),
    ("mixing", mixing),
]
#: The classifier and the sketches of near-duplicates cannot be said in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written as Parquet and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
