"""Corpus pipeline: language ID, exact dedup, near dedup, benchmark decontamination, mixing.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; every row keeps the columns of
documents. No stage is expressible in SQL as a whole (a trained classifier, fingerprints), so ORACLE_SQL is None and
`tests/llm/test_others.py` holds the stages against brute force.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quillgraph.llm import decontaminate, exact_dedup, language_id, mixing, simhash
from quillgraph.llm.common import remainder, store, table


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose language can't be told go."""
    return language_id.accepted(docs, language_id.fit(docs.filter(remainder("doc_id", 4) != 2)))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the longest row stays."""
    return exact_dedup.survivors(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies stays, by the settings of the SimHash operator: three words, three differing bits."""
    return simhash.survivors(docs)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that hold ten words in a row of a benchmark item go."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources in proportion to their weights; documents are left out or repeated."""
    return mixing.mix(docs)


STAGES = [("language_id", language), ("exact_dedup", exact), ("near_dedup", near), ("decontamination", benchmark), ("mixing", mixture)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what a stage returns is written and read again by the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = store(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
