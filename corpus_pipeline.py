"""Corpus pipeline: documents through quality rules, line dedup, Jaccard join, decontamination and packing.

``STAGES`` lists (name, function); each function takes (spark, docs, sf_dir) and returns a DataFrame, written as
Parquet and read again as the next one's ``docs``. All but the last return the columns of ``docs``:

``quality``        documents that the rules reject go
``linededup``      blocks that an earlier document has are deleted; documents left without a word go
``jaccard``        of each group of near copies the document of the least id stays
``decontaminate``  documents that share a window with a benchmark item go
``packing``        what is left, as pieces of token sequences
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from capindex.llm.common import stage, table
from capindex.llm.decontaminate import decontaminated
from capindex.llm.jaccard import one_of_each
from capindex.llm.linededup import dedup_lines
from capindex.llm.packing import packing_report
from capindex.llm.quality import good


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return good(docs)


def linededup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return dedup_lines(docs)


def jaccard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return one_of_each(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminated(docs, table(spark, sf_dir, "benchmark"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing_report(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality), ("linededup", linededup), ("jaccard", jaccard), ("decontaminate", decontaminate), ("packing", packing)]

#: SQL can't express the covariance estimates, the alignment or the packing order; tests use brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole ``documents`` table."""
    docs = table(spark, sf_dir, "documents")
    for name, apply in STAGES[:-1]:
        docs = stage(apply(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
