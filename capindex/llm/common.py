"""Helpers shared by the operators of this package."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from capindex.session import scratch_path

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Java regex of the white space that separates words: blank and the control characters tab to CR.
BLANKS = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given Parquet tables (any Hadoop path)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to a fresh folder of the shared directory and read it back.

    This cuts the lineage: what follows re-reads files that every executor sees, so a lost executor costs
    a re-read and values that depend on task order are fixed once.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def text_or_empty(text: Column) -> Column:
    return F.coalesce(text.cast("string"), F.lit(""))


def ascii_lower(text: Column) -> Column:
    """Only A-Z in lower case. ``lower`` does that for texts of one-byte characters; others are translated."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(
        F.translate(text, UPPER, UPPER.lower()))


def words_of(text: Column) -> Column:
    """Words between white space; null and blank texts have none."""
    return F.filter(F.split(text_or_empty(text), BLANKS, -1), lambda w: w != "")


def broadcast_if_small(df: DataFrame, row_bytes: int, limit: int = 32 << 20) -> DataFrame:
    """``df`` with a broadcast hint when its counted rows times ``row_bytes`` stay below ``limit`` bytes; else a join
    shuffles it. Give it staged tables: their count reads no data."""
    return F.broadcast(df) if df.count() * row_bytes <= limit else df


def grams(hashes: Column, k: int, n: Column, seed: int = 0) -> Column:
    """Hashes of the ``k`` consecutive entries that start at each of the ``n`` entries of an array column.

    ``hashes`` must be a column of its own (not an expression): it is read again at every position.
    """
    first = [F.lit(seed)] if seed else []
    return F.filter(F.transform(hashes, lambda x, i: F.when(i + k <= n, F.xxhash64(
        *first, x, *[F.get(hashes, i + j) for j in range(1, k)]))), lambda x: x.isNotNull())
