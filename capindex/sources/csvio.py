"""Escaped-CSV sink and source: ``\\`` and ``,`` escaped with a backslash, no quoting, ``\\n`` line ends.

Spark's CSV reader cannot read this dialect (an escaped comma still splits a cell), so both directions
are written as string expressions over ``write.text`` / ``read.text``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import cdx as fx
from ..schema import CAPTURE_COLUMNS, CAPTURE_SCHEMA, EXPORT_DATE_FORMAT
from ..session import ensure_utc

CSV_HEADER_LINE = ",".join(CAPTURE_COLUMNS)


def _cell_text(df: DataFrame, name: str):
    dtype = df.schema[name].dataType.simpleString()
    if dtype == "timestamp":
        return F.date_format(F.col(name), EXPORT_DATE_FORMAT)
    return F.col(name).cast("string")


def to_escaped_lines(df: DataFrame, columns=CAPTURE_COLUMNS) -> DataFrame:
    """One ``value`` line per row: cells escaped and joined by ``,``; null -> empty cell."""
    ensure_utc(df.sparkSession)
    cells = [fx.escape_cell(_cell_text(df, c)) for c in columns]
    return df.select(F.concat_ws(",", *cells).alias("value"))


def write_escaped_csv(df: DataFrame, path: str, header: bool = True, columns=CAPTURE_COLUMNS,
                      mode: str = "errorifexists") -> None:
    """Distributed write in one job, one part file per partition, no shuffle. ``header`` puts the column line first in
    every file."""
    lines = to_escaped_lines(df, columns)
    if header:
        top = ",".join(columns)
        # a row that reads like the column line keeps apart from it by an escape that the reader takes away again
        lines = lines.select(F.when(F.col("value") == top, "\\" + top).otherwise(F.col("value")).alias("value"))
        # documented layout of monotonically_increasing_id: the row's number in its partition in the lower 33 bits
        first = F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1) == 0
        lines = lines.select(F.when(first, F.concat(F.lit(top + "\n"), "value")).otherwise(F.col("value")).alias("value"))
    lines.write.mode(mode).option("lineSep", "\n").text(path)


def from_escaped_lines(lines: DataFrame, columns=CAPTURE_COLUMNS, schema=CAPTURE_SCHEMA) -> DataFrame:
    """Data lines back to typed columns; empty cells become null."""
    ensure_utc(lines.sparkSession)
    cells = lines.select(fx.split_escaped_line("value").alias("_c"))
    out = []
    for i, name in enumerate(columns):
        raw = F.get(F.col("_c"), i)
        cell = F.when(raw != "", raw)
        dtype = schema[name].dataType.simpleString() if name in schema.fieldNames() else "string"
        if dtype == "timestamp":
            cell = F.try_to_timestamp(cell, F.lit(EXPORT_DATE_FORMAT))
        elif dtype != "string":
            cell = cell.try_cast(dtype)
        out.append(cell.alias(name))
    return cells.select(*out)


def read_escaped_csv(spark: SparkSession, path: str, columns=CAPTURE_COLUMNS, header: bool = True) -> DataFrame:
    """``header``: lines that are the column line are headers, at the top of a file or where files were joined; the writer
    escapes a row that would read like one. So every line is judged by itself: one scan, nothing is shuffled."""
    lines = spark.read.option("lineSep", "\n").text(path)
    if header:
        lines = lines.where(F.col("value") != F.lit(",".join(columns)))
    return from_escaped_lines(lines, columns)
