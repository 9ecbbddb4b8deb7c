"""The reference's two entry points, as DataFrame functions over the operators of this package.

- lookup: ``url``, ``fl``, ``limit``, ``offset``, ``output`` -> the matching captures as CSV or JSON lines;
- conversion: a CDX file -> an escaped-CSV file beside it, skipped when that output already exists.
"""

from __future__ import annotations

from collections.abc import Sequence
from urllib.parse import unquote_plus

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import DEFAULT_FIELDS, DEFAULT_LIMIT, EXPORT_DATE_FORMAT
from ..session import path_exists
from ..sources.cdx import accepted, read_cdx
from ..sources.csvio import to_escaped_lines, write_escaped_csv
from .lookup import search


def cdx_search(df: DataFrame, url: str, fl: str | Sequence[str] | None = None, limit: int | None = None,
               offset: int | None = None, output: str = "csv") -> DataFrame:
    """Captures whose original URL is ``url`` (percent-decoded, as a request parameter is), ordered by
    ``(url, date, id)``, ``offset``/``limit`` applied, projected to ``fl`` (default
    ``ourl,date,mime,arc,offset``). ``output='json'`` gives one JSON object per line, anything else one
    escaped-CSV line; the result is a one-column (``value``) DataFrame, written or streamed by the caller.
    """
    cols = [c.strip() for c in fl.split(",")] if isinstance(fl, str) else list(fl or DEFAULT_FIELDS)
    rows = search(df, ourl=unquote_plus(url), columns=cols, limit=DEFAULT_LIMIT if limit is None else limit,
                  offset=offset or 0)
    if output == "json":
        # timestamps as the export text (UTC, trailing Z), like the CSV cells
        fixed = [F.date_format(c, EXPORT_DATE_FORMAT).alias(c) if rows.schema[c].dataType.simpleString() == "timestamp"
                 else F.col(c) for c in cols]
        return rows.select(F.to_json(F.struct(*fixed)).alias("value"))
    return to_escaped_lines(rows, cols)


def convert_cdx(spark: SparkSession, path: str, out: str | None = None) -> str | None:
    """Convert CDX file(s) at ``path`` into escaped CSV at ``out`` (default ``path + '.csv'``). Returns the
    output path, or None when it is already complete (nothing is redone)."""
    out = out or f"{path.rstrip('/')}.csv"
    if path_exists(spark, f"{out}/_SUCCESS"):
        return None
    # a folder without the writer's mark is what an interrupted run left
    write_escaped_csv(accepted(read_cdx(spark, path)), out, mode="overwrite")
    return out


def convert_files(spark: SparkSession, paths: Sequence[str]) -> list[tuple[str, str | None, str]]:
    """:func:`convert_cdx` for each of several sources: (source, output, ``converted`` | ``exists`` | ``missing``). A missing
    source is reported and the others go on."""
    out = []
    for p in paths:
        if not path_exists(spark, p):
            out.append((p, None, "missing"))
            continue
        done = convert_cdx(spark, p)
        out.append((p, done or f"{p.rstrip('/')}.csv", "converted" if done else "exists"))
    return out
