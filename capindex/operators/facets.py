"""Aggregations over captures: hit counts, facets (with optional zero counts), per-digest and per-file
summaries, capture calendars, distinct URLs.

All are hash aggregations with map-side partial aggregation, so a hot group (one URL, digest or file
holding a third of all captures) is reduced inside every task before anything is shuffled.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import ensure_utc
from .predicates import match, match_condition

FACETS = {
    "arc": lambda: F.col("arc"),
    "sdomain": lambda: F.col("sdomain"),
    "domain": lambda: F.col("sdomain"),
    "mime": lambda: F.col("mime"),
    "year": lambda: F.year("date"),
    "response": lambda: F.col("response"),
}

CALENDAR_UNITS = {
    "year": "yyyy", "month": "yyyy-MM", "day": "yyyy-MM-dd", "hour": "yyyy-MM-dd HH",
}


def _facet_col(by: str | Column) -> Column:
    if isinstance(by, Column):
        return by
    return FACETS[by]().alias("year" if by == "year" else ("sdomain" if by == "domain" else by))


def hit_count(df: DataFrame, **conditions) -> DataFrame:
    """One row: ``n`` = number of matching captures (nothing else is read beyond the filter columns)."""
    return match(df, **conditions).agg(F.count(F.lit(1)).alias("n"))


def facet(df: DataFrame, by: str | Column | Sequence[str | Column] = "arc", min_count: int = 1,
          limit: int | None = None, **conditions) -> DataFrame:
    """Counts of matching captures per facet value (``arc``, ``sdomain``, ``mime``, ``year``, ...).

    ``min_count=0`` also lists values with no match: a single pass over all captures counting matches
    with ``count_if`` (no join against a list of distinct values). ``limit`` keeps the ``limit`` largest
    counts (ties by value); the default is no cut-off.
    """
    ensure_utc(df.sparkSession)  # years are those of UTC
    keys = [_facet_col(b) for b in ([by] if isinstance(by, (str, Column)) else by)]
    if min_count <= 0:
        cond = match_condition(**conditions)
        n = F.count_if(cond) if cond is not None else F.count(F.lit(1))
        out = df.groupBy(*keys).agg(n.alias("n"))
    else:
        out = match(df, **conditions).groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
        out = out.where(F.col("n") >= min_count) if min_count > 1 else out
    if limit is not None:
        out = out.orderBy(F.col("n").desc(), *[F.col(c).asc_nulls_last() for c in out.columns if c != "n"])
        out = out.limit(limit)
    return out


def group_summary(df: DataFrame, by: str | Sequence[str] = "newdigest", **conditions) -> DataFrame:
    """Per group (content digest, archive file, ...): number of captures, first and last capture instant.
    Null keys form one group."""
    by = [by] if isinstance(by, str) else list(by)
    return (match(df, **conditions).groupBy(*by)
            .agg(F.count(F.lit(1)).alias("n"), F.min("date").alias("first_date"),
                 F.max("date").alias("last_date")))


def first_per_digest(df: DataFrame, by: Sequence[str] = ("url",), fields: Sequence[str] = ("date", "id"),
                     **conditions) -> DataFrame:
    """First capture (earliest date, then smallest id) of every content version: one row per
    ``(*by, newdigest)``, so content A, B, A gives two rows. Also ``n``, the captures of that version.

    A ``min`` over ``struct(date, id, ...)`` is combined map-side, so a digest shared by a huge number
    of captures never lands whole in one task (a ``row_number`` window would sort it in one task).
    """
    by = list(by)
    fields = list(dict.fromkeys(["date", "id", *fields]))
    first = F.min(F.struct(*[F.col(f) for f in fields])).alias("_first")
    out = match(df, **conditions).groupBy(*by, "newdigest").agg(first, F.count(F.lit(1)).alias("n"))
    return out.select(*by, "newdigest", *[F.col(f"_first.{f}").alias(f) for f in fields], "n")


def capture_calendar(df: DataFrame, unit: str = "day", **conditions) -> DataFrame:
    """Captures per calendar unit (``year``, ``month``, ``day``, ``hour``) as ``period, n``."""
    ensure_utc(df.sparkSession)
    fmt = CALENDAR_UNITS[unit]
    return (match(df, **conditions).groupBy(F.date_format("date", fmt).alias("period"))
            .agg(F.count(F.lit(1)).alias("n")))


def distinct_urls(df: DataFrame, **conditions) -> DataFrame:
    """Matching canonical URLs, each once ("which paths exist, regardless of time")."""
    return match(df, **conditions).select("url").distinct()
