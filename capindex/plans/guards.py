"""Plan guards: broadcast only sides with a known size bound, and helpers to inspect physical plans."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def bounded_broadcast(df: DataFrame, row_bound: int | None, max_rows: int) -> DataFrame:
    """``broadcast(df)`` when ``row_bound`` (a proven upper bound on its rows, e.g. a count or a file
    listing size) is at most ``max_rows``; otherwise the plain side, so Spark plans a shuffle join (and AQE
    may still switch to broadcast from measured sizes at run time)."""
    if row_bound is not None and row_bound <= max_rows:
        return F.broadcast(df)
    return df


def physical_plan(df: DataFrame, mode: str = "formatted") -> str:
    """Text of ``df.explain(mode)`` (for tests that assert pushdown / operator choice)."""
    import contextlib
    import io

    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain(mode)
    return buf.getvalue()
