"""Per-row Column expressions for CDX lines and capture cells. All built-in, all inside whole-stage codegen."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import DOMAIN_END, NULL_TOKENS, RESPONSE_PLACEHOLDER_VALUE, RESPONSE_PLACEHOLDERS

_INT_TEXT = r"^[+-]?[0-9]+$"


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def tokenise(line: Column | str) -> Column:
    """Split a CDX line on single spaces. Trailing empty tokens are dropped (trailing spaces trimmed
    first); doubled or leading spaces still produce empty tokens."""
    return F.split(F.rtrim(_c(line)), " ")


def token(tokens: Column, i: int) -> Column:
    """Token ``i`` or null when the line is short (no ANSI out-of-bounds error)."""
    return F.get(tokens, i)


def nullify(c: Column | str) -> Column:
    """``''`` and ``'-'`` mean "no value"."""
    c = _c(c)
    return F.when(c.isin(*NULL_TOKENS), F.lit(None).cast("string")).otherwise(c)


def parse_response(c: Column | str) -> Column:
    """Integer response; ``-``/``TBD`` become -1; anything else that is not an int is null (a reject)."""
    c = _c(c)
    return (F.when(c.isin(*RESPONSE_PLACEHOLDERS), F.lit(RESPONSE_PLACEHOLDER_VALUE))
            .when(c.rlike(_INT_TEXT), c.try_cast("int")))


def parse_offset(c: Column | str) -> Column:
    """Long offset; no fallback (a capture without offset cannot be fetched)."""
    c = _c(c)
    return F.when(c.rlike(_INT_TEXT), c.try_cast("bigint"))


def parse_timestamp(c: Column | str) -> Column:
    """First 14 characters as ``yyyyMMddHHmmss`` in UTC; null when shorter, not digits or not a real
    instant (month 13, second 99, ...)."""
    c = _c(c)
    s = F.substring(c, 1, 14)
    part = lambda a, n: F.substring(s, a, n).try_cast("int")
    ts = F.try_make_timestamp(part(1, 4), part(5, 2), part(7, 2), part(9, 2), part(11, 2),
                              part(13, 2), F.lit("UTC"))
    return F.when(s.rlike(r"^[0-9]{12}[0-5][0-9]$"), ts)  # Spark would take second 60 for the next minute


def capture_id(digest: Column | str, timestamp: Column | str) -> Column:
    """``digest ++ timestamp`` (whole timestamp token); the null rule applies to the concatenation, so a
    missing digest gives ``'-' ++ timestamp``."""
    return nullify(F.concat(_c(digest), _c(timestamp)))


def split_url(url: Column | str) -> Column:
    """``[domain, path]`` split at the first ``)/`` or ``/``; no match keeps the whole value as domain."""
    return F.split(_c(url), DOMAIN_END, 2)


def sdomain_of(url: Column | str) -> Column:
    return nullify(F.get(split_url(url), 0))


def path_of(url: Column | str) -> Column:
    return nullify(F.get(split_url(url), 1))


def escape_cell(c: Column | str) -> Column:
    """Backslash first, then comma: ``\\`` -> ``\\\\``, ``,`` -> ``\\,``; null -> empty cell."""
    c = _c(c).cast("string")
    esc = F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit(","), F.lit("\\,"))
    return F.coalesce(esc, F.lit(""))


def split_escaped_line(line: Column | str) -> Column:
    """Cells of one escaped-CSV line, unescaped. A comma is prepended so an empty first cell survives."""
    cells = F.regexp_extract_all(F.concat(F.lit(","), _c(line)), F.lit(r",((?:[^\\,]|\\.)*)"), F.lit(1))
    return F.transform(cells, lambda v: F.regexp_replace(v, r"\\(.)", "$1"))
