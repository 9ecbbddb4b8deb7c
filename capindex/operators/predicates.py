"""Capture filters. Every argument is optional; the given ones are ANDed into one predicate.

Equality, ``IN``, prefix (``startswith``), null tests and date bounds reach the Parquet scan as pushed
filters; on a store sorted by ``(url, date)`` they also skip row groups by min/max statistics.
"""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.surt import scheme as scheme_of
from ..functions.time import lit_ts, partial_range

_REGEX_META = set(".^$*+?()[]{}|\\")


def literal_prefix(regex: str) -> str:
    """Longest literal text every match of ``regex`` must start with (for a pushable prefix filter).
    Conservative: any ``|`` in the pattern makes the prefix empty."""
    if "|" in regex:
        return ""
    out = []
    i = 0
    while i < len(regex):
        ch = regex[i]
        if ch == "\\" and i + 1 < len(regex) and not regex[i + 1].isalnum():
            out.append(regex[i + 1])
            i += 2
            continue
        if ch in _REGEX_META:
            # a quantifier applies to the previous character: it is then not certain
            if ch in "*?{" and out:
                out.pop()
            break
        out.append(ch)
        i += 1
    return "".join(out)


def like_escape(s: str) -> str:
    """Escape ``%``, ``_`` and ``\\`` for a ``LIKE`` pattern."""
    return re.sub(r"([%_\\])", r"\\\1", s)


def wildcard_like(pattern: str) -> str:
    """A wildcard pattern as a ``LIKE`` pattern: ``*`` is any text, ``?`` any one character, a backslash makes the next
    character literal, and everything else (``%`` and ``_`` too) stands for itself."""
    out, i = [], 0
    while i < len(pattern):
        ch = pattern[i]
        if ch == "\\" and i + 1 < len(pattern):
            i += 1
            out.append(like_escape(pattern[i]))
        else:
            out.append({"*": "%", "?": "_"}.get(ch) or like_escape(ch))
        i += 1
    return "".join(out)


def wildcard_prefix(pattern: str) -> str:
    """The literal text before a pattern's first wildcard."""
    found = re.match(r"(?:[^*?\\]|\\.|\\$)*", pattern, re.DOTALL).group()
    return re.sub(r"\\(.)", r"\1", found, flags=re.DOTALL)


def _eq_or_in(col: str, v) -> Column:
    if isinstance(v, (list, tuple, set, frozenset)):
        return F.col(col).isin(*list(v))
    return F.col(col) == F.lit(v)


def match_condition(*, ourl=None, url=None, at=None, start=None, end=None, partial: str | None = None,
                    domain=None, url_prefix: str | None = None, under_domain: str | None = None,
                    path_prefix: str | None = None, include_root: bool = False,
                    url_regex: str | None = None, url_wildcard: str | None = None, mime=None, arc=None, scheme: str | None = None,
                    response=None, missing: Iterable[str] = (), present: Iterable[str] = ()) -> Column | None:
    """The ANDed condition, or None when nothing is given.

    - ``ourl`` / ``url``: exact original / canonical URL (value or list of values).
    - ``at``: exact capture instant; ``start``/``end``: inclusive range (instants, or Columns such as
      :func:`~capindex.functions.time.date_math`); ``partial``: ``'2014'``,
      ``'201401'``, ... half-open unit range.
    - ``domain``: exact ``sdomain``; ``url_prefix``: canonical URL prefix (truncated path);
      ``under_domain`` + ``path_prefix``: every subdomain of a SURT domain (``com,example``) whose path
      starts with the prefix; the root domain itself only with ``include_root``.
    - ``url_regex``: whole-value regular expression on ``url`` (its literal prefix is added as a
      pushable ``startswith``); ``url_wildcard``: whole-value pattern with ``*`` and ``?`` (see :func:`wildcard_like`), its
      literal prefix added likewise.
    - ``mime``, ``arc``, ``response``: exact values; ``scheme``: scheme of the original URL.
    - ``missing`` / ``present``: columns that must be null / not null.
    """
    conds: list[Column] = []
    if ourl is not None:
        conds.append(_eq_or_in("ourl", ourl))
    if url is not None:
        conds.append(_eq_or_in("url", url))
    if at is not None:
        conds.append(F.col("date") == lit_ts(at))
    if start is not None:
        conds.append(F.col("date") >= (start if isinstance(start, Column) else lit_ts(start)))
    if end is not None:
        conds.append(F.col("date") <= (end if isinstance(end, Column) else lit_ts(end)))
    if partial is not None:
        lo, hi = partial_range(partial)
        conds.append((F.col("date") >= F.lit(lo)) & (F.col("date") < F.lit(hi)))
    if domain is not None:
        conds.append(_eq_or_in("sdomain", domain))
    if url_prefix is not None:
        conds.append(F.col("url").startswith(url_prefix))
    if under_domain is not None:
        root = under_domain.rstrip(",")
        sub = F.col("sdomain").startswith(root + ",")
        conds.append((sub | (F.col("sdomain") == root)) if include_root else sub)
    if path_prefix is not None:
        conds.append(F.col("path").startswith(path_prefix))
    if url_regex is not None:
        lit_prefix = literal_prefix(url_regex)
        if lit_prefix:
            conds.append(F.col("url").startswith(lit_prefix))
        conds.append(F.col("url").rlike(f"^(?:{url_regex})$"))
    if url_wildcard is not None:
        prefix = wildcard_prefix(url_wildcard)
        if prefix:
            conds.append(F.col("url").startswith(prefix))
        conds.append(F.col("url").like(wildcard_like(url_wildcard)))
    if mime is not None:
        conds.append(_eq_or_in("mime", mime))
    if arc is not None:
        conds.append(_eq_or_in("arc", arc))
    if response is not None:
        conds.append(_eq_or_in("response", response))
    if scheme is not None:
        conds.append(scheme_of("ourl") == F.lit(scheme.lower()))
    for c in missing:
        conds.append(F.col(c).isNull())
    for c in present:
        conds.append(F.col(c).isNotNull())
    if not conds:
        return None
    out = conds[0]
    for c in conds[1:]:
        out = out & c
    return out


def match(df: DataFrame, **kw) -> DataFrame:
    """``df`` filtered by :func:`match_condition` (unchanged when no argument is given)."""
    cond = match_condition(**kw)
    return df if cond is None else df.where(cond)
