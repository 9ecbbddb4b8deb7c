"""URL canonicalisation (SURT form) and URL scheme, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_SCHEME = r"^([A-Za-z][A-Za-z0-9+.-]*):"


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def scheme(url: Column | str) -> Column:
    """Lower-case scheme of an original URL (``''`` when there is none)."""
    return F.lower(F.regexp_extract(_c(url), _SCHEME, 1))


def reverse_host(host: Column | str) -> Column:
    """``www.example.com`` -> ``com,example,www``; IPv4 addresses are reversed the same way."""
    return F.array_join(F.reverse(F.split(_c(host), r"[.]")), ",")


def surt(url: Column | str) -> Column:
    """Canonical, sort-friendly form of an original URL.

    Lower-cased; scheme, user info, port, a leading ``www.`` and the fragment dropped; host labels
    reversed and comma-joined; then ``)``, the path (``/`` when empty) and the query with its
    ``&``-separated parts sorted. Percent-encoding is left alone (a decoded space would break the
    space-separated CDX line).
    """
    u = F.lower(F.trim(_c(url)))
    u = F.regexp_replace(u, r"^[a-z][a-z0-9+.-]*://", "")
    u = F.regexp_replace(u, r"#.*$", "")
    authority = F.regexp_extract(u, r"^([^/?]*)", 1)
    rest = F.substring(u, F.length(authority) + 1, 1 << 30)
    host = F.regexp_replace(F.regexp_replace(authority, r"^.*@", ""), r":[0-9]*$", "")
    host = F.regexp_replace(F.regexp_replace(host, r"^www[0-9]*\.", ""), r"\.$", "")
    path = F.regexp_extract(rest, r"^([^?]*)", 1)
    query = F.regexp_extract(rest, r"^[^?]*\?(.*)$", 1)
    sorted_query = F.array_join(F.array_sort(F.split(query, "&")), "&")
    return F.concat(
        reverse_host(host), F.lit(")"),
        F.when(path == "", F.lit("/")).otherwise(path),
        F.when(F.instr(rest, "?") > 0, F.concat(F.lit("?"), sorted_query)).otherwise(F.lit("")),
    )
