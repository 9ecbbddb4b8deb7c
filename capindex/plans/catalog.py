"""Registered queries: one Spark builder ``(spark, sf_dir) -> DataFrame`` per operator, each with a DuckDB
SQL twin over the driver's tables (the correctness oracle), where SQL can express it.

Lookup requests (a URL, a domain, a prefix, a cursor) are taken from the data itself (page 0), so every
query does real work at every scale factor; instants are fixed literals inside the data's month.
Outputs carry ``ts14`` text / epoch numbers instead of timestamps so both engines print the same values.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.surt import surt
from ..functions.time import date_math, instant, partial_range, ts14
from ..operators import facets, lookup
from ..operators.predicates import match
from ..schema import DEFAULT_ORDER
from ..sources import adapter as A
from ..sources import cdx, csvio, store

# Request parameters of the registered queries (instants inside the month the data covers).
T_CLOSEST = "2024-01-15T12:00:00Z"
RANGE_START, RANGE_END = "2024-01-05T00:00:00Z", "2024-01-20T23:59:59Z"
PARTIAL = "20240110"
ARC = "crawl-20240115.warc.gz"
LOOKUP_DAY = "20240115"
RANDOM_START, RANDOM_END, RANDOM_SEED = "2024-01-01T00:00:00Z", "2024-01-31T23:59:59Z", 7
ORDER_SEED = "42"
URL_REGEX = r"com,example,[a-z]+(,[a-z]+)?\)/en/[0-9]+\.html"
KEYSET_AT = "2024-01-15T00:00:00Z"
PAGE_OFFSET, PAGE_LIMIT, KEYSET_LIMIT, CHUNKS = 100, 10, 50, 8


def _e(t) -> int:
    return int(instant(t).timestamp())


Builder = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Builder] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn: Builder) -> Builder:
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


W = A.with_captures
TGT = A.SQL_TARGET_URL
TGT_OURL = A.SQL_TARGET_OURL
TGT_SDOMAIN = A.SQL_TARGET_SDOMAIN
TGT_PREFIX = "(SELECT sdomain || ')/' || substr(path, 1, 3) FROM pk WHERE page_id = 0)"
TGT_ROOT = "(SELECT array_to_string(string_split(sdomain, ',')[1:2], ',') FROM pk WHERE page_id = 0)"
TGT_PATH_PREFIX = "(SELECT split_part(path, '/', 1) || '/' FROM pk WHERE page_id = 0)"


def _caps(spark: SparkSession, sf_dir: str, caps: DataFrame | None = None) -> DataFrame:
    """The captures to query: a given DataFrame (e.g. the stored index) or the adapter over ``sf_dir``."""
    return caps if caps is not None else A.captures(spark, sf_dir)


def caps_and_target(spark: SparkSession, sf_dir: str, caps: DataFrame | None = None):
    return _caps(spark, sf_dir, caps), A.target(spark, sf_dir)


# ---- lookups -------------------------------------------------------------------------------------

@register("lookup_exact", W(f"""
SELECT id, ourl, ts14, mime, arc, "offset" FROM captures
WHERE url = {TGT} AND epoch_s = (SELECT min(epoch_s) FROM captures WHERE url = {TGT})"""))
def q_lookup_exact(spark, sf_dir, caps=None):
    caps, t = caps_and_target(spark, sf_dir, caps)
    first = caps.where(F.col("url") == t.url).agg(F.min("date")).first()[0]  # the request: a known capture
    out = lookup.search(caps, url=t.url, at=first, columns=None, limit=None)
    return out.select("id", "ourl", ts14("date").alias("ts14"), "mime", "arc", "offset")


@register("closest_capture", W(f"""
SELECT ourl, ts14, id, abs({_e(T_CLOSEST)} - epoch_s) * 1000 AS distance_ms FROM captures
WHERE url = {TGT} ORDER BY distance_ms, epoch_s, id LIMIT 1"""))
def q_closest_capture(spark, sf_dir, caps=None):
    caps, t = caps_and_target(spark, sf_dir, caps)
    out = lookup.closest_capture(caps, t.url, T_CLOSEST)
    return out.select("ourl", ts14("date").alias("ts14"), "id", "distance_ms")


@register("closest_bulk", W("""
, req AS (SELECT event_id AS rid, url, epoch_s + 3600 AS t FROM captures)
, pairs AS (
  SELECT r.rid, r.t, c.ts14, c.id, abs(r.t - c.epoch_s) * 1000 AS distance_ms,
         row_number() OVER (PARTITION BY r.rid ORDER BY abs(r.t - c.epoch_s), c.epoch_s, c.id) AS rn
  FROM req r JOIN captures c ON c.url = r.url)
SELECT rid, t AS t_epoch_s, ts14, id, distance_ms FROM pairs WHERE rn = 1"""))
def q_closest_bulk(spark, sf_dir, caps=None):
    caps = _caps(spark, sf_dir, caps)
    out = lookup.closest(A.requests(caps), caps)
    return out.select("rid", F.unix_seconds("t").alias("t_epoch_s"), ts14("date").alias("ts14"), "id",
                      "distance_ms")


@register("url_summary", W(f"""
SELECT ts14, id, mime, response FROM captures WHERE url = {TGT}"""))
def q_url_summary(spark, sf_dir, caps=None):
    caps, t = caps_and_target(spark, sf_dir, caps)
    return match(caps, url=t.url).select(ts14("date").alias("ts14"), "id", "mime", "response")


@register("url_calendar", W(f"""
SELECT strftime(date, '%Y-%m-%d') AS period, count(*) AS n FROM captures WHERE url = {TGT} GROUP BY 1"""))
def q_url_calendar(spark, sf_dir, caps=None):
    caps, t = caps_and_target(spark, sf_dir, caps)
    return facets.capture_calendar(caps, "day", url=t.url)


@register("domain_summary", W(f"""
SELECT strftime(date, '%Y-%m-%d') AS period, count(*) AS n FROM captures
WHERE sdomain = {TGT_SDOMAIN} GROUP BY 1"""))
def q_domain_summary(spark, sf_dir, caps=None):
    caps, t = caps_and_target(spark, sf_dir, caps)
    return facets.capture_calendar(caps, "day", domain=t.sdomain)


@register("prefix_distinct", W(f"""
SELECT DISTINCT url FROM captures WHERE starts_with(url, {TGT_PREFIX})"""))
def q_prefix_distinct(spark, sf_dir, caps=None):
    caps, t = caps_and_target(spark, sf_dir, caps)
    return facets.distinct_urls(caps, url_prefix=t.url_prefix)


@register("subdomain_path", W(f"""
SELECT DISTINCT url FROM captures
WHERE starts_with(sdomain, {TGT_ROOT} || ',') AND starts_with(path, {TGT_PATH_PREFIX})"""))
def q_subdomain_path(spark, sf_dir, caps=None):
    caps, t = caps_and_target(spark, sf_dir, caps)
    return facets.distinct_urls(caps, under_domain=t.root, path_prefix=t.path_prefix)


@register("range_lookup", W(f"""
SELECT ts14, id FROM captures
WHERE url = {TGT} AND epoch_s BETWEEN {_e(RANGE_START)} AND {_e(RANGE_END)}"""))
def q_range_lookup(spark, sf_dir, caps=None):
    caps, t = caps_and_target(spark, sf_dir, caps)
    return match(caps, url=t.url, start=RANGE_START, end=RANGE_END).select(ts14("date").alias("ts14"), "id")


_P0, _P1 = (int(x.timestamp()) for x in partial_range(PARTIAL))


@register("partial_timestamp", W(f"""
SELECT ts14, id FROM captures WHERE url = {TGT} AND epoch_s >= {_P0} AND epoch_s < {_P1}"""))
def q_partial_timestamp(spark, sf_dir, caps=None):
    caps, t = caps_and_target(spark, sf_dir, caps)
    return match(caps, url=t.url, partial=PARTIAL).select(ts14("date").alias("ts14"), "id")


@register("hit_count", W(f"""
SELECT count(*) AS n FROM captures
WHERE url = {TGT} AND epoch_s BETWEEN {_e(RANGE_START)} AND {_e(RANGE_END)}"""))
def q_hit_count(spark, sf_dir, caps=None):
    caps, t = caps_and_target(spark, sf_dir, caps)
    return facets.hit_count(caps, url=t.url, start=RANGE_START, end=RANGE_END)


@register("search_default", W(f"""
SELECT ourl, ts14, mime, arc, "offset" FROM captures WHERE ourl = {TGT_OURL}
ORDER BY url, epoch_s, id LIMIT 10000"""))
def q_search_default(spark, sf_dir, caps=None):
    caps, t = caps_and_target(spark, sf_dir, caps)
    out = lookup.search(caps, ourl=t.ourl, columns=None)
    return out.select("ourl", ts14("date").alias("ts14"), "mime", "arc", "offset")


@register("regex_lookup", W(f"""
SELECT url, ts14, id FROM captures WHERE regexp_full_match(url, '{URL_REGEX}')"""))
def q_regex_lookup(spark, sf_dir, caps=None):
    caps = _caps(spark, sf_dir, caps)
    return match(caps, url_regex=URL_REGEX).select("url", ts14("date").alias("ts14"), "id")


@register("wildcard_lookup", W(r"""
SELECT url, ts14, id FROM captures WHERE url LIKE 'com,example,%)/e_/%?utm\_source=%' ESCAPE '\'"""))
def q_wildcard_lookup(spark, sf_dir, caps=None):
    """Wildcards beside characters that patterns of either kind give a meaning (``?``, ``_``)."""
    caps = _caps(spark, sf_dir, caps)
    return match(caps, url_wildcard=r"com,example,*)/e?/*\?utm_source=*").select("url", ts14("date").alias("ts14"), "id")


@register("sort_nullable", W("""
, up AS (SELECT 'up' AS way, row_number() OVER (ORDER BY mime ASC NULLS LAST, response ASC NULLS LAST, url, epoch_s, id) AS place, * FROM captures)
, down AS (SELECT 'down' AS way, row_number() OVER (ORDER BY mime DESC NULLS LAST, response DESC NULLS LAST, url, epoch_s, id) AS place, * FROM captures)
SELECT way, mime, response, id FROM (SELECT * FROM up UNION ALL SELECT * FROM down) WHERE place > 20 AND place <= 320"""))
def q_sort_nullable(spark, sf_dir, caps=None):
    """Pages in the order of columns with missing values, which come last in either direction."""
    caps = _caps(spark, sf_dir, caps)
    page = {way: lookup.search(caps, columns=("mime", "response", "id"), limit=300, offset=20, order=(f"{sign}mime", f"{sign}response", *DEFAULT_ORDER))
            .withColumn("way", F.lit(way)) for way, sign in (("up", ""), ("down", "-"))}
    return page["up"].unionByName(page["down"])


REQUIRED_GAP = 71  # events whose lines get no original URL


@register("reject_required", W(f"""
SELECT CASE WHEN event_id % 97 = 0 THEN 'column_count' WHEN event_id % 89 = 0 THEN 'bad_response'
            WHEN event_id % 83 = 0 THEN 'bad_offset' WHEN event_id % 79 = 0 THEN 'bad_timestamp'
            WHEN event_id % {REQUIRED_GAP} = 0 THEN 'missing_required' ELSE 'accepted' END AS status, count(*) AS n
FROM captures GROUP BY 1"""))
def q_reject_required(spark, sf_dir, caps=None):
    """As ``reject_summary``, with lines that lack a required field."""
    lines = A.cdx_lines(_caps(spark, sf_dir, caps))
    t = F.split("value", " ")
    gap = F.concat_ws(" ", F.slice(t, 1, 2), F.lit("-"), F.slice(t, F.lit(4), F.size(t)))
    return cdx.reject_summary(cdx.parse_cdx(lines.select("line_mid", F.when(F.col("event_id") % REQUIRED_GAP == 0, gap).otherwise(F.col("value")).alias("value"))))


@register("mime_lookup", W("""
SELECT id, url, ts14 FROM captures WHERE mime = 'text/html'"""))
def q_mime_lookup(spark, sf_dir, caps=None):
    return match(_caps(spark, sf_dir, caps), mime="text/html").select("id", "url", ts14("date").alias("ts14"))


@register("arc_urls", W(f"""
SELECT DISTINCT url FROM captures WHERE arc = '{ARC}' AND starts_with(sdomain, {TGT_ROOT} || ',')"""))
def q_arc_urls(spark, sf_dir, caps=None):
    caps, t = caps_and_target(spark, sf_dir, caps)
    return facets.distinct_urls(caps, arc=ARC, under_domain=t.root)


@register("scheme_lookup", W("""
SELECT id, ourl FROM captures WHERE lower(regexp_extract(ourl, '^([A-Za-z][A-Za-z0-9+.-]*):', 1)) = 'https'"""))
def q_scheme_lookup(spark, sf_dir, caps=None):
    return match(_caps(spark, sf_dir, caps), scheme="https").select("id", "ourl")


@register("combined_filter", W(f"""
SELECT id, url, ts14 FROM captures
WHERE starts_with(sdomain, {TGT_ROOT} || ',') AND mime = 'text/html' AND response = 200
  AND epoch_s BETWEEN {_e(RANGE_START)} AND {_e(RANGE_END)}"""))
def q_combined_filter(spark, sf_dir, caps=None):
    caps, t = caps_and_target(spark, sf_dir, caps)
    out = match(caps, under_domain=t.root, mime="text/html", response=200, start=RANGE_START, end=RANGE_END)
    return out.select("id", "url", ts14("date").alias("ts14"))


@register("missing_mime", W("""
SELECT id, url, ts14 FROM captures WHERE mime IS NULL"""))
def q_missing_mime(spark, sf_dir, caps=None):
    return match(_caps(spark, sf_dir, caps), missing=["mime"]).select("id", "url", ts14("date").alias("ts14"))


# ---- aggregations ----------------------------------------------------------------------------------

@register("first_per_digest", W("""
, ranked AS (SELECT url, newdigest, ts14, id, count(*) OVER (PARTITION BY url, newdigest) AS n,
                    row_number() OVER (PARTITION BY url, newdigest ORDER BY epoch_s, id) AS rn FROM captures)
SELECT url, newdigest, ts14, id, n FROM ranked WHERE rn = 1"""))
def q_first_per_digest(spark, sf_dir, caps=None):
    out = facets.first_per_digest(_caps(spark, sf_dir, caps))
    return out.select("url", "newdigest", ts14("date").alias("ts14"), "id", "n")


@register("facet_arc", W("""
SELECT arc, count(*) AS n FROM captures GROUP BY arc"""))
def q_facet_arc(spark, sf_dir, caps=None):
    return facets.facet(_caps(spark, sf_dir, caps), "arc")


@register("facet_arc_zero", W(f"""
SELECT arc, count(*) FILTER (WHERE starts_with(url, {TGT_PREFIX})) AS n FROM captures GROUP BY arc"""))
def q_facet_arc_zero(spark, sf_dir, caps=None):
    caps, t = caps_and_target(spark, sf_dir, caps)
    return facets.facet(caps, "arc", min_count=0, url_prefix=t.url_prefix)


@register("facet_year_mime", W("""
SELECT CAST(year(date) AS INTEGER) AS year, mime, count(*) AS n FROM captures GROUP BY 1, 2"""))
def q_facet_year_mime(spark, sf_dir, caps=None):
    return facets.facet(_caps(spark, sf_dir, caps), ["year", "mime"])


@register("facet_domain", W("""
SELECT sdomain, count(*) AS n FROM captures GROUP BY sdomain"""))
def q_facet_domain(spark, sf_dir, caps=None):
    return facets.facet(_caps(spark, sf_dir, caps), "sdomain")


@register("group_arc", W("""
SELECT arc, count(*) AS n, min(ts14) AS first_ts14, max(ts14) AS last_ts14 FROM captures GROUP BY arc"""))
def q_group_arc(spark, sf_dir, caps=None):
    out = facets.group_summary(_caps(spark, sf_dir, caps), "arc")
    return out.select("arc", "n", ts14("first_date").alias("first_ts14"), ts14("last_date").alias("last_ts14"))


@register("group_digest", W("""
SELECT newdigest, count(*) AS n, min(ts14) AS first_ts14, max(ts14) AS last_ts14 FROM captures
GROUP BY newdigest"""))
def q_group_digest(spark, sf_dir, caps=None):
    out = facets.group_summary(_caps(spark, sf_dir, caps), "newdigest")
    return out.select("newdigest", "n", ts14("first_date").alias("first_ts14"),
                      ts14("last_date").alias("last_ts14"))


# ---- bulk / paging / ordering ---------------------------------------------------------------------

_D0, _D1 = (int(x.timestamp()) for x in partial_range(LOOKUP_DAY))


@register("lookup_many", W(f"""
, req AS (SELECT DISTINCT url FROM captures WHERE epoch_s >= {_D0} AND epoch_s < {_D1})
SELECT c.url, c.ts14, c.id FROM captures c WHERE c.url IN (SELECT url FROM req)"""))
def q_lookup_many(spark, sf_dir, caps=None):
    caps = _caps(spark, sf_dir, caps)
    reqs = facets.distinct_urls(caps, partial=LOOKUP_DAY)
    return lookup.lookup_many(reqs, caps).select("url", ts14("date").alias("ts14"), "id")


@register("keyset_page", W(f"""
SELECT url, ts14, id FROM captures
WHERE url > {TGT} OR (url = {TGT} AND epoch_s > {_e(KEYSET_AT)})
   OR (url = {TGT} AND epoch_s = {_e(KEYSET_AT)} AND id > '')
ORDER BY url, epoch_s, id LIMIT {KEYSET_LIMIT}"""))
def q_keyset_page(spark, sf_dir, caps=None):
    caps, t = caps_and_target(spark, sf_dir, caps)
    out = lookup.page_after(caps, {"url": t.url, "date": KEYSET_AT, "id": ""}, KEYSET_LIMIT)
    return out.select("url", ts14("date").alias("ts14"), "id")


@register("offset_page", W(f"""
SELECT url, ts14, id FROM captures ORDER BY url, epoch_s, id LIMIT {PAGE_LIMIT} OFFSET {PAGE_OFFSET}"""))
def q_offset_page(spark, sf_dir, caps=None):
    out = lookup.search(_caps(spark, sf_dir, caps), columns=None, limit=PAGE_LIMIT, offset=PAGE_OFFSET)
    return out.select("url", ts14("date").alias("ts14"), "id")


@register("chunk_plan", W(f"""
, t AS (SELECT url, epoch_s, ts14, id, CAST(ntile({CHUNKS}) OVER (ORDER BY url, epoch_s, id) AS INTEGER) AS chunk
        FROM captures)
, r AS (SELECT *, row_number() OVER (PARTITION BY chunk ORDER BY url, epoch_s, id) AS a,
               row_number() OVER (PARTITION BY chunk ORDER BY url DESC, epoch_s DESC, id DESC) AS d,
               count(*) OVER (PARTITION BY chunk) AS n FROM t)
SELECT chunk, max(n) AS n,
       max(CASE WHEN a = 1 THEN url END) AS first_url, max(CASE WHEN a = 1 THEN ts14 END) AS first_ts14,
       max(CASE WHEN a = 1 THEN id END) AS first_id,
       max(CASE WHEN d = 1 THEN url END) AS last_url, max(CASE WHEN d = 1 THEN ts14 END) AS last_ts14,
       max(CASE WHEN d = 1 THEN id END) AS last_id
FROM r GROUP BY chunk"""))
def q_chunk_plan(spark, sf_dir, caps=None):
    out = lookup.chunk_plan(_caps(spark, sf_dir, caps), CHUNKS)
    return out.select("chunk", "n", "first_url", ts14("first_date").alias("first_ts14"), "first_id",
                      "last_url", ts14("last_date").alias("last_ts14"), "last_id")


_RANDOM_T = lookup.random_instant(RANDOM_START, RANDOM_END, RANDOM_SEED)


@register("random_in_period", W(f"""
SELECT ourl, ts14, id, abs({_RANDOM_T} - epoch_s) * 1000 AS distance_ms FROM captures
WHERE url = {TGT} AND epoch_s BETWEEN {_e(RANDOM_START)} AND {_e(RANDOM_END)}
ORDER BY distance_ms, epoch_s, id LIMIT 1"""))
def q_random_in_period(spark, sf_dir, caps=None):
    caps, t = caps_and_target(spark, sf_dir, caps)
    out = lookup.random_capture(caps, t.url, RANDOM_START, RANDOM_END, RANDOM_SEED)
    return out.select("ourl", ts14("date").alias("ts14"), "id", "distance_ms")


@register("random_order", W(f"""
SELECT id, url, md5('{ORDER_SEED}' || id) AS sort_key FROM captures"""))
def q_random_order(spark, sf_dir, caps=None):
    out = lookup.random_order(_caps(spark, sf_dir, caps), ORDER_SEED)
    return out.select("id", "url", "sort_key")


# ---- URL canonicalisation -------------------------------------------------------------------------

_SURT_SQL = r"""
, u0 AS (SELECT page_id, url,
                regexp_replace(regexp_replace(lower(trim(url)), '^[a-z][a-z0-9+.-]*://', ''), '#.*$', '') AS u
         FROM pages)
, u1 AS (SELECT page_id, url, u, regexp_extract(u, '^([^/?]*)', 1) AS authority FROM u0)
, u2 AS (SELECT page_id, url, substr(u, length(authority) + 1) AS rest,
                regexp_replace(regexp_replace(regexp_replace(regexp_replace(authority, '^.*@', ''),
                  ':[0-9]*$', ''), '^www[0-9]*\.', ''), '\.$', '') AS host FROM u1)
, u3 AS (SELECT page_id, url, rest, host, regexp_extract(rest, '^([^?]*)', 1) AS path,
                regexp_extract(rest, '^[^?]*\?(.*)$', 1) AS query FROM u2)
SELECT page_id, url,
       array_to_string(list_reverse(string_split(host, '.')), ',') || ')' ||
       CASE WHEN path = '' THEN '/' ELSE path END ||
       CASE WHEN strpos(rest, '?') > 0 THEN '?' || array_to_string(list_sort(string_split(query, '&')), '&')
            ELSE '' END AS surt
FROM u3"""


@register("surt", "WITH " + _SURT_SQL.lstrip().lstrip(","))
def q_surt(spark, sf_dir, caps=None):
    pages = A.table(spark, sf_dir, "pages")
    return pages.select("page_id", "url", surt("url").alias("surt"))


# ---- parsing, export, upsert, streaming --------------------------------------------------------------

_CLEAN = "event_id % 97 <> 0 AND event_id % 89 <> 0 AND event_id % 83 <> 0 AND event_id % 79 <> 0"
_PARSED_COLS = ("id, url, ts14, ourl, mime, CASE WHEN event_id % 73 = 0 THEN -1 ELSE response END AS response, "
                "newdigest, redirect, \"offset\", arc, nullif(sdomain, '') AS sdomain, nullif(path, '') AS path")


def _capture_cols(df: DataFrame) -> DataFrame:
    return df.select("id", "url", ts14("date").alias("ts14"), "ourl", "mime", "response", "newdigest",
                     "redirect", "offset", "arc", "sdomain", "path")


@register("parse_cdx", W(f"""
SELECT {_PARSED_COLS} FROM captures WHERE {_CLEAN}"""))
def q_parse_cdx(spark, sf_dir, caps=None):
    lines = A.cdx_lines(_caps(spark, sf_dir, caps)).select("line_mid", "value")
    return _capture_cols(cdx.accepted(cdx.parse_cdx(lines)))


@register("reject_summary", W("""
SELECT CASE WHEN event_id % 97 = 0 THEN 'column_count' WHEN event_id % 89 = 0 THEN 'bad_response'
            WHEN event_id % 83 = 0 THEN 'bad_offset' WHEN event_id % 79 = 0 THEN 'bad_timestamp'
            ELSE 'accepted' END AS status, count(*) AS n
FROM captures GROUP BY 1"""))
def q_reject_summary(spark, sf_dir, caps=None):
    lines = A.cdx_lines(_caps(spark, sf_dir, caps)).select("line_mid", "value")
    return cdx.reject_summary(cdx.parse_cdx(lines))


@register("csv_round_trip", W("""
SELECT id, url, ts14, ourl, mime, response, newdigest, redirect, "offset", arc,
       nullif(sdomain, '') AS sdomain, nullif(path, '') AS path FROM captures"""))
def q_csv_round_trip(spark, sf_dir, caps=None):
    caps = _caps(spark, sf_dir, caps)
    return _capture_cols(csvio.from_escaped_lines(csvio.to_escaped_lines(caps)))


@register("upsert_overlap", W("""
SELECT id, url, ts14, CASE WHEN event_id % 3 = 1 THEN response ELSE 200 END AS response, "offset"
FROM captures"""))
def q_upsert_overlap(spark, sf_dir, caps=None):
    b1, b2 = A.batches(_caps(spark, sf_dir, caps))
    out = store.upsert(b1, b2, key=("id",))
    return out.select("id", "url", ts14("date").alias("ts14"), "response", "offset")


@register("upsert_latest", W("""
, r AS (SELECT *, row_number() OVER (PARTITION BY url ORDER BY epoch_s DESC, id DESC) AS rn FROM captures)
SELECT url, ts14, id, event_id FROM r WHERE rn = 1"""))
def q_upsert_latest(spark, sf_dir, caps=None):
    caps = _caps(spark, sf_dir, caps)
    out = store.upsert(None, caps, key=("url",), order=("date", "id"))
    return out.select("url", ts14("date").alias("ts14"), "id", "event_id")





# ---- more of the surface: decoding, date math, statistics, export ------------------------------------

@register("lookup_many_decoded", W(f"""
, req AS (SELECT DISTINCT url FROM captures WHERE epoch_s >= {_D0} AND epoch_s < {_D1})
SELECT c.url, c.ts14, c.id FROM captures c WHERE c.url IN (SELECT url FROM req)"""))
def q_lookup_many_decoded(spark, sf_dir, caps=None):
    """Requests arrive percent-encoded (as in a request URL) and are decoded before the lookup."""
    caps = _caps(spark, sf_dir, caps)
    reqs = facets.distinct_urls(caps, partial=LOOKUP_DAY).select(F.url_encode("url").alias("url"))
    return lookup.lookup_many(reqs, caps, decode_url=True).select("url", ts14("date").alias("ts14"), "id")


DM_NOW, DM_TRUNC, DM_ADD = "2024-01-20T13:45:00Z", "DAY", "-7DAYS"


@register("date_math_count", W(f"""
SELECT count(*) AS n FROM captures
WHERE epoch_s >= {_e("2024-01-13T00:00:00Z")} AND epoch_s <= {_e(DM_NOW)}"""))
def q_date_math_count(spark, sf_dir, caps=None):
    """Captures from ``NOW/DAY-7DAYS`` to ``NOW`` (``now`` passed explicitly)."""
    caps = _caps(spark, sf_dir, caps)
    return facets.hit_count(caps, start=date_math(DM_NOW, DM_TRUNC, DM_ADD), end=date_math(DM_NOW))


@register("mime_stats", W("""
SELECT mime, count(*) AS n FROM captures GROUP BY mime"""))
def q_mime_stats(spark, sf_dir, caps=None):
    return facets.facet(_caps(spark, sf_dir, caps), "mime")


@register("prefix_calendar", W(f"""
SELECT strftime(date, '%Y-%m') AS period, count(*) AS n FROM captures
WHERE starts_with(url, {TGT_SDOMAIN} || ')') GROUP BY 1"""))
def q_prefix_calendar(spark, sf_dir, caps=None):
    """Domain summary over time in its prefix form (``url:example.com/*``)."""
    caps, t = caps_and_target(spark, sf_dir, caps)
    return facets.capture_calendar(caps, "month", url_prefix=f"{t.sdomain})")


@register("export_json", W(f"""
SELECT id, url, ts14, mime, response FROM captures"""))
def q_export_json(spark, sf_dir, caps=None):
    """Bulk export of all captures as JSON (distributed write), read back."""
    from ..schema import CAPTURE_SCHEMA
    from ..session import scratch_path
    path = scratch_path(spark, "export-json")
    lookup.export(_caps(spark, sf_dir, caps), path, format="json", columns=("id", "url", "date", "mime", "response"))
    back = spark.read.schema(CAPTURE_SCHEMA).json(path)
    return back.select("id", "url", ts14("date").alias("ts14"), "mime", "response")



@register("api_search", W(f"""
SELECT concat_ws(',', replace(replace(ourl, '\\', '\\\\'), ',', '\\,'), strftime(date, '%Y-%m-%dT%H:%M:%SZ'),
                 replace(replace(coalesce(mime, ''), '\\', '\\\\'), ',', '\\,'),
                 replace(replace(arc, '\\', '\\\\'), ',', '\\,'), CAST("offset" AS VARCHAR)) AS value
FROM captures WHERE ourl = {TGT_OURL} ORDER BY url, epoch_s, id LIMIT 10000"""))
def q_api_search(spark, sf_dir, caps=None):
    """The lookup entry point as the reference is called: a percent-encoded URL, default fields, CSV."""
    from urllib.parse import quote
    from ..operators.api import cdx_search
    caps, t = caps_and_target(spark, sf_dir, caps)
    return cdx_search(caps, quote(t.ourl, safe=""), fl="ourl,date,mime,arc,offset", output="csv")


__all__ = ["QUERIES", "ORACLE", "register"]
