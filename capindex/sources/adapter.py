"""The driver's tables as a capture index.

The test data has no CDX files, so each ``events`` row is read as one capture of a ``pages`` row
(``page_id = user_id % <number of pages>``). Everything here is derived by Spark from the given tables,
so the work grows with them. Each Spark builder has a DuckDB SQL twin (used as the correctness oracle).
"""

from __future__ import annotations

import os
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.surt import reverse_host
from ..functions.time import ts14
from ..plans.guards import bounded_broadcast
from ..session import ensure_utc

# Page dimension rows broadcast to the event scan only below this proven row count (the page count is
# taken before the join); above it the join shuffles, and AQE splits a hot page's partition.
MAX_BROADCAST_PAGES = 500_000

_HOST_RE = r"^[a-zA-Z]+://([^/:?#]+)"
_PATH_RE = r"^[a-zA-Z]+://[^/]+/([^#]*)"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def page_keys(pages: DataFrame) -> DataFrame:
    """``page_id, ourl, sdomain, path, url`` of every page (the canonical key used by the captures)."""
    u = F.col("url")
    sdomain = reverse_host(F.lower(F.regexp_extract(u, _HOST_RE, 1)))
    path = F.lower(F.regexp_extract(u, _PATH_RE, 1))
    return pages.select("page_id", u.alias("ourl"), sdomain.alias("sdomain"), path.alias("path")) \
        .withColumn("url", F.concat("sdomain", F.lit(")/"), "path"))


_MIME = {"view": "text/html", "click": "image/jpeg", "purchase": "application/pdf", "error": "text/plain"}
_RESPONSE = {"view": 200, "click": 301, "purchase": 200, "error": 404}


def _case(col: Column, mapping: dict, default) -> Column:
    expr = None
    for k, v in mapping.items():
        expr = F.when(col == k, F.lit(v)) if expr is None else expr.when(col == k, F.lit(v))
    return expr.otherwise(default)


def captures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Capture table (12 capture columns + ``event_id``) derived from ``events`` and ``pages``."""
    ensure_utc(spark)
    pages = table(spark, sf_dir, "pages")
    n_pages = _page_count(spark, sf_dir, pages)  # a literal for the join key
    keys = page_keys(pages)
    ev = table(spark, sf_dir, "events").select(
        "event_id", "event_type", "value",
        F.to_timestamp(F.date_format("ts", "yyyyMMddHHmmss"), "yyyyMMddHHmmss").alias("date"),
        (F.col("user_id") % F.lit(n_pages)).alias("page_id"),
    )
    j = ev.join(bounded_broadcast(keys, n_pages, MAX_BROADCAST_PAGES), "page_id")
    digest = F.md5(F.concat(F.col("page_id").cast("string"), F.lit("-"),
                            F.floor(F.col("value") / 10).cast("string")))
    et = F.col("event_type")
    return j.select(
        F.concat(digest, ts14("date")).alias("id"),
        "url", "date", "ourl",
        _case(et, _MIME, F.lit(None).cast("string")).alias("mime"),
        _case(et, _RESPONSE, F.lit(-1)).cast("int").alias("response"),
        digest.alias("newdigest"),
        F.lit(None).cast("string").alias("redirect"),
        (F.col("event_id") * 4096).alias("offset"),
        F.concat(F.lit("crawl-"), F.date_format("date", "yyyyMMdd"), F.lit(".warc.gz")).alias("arc"),
        "sdomain", "path", "event_id",
    )


# ---- rendered CDX lines (for the parser) --------------------------------------------------------
# Deterministic damage, first match wins, so the oracle can count every reject reason. Every row is
# rendered; the moduli only choose which lines are damaged.
DAMAGE = (("column_count", 97), ("bad_response", 89), ("bad_offset", 83), ("bad_timestamp", 79),
          ("tbd_response", 73))


def cdx_lines(caps: DataFrame) -> DataFrame:
    """``event_id, line_mid, value``: one 11-token CDX line per capture, some damaged (see ``DAMAGE``)."""
    eid = F.col("event_id")
    kind = None
    for name, m in DAMAGE:  # first matching rule wins
        kind = F.when(eid % m == 0, F.lit(name)) if kind is None else kind.when(eid % m == 0, F.lit(name))
    hit = lambda name: F.col("_damage") == F.lit(name)
    dash = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("-"))
    resp = F.when(F.col("response") == -1, F.lit("-")).otherwise(F.col("response").cast("string"))
    resp = F.when(hit("bad_response"), F.lit("1.5")).when(hit("tbd_response"), F.lit("TBD")).otherwise(resp)
    offset = F.when(hit("bad_offset"), F.lit("-")).otherwise(F.col("offset").cast("string"))
    stamp = F.col("_ts14")
    stamp = F.when(hit("bad_timestamp"), F.substring(stamp, 1, 4)).otherwise(stamp)
    toks = [dash("url"), stamp, dash("ourl"), dash("mime"), resp, dash("newdigest"), dash("redirect"),
            F.lit("-"), F.lit("1024"), offset]
    arc = F.when(hit("column_count"), F.lit(None)).otherwise(dash("arc"))
    tagged = caps.withColumn("_damage", kind).withColumn("_ts14", ts14("date"))
    # like a file reader, the lines carry their position as delivered (``line_mid``)
    return tagged.select("event_id", F.monotonically_increasing_id().alias("line_mid"),
                         F.concat_ws(" ", *toks, arc).alias("value"))


def requests(caps: DataFrame, shift_seconds: int = 3600) -> DataFrame:
    """One closest-capture request per capture: ``rid, url, t`` with ``t`` shifted by ``shift_seconds``."""
    return caps.select(F.col("event_id").alias("rid"), "url",
                       (F.col("date") + F.expr(f"INTERVAL {int(shift_seconds)} SECONDS")).alias("t"))


def batches(caps: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Two overlapping ingest batches covering every capture; rows in both differ in ``response``,
    so the later batch must win."""
    b1 = caps.where(F.col("event_id") % 3 != 0)
    b2 = caps.where(F.col("event_id") % 3 != 1).withColumn("response", F.lit(200))
    return b1, b2


@dataclass(frozen=True)
class Target:
    """A lookup request taken from the data: the canonical key of page 0."""
    url: str
    ourl: str
    sdomain: str
    path: str

    @property
    def root(self) -> str:
        """Registrable domain in SURT form (first two labels), e.g. ``com,example``."""
        return ",".join(self.sdomain.split(",")[:2])

    @property
    def url_prefix(self) -> str:
        return f"{self.sdomain})/{self.path[:3]}"

    @property
    def path_prefix(self) -> str:
        return self.path.split("/")[0] + "/"


_TARGETS: dict[tuple, Target] = {}
_COUNTS: dict[tuple, int] = {}


def _file_key(sf_dir: str, name: str):
    path = f"{sf_dir.rstrip('/')}/{name}.parquet"
    try:
        st = os.stat(path)
    except OSError:  # not a local path: no memo
        return None
    return (path, st.st_mtime_ns, st.st_size)


def _page_count(spark: SparkSession, sf_dir: str, pages: DataFrame) -> int:
    """Row count of ``pages`` (answered from Parquet footers), remembered per table file version."""
    key = _file_key(sf_dir, "pages")
    if key is not None and key in _COUNTS:
        return _COUNTS[key]
    n = pages.count()
    if key is not None:
        _COUNTS[key] = n
    return n


def target(spark: SparkSession, sf_dir: str, page_id: int = 0) -> Target:
    """The request of the lookup queries (one row of ``pages``), remembered per table file version."""
    fk = _file_key(sf_dir, "pages")
    key = None if fk is None else (*fk, page_id)
    if key is not None and key in _TARGETS:
        return _TARGETS[key]
    r = page_keys(table(spark, sf_dir, "pages")).where(F.col("page_id") == page_id).first()
    t = Target(r.url, r.ourl, r.sdomain, r.path)
    if key is not None:
        _TARGETS[key] = t
    return t


# ---- DuckDB twins -----------------------------------------------------------------------------
SQL_PAGE_KEYS = f"""pk AS (
  SELECT page_id, url AS ourl,
         array_to_string(list_reverse(string_split(lower(regexp_extract(url, '{_HOST_RE}', 1)), '.')), ',')
           AS sdomain,
         lower(regexp_extract(url, '{_PATH_RE}', 1)) AS path
  FROM pages)"""

SQL_CAPTURES = SQL_PAGE_KEYS + """,
ev AS (
  SELECT e.event_id, e.event_type, e.value, date_trunc('second', e.ts) AS date,
         strftime(e.ts, '%Y%m%d%H%M%S') AS ts14, e.user_id % (SELECT count(*) FROM pages) AS page_id
  FROM events e),
captures AS (
  SELECT md5(concat(p.page_id, '-', cast(floor(ev.value / 10) AS bigint))) || ev.ts14 AS id,
         p.sdomain || ')/' || p.path AS url, ev.date, p.ourl,
         CASE ev.event_type WHEN 'view' THEN 'text/html' WHEN 'click' THEN 'image/jpeg'
              WHEN 'purchase' THEN 'application/pdf' WHEN 'error' THEN 'text/plain' END AS mime,
         CAST(CASE ev.event_type WHEN 'view' THEN 200 WHEN 'click' THEN 301 WHEN 'purchase' THEN 200
              WHEN 'error' THEN 404 ELSE -1 END AS INTEGER) AS response,
         md5(concat(p.page_id, '-', cast(floor(ev.value / 10) AS bigint))) AS newdigest,
         CAST(NULL AS VARCHAR) AS redirect, ev.event_id * 4096 AS "offset",
         'crawl-' || strftime(ev.date, '%Y%m%d') || '.warc.gz' AS arc,
         p.sdomain, p.path, ev.event_id, ev.ts14, CAST(epoch(ev.date) AS BIGINT) AS epoch_s
  FROM ev JOIN pk p ON p.page_id = ev.page_id)"""

SQL_TARGET_URL = "(SELECT sdomain || ')/' || path FROM pk WHERE page_id = 0)"
SQL_TARGET_OURL = "(SELECT ourl FROM pk WHERE page_id = 0)"
SQL_TARGET_SDOMAIN = "(SELECT sdomain FROM pk WHERE page_id = 0)"


def with_captures(body: str) -> str:
    """``WITH <captures twin> <body>`` where ``body`` may start with more CTEs (``, x AS (...)``)."""
    return "WITH " + SQL_CAPTURES + "\n" + body


__all__ = ["captures", "cdx_lines", "requests", "batches", "target", "page_keys", "table", "Target",
           "SQL_CAPTURES", "with_captures"]
