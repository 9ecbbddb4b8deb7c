"""Lookups: search with limit/offset, keyset paging, export chunk plans, closest capture (one request or
millions at once), bulk URL lookup, random capture and stable pseudo-random order."""

from __future__ import annotations

import random as _random
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.time import instant, lit_ts, time_distance
from ..schema import DEFAULT_FIELDS, DEFAULT_LIMIT, DEFAULT_ORDER, REQUIRED
from ..session import default_parallelism, scratch_path
from ..sources.layout import place_among
from .predicates import match


def _asc(cols: Sequence[str]) -> list[Column]:
    """Sort columns, missing values last in either direction; ``-name`` sorts descending."""
    return [F.col(c[1:]).desc_nulls_last() if c.startswith("-") else F.col(c).asc_nulls_last() for c in cols]


def search(df: DataFrame, *, columns: Sequence[str] | None = DEFAULT_FIELDS, limit: int | None = DEFAULT_LIMIT,
           offset: int = 0, order: Sequence[str] | None = DEFAULT_ORDER, **conditions) -> DataFrame:
    """Filter, order by a total order (nulls last; ``-field`` for descending), skip ``offset`` rows, keep
    ``limit`` rows, project.

    ``limit=None`` returns every match (use :func:`export` to write it rather than collecting it).
    With a limit this plans one ``TakeOrderedAndProject``: every task keeps its best ``offset + limit`` rows.
    """
    out = match(df, **conditions)
    if order:
        out = out.orderBy(*_asc(order))
    if offset:
        out = out.offset(offset)
    if limit is not None:
        out = out.limit(limit)
    if columns:
        out = out.select(*columns)
    return out


def export(df: DataFrame, path: str, format: str = "csv", mode: str = "errorifexists",
           columns: Sequence[str] | None = None, **conditions) -> None:
    """Bulk export of every match as a distributed write (``csv``: the escaped dialect, ``json``,
    ``parquet``); nothing passes through the driver."""
    out = match(df, **conditions)
    if columns:
        out = out.select(*columns)
    if format == "csv":
        from ..sources.csvio import write_escaped_csv
        write_escaped_csv(out, path, columns=tuple(out.columns), mode=mode)
    elif format in ("json", "parquet"):
        getattr(out.write.mode(mode), format)(path)
    else:
        raise ValueError(f"unknown export format {format!r}")


def keyset_condition(cursor: Mapping[str, object] | Sequence, order: Sequence[str] = DEFAULT_ORDER) -> Column:
    """Rows strictly after ``cursor`` in ``order`` (``-field`` = descending): ``k1 > v1 OR (k1 = v1 AND
    k2 > v2) OR ...``, plus the implied bound on ``k1`` so the scan can skip by statistics."""
    names = [k.lstrip("-") for k in order]
    desc = [k.startswith("-") for k in order]
    vals = [cursor[k] for k in names] if isinstance(cursor, Mapping) else list(cursor)
    lit = [lit_ts(v) if k == "date" else F.lit(v) for k, v in zip(names, vals)]

    def beyond(i: int, equal: bool = False) -> Column:
        """Missing values come last in either direction: after every value, and nothing after them."""
        if vals[i] is None:
            return F.col(names[i]).isNull() if equal else F.lit(False)
        c = F.col(names[i])
        own = ((c <= lit[i]) if equal else (c < lit[i])) if desc[i] else ((c >= lit[i]) if equal else (c > lit[i]))
        return own if names[i] in REQUIRED else own | c.isNull()

    disj = None
    for i in range(len(names)):
        term = beyond(i)
        for j in range(i):
            term = (F.col(names[j]).isNull() if vals[j] is None else F.col(names[j]) == lit[j]) & term
        disj = term if disj is None else (disj | term)
    return beyond(0, equal=True) & disj


def page_after(df: DataFrame, cursor, limit: int, order: Sequence[str] = DEFAULT_ORDER,
               columns: Sequence[str] | None = None, **conditions) -> DataFrame:
    """Cursor paging: the ``limit`` rows after ``cursor`` (``None`` = first page). The last row of a page is
    the cursor of the next one; cost does not grow with the page number, unlike ``offset``."""
    out = match(df, **conditions)
    if cursor is not None:
        out = out.where(keyset_condition(cursor, order))
    out = out.orderBy(*_asc(order)).limit(limit)
    return out.select(*columns) if columns else out


def chunk_plan(df: DataFrame, n: int, order: Sequence[str] = DEFAULT_ORDER, partitions: int | None = None,
               exact: bool = True, **conditions) -> DataFrame:
    """Boundaries of ``n`` chunks of the ordered matches: ``chunk, n, first_*, last_*``.

    ``exact=True``: equal chunks with ``ntile`` semantics, computed in parallel. The rows are
    range-partitioned and sorted by ``order``, their positions written once to the shared folder; a
    per-partition row count (one small row per partition reaches the driver) gives each partition's
    global offset and so the places of all boundary rows, which one join with that small list picks out.
    No single-partition window.

    ``exact=False``: one pass, nothing written: the range partitioner's own ``n`` ranges (sampled, so
    near-equal), each published with its count and first/last key. Chunks are disjoint, ordered and
    cover every row, which is what parallel export needs.
    """
    rows = match(df, **conditions).select(*[k.lstrip("-") for k in order])
    ascending, order = _asc(order), [k.lstrip("-") for k in order]
    spark = rows.sparkSession
    if not exact:
        key = F.struct(*order)
        agg = (rows.repartitionByRange(n, *ascending).sortWithinPartitions(*ascending)
               .select(F.spark_partition_id().alias("_p"), key.alias("_k"), F.monotonically_increasing_id().alias("_i"))
               .groupBy("_p").agg(F.count(F.lit(1)).alias("n"), F.min_by("_k", "_i").alias("_lo"), F.max_by("_k", "_i").alias("_hi")))
        return agg.select((F.dense_rank().over(Window.orderBy("_p"))).cast("int").alias("chunk"), "n",
                          *[F.col(f"_lo.{k}").alias(f"first_{k}") for k in order],
                          *[F.col(f"_hi.{k}").alias(f"last_{k}") for k in order])
    parts = partitions or max(n, default_parallelism(spark))
    ranked = (rows.repartitionByRange(parts, *ascending).sortWithinPartitions(*ascending)
              .withColumn("_mid", F.monotonically_increasing_id()))
    # documented layout of monotonically_increasing_id: partition id in the upper 31 bits
    ranked = ranked.select(*order, F.shiftright("_mid", 33).alias("_pid"),
                           F.col("_mid").bitwiseAND((1 << 33) - 1).alias("_pos"))
    # range boundaries are sampled per job, so the positions are written once (a table in the shared
    # folder) and both the counts and the chunk assignment read that copy
    path = scratch_path(spark, "chunk-plan")
    ranked.write.parquet(path)
    ranked = spark.read.parquet(path)
    counts = sorted((r["_pid"], r["c"]) for r in ranked.groupBy("_pid").agg(F.count(F.lit(1)).alias("c")).collect())
    offsets, total = {}, 0
    for pid, c in counts:
        offsets[pid] = total
        total += c
    if total == 0:
        return rows.sparkSession.createDataFrame(
            [], "chunk int, n bigint, " + ", ".join(f"first_{k} {rows.schema[k].dataType.simpleString()}, "
                                                      f"last_{k} {rows.schema[k].dataType.simpleString()}"
                                                      for k in order))
    # a chunk's first and last positions are known from the counts: only those rows are looked up
    bounds, at = [], 0
    for c in range(min(n, total)):
        size = total // n + (c < total % n)
        bounds.append((c + 1, size, at, at + size - 1))
        at += size
    starts = sorted(offsets.items(), key=lambda x: x[1])
    ends = []
    for c, size, lo, hi in bounds:
        for which, pos in (("lo", lo), ("hi", hi)):
            pid, base = [s for s in starts if s[1] <= pos][-1]
            ends.append((c, size, which, pid, pos - base))
    wanted = spark.createDataFrame(ends, "chunk int, n bigint, _which string, _pid bigint, _pos bigint")
    found = ranked.join(F.broadcast(wanted), ["_pid", "_pos"])  # two rows per chunk
    key = F.struct(*order)
    agg = found.groupBy("chunk", "n").agg(F.first(F.when(F.col("_which") == "lo", key), ignorenulls=True).alias("_lo"),
                                          F.first(F.when(F.col("_which") == "hi", key), ignorenulls=True).alias("_hi"))
    return agg.select("chunk", "n", *[F.col(f"_lo.{k}").alias(f"first_{k}") for k in order],
                      *[F.col(f"_hi.{k}").alias(f"last_{k}") for k in order])


# ---- closest capture ------------------------------------------------------------------------------

def closest_capture(df: DataFrame, url: str, t, start=None, end=None, **conditions) -> DataFrame:
    """The capture of ``url`` nearest to ``t`` (ties: earlier date, then smaller id), with
    ``distance_ms``; one ``TakeOrderedAndProject`` over the pushed-down URL filter."""
    cand = match(df, url=url, start=start, end=end, **conditions)
    return (cand.withColumn("distance_ms", time_distance("date", t))
            .orderBy("distance_ms", "date", "id").limit(1))


def random_instant(start, end, seed: int) -> int:
    """Seeded uniform instant (epoch seconds) in ``[start, end]``, drawn on the driver."""
    lo, hi = int(instant(start).timestamp()), int(instant(end).timestamp())
    return lo + int(_random.Random(seed).random() * (hi - lo + 1))


def random_capture(df: DataFrame, url: str, start, end, seed: int, **conditions) -> DataFrame:
    """A random capture of ``url`` within ``[start, end]``: a seeded random instant, then the closest."""
    t = random_instant(start, end, seed)
    return closest_capture(df, url, t, start=start, end=end, **conditions)


def random_order(df: DataFrame, seed: int | str, n: int | None = None, **conditions) -> DataFrame:
    """Stable pseudo-random order: by ``md5(seed || id)``, then ``id``. Same seed, same order, in any
    engine; ``n`` keeps the first ``n`` (a sample)."""
    key = F.md5(F.concat(F.lit(str(seed)), F.col("id")))
    out = match(df, **conditions).withColumn("sort_key", key).orderBy("sort_key", "id")
    return out.limit(n) if n is not None else out


MAX_GROUP_ROWS = 2_000_000     # captures and requests of one URL handled by one task before they are cut into ranges
MAX_ASKED_BROADCAST = 50_000   # requested URLs listed to every task below this (counted) number: a few MB
RANGE_SAMPLE = 100             # sampled rows per range
RANGE_SAMPLE_ROWS = 400_000    # and in all: what the driver sorts


def closest(requests: DataFrame, df: DataFrame, *, t_col: str = "t", max_distance_ms: int | None = None,
            payload: Sequence[str] = ("date", "id"), max_group_rows: int = MAX_GROUP_ROWS, decode_url: bool = False,
            keep_unmatched: bool = False) -> DataFrame:
    """For each request ``(url, t)`` the capture of that URL nearest to ``t`` (ties: earlier, then smaller id).

    An as-of join by prefix scan: requests are never paired with captures. Both are put into one order (URL, time, captures
    before requests, a hash), in which each request takes the last capture before it and the first after it. The order is
    cut into ranges of at most about ``max_group_rows`` rows, at places drawn from a sample of requests and captures, so a
    URL, a day or an instant that holds a third of either is spread over many tasks. Inside a URL's range two running
    windows find the neighbours; across the borders each range's first and last capture is carried on (one row per
    URL and range). Without a cut there is nothing to carry.

    Output: request columns, the ``payload`` columns of the chosen capture, ``distance_ms``.
    """
    payload = list(dict.fromkeys(["date", "id", *payload]))
    given = requests
    if decode_url:
        requests = requests.withColumn("url", F.coalesce(F.try_url_decode("url"), F.col("url")))
    out = _closest_by_scan(requests, df, t_col, payload, keep_unmatched, max_group_rows)
    found = [*payload, "distance_ms"]
    if max_distance_ms is not None:
        near = F.col("distance_ms") <= F.lit(int(max_distance_ms))
        if keep_unmatched:
            out = out.select(*given.columns, *[F.when(near, F.col(c)).alias(c) for c in found])
        else:
            out = out.where(near)
    if keep_unmatched:
        # requests without a URL or an instant match nothing, but they are requests
        none = [F.lit(None).cast(out.schema[c].dataType).alias(c) for c in found]
        lost = requests.where(F.col("url").isNull() | F.col(t_col).isNull())
        out = out.unionByName(lost.select(*given.columns, *none))
    return out


_PLACE = "struct<url:string,_ms:bigint,_kind:int,_tie:bigint>"


def _range_borders(places: DataFrame, max_group_rows: int) -> list:
    """Where the order of ``places`` (columns of ``_PLACE``) is cut; nowhere when one range is enough."""
    n = places.count()
    k = -(-2 * n // max_group_rows)  # half full on average, so that sampling error does not matter
    if n <= max_group_rows:
        return []
    share = min(1.0, 1.2 * min(RANGE_SAMPLE * k, RANGE_SAMPLE_ROWS) / n)
    order = ["url", "_ms", "_kind", "_tie"]
    sample = (places if share >= 1 else places.sample(share, seed=5)).select(F.struct(*order).alias("p")).sort("p").collect()
    borders = [sample[len(sample) * i // k].p for i in range(1, k)] if sample else []
    return [p for i, p in enumerate(borders) if not i or p != borders[i - 1]]


def _closest_by_scan(requests: DataFrame, df: DataFrame, t_col: str, payload: Sequence[str], keep_unmatched: bool,
                     max_group_rows: int) -> DataFrame:
    req_cols = requests.columns
    cap_struct = F.struct(F.unix_millis("date").alias("ms"), *[F.col(p) for p in payload])
    # a null URL or instant matches nothing (window partitions would group nulls together)
    df = df.where(F.col("url").isNotNull() & F.col("date").isNotNull())
    requests = requests.where(F.col("url").isNotNull() & F.col(t_col).isNotNull())
    # Few requested URLs: captures of others are dropped at the scan. With many, nearly all captures are asked for and
    # the semi join would be one more shuffle of them.
    asked = requests.select("url").distinct()
    if asked.limit(MAX_ASKED_BROADCAST + 1).count() <= MAX_ASKED_BROADCAST:
        df = df.join(F.broadcast(asked), "url", "left_semi")
    caps = df.select("url", F.unix_millis("date").alias("_ms"), F.lit(0).alias("_kind"), F.xxhash64("id").alias("_tie"), F.col("id").alias("_id"), cap_struct.alias("_cap"))
    reqs = requests.select("url", F.unix_millis(t_col).alias("_ms"), F.lit(1).alias("_kind"), F.xxhash64(*req_cols).alias("_tie"),
                           F.struct(*req_cols).alias("_req"))
    place = ["url", "_ms", "_kind", "_tie"]
    borders = _range_borders(caps.select(*place).unionByName(reqs.select(*place)), max_group_rows)
    in_range = place_among(F.struct(*place), borders, _PLACE).alias("_b")
    caps, reqs = caps.select("*", in_range), reqs.select("*", in_range)

    both = caps.select("url", "_b", "_ms", "_kind", "_id", "_cap").unionByName(reqs.select("url", "_b", "_ms", "_kind", "_req"), allowMissingColumns=True)
    part = Window.partitionBy("url", "_b")
    # Both are running frames (unbounded preceding .. previous row), which Spark evaluates in one pass;
    # a frame reaching to unbounded following would be recomputed for every row.
    # last capture at or before the request: captures sort before requests at the same instant, and
    # among captures of one instant the smallest id comes last
    w_prev = part.orderBy("_ms", "_kind", F.col("_id").desc()).rowsBetween(Window.unboundedPreceding, -1)
    # nearest later capture: the same walk backwards in time; requests first at an instant, and the
    # smallest id comes last among captures of one instant
    w_next = (part.orderBy(F.col("_ms").desc(), F.col("_kind").desc(), F.col("_id").desc())
              .rowsBetween(Window.unboundedPreceding, -1))
    found = both.select("url", "_b", "_ms", "_kind", "_req",
                        F.last("_cap", ignorenulls=True).over(w_prev).alias("_prev"),
                        F.last("_cap", ignorenulls=True).over(w_next).alias("_next")).where(F.col("_kind") == 1)
    if borders:
        found = _carried(found, caps, reqs)
    prev, nxt = F.col("_prev"), F.col("_next")
    d_prev = F.col("_ms") - prev["ms"]
    d_next = nxt["ms"] - F.col("_ms")
    best = (F.when(prev.isNull(), nxt).when(nxt.isNull(), prev)
            .when(d_prev <= d_next, prev).otherwise(nxt))
    out = found.select("_req", "_ms", best.alias("_best"))
    if not keep_unmatched:
        out = out.where(F.col("_best").isNotNull())
    return out.select(*[F.col(f"_req.{c}").alias(c) for c in req_cols],
                      *[F.col(f"_best.{p}").alias(p) for p in payload],
                      F.abs(F.col("_ms") - F.col("_best.ms")).alias("distance_ms"))


def _carried(found: DataFrame, caps: DataFrame, reqs: DataFrame) -> DataFrame:
    """``found`` with what lies beyond the borders of a request's range: the nearest capture of the URL's earlier and later ranges
    (an instant may lie on both sides of a border, so the smaller id is taken again)."""
    late, early = (lambda c: F.struct(-c["ms"], c["id"])), (lambda c: F.struct(c["ms"], c["id"]))
    cap = F.col("_cap")
    ends = caps.groupBy("url", "_b").agg(F.min_by("_cap", early(cap)).alias("_first"), F.min_by("_cap", late(cap)).alias("_last"))
    keyed = ends.join(reqs.select("url", "_b").distinct().withColumn("_q", F.lit(True)), ["url", "_b"], "full_outer")
    # one row per URL and range; min_by skips rows whose order is null, so ranges without captures carry nothing
    before = Window.partitionBy("url").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    behind = Window.partitionBy("url").orderBy(F.col("_b").desc()).rowsBetween(Window.unboundedPreceding, -1)
    has = lambda c, order: F.when(F.col(c).isNotNull(), order(F.col(c)))
    beyond = keyed.select("url", "_b", "_q", F.min_by("_last", has("_last", late)).over(before).alias("_before"),
                          F.min_by("_first", has("_first", early)).over(behind).alias("_behind")).where(F.col("_q")).drop("_q")

    def nearer(a: str, b: str, order) -> Column:
        return F.when(F.col(a).isNull() | (order(F.col(b)) < order(F.col(a))), F.col(b)).otherwise(F.col(a))

    return found.join(beyond, ["url", "_b"], "left").select(
        "url", "_b", "_ms", "_req", F.when(F.col("_before").isNull(), F.col("_prev")).otherwise(nearer("_prev", "_before", late)).alias("_prev"),
        F.when(F.col("_behind").isNull(), F.col("_next")).otherwise(nearer("_next", "_behind", early)).alias("_next"))


def lookup_many(requests: DataFrame, df: DataFrame, *, on: str = "url", decode_url: bool = False) -> DataFrame:
    """Captures of many requested keys at once: a semi join, so each capture appears once however many
    requests name it (no request x capture pairs). Small request sets are broadcast by AQE from their
    measured size; large ones shuffle, and AQE splits a hot key's partition."""
    if decode_url:
        requests = requests.withColumn(on, F.coalesce(F.try_url_decode(on), F.col(on)))
    return df.join(requests.select(on), on, "left_semi")
