"""Operators against brute force on small fixtures."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from capindex.schema import CDX_HEADER
from capindex.functions import date_math, surt
from capindex.functions.time import partial_range
from capindex.operators import facets, lookup
from capindex.operators.predicates import literal_prefix, match
from capindex.plans.guards import physical_plan
from capindex.sources import csvio, store

UTC = dt.timezone.utc
T0 = dt.datetime(2024, 1, 1, tzinfo=UTC)


def caps_df(spark, rows):
    return spark.createDataFrame(rows, "url string, date timestamp, id string, mime string")


def random_captures(n, urls, seed, span_s=40 * 86400, hot=None):
    rnd = random.Random(seed)
    out = []
    for i in range(n):
        u = hot if hot and rnd.random() < 0.4 else rnd.choice(urls)
        # coarse instants so same-second ties are common
        t = T0 + dt.timedelta(seconds=rnd.randrange(0, span_s, 3600 * 7))
        out.append((u, t, f"id{rnd.randrange(10**6):06d}", None))
    return out


def brute_closest(caps, reqs):
    best = {}
    for rid, url, t in reqs:
        cand = [(abs((t - d).total_seconds()), d, i) for (u, d, i, _) in caps if u == url]
        if cand:
            d, when, i = min(cand)
            best[rid] = (when.replace(tzinfo=None), i, int(d * 1000))
    return best


@pytest.mark.parametrize("seed,max_rows", [(3600, 2_000_000), (86400, 400), (7, 100), (8, 7), (9, 3)])
def test_closest_scan_matches_brute_force(spark, seed, max_rows):
    urls = [f"com,ex)/{i}" for i in range(6)]
    caps = random_captures(400, urls, seed=seed, hot=urls[0])
    rnd = random.Random(1)
    reqs = [(k, rnd.choice(urls + ["com,none)/"]), T0 + dt.timedelta(seconds=rnd.randrange(-86400 * 5, 86400 * 50, 1800)))
            for k in range(300)]
    reqs += [(1000 + k, c[0], c[1]) for k, c in enumerate(caps[:30])]  # exact hits
    caps += [(urls[1], T0, f"same{k:03d}", None) for k in range(40)]  # an instant with many captures and requests
    reqs += [(2000 + k, urls[1], T0) for k in range(40)]
    got = lookup.closest(spark.createDataFrame(reqs, "rid long, url string, t timestamp"), caps_df(spark, caps),
                         max_group_rows=max_rows).collect()
    got = {r.rid: (r.date, r.id, r.distance_ms) for r in got}
    assert got == brute_closest(caps, reqs)


def test_closest_max_distance_and_unmatched(spark):
    caps = caps_df(spark, [("u", T0, "a", None), (None, T0, "n", None)])
    nulls = spark.createDataFrame([(9, None, T0)], "rid long, url string, t timestamp")
    assert lookup.closest(nulls, caps).count() == 0
    reqs = spark.createDataFrame([(1, "u", T0 + dt.timedelta(hours=2)), (2, "v", T0)], "rid long, url string, t timestamp")
    assert lookup.closest(reqs, caps, max_distance_ms=3600 * 1000).count() == 0
    out = lookup.closest(reqs, caps, keep_unmatched=True).orderBy("rid").collect()
    assert [r.id for r in out] == ["a", None]


def test_closest_capture_single(spark):
    caps = caps_df(spark, [("u", T0, "b", None), ("u", T0 + dt.timedelta(hours=2), "a", None),
                           ("u", T0 + dt.timedelta(hours=2), "c", None)])
    r = lookup.closest_capture(caps, "u", T0 + dt.timedelta(hours=1)).collect()[0]
    assert r.id == "b" and r.distance_ms == 3600 * 1000  # tie on distance: the earlier capture
    r = lookup.closest_capture(caps, "u", T0 + dt.timedelta(hours=3)).collect()[0]
    assert r.id == "a"  # same instant: the smaller id


def test_keyset_pages_cover_everything_once(spark):
    rows = random_captures(120, ["a", "b", "c"], seed=3)
    df = caps_df(spark, rows)
    seen, cursor = [], None
    while True:
        page = lookup.page_after(df, cursor, 17).collect()
        if not page:
            break
        seen += [(r.url, r.date, r.id) for r in page]
        last = page[-1]
        cursor = {"url": last.url, "date": last.date.replace(tzinfo=UTC), "id": last.id}
    assert seen == [tuple(r) for r in df.select("url", "date", "id").orderBy("url", "date", "id").collect()]
    assert len(seen) == len(set(seen)) == len({(u, d, i) for u, d, i, _ in rows})


def test_chunk_plan_equals_ntile(spark):
    rows = random_captures(203, ["a", "b", "c", "d"], seed=5)
    df = caps_df(spark, rows)
    order = sorted({(u, d.replace(tzinfo=None), i) for u, d, i, _ in rows})
    plan = {r.chunk: (r.n, (r.first_url, r.first_date, r.first_id), (r.last_url, r.last_date, r.last_id))
            for r in lookup.chunk_plan(df.dropDuplicates(["url", "date", "id"]), 7, partitions=5).collect()}
    total, n = len(order), 7
    q, rem = divmod(total, n)
    start = 0
    for c in range(1, n + 1):
        size = q + (1 if c <= rem else 0)
        assert plan[c] == (size, order[start], order[start + size - 1])
        start += size


def test_search_offset_limit_nulls_last(spark):
    df = caps_df(spark, [("a", T0, "x", None), ("a", T0, "w", "text/html"), ("b", T0, "z", None)])
    out = lookup.search(df, columns=("url", "id"), limit=2, offset=1).collect()
    assert [(r.url, r.id) for r in out] == [("a", "x"), ("b", "z")]


def test_random_order_is_stable(spark):
    df = caps_df(spark, random_captures(50, ["a"], seed=9))
    a = [r.id for r in lookup.random_order(df, 11, 10).collect()]
    b = [r.id for r in lookup.random_order(df, 11, 10).collect()]
    assert a == b and len(a) == 10


def test_facets_zero_counts_and_first_per_digest(spark):
    rows = [("u", T0 + dt.timedelta(days=i), f"i{i}", d) for i, d in enumerate(["A", "B", "A"])]
    df = spark.createDataFrame(rows, "url string, date timestamp, id string, newdigest string") \
        .withColumn("arc", F.lit("x")).withColumn("sdomain", F.lit("com,ex"))
    first = facets.first_per_digest(df).orderBy("date").collect()
    assert [(r.newdigest, r.id, r.n) for r in first] == [("A", "i0", 2), ("B", "i1", 1)]
    z = facets.facet(df, "arc", min_count=0, url="nope").collect()
    assert [(r.arc, r.n) for r in z] == [("x", 0)]
    assert facets.hit_count(df, partial="202401").collect()[0].n == 3


def test_upsert_semantics(spark):
    a = spark.createDataFrame([("k1", 1, 0), ("k2", 1, 0)], "id string, v int, seq int")
    b = spark.createDataFrame([("k2", 2, 0), ("k3", 2, 1), ("k3", 3, 2)], "id string, v int, seq int")
    out = {r.id: r.v for r in store.upsert(a, b, order=("seq",)).collect()}
    assert out == {"k1": 1, "k2": 2, "k3": 3}
    again = {r.id: r.v for r in store.upsert(store.upsert(a, b, order=("seq",)), b, order=("seq",)).collect()}
    assert again == out  # idempotent


def test_commit_upsert_is_idempotent(spark, tmp_path):
    root = str(tmp_path / "store")
    b = spark.createDataFrame([("k", 1, "u", T0)], "id string, v int, url string, date timestamp")
    assert store.commit_upsert(spark, root, b, source="q/0") is True
    assert store.commit_upsert(spark, root, b, source="q/0") is False
    assert store.versions(spark, root) == [1]
    with pytest.raises(ValueError, match="taken"):
        store.commit_upsert(spark, root, b, 1)
    assert store.read_store(spark, root).count() == 1


def test_escaped_csv_round_trip_random(spark, tmp_path):
    rnd = random.Random(4)
    alphabet = "ab,\\\" -x"
    rows = [tuple(("".join(rnd.choice(alphabet) for _ in range(rnd.randrange(0, 6))) or None) for _ in range(3))
            for _ in range(500)]
    df = spark.createDataFrame(rows, "a string, b string, c string")
    cols = ("a", "b", "c")
    back = csvio.from_escaped_lines(csvio.to_escaped_lines(df, cols), cols).collect()
    norm = lambda v: v if v else None  # noqa: E731  (empty and null are one cell value)
    assert sorted(map(tuple, back), key=str) == sorted([tuple(norm(v) for v in r) for r in rows], key=str)
    path = str(tmp_path / "csv")
    csvio.write_escaped_csv(df, path, columns=cols)
    assert csvio.read_escaped_csv(spark, path, columns=cols).count() == 500


def test_escape_golden(spark):
    from capindex.functions import escape_cell
    df = spark.createDataFrame([("a,b\\c",)], "v string")
    assert df.select(escape_cell("v")).first()[0] == "a\\,b\\\\c"


@pytest.mark.parametrize("url,expected", [
    ("http://www.Example.com/Path?b=2&a=1#frag", "com,example)/path?a=1&b=2"),
    ("https://198.51.100.23:8080/x", "23,100,51,198)/x"),
    ("http://user@sub.ex.org", "org,ex,sub)/"),
    ("http://ex.com/a%20b&", "com,ex)/a%20b&"),
])
def test_surt(spark, url, expected):
    assert spark.createDataFrame([(url,)], "u string").select(surt("u")).first()[0] == expected


def test_partial_range_and_date_math(spark):
    assert partial_range("201402") == (dt.datetime(2014, 2, 1, tzinfo=UTC), dt.datetime(2014, 3, 1, tzinfo=UTC))
    assert partial_range("2014123123")[1] == dt.datetime(2015, 1, 1, tzinfo=UTC)
    now = dt.datetime(2016, 3, 4, 20, 54, 10, tzinfo=UTC)
    got = spark.range(1).select(date_math(now, "DAY", "+6MONTHS+3DAYS").alias("d"),
                                date_math(now, None, "-1DAY").alias("e")).first()
    assert got.d == dt.datetime(2016, 9, 7) and got.e == dt.datetime(2016, 3, 3, 20, 54, 10)


def test_literal_prefix():
    assert literal_prefix(r"com,example,[a-z]+\)/en") == "com,example,"
    assert literal_prefix(r"abc*d") == "ab"
    assert literal_prefix(r"a|b") == ""


def test_filters_reach_the_scan(spark, tmp_path):
    rows = random_captures(200, ["com,a)/x", "com,b)/y"], seed=2)
    df = caps_df(spark, rows).withColumn("sdomain", F.lit("com,a")).withColumn("path", F.lit("x"))
    path = str(tmp_path / "s")
    store.write_layout(df, path, 4)
    s = spark.read.parquet(path)
    plan = physical_plan(match(s, url="com,a)/x", start="2024-01-02T00:00:00Z"), "formatted")
    assert "EqualTo(url,com,a)/x)" in plan and "GreaterThanOrEqual(date" in plan
    plan = physical_plan(match(s, url_prefix="com,a)", mime="text/html"))
    assert "StringStartsWith(url,com,a))" in plan
    plan = physical_plan(lookup.search(s, url="com,a)/x", columns=("id",)))
    assert "TakeOrderedAndProject" in plan and "ReadSchema: struct<url:string,date:timestamp,id:string>" in plan


def test_versions_rewrite_only_touched_months(spark, tmp_path):
    root = str(tmp_path / "st")
    jan, feb = dt.datetime(2024, 1, 5, tzinfo=UTC), dt.datetime(2024, 2, 5, tzinfo=UTC)
    schema = "id string, url string, date timestamp, v int"
    b1 = spark.createDataFrame([("a", "u", jan, 1), ("b", "u", feb, 1)], schema)
    b2 = spark.createDataFrame([("b", "u", feb, 2), ("c", "w", feb, 2)], schema)
    assert store.commit_upsert(spark, root, b1, 1)
    assert store.commit_upsert(spark, root, b2, 2)
    assert store.manifest(spark, root) == {"202401": [1], "202402": [2]}  # feb had a replaced key
    import os
    assert [n for n in sorted(os.listdir(tmp_path / "st" / "data" / "w=2")) if n.startswith("pmonth")] == ["pmonth=202402"]
    got = {r.id: r.v for r in store.read_store(spark, root).collect()}
    assert got == {"a": 1, "b": 2, "c": 2}
    assert {r.id for r in store.read_store(spark, root, version=1).collect()} == {"a", "b"}
    assert [r.id for r in store.read_store(spark, root, months={"202401"}).collect()] == ["a"]
    assert [r.id for r in store.read_store(spark, root, start="2024-02-01T00:00:00Z").collect()] != []
    assert {r.id for r in store.read_store(spark, root, end="2024-01-31T00:00:00Z").collect()} == {"a"}
    # new keys only: appended as a new part, existing parts untouched
    assert store.commit_upsert(spark, root, spark.createDataFrame([("d", "u", feb, 3)], schema), 3)
    assert store.manifest(spark, root) == {"202401": [1], "202402": [2, 3]}
    assert {r.id: r.v for r in store.read_store(spark, root).collect()} == {"a": 1, "b": 2, "c": 2, "d": 3}
    # a replaced key in a month with two parts: only the part holding it is rewritten
    assert store.commit_upsert(spark, root, spark.createDataFrame([("c", "w", feb, 4)], schema), 4)
    assert store.manifest(spark, root) == {"202401": [1], "202402": [3, 4]}
    assert {r.id: r.v for r in store.read_store(spark, root).collect()} == {"a": 1, "b": 2, "c": 4, "d": 3}
    assert store.commit_upsert(spark, root, spark.createDataFrame([("e", "u", jan, 5)], schema), 5)
    assert store.compact(spark, root, 6) == ["202401", "202402"]
    assert store.manifest(spark, root) == {"202401": [6], "202402": [6]}
    assert {r.id: r.v for r in store.read_store(spark, root).collect()} == {"a": 1, "b": 2, "c": 4, "d": 3, "e": 5}


def test_descending_sort_and_facet_limit(spark):
    df = caps_df(spark, [("a", T0, "x", None), ("a", T0 + dt.timedelta(days=1), "y", "m"),
                         ("b", T0, "z", "m")])
    out = lookup.search(df, columns=("id",), order=("-date", "id")).collect()
    assert [r.id for r in out] == ["y", "x", "z"]
    top = facets.facet(df.withColumn("arc", F.col("url")), "arc", limit=1).collect()
    assert [(r.arc, r.n) for r in top] == [("a", 2)]


def test_keyset_descending(spark):
    rows = random_captures(60, ["a", "b"], seed=8)
    df = caps_df(spark, rows).dropDuplicates(["url", "date", "id"])
    order = ("url", "-date", "id")
    want = [(r.url, r.date, r.id) for r in lookup.search(df, columns=("url", "date", "id"), order=order, limit=None).collect()]
    seen, cursor = [], None
    while True:
        page = lookup.page_after(df, cursor, 13, order=order).collect()
        if not page:
            break
        seen += [(r.url, r.date, r.id) for r in page]
        cursor = {"url": page[-1].url, "date": page[-1].date.replace(tzinfo=UTC), "id": page[-1].id}
    assert seen == want


def test_commit_upsert_key_across_months(spark, tmp_path):
    root = str(tmp_path / "st2")
    jan, feb = dt.datetime(2024, 1, 5, tzinfo=UTC), dt.datetime(2024, 2, 5, tzinfo=UTC)
    schema = "id string, url string, date timestamp"
    store.commit_upsert(spark, root, spark.createDataFrame([("a", "u", jan), ("b", "w", jan)], schema), 1,
                        key=("url",))
    store.commit_upsert(spark, root, spark.createDataFrame([("c", "u", feb)], schema), 2, key=("url",))
    assert sorted((r.url, r.id) for r in store.read_store(spark, root).collect()) == [("u", "c"), ("w", "b")]


def test_cdx_search_and_convert(spark, tmp_path):
    import json
    from capindex.operators.api import cdx_search, convert_cdx
    from capindex.schema import CDX_HEADER
    df = spark.createDataFrame([("u", T0, "i1", "http://a/b?x=1,2", "text/html", "f.warc", 7)],
                               "url string, date timestamp, id string, ourl string, mime string, arc string, offset long")
    line = cdx_search(df, "http%3A%2F%2Fa%2Fb%3Fx%3D1%2C2").first().value
    assert line == "http://a/b?x=1\\,2,2024-01-01T00:00:00Z,text/html,f.warc,7"
    js = json.loads(cdx_search(df, "http://a/b?x=1,2", fl="ourl,date", output="json").first().value)
    assert js == {"ourl": "http://a/b?x=1,2", "date": "2024-01-01T00:00:00Z"}
    src = tmp_path / "x.cdx"
    src.write_text(CDX_HEADER + "\ncom,ex)/p 20190614083142 http://ex.com/p text/html 200 DIG - - 1 5 a.warc.gz\n")
    out = convert_cdx(spark, str(src))
    assert out and convert_cdx(spark, str(src)) is None
    lines = [r.value for r in spark.read.text(out).collect()]
    assert "DIG20190614083142,com\\,ex)/p,2019-06-14T08:31:42Z,http://ex.com/p,text/html,200,DIG,,5,a.warc.gz,com\\,ex,p" in lines


def test_chunk_plan_approximate_covers_in_order(spark):
    rows = random_captures(300, ["a", "b", "c", "d"], seed=6)
    df = caps_df(spark, rows).dropDuplicates(["url", "date", "id"])
    plan = sorted(lookup.chunk_plan(df, 4, exact=False).collect(), key=lambda r: r.chunk)
    assert sum(r.n for r in plan) == df.count() and [r.chunk for r in plan] == list(range(1, len(plan) + 1))
    for a, b in zip(plan, plan[1:]):
        assert (a.last_url, a.last_date, a.last_id) < (b.first_url, b.first_date, b.first_id)


def test_scale_plan_shapes(spark, tmp_path):
    rows = random_captures(300, ["a", "b", "c"], seed=12)
    path = str(tmp_path / "s")
    store.write_layout(caps_df(spark, rows), path, 4)
    caps = spark.read.parquet(path)
    reqs = caps.select(F.col("id").alias("rid"), "url", F.col("date").alias("t"))
    import re
    plan = re.sub(r"#\d+L?", "", physical_plan(lookup.closest(reqs, caps), "simple"))
    # the only exchange carrying every capture and request is the (url, range) one
    assert plan.count("hashpartitioning(url, _b") == 1
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    batch = caps.limit(5)
    plan = physical_plan(store.upsert(caps, batch), "simple")
    assert "BroadcastHashJoin" in plan and "LeftAnti" in plan


def test_versions_are_claimed_and_foreign_commits_fail(spark, tmp_path, monkeypatch):
    root = str(tmp_path / "store")
    schema = "id string, url string, date timestamp"
    row = lambda k: spark.createDataFrame([(k, "u", T0)], schema)
    first = store.claim_version(spark, root)
    assert store.commit_upsert(spark, root, row("a")) and store.versions(spark, root) == [first + 1]
    assert store.commit_upsert(spark, root, row("b"), source="q/0") and not store.commit_upsert(spark, root, row("x"), source="q/0")
    write = store._write_parts

    def meanwhile(df, path, partitions, mode="overwrite"):
        monkeypatch.setattr(store, "_write_parts", write)
        assert store.commit_upsert(spark, root, row("other"))
        write(df, path, partitions, mode)

    monkeypatch.setattr(store, "_write_parts", meanwhile)
    with pytest.raises(store.StoreChanged):
        store.commit_upsert(spark, root, row("c"))
    assert sorted(r.id for r in store.read_store(spark, root).collect()) == ["a", "b", "other"]


def test_optional_columns_survive_later_batches_and_compaction(spark, tmp_path):
    root = str(tmp_path / "store")
    store.commit_upsert(spark, root, spark.createDataFrame([("a", "u", T0, "10.20.30.40")], "id string, url string, date timestamp, ip string"))
    store.commit_upsert(spark, root, spark.createDataFrame([("b", "u", T0, 7)], "id string, url string, date timestamp, arclength bigint"))
    want = [("a", "10.20.30.40", None), ("b", None, 7)]
    assert sorted((r.id, r.ip, r.arclength) for r in store.read_store(spark, root).collect()) == want
    assert store.compact(spark, root)
    assert sorted((r.id, r.ip, r.arclength) for r in store.read_store(spark, root).collect()) == want


def test_months_and_calendars_are_utc_whatever_the_session(spark, tmp_path):
    when = dt.datetime(2024, 2, 1, 3, tzinfo=UTC)
    df = spark.createDataFrame([("a", "u", when)], "id string, url string, date timestamp")
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/Los_Angeles")
        store.commit_upsert(spark, str(tmp_path / "s"), df)
        assert store.read_store(spark, str(tmp_path / "s"), start="2024-02-01T00:00:00Z").count() == 1
        spark.conf.set("spark.sql.session.timeZone", "America/Los_Angeles")
        assert [r.period for r in facets.capture_calendar(df, "month").collect()] == ["2024-02"]
        spark.conf.set("spark.sql.session.timeZone", "America/Los_Angeles")
        assert [r.year for r in facets.facet(df.withColumn("date", F.lit("2024-01-01T01:00:00Z").cast("timestamp")), "year").collect()] == [2024]
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_keyset_returns_missing_values_last(spark):
    df = spark.createDataFrame([("a", "x"), ("b", None), ("c", "y"), ("d", None)], "id string, mime string")
    for order in (("mime", "id"), ("-mime", "id")):
        want = [r.id for r in lookup.search(df, columns=("id",), order=order, limit=None).collect()]
        seen, cursor = [], None
        while page := lookup.page_after(df, cursor, 1, order=order).collect():
            seen.append(page[-1].id)
            cursor = {"mime": page[-1].mime, "id": page[-1].id}
        assert seen == want and len(seen) == 4


def test_closest_keeps_unmatched_requests(spark):
    caps = caps_df(spark, [("a", T0, "x", None)])
    far = T0 + dt.timedelta(days=9)
    reqs = spark.createDataFrame([(1, "a", T0), (2, "a", far), (3, "zz", T0), (4, None, T0), (5, "a", None)], "rid int, url string, t timestamp")
    got = {r.rid: r.id for r in lookup.closest(reqs, caps, keep_unmatched=True, max_distance_ms=1000).collect()}
    assert got == {1: "x", 2: None, 3: None, 4: None, 5: None}
    assert {r.rid for r in lookup.closest(reqs, caps, max_distance_ms=1000).collect()} == {1}


def test_chunk_plan_descending(spark):
    df = caps_df(spark, random_captures(57, ["a", "b", "c"], seed=4))
    ids = [r.id for r in lookup.search(df, columns=("id",), order=("-date", "id"), limit=None).collect()]
    for exact in (True, False):
        plan = sorted(lookup.chunk_plan(df, 5, order=("-date", "id"), exact=exact).collect(), key=lambda r: r.chunk)
        assert sum(r.n for r in plan) == 57 and plan[0].first_id == ids[0] and plan[-1].last_id == ids[-1]
        at = 0
        for r in plan:
            assert (r.first_id, r.last_id) == (ids[at], ids[at + r.n - 1])
            at += r.n


def test_csv_header_is_line_one_and_equal_rows_are_data(spark, tmp_path):
    cols = ("id", "url")
    rows = [("id", "url"), ("a\\,b", '"q" #x'), (" lead", "trail "), (None, "z"), ("#c", "'"), ("\\", ",")]
    path = str(tmp_path / "out")
    csvio.write_escaped_csv(spark.createDataFrame(rows, "id string, url string").repartition(3), path, columns=cols)
    assert sorted(map(str, (tuple(r) for r in csvio.read_escaped_csv(spark, path, cols).collect()))) == sorted(map(str, rows))
    for part in (tmp_path / "out").glob("part-*"):
        assert part.read_text().split("\n")[0] == "id,url"


def test_missing_sources_odd_names_and_old_digests(spark, tmp_path):
    from capindex.operators.api import cdx_search, convert_files
    from capindex.sources.cdx import accepted, parse_cdx
    from capindex.sources.ingest import ingest_files
    line = "org,q)/ 20200102030405 http://q.org/?a=b+c text/html 200 DIG - - 10 5 q.warc.gz"
    for name in ("a b.cdx", "c[1].cdx"):
        (tmp_path / name).write_text(CDX_HEADER + "\n" + line.replace("DIG", name[0].upper()) + "\n")
    with pytest.warns(UserWarning, match="nothere"):
        ingest_files(spark, [str(tmp_path / "a b.cdx"), str(tmp_path / "nothere.cdx"), str(tmp_path / "c*.cdx")], str(tmp_path / "root"))
    s = store.read_store(spark, str(tmp_path / "root" / "store"))
    assert sorted(r.newdigest for r in s.collect()) == ["A", "C"]
    assert cdx_search(s, "http%3A%2F%2Fq.org%2F%3Fa%3Db%2Bc").count() == 2
    done = convert_files(spark, [str(tmp_path / "nothere.cdx"), str(tmp_path / "a b.cdx"), str(tmp_path / "a b.cdx")])
    assert [d[2] for d in done] == ["missing", "converted", "exists"]
    old = parse_cdx(spark.createDataFrame([(line.replace(" 200 DIG", " 200 OLD"),)], "value string"), CDX_HEADER.replace(" k ", " c "))
    assert [r.newdigest for r in accepted(old).collect()] == ["OLD"]
    bad = parse_cdx(spark.createDataFrame([(line.replace("030405", "030460"),)], "value string"), CDX_HEADER)
    assert [r.reject_reason for r in bad.collect()] == ["bad_timestamp"]


def test_shared_folder_is_asked_for_on_a_cluster():
    from types import SimpleNamespace

    from capindex import session
    cluster = SimpleNamespace(sparkContext=SimpleNamespace(getCheckpointDir=lambda: None, master="yarn"),
                              conf=SimpleNamespace(get=lambda k, d=None: d))
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session.shared_dir(cluster)


def test_closest_reads_only_the_requested_urls(spark):
    caps = caps_df(spark, random_captures(80, ["a", "b", "c"], seed=6))
    reqs = spark.createDataFrame([(1, "b", T0)], "rid int, url string, t timestamp")
    out = lookup.closest(reqs, caps)
    assert "LeftSemi" in physical_plan(out)
    want = lookup.closest_capture(caps, "b", T0).first()
    assert [(r.id, r.distance_ms) for r in out.collect()] == [(want.id, want.distance_ms)]


def test_closest_spreads_hot_requests_over_tasks(spark):
    n = 3000
    reqs = spark.range(n).select(F.col("id").alias("rid"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("u"), F.col("id") % 50)).alias("url"),
                                 F.timestamp_seconds(F.when(F.col("id") % 6 == 0, F.lit(1_700_000_000)).otherwise(F.col("id") + 1_700_000_000)).alias("t"))
    caps = spark.range(60).select(F.when(F.col("id") < 10, "hot").otherwise(F.concat(F.lit("u"), F.col("id") - 10)).alias("url"),
                                  F.timestamp_seconds(F.lit(1_700_000_000) + F.col("id") * 100).alias("date"), F.col("id").cast("string").alias("id"))
    out = lookup.closest(reqs, caps, max_group_rows=200)
    assert out.count() == n
    plan = physical_plan(out, "simple")
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    places = reqs.select("url", F.unix_millis("t").alias("_ms"), F.lit(1).alias("_kind"), F.xxhash64(*reqs.columns).alias("_tie"))
    borders = lookup._range_borders(places, 200)
    sizes = [r["count"] for r in places.select(lookup.place_among(F.struct("url", "_ms", "_kind", "_tie"), borders, lookup._PLACE).alias("b")).groupBy("b").count().collect()]
    assert sum(sizes) == n and max(sizes) <= 200 and len(sizes) >= 15
