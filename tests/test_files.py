"""Heads of files, the one-pass header check, CSV headers, the ledger, wildcard patterns, and cleaning up."""

import bz2
import gzip
import re
import time

import pytest

from capindex import session
from capindex.operators.predicates import like_escape, match, wildcard_like, wildcard_prefix
from capindex.plans.guards import physical_plan
from capindex.schema import CDX_HEADER
from capindex.sources import cdx, csvio, heads, ingest, store
from capindex.sources.ingest import ingest_files, read_rejects

LINE = "org,q)/{0} 20200102030405 http://q.org/{0} text/html 200 DIG{0} - - 10 5 q.warc.gz"


def lines(*names):
    return "\n".join([CDX_HEADER, *[LINE.format(n) for n in names]]) + "\n"


def test_heads_are_the_first_lines_of_every_codec(spark, tmp_path):
    long = "x" * 200_000
    texts = {"a.cdx": b"one\ntwo\n", "b.cdx.gz": gzip.compress(b"one\r\ntwo"), "c.bz2": bz2.compress(b"only"), "d [1] %41.cdx": b"\xc3\xa9\rtwo",
             "e.cdx": b"\nsecond", "empty.cdx": b"", "empty.gz": gzip.compress(b""), "long.cdx": long.encode()}
    for name, data in texts.items():
        (tmp_path / name).write_bytes(data)
    text = cdx.read_lines(spark, str(tmp_path))
    listed = text.inputFiles()
    assert len(listed) == len(texts)
    got = {r.file_path: r.first_line for r in cdx.first_lines(text, listed).collect()}
    scanned = {r.file_path: r.first_line for r in cdx.first_lines(text).collect()}
    assert set(got) == set(scanned) and len(got) == 6
    assert all(got[f] == scanned[f] or len(got[f]) == heads.HEAD_BYTES and scanned[f].startswith(got[f]) for f in got)
    assert not heads.readable("viewfs://x/a.cdx") and not heads.readable("/a.zst") and heads.readable("hdfs://h/a.gz") and heads.readable("/a b.cdx")


def test_the_header_check_reads_the_text_once(spark, tmp_path):
    (tmp_path / "a.cdx").write_text(lines("a", "b") + CDX_HEADER + "\n" + LINE.format("c") + "\n")
    (tmp_path / "b.cdx.gz").write_bytes(gzip.compress(lines("d").encode()))
    (tmp_path / "bad.cdx").write_text("not a header\n" + LINE.format("e") + "\n")
    for layout in (CDX_HEADER, cdx.AUTO):
        df = cdx.accepted(cdx.read_cdx(spark, str(tmp_path), layout))
        plan = physical_plan(df, "simple")
        assert len(re.findall(r"FileScan text", plan)) == 1 and "SortAggregate" not in plan and "Exchange hashpartitioning" not in plan
        assert sorted(r.newdigest for r in df.collect()) == ["DIGa", "DIGb", "DIGc", "DIGd"]


def test_the_csv_reader_scans_once_and_shuffles_nothing(spark, tmp_path):
    cols = ("id", "url")
    rows = [("id", "url"), ("a", "b"), ("id", "url"), ("\\id", "url"), (None, None)]
    path = str(tmp_path / "out")
    csvio.write_escaped_csv(spark.createDataFrame(rows, "id string, url string").repartition(2), path, columns=cols)
    df = csvio.read_escaped_csv(spark, path, cols)
    plan = physical_plan(df, "simple")
    assert plan.count("FileScan text") == 1 and "Exchange" not in plan and "Join" not in plan
    assert sorted(map(str, map(tuple, df.collect()))) == sorted(map(str, rows))


def test_the_ledger_stays_where_it_is(spark, tmp_path):
    root, inbox = str(tmp_path / "root"), tmp_path / "in"
    inbox.mkdir()
    for n in "abc":
        (inbox / f"{n}.cdx").write_text(lines(n))
    assert ingest_files(spark, str(inbox), root).count() == 3
    # a long history of other files
    spark.range(300_000).selectExpr("concat('file:/elsewhere/', id) AS file_path", "true AS header_ok", "1L AS lines", "1L AS accepted", "1 AS version",
                                    "current_timestamp() AS ingested_at", "0.0D AS run_seconds").write.mode("append").parquet(f"{root}/ledger")
    (inbox / "d.cdx").write_text(lines("d"))
    listing = spark.createDataFrame([(f,) for f in ("file:/elsewhere/7", "file:/new")], "file_path string")
    plan = physical_plan(cdx.new_files(listing, spark.read.parquet(f"{root}/ledger")), "simple")
    assert "LeftAnti" in plan
    assert [r.file_path.rsplit("/", 1)[1] for r in ingest_files(spark, str(inbox), root).collect()] == ["d.cdx"]
    assert ingest_files(spark, str(inbox), root) is None
    assert store.read_store(spark, f"{root}/store").count() == 4


def test_files_without_lines_are_in_the_ledger(spark, tmp_path):
    root, inbox = str(tmp_path / "root"), tmp_path / "in"
    inbox.mkdir()
    (inbox / "a.cdx").write_text(lines("a") + "broken line\n")
    (inbox / "bad.cdx").write_text("not a header\n" + LINE.format("e") + "\n")
    (inbox / "e [1] %41 é.cdx").write_bytes(b"")
    (inbox / "e.cdx.gz").write_bytes(gzip.compress(b""))
    report = {r.file_path.rsplit("/", 1)[1][:3]: r for r in ingest_files(spark, str(inbox), root).collect()}
    assert {n: (r.header_ok, r.lines, r.accepted, r.column_count, r.missing_required, r.months) for n, r in report.items()} == {
        "a.c": (True, 2, 1, 1, 0, ["202001"]), "bad": (False, 2, 1, 1, 0, ["202001"]),
        "e%2": (False, 0, 0, 0, 0, []), "e.c": (False, 0, 0, 0, 0, [])}
    assert spark.read.parquet(f"{root}/ledger").count() == 4 and read_rejects(spark, root, 1).count() == 1
    assert ingest_files(spark, str(inbox), root) is None  # nothing is new
    (inbox / "f.cdx").write_bytes(b"")
    assert [(r.header_ok, r.lines) for r in ingest_files(spark, str(inbox), root).collect()] == [(False, 0)]
    assert ingest_files(spark, str(inbox), root) is None and store.read_store(spark, f"{root}/store").count() == 1


def test_wildcards_and_literal_characters(spark):
    urls = ["com,a)/x_1", "com,a)/xa1", "com,a)/100%", "com,a)/100x", "com,a)/a*b", "com,a)/azb", "com,a)/q?x", "com,a)/q\\x", "org,a)/x_1"]
    df = spark.createDataFrame([(u,) for u in urls], "url string")
    found = lambda p: [r.url[7:] for r in match(df, url_wildcard=p).orderBy("url").collect()]
    assert found("com,a)/x_1") == ["x_1"] and found("com,a)/x?1") == ["x_1", "xa1"]
    assert found("com,a)/100%") == ["100%"] and found(r"com,a)/a\*b") == ["a*b"] and found("com,a)/a*b") == ["a*b", "azb"]
    assert found(r"com,a)/q\?x") == ["q?x"] and found(r"com,a)/q\\x") == ["q\\x"] and found("*_1") == ["x_1", "x_1"]
    assert wildcard_prefix(r"com,a)/\*x*y") == "com,a)/*x" and wildcard_prefix("*x") == "" and wildcard_like("a%*") == r"a\%%" and like_escape("_") == r"\_"
    assert "StartsWith" in physical_plan(match(df, url_wildcard="com,a)/x*"))


def test_clean_runs_and_scratch(spark, tmp_path):
    root, inbox = str(tmp_path / "root"), tmp_path / "in"
    inbox.mkdir()
    for n in "abc":
        (inbox / f"{n}.cdx").write_text(lines(n) + "broken line\n")
        ingest_files(spark, str(inbox / f"{n}.cdx"), root)
    assert ingest.clean_runs(spark, root) == []  # younger than a week
    gone = ingest.clean_runs(spark, root, keep=1, older_than_seconds=0)
    assert gone == [1, 2] and read_rejects(spark, root, 3).count() == 1
    assert store.read_store(spark, f"{root}/store").count() == 3
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        read_rejects(spark, root, 1)
    path = session.scratch_path(spark, "some-stage")
    spark.range(3).write.parquet(path)
    assert path not in session.clean_scratch(spark, older_than_seconds=3600)
    time.sleep(1.1)
    spark.range(1).write.parquet(keep := f"{session.shared_dir(spark)}/kept-by-name")
    assert path in session.clean_scratch(spark, older_than_seconds=1)
    assert not session.path_exists(spark, path) and session.path_exists(spark, keep)
