"""Parser rules, one hand-written line per rule (our own strings)."""

import datetime as dt
import gzip
import os

import pytest

from capindex.schema import CDX_HEADER
from capindex.sources import cdx

BASE = ["com,ex)/p", "20190614083142", "http://ex.com/p", "text/html", "200", "DIG", "-", "-", "1", "5",
        "a.warc.gz"]


def line(**changes):
    t = list(BASE)
    for i, v in changes.items():
        t[int(i[1:])] = v
    return " ".join(t)


def parse(spark, lines):
    df = spark.createDataFrame([(x,) for x in lines], "value string")
    return [r.asDict() for r in cdx.parse_cdx(df).collect()]


def one(spark, text):
    rows = parse(spark, [text])
    assert len(rows) == 1
    return rows[0]


def test_base_line(spark):
    r = one(spark, line())
    assert r["reject_reason"] is None
    assert r["id"] == "DIG20190614083142"
    assert r["url"] == "com,ex)/p" and r["sdomain"] == "com,ex" and r["path"] == "p"
    assert r["date"] == dt.datetime(2019, 6, 14, 8, 31, 42)
    assert r["redirect"] is None and r["response"] == 200 and r["offset"] == 5


@pytest.mark.parametrize("tok,expected", [("-", -1), ("TBD", -1), ("+7", 7)])
def test_response_placeholders(spark, tok, expected):
    r = one(spark, line(t4=tok))
    assert r["reject_reason"] is None and r["response"] == expected


@pytest.mark.parametrize("tok", ["1.5", "99999999999", "\t200", ""])
def test_bad_response(spark, tok):
    assert one(spark, line(t4=tok))["reject_reason"] in ("bad_response", "column_count")


def test_bad_offset(spark):
    assert one(spark, line(t9="-"))["reject_reason"] == "bad_offset"


def test_trailing_spaces_ok(spark):
    assert one(spark, line() + "  ")["reject_reason"] is None


@pytest.mark.parametrize("text", ["short line", "", " " + line(), line().replace(" ", "  ", 1)])
def test_column_count(spark, text):
    assert one(spark, text)["reject_reason"] == "column_count"


@pytest.mark.parametrize("url,dom,path", [("dns:ex.com", "dns:ex.com", None), ("com,ex)/", "com,ex", None),
                                          ("com,ex)", "com,ex)", None), ("a)//b", "a", "/b")])
def test_domain_path_split(spark, url, dom, path):
    r = one(spark, line(t0=url))
    assert (r["sdomain"], r["path"]) == (dom, path)


@pytest.mark.parametrize("ts", ["2019", "20191399999999", "2019061408314x"])
def test_bad_timestamp(spark, ts):
    assert one(spark, line(t1=ts))["reject_reason"] == "bad_timestamp"


def test_long_timestamp(spark):
    r = one(spark, line(t1="20190614083142123"))
    assert r["date"] == dt.datetime(2019, 6, 14, 8, 31, 42)
    assert r["id"] == "DIG20190614083142123"


def test_missing_digest_id(spark):
    r = one(spark, line(t5="-"))
    assert r["id"] == "-20190614083142" and r["newdigest"] is None


def test_missing_url(spark):
    assert one(spark, line(t0="-"))["reject_reason"] == "missing_required"


def test_files_headers_gzip_line_ends(spark, tmp_path):
    good = [line(t9=str(i)) for i in range(5)]
    (tmp_path / "a.cdx").write_text(CDX_HEADER + "\n" + "\n".join(good[:3]) + "\n" + CDX_HEADER + "\n" + good[3] + "\n")
    with gzip.open(tmp_path / "b.cdx.gz", "wt") as f:
        f.write(CDX_HEADER + "\r\n" + good[4] + "\r\n")
    (tmp_path / "c.cdx").write_text("not a header\n" + good[0] + "\n")
    (tmp_path / "d.cdx").write_text(CDX_HEADER + "\r" + good[1] + "\r")
    parsed = cdx.read_cdx(spark, str(tmp_path))
    rows = cdx.accepted(parsed).collect()
    assert sorted(r.offset for r in rows) == [0, 1, 1, 2, 3, 4]
    assert cdx.rejected(parsed).count() == 0
    rep = {os.path.basename(r.file_path): r.header_ok for r in cdx.header_report(cdx.read_lines(spark, str(tmp_path))).collect()}
    assert rep == {"a.cdx": True, "b.cdx.gz": True, "c.cdx": False, "d.cdx": True}
    with pytest.raises(ValueError):
        cdx.read_cdx(spark, str(tmp_path), on_bad_header="error")


def test_layout_variant(spark):
    layout = " CDX N b a m s k r V g"
    df = spark.createDataFrame([("com,ex)/p 20190614083142 http://ex.com/p text/html 200 DIG - 7 a.warc.gz",)],
                               "value string")
    r = cdx.parse_cdx(df, layout).collect()[0]
    assert r.reject_reason is None and r.offset == 7 and r.arc == "a.warc.gz"


def test_ingest_report_and_new_files(spark):
    df = spark.createDataFrame([(line(), "f1"), (line(t9="x"), "f1"), ("bad", "f2")], "value string, file_path string")
    rep = {r.file_path: r.asDict() for r in cdx.ingest_report(cdx.parse_cdx(df)).collect()}
    assert rep["f1"]["lines"] == 2 and rep["f1"]["accepted"] == 1 and rep["f1"]["bad_offset"] == 1
    assert rep["f2"]["column_count"] == 1
    cand = spark.createDataFrame([("f1",), ("f3",)], "file_path string")
    assert [r.file_path for r in cdx.new_files(cand, df).collect()] == ["f3"]


def test_wide_layout_optional_fields(spark):
    layout = " CDX A b e a m s c k r V v D d g M n"
    text = "com,ex)/p 20190614083142 10.20.30.40 http://ex.com/p text/html 200 OLD NEW - 5 50 - 7 f.arc AI 123"
    r = cdx.parse_cdx(spark.createDataFrame([(text,)], "value string"), layout).collect()[0]
    assert r.reject_reason is None and r.url == "com,ex)/p" and r.sdomain == "com,ex"
    assert (r.ip, r.digest, r.newdigest, r.offset, r.uoffset, r.doffset, r.udoffset) == ("10.20.30.40", "OLD", "NEW", 5, 50, None, 7)
    assert r.meta == ["A", "I"] and r.arclength == 123 and r.arc == "f.arc"


def test_auto_layout_mixed_files(spark, tmp_path):
    (tmp_path / "std.cdx").write_text(CDX_HEADER + "\n" + line() + "\n")
    wide = " CDX A b e a m s c k r V v D d g M n"
    (tmp_path / "wide.cdx").write_text(
        wide + "\ncom,ex)/q 20190614083143 10.20.30.40 http://ex.com/q text/html 404 OLD NEW2 - 6 60 - - g.arc - 9\n")
    (tmp_path / "noheader.cdx").write_text(line() + "\n")
    parsed = cdx.read_cdx(spark, str(tmp_path), layout="auto")
    rows = sorted((r.url, r.offset, r.response, r.ip, r.uoffset) for r in cdx.accepted(parsed).collect())
    assert rows == [("com,ex)/p", 5, 200, None, None), ("com,ex)/q", 6, 404, "10.20.30.40", 60)]
    assert cdx.rejected(parsed).count() == 0
    short = spark.createDataFrame([("com,ex)/p 20190614083142 x", CDX_HEADER)], "value string, lay string")
    assert cdx.parse_cdx(short, layout_col="lay").first().reject_reason == "column_count"
