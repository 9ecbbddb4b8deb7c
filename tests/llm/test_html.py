import random
import re
import time

import pytest

from capindex.llm.htmlextract import default_model, extract, labels_of, main_text, marginals, parse
from capindex.llm.labelled_pages import labelled_pages


@pytest.fixture(scope="module")
def model():
    return default_model()


def test_held_out_pages(model):
    right = blocks = exact = 0
    pages = labelled_pages(150, seed=1234)
    for page in pages:
        t = parse(page)
        y, p = labels_of(t), marginals(t, model)
        right += sum((p[k] > 0.5) == y[k] for k, _, _ in t.runs)
        blocks += len(t.runs)
        exact += main_text(page, model) == " ".join(x for k, x, _ in t.runs if y[k])
    assert right >= 0.98 * blocks and exact >= 0.9 * len(pages)


def test_marginals_equal_enumeration(model):
    """Every labelling of small trees, summed up."""
    import itertools
    import math

    from capindex.llm.htmlextract import edge_kind, features

    r = random.Random(0)
    for page in labelled_pages(60, seed=5):
        m = re.search(r"<body>(.{0,160})", page)
        t = parse(m[1] if m else page[:160])
        n = len(t.tag)
        if not 2 <= n <= 10:
            continue
        s = [sum(model.weights[i] * x for i, x in f) for f in features(t)]
        total, on = 0.0, [0.0] * n
        for x in itertools.product((0, 1), repeat=n):
            e = sum(s[v] * x[v] for v in range(n))
            for v in range(1, n):
                k, a = edge_kind(t.tag[v]), x[t.parent[v]]
                e += (1 - a) * (1 - x[v]) * model.neither[k] + a * x[v] * model.both[k]
            w = math.exp(e)
            total += w
            on = [o + w * b for o, b in zip(on, x)]
        assert all(abs(o / total - p) < 1e-6 for o, p in zip(on, marginals(t, model)))
    assert r


def test_given_pages(spark, small_dir, model):
    rows = extract(spark.read.parquet(f"{small_dir}/pages.parquet"), model).collect()
    right = 0
    for r in rows:
        inner = re.search(r"<article>(.*)</article>", r.html, re.S)[1]
        right += r.text == " ".join(x for _, x, _ in parse(inner).runs)
    assert right >= 0.98 * len(rows)


def test_reader():
    text = lambda h: [x for _, x, _ in parse(h).runs]
    assert text("<p>a<p>b<b>c</b>d<br>e &amp; &#233;&nbsp;f") == ["a", "bcd e & é f"]
    assert text("<ul><li>x<li>y<ul><li>z</ul><li>w</ul>q") == ["x", "y", "z", "w", "q"]
    assert text("<script>var t='</p>';if(a<b){}</script>1<style>p{}</style>2<!-- <p>3 -->4<!--") == ["124"]
    assert text("</div></p>a</b><div>b") == ["a", "b"] and text("a < b & c <3") == ["a < b & c <3"]
    assert text("<title>x</title><head><title>t</title><body>y") == ["y"]
    assert text('<p title="a>b">x</p><p class=\'q">y') == ["x", "y"] and text("") == [] and text("<") == ["<"]
    assert text("<table><tr><td>1<td>2<tr><td>3</table>") == ["1", "2", "3"]
    assert len(text("<div>" * 5000 + "x")) == 1 and text("<a href='" * 3000)


def test_elements_without_an_end_end_with_their_block(model):
    text = lambda h: [x for _, x, _ in parse(h).runs]
    for tag in "template noscript iframe select button svg audio video canvas".split():
        assert text(f"<p>a<{tag}>x<b>y</b></{tag}>b") == ["ab"] and text(f"<p>a<{tag}/>b") == ["ab"]
        assert text(f"<body><{tag}>menu<article><p>a</p></article>") == ["a"]
        assert text(f"<div><p>a <{tag}>x</p><p>b</p></div>c") == ["a", "b", "c"]
        assert text(f"<{tag}><div>x</div><p>y</{tag}><p>a") == ["a"]
    assert text("<button>menu<article>a</article><p>b<button>x</button>c") == ["a", "bc"]
    assert text("<svg><svg>x</svg>y</svg>a<script><svg></script>b") == ["ab"]
    assert text("<p>so <math><mi>x</mi><mo>=</mo>2</math> and <object data=y>z</object>.</p>") == ["so x=2 and z."]
    assert text("<object data=x><p>a<math>") == ["a"]
    assert len(text("<svg><div>" * 3000 + "x" + "</svg>" * 10)) <= 1 and len(text("<button><div>" * 3000 + "x")) == 1
    body = "<article><h1>Words of a title</h1>" + "<p>One two three four five. Six seven eight nine ten.</p>" * 3 + "</article></body></html>"
    whole = main_text("<html><body>" + body, model)
    assert whole and all(main_text(f"<html><body><{x}>" + body, model) == whole for x in ("button", "object", "svg"))


def test_odd_pages(spark, model):
    rows = [(1, None), (2, ""), (3, "<html></html>"), (4, "<nav><a href=x>menu</a></nav>"), (4, "<nav><a href=x>menu</a></nav>"),
            (None, "<article><p>One two three four five. Six seven eight.</p></article>"), (6, "<div>" * 3000 + "<p>deep words here.</p>")]
    df = spark.createDataFrame(rows, "page_id bigint, html string").selectExpr("*", "1 as text", "'u' as url")
    out = extract(df, model)
    assert out.columns == ["page_id", "html", "url", "text"]
    got = [r.text for r in out.collect()]
    assert got[:5] == [""] * 5 and got[5] == "One two three four five. Six seven eight."
    assert extract(df.where("false"), model).count() == 0


def test_a_megabyte_of_odd_tags():
    """Time in proportion to the page: a megabyte of each takes seconds at most."""
    pages = ["<div>" * 200_000 + "</p>" * 1000, "<div></p>" * 110_000, "<head>" * 170_000, "<!" * 500_000, "<a" * 500_000,
             "<div>" * 100_000 + "<li></li>" * 50_000, "<svg><div>" * 90_000, "<!--" * 250_000, "<button><head>" * 70_000,
             '<a "' * 250_000, "<div>" * 100_000 + "<tr></tr>" * 90_000, "<div>" * 100_000 + "<p>x</p>" * 90_000]
    for page in pages:
        began = time.time()
        assert len(parse(page).runs) <= 90_001
        assert time.time() - began < 10, page[:40]


def test_tags_after_the_last_end():
    text = lambda h: [x for _, x, _ in parse(h).runs]
    assert text("<p>a</p>b <c d") == ["a", "b <c d"] and text("<p>a<!-- b") == ["a"] and text("<p>a<!--b>c") == ["a"]
    assert text("<script>a<p>b") == [] and text("<p>a<script>b<!--") == ["a"] and text("<!-->a<p>b") == []
