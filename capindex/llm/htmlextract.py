"""Main text of web pages by a tree-structured graphical model.

Every block element of a page is a variable: main text or not. Its tag, names, text and links speak for or against it; a
potential between parent and child lets a block follow the one around it, so that a paragraph in a list of comments
goes with the comments and one in an article with the article. Sum-product messages, upward from the leaves and downward
from the root, give exact marginals; blocks of more than one half are main text.

The weights are trained by gradient ascent on the likelihood of labelled pages (``labelled_pages``), with the same
messages over all of their trees at once. Training takes seconds, on the driver, once per process; the model is some
hundred numbers. Extraction is one pass over the pages without a shuffle, one page at a time.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from capindex.llm.htmltree import Tree, parse
from capindex.llm.labelled_pages import labelled_pages

#: Groups of element names; those not named here are the last group.
TAG_GROUPS = (
    ("#root", "html", "body"), ("div", "center"), ("section", "details", "dialog"), ("article",), ("main",), ("p",),
    ("h1",), ("h2", "h3", "h4", "h5", "h6", "hgroup", "summary"), ("ul", "ol", "dl", "menu", "dir"), ("li", "dt", "dd"),
    ("table", "tbody", "thead", "tfoot", "tr", "td", "th", "caption"), ("nav",), ("header",), ("footer",), ("aside",),
    ("form", "fieldset", "legend", "search"), ("blockquote", "pre", "figure", "figcaption"), ())
LANDMARKS = frozenset("article main nav header footer aside form search".split())
#: Words in class, id and role that tell what a block is.
NAME_GROUPS = (
    "nav navbar navigation menu menubar breadcrumb breadcrumbs topnav pager pagination toc skip",
    "header masthead branding banner topbar logo tagline",
    "footer copyright legal colophon contentinfo imprint",
    "sidebar side aside rail widget widgets related recommended trending popular complementary more teaser",
    "ad ads advert adverts advertisement sponsor sponsored promo promotion promoted adsense dfp",
    "cookie cookies consent gdpr notice alert popup modal overlay newsletter subscribe subscription paywall announcement toast dialog",
    "search login signup signin register form contact survey poll",
    "comment comments commentlist discussion response responses reply replies disqus respond thread",
    "share sharing social follow tags tag meta byline author",
    "article content post entry story main body text prose")
NAME_AT = {w: i for i, group in enumerate(NAME_GROUPS) for w in group.split()}
TAG_AT = {t: i for i, group in enumerate(TAG_GROUPS) for t in group}
_T, _G = len(TAG_GROUPS), len(NAME_GROUPS)
_OWN, _OWN_LINKS, _ALL, _ALL_LINKS, _PART, _ENDS, _SHORT, _COPY, _BEFORE, _HIDDEN, _EMPTY, _BIAS = range(_T + _G, _T + _G + 12)
FEATURES = _T + _G + 12
EDGES = 3
_STOPS = re.compile(r"[.!?]")


def features(t: Tree) -> list[list[tuple[int, float]]]:
    """(feature, value) of each block."""
    n = len(t.tag)
    own, own_links, ends, copied, first = [0] * n, [0] * n, [0] * n, [False] * n, [-1] * n
    seen = 0
    for k, text, links in t.runs:
        if first[k] < 0:
            first[k] = seen
        own[k] += len(text)
        own_links[k] += links
        ends[k] += len(_STOPS.findall(text))
        copied[k] = copied[k] or "©" in text
        seen += len(text)
    total, total_links = own[:], own_links[:]
    for v in range(n - 1, 0, -1):  # children come after their parents
        total[t.parent[v]] += total[v]
        total_links[t.parent[v]] += total_links[v]
        if first[v] >= 0 and (first[t.parent[v]] < 0 or first[v] < first[t.parent[v]]):
            first[t.parent[v]] = first[v]
    out = []
    for v in range(n):
        f = [(TAG_AT.get(t.tag[v], _T - 1), 1.0), (_BIAS, 1.0)]
        f += [(_T + g, 1.0) for g in {NAME_AT[w] for w in t.names[v] if w in NAME_AT}]
        if own[v]:
            f += [(_OWN, math.log1p(own[v]) / 6), (_OWN_LINKS, own_links[v] / own[v]), (_ENDS, min(1.0, ends[v] / 3))]
            if own[v] < 40:
                f.append((_SHORT, 1.0))
        if total[v]:
            f += [(_ALL, math.log1p(total[v]) / 8), (_ALL_LINKS, total_links[v] / total[v]), (_PART, total[v] / seen),
                  (_BEFORE, first[v] / seen)]
        else:
            f.append((_EMPTY, 1.0))
        if copied[v]:
            f.append((_COPY, 1.0))
        if t.hidden[v]:
            f.append((_HIDDEN, 1.0))
        out.append(f)
    return out


def edge_kind(tag: str) -> int:
    return 0 if tag in LANDMARKS else 1 if tag in ("div", "section") else 2


@dataclass(frozen=True)
class Model:
    """Node weights, and per kind of child the potentials of (neither is main text, both are)."""

    weights: tuple[float, ...]
    neither: tuple[float, ...]
    both: tuple[float, ...]


def _logadd(a: float, b: float) -> float:
    return (a + math.log1p(math.exp(b - a))) if a > b else (b + math.log1p(math.exp(a - b)))


def marginals(t: Tree, model: Model) -> list[float]:
    """Probability of main text of each block, by messages up and down the tree."""
    w, n = model.weights, len(t.tag)
    score = [sum(w[i] * x for i, x in f) for f in features(t)]
    kind = [edge_kind(x) for x in t.tag]
    off, on = [0.0] * n, score[:]  # what the block and all below it say of each state
    up0, up1 = [0.0] * n, [0.0] * n
    for v in range(n - 1, 0, -1):
        p, e0, e1 = t.parent[v], model.neither[kind[v]], model.both[kind[v]]
        up0[v], up1[v] = _logadd(e0 + off[v], on[v]), _logadd(off[v], e1 + on[v])
        off[p] += up0[v]
        on[p] += up1[v]
    out = [0.0] * n
    for v in range(n):
        if v:
            p, e0, e1 = t.parent[v], model.neither[kind[v]], model.both[kind[v]]
            rest0, rest1 = off[p] - up0[v], on[p] - up1[v]
            off[v] += _logadd(rest0 + e0, rest1)
            on[v] += _logadd(rest0, rest1 + e1)
        d = off[v] - on[v]
        out[v] = 1 / (1 + math.exp(d)) if d < 700 else 0.0
    return out


def labels_of(t: Tree) -> list[bool]:
    out: list[bool] = []
    for v, mark in enumerate(t.mark):
        out.append(mark if mark is not None else v > 0 and out[t.parent[v]])
    return out


def train(pages: list[str], steps: int = 250, rate: float = 0.1, decay: float = 1e-4) -> Model:
    """Weights of largest likelihood (with a small penalty) of pages whose blocks are labelled, by Adam."""
    rows, cols, vals, parent, depth, kind, truth = [], [], [], [], [], [], []
    for page in pages:
        t, base = parse(page), len(parent)
        for v, f in enumerate(features(t)):
            rows += [base + v] * len(f)
            cols += [i for i, _ in f]
            vals += [x for _, x in f]
            parent.append(base + t.parent[v] if v else -1)
            depth.append(depth[base + t.parent[v]] + 1 if v else 0)
            kind.append(edge_kind(t.tag[v]))
        truth += labels_of(t)
    n = len(parent)
    x = np.zeros((n, FEATURES))
    np.add.at(x, (rows, cols), vals)
    parent, depth, kind, y = np.array(parent), np.array(depth), np.array(kind), np.array(truth, dtype=float)
    levels = [np.flatnonzero(depth == d) for d in range(depth.max() + 1)]
    child = np.flatnonzero(parent >= 0)
    yp, yc = y[parent[child]], y[child]
    seen = np.concatenate([np.bincount(kind[child], (1 - yp) * (1 - yc), EDGES), np.bincount(kind[child], yp * yc, EDGES)])
    theta, m1, m2 = np.zeros(FEATURES + 2 * EDGES), 0.0, 0.0
    for step in range(1, steps + 1):
        s, e = x @ theta[:FEATURES], theta[FEATURES:].reshape(2, EDGES)
        off, on, e0, e1 = np.zeros(n), s.copy(), e[0][kind], e[1][kind]
        up0, up1 = np.zeros(n), np.zeros(n)
        for at in levels[:0:-1]:
            up0[at], up1[at] = np.logaddexp(e0[at] + off[at], on[at]), np.logaddexp(off[at], e1[at] + on[at])
            np.add.at(off, parent[at], up0[at])
            np.add.at(on, parent[at], up1[at])
        low0, low1 = off.copy(), on.copy()  # without the message from above
        for at in levels[1:]:
            r0, r1 = off[parent[at]] - up0[at], on[parent[at]] - up1[at]
            off[at] += np.logaddexp(r0 + e0[at], r1)
            on[at] += np.logaddexp(r0, r1 + e1[at])
        z = np.logaddexp(off, on)
        p, zc = np.exp(on - z), z[parent[child]]
        both0 = np.exp(off[parent[child]] - up0[child] + e0[child] + low0[child] - zc)
        both1 = np.exp(on[parent[child]] - up1[child] + e1[child] + low1[child] - zc)
        made = np.concatenate([np.bincount(kind[child], both0, EDGES), np.bincount(kind[child], both1, EDGES)])
        g = np.concatenate([x.T @ (y - p), seen - made]) / len(pages) - decay * theta
        m1, m2 = 0.9 * m1 + 0.1 * g, 0.99 * m2 + 0.01 * g * g
        theta = theta + rate * (m1 / (1 - 0.9**step)) / (np.sqrt(m2 / (1 - 0.99**step)) + 1e-8)
    return Model(tuple(theta[:FEATURES].tolist()), tuple(theta[FEATURES : FEATURES + EDGES].tolist()), tuple(theta[FEATURES + EDGES :].tolist()))


@lru_cache(maxsize=4)
def default_model(pages: int = 400, seed: int = 7) -> Model:
    return train(labelled_pages(pages, seed))


def main_text(html: str | None, model: Model) -> str:
    """Texts of main blocks in page order, joined by one blank; empty if there are none."""
    if not html:
        return ""
    t = parse(html)
    p = marginals(t, model)
    return " ".join(text for k, text, _ in t.runs if p[k] > 0.5)


def extract(pages: DataFrame, model: Model | None = None, html: str = "html", into: str = "text") -> DataFrame:
    """``pages`` with the main text of each; a column of that name is replaced. Null and empty pages, and pages without main
    text, have an empty text."""
    model = model or default_model()
    given = pages.select(*[F.col(f"`{c}`") for c in pages.columns if c != into])

    def run(batches):
        for b in batches:
            texts = [main_text(h, model) for h in b.column(html).to_pylist()]
            yield b.append_column(into, pa.array(texts, pa.string()))

    return given.mapInArrow(run, StructType([*given.schema.fields, StructField(into, StringType())]))


def extraction_report(pages: DataFrame) -> DataFrame:
    """The digest per page."""
    out = extract(pages.select("page_id", "url", "html"))
    return out.select("page_id", "url", "text", F.char_length("text").cast("bigint").alias("n_chars"))
