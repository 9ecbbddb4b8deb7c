import random

import numpy as np
import pytest

from capindex.llm import jaccard
from capindex.llm.components import components
from capindex.llm.jaccard import jaccard_classes, jaccard_links, jaccard_report, one_of_each


def grams(t):
    w = (t or "").encode().lower().split()
    return {tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute(docs):
    """Component of each row by its place, and the sizes of the sets."""
    sets = [grams(t) for _, t in docs]
    at = list(range(len(docs)))

    def find(x):
        while at[x] != x:
            x = at[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if a and sets[j] and 100 * both >= 80 * (len(a) + len(sets[j]) - both):
                at[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(docs):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return [(d, len(s), least.get(find(i))) for i, ((d, _), s) in enumerate(zip(docs, sets))]


def make(seed, n=160):
    r = random.Random(seed)
    word = lambda: f"w{r.randint(0, 400)}"
    docs, passage = [], [word() for _ in range(30)]
    bases = [[word() for _ in range(r.choice([3, 6, 20, 60, 140]))] for _ in range(12)]
    for i in range(n):
        k = r.random()
        w = list(r.choice(bases)) if k < 0.7 else [word() for _ in range(r.randint(0, 80))]
        for _ in range(r.choice([0, 0, 1, 1, 2, 3, 6])):
            if w:
                w[r.randrange(len(w))] = word()
        if r.random() < 0.2:
            w += passage
        docs.append((i, " ".join(w)))
    return docs + [(1000, None), (1001, ""), (1002, " \n"), (5, docs[7][1]), (None, docs[3][1]), (None, "only here"), (8, docs[8][1]), (8, docs[8][1])]


@pytest.mark.parametrize("block,frequent", [(4096, 16), (5, 2)])
def test_equals_brute_force(spark, monkeypatch, block, frequent):
    monkeypatch.setattr(jaccard, "BLOCK", block)
    monkeypatch.setattr(jaccard, "FREQUENT", frequent)
    docs = make(block)
    got = jaccard_report(spark.createDataFrame(docs, "doc_id bigint, text string")).collect()
    key = lambda x: tuple((v is None, v or 0) for v in x)
    assert sorted([(r.doc_id, r.n_shingles, r.component_id) for r in got], key=key) == sorted(brute(docs), key=key)


@pytest.mark.parametrize("block,frequent", [(4096, 16), (5, 2)])
def test_links_equal_brute_force(spark, monkeypatch, block, frequent):
    monkeypatch.setattr(jaccard, "BLOCK", block)
    monkeypatch.setattr(jaccard, "FREQUENT", frequent)
    docs = make(block + 1)
    sets = [grams(t) for _, t in docs]
    links = [sum(i != j and bool(a and b) and 100 * len(a & b) >= 80 * len(a | b) for j, b in enumerate(sets)) for i, a in enumerate(sets)]
    want = [(d, len(s), n) for (d, _), s, n in zip(docs, sets, links)]
    got = jaccard_links(spark.createDataFrame(docs, "doc_id bigint, text string")).collect()
    key = lambda x: tuple((v is None, v or 0) for v in x)
    assert sorted([(r.doc_id, r.n_shingles, r.n_links) for r in got], key=key) == sorted(want, key=key) and max(links) > 5


def test_only_the_least_of_a_group_stays(spark):
    docs = [(i, f"{i % 3} same words in every text of this group " * 3) for i in range(9)] + [(50, None), (51, ""), (4, "1 stands alone")]
    df = spark.createDataFrame(docs, "doc_id bigint, text string").selectExpr("doc_id", "text", "7 as component_id", "'h' as text_hash")
    out = one_of_each(df)
    assert out.columns == df.columns
    assert sorted((r.doc_id, (r.text or "")[:3]) for r in out.collect()) == [
        (0, "0 s"), (1, "1 s"), (2, "2 s"), (4, "1 s"), (50, ""), (51, "")]


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id bigint, text string")
    assert jaccard_classes(df).count() == 0 and one_of_each(df).count() == 0


def test_bounds_never_rule_out_a_link():
    r = np.random.RandomState(1)
    for n in (8, 70, 500):
        for _ in range(60):
            x = np.unique(r.randint(0, 2**62, n).astype(np.uint64))
            drop = r.randint(0, max(1, n // 5))
            y = np.unique(np.concatenate([x[drop:], r.randint(0, 2**62, r.randint(0, n // 6 + 1)).astype(np.uint64)]))
            both = len(np.intersect1d(x, y))
            if 100 * both >= 80 * (len(x) + len(y) - both):
                sizes = np.array([len(x), len(y)])
                assert jaccard._bounded(np.array([0]), np.array([1]), sizes, [jaccard.signature(x), jaccard.signature(y)])[0]


def test_components(spark):
    edges = [(1, 2), (2, 3), (10, 9), (9, 8), (8, 7), (7, 6), (20, 20)] + [(100 + i, 101 + i) for i in range(40)] + [(300, 400 + i) for i in range(50)]
    got = {r.node: r.label for r in components(spark.createDataFrame(edges, "a bigint, b bigint"), "a", "b").collect()}
    assert [got[k] for k in (1, 2, 3, 6, 10)] == [1, 1, 1, 6, 6] and 20 not in got
    assert {got[k] for k in range(100, 141)} == {100} and {got[k] for k in range(400, 450)} == {300}
    assert components(spark.createDataFrame([], "a bigint, b bigint"), "a", "b").count() == 0
