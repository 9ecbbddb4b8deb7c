import itertools
import random
import re
from collections import Counter

import numpy as np

from capindex.llm.quality import CONSISTENCY, FLOORS, UNIT, Z, good, judge, mcd, quality_report, text_statistics

WORDS = "the of and to in is was that with from ration lemon garden window paper summer winter stone".split()


def prose(r, n):
    return " ".join(r.choice(WORDS) + str(r.randint(0, 99)) if r.random() < 0.05 else r.choice(WORDS) + r.choice("aeiou") * r.randint(0, 1)
                    for _ in range(n)) + "."


def brute(t):
    t = t or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    count, covered = Counter(tuple(w[i:i + 5]) for i in range(len(w) - 4)), set()
    for i in range(len(w) - 4):
        if count[tuple(w[i:i + 5])] > 1:
            covered.update(range(i, i + 5))
    seen, dup = set(), 0
    for line in t.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(covered)


def test_statistics_equal_brute_force(spark, small_docs):
    cases = ["", None, " \t\n", "a b c d e a b c d e", "x " * 40, "a\nb\na\n\n\nb \nb", "é#ü |<>", "a\x0bb\x0cc\rd", "w " * 4, "one two three four five"]
    rows = list(enumerate(cases)) + [(100 + r.doc_id, r.text) for r in small_docs.collect()]
    got = text_statistics(spark.createDataFrame(rows, "id bigint, text string")).collect()
    for r in got:
        want = brute(dict(rows)[r.id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (want[0] < 10 or 100 * want[4] > 20 * want[0])


def test_outliers_go_and_clean_texts_stay(docs_of):
    r = random.Random(1)
    rows = [(i, prose(r, r.randint(30, 300)), r.choice(["en", "de", None]), "hot" if r.random() < 0.4 else f"s{i % 9}") for i in range(900)]
    junk = [(2000 + i, " ".join(w + "###" for w in prose(r, 60).split()), "en", "hot") for i in range(30)]
    loud = [(3000 + i, " ".join(w + "!!" for w in prose(r, 60).upper().split()), "en", None) for i in range(30)]
    out = {x.doc_id: x.kept for x in judge(docs_of(rows + junk + loud + junk[:1])).collect()}
    assert len(out) == 960
    assert not any(out[i] for i in out if i >= 2000)
    assert sum(not out[i] for i in range(900)) <= 5


def test_same_verdict_whatever_the_partitions(small_docs):
    one = {x.doc_id: (x.kept, x.distance) for x in quality_report(small_docs).collect()}
    two = {x.doc_id: (x.kept, x.distance) for x in quality_report(small_docs.repartition(7)).collect()}
    assert one == two and any(k for k, _ in one.values()) and not all(k for k, _ in one.values())


def test_small_and_empty_tables(docs_of):
    assert judge(docs_of([])).count() == 0
    few = {r.doc_id: (r.kept, r.base_failed) for r in judge(docs_of([(1, prose(random.Random(2), 50), None, None), (2, None), (3, "")])).collect()}
    assert few == {1: (True, False), 2: (False, True), 3: (False, True)}


def vectors(spark, groups):
    rows = [(lang, source, *[int(v) for v in np.rint(x * UNIT)]) for lang, source, points in groups for x in points]
    return spark.createDataFrame(rows, "__q_lang string, __q_source string, " + ", ".join(f"{z} bigint" for z in Z))


def log_det(points, weights):
    w = weights / weights.sum()
    d = points - w @ points
    return float(np.linalg.slogdet((d * w[:, None]).T @ d * CONSISTENCY + np.diag(np.square(FLOORS)))[1])


def test_least_determinant_of_small_groups(spark):
    """Against all subsets of the share: the determinant found is no worse than a little above the least."""
    r = np.random.default_rng(4)
    groups = []
    for k in range(8):
        points = r.normal(0, 1, (16, len(Z))) @ np.diag(r.uniform(0.2, 2, len(Z)))
        points[: k % 4] += r.uniform(4, 8, len(Z))
        groups.append(("=x", f"={k}", np.rint(points * UNIT) / UNIT))
    found = {x["__q_source"]: x for x in mcd(vectors(spark, groups)).collect()}
    for k, (_, source, points) in enumerate(groups):
        least = min(log_det(points[list(c)], np.ones(12)) for c in itertools.combinations(range(16), 12))
        got = found[source]
        assert got.n == 16 and least - 0.3 <= got.log_det <= least + 1.0, (source, got.log_det, least)
        cov = np.array([[got[f"c_{min(i, j)}_{max(i, j)}"] for j in range(len(Z))] for i in range(len(Z))])
        assert abs(np.linalg.slogdet(cov)[1] - got.log_det) < 1e-6
        if 0 < k % 4:  # points far off take no part in the centre
            clean = points[k % 4 :]
            assert np.linalg.norm([got[f"m_{i}"] for i in range(len(Z))] - clean.mean(0)) < np.linalg.norm(points.mean(0) - clean.mean(0))


def test_every_small_group_is_judged(docs_of):
    """Sources of one document each, and languages of a few: outliers go there too."""
    r = random.Random(8)
    rows = [(i, prose(r, r.randint(30, 300)), f"l{i % 12}", f"own{i}") for i in range(240)]
    odd = [(1000 + i, " ".join(w.upper() + "!!" for w in prose(r, 60).split()), f"l{i}", f"odd{i}") for i in range(12)]
    out = {x.doc_id: (x.kept, x.distance) for x in judge(docs_of(rows + odd)).collect()}
    assert all(d is not None for _, d in out.values())
    assert not any(out[i][0] for i in out if i >= 1000)
    assert sum(not out[i][0] for i in range(240)) <= 4


def test_clashing_columns(docs_of):
    r = random.Random(3)
    df = docs_of([(i, prose(r, 50)) for i in range(40)] + [(99, None)])
    more = ["pool_n", "m_0", "g_lang", "n_words", "kept", "distance", "start", "n", "all", "bin", "c_0_0", "i_0_0", "up", "log_det"]
    wide = df.selectExpr("*", *[f"concat('{c}', doc_id) as {c}" for c in more])
    a = {x.doc_id: x.kept for x in judge(df).collect()}
    got = judge(wide)
    assert {x.doc_id: x.kept for x in got.collect()} == a
    assert got.where("kept").select("pool_n", "m_0", "g_lang", "n").first()[2].startswith("g_lang")
    back = good(wide)
    assert back.columns == wide.columns
    assert {x.doc_id: x.n_words for x in back.collect()} == {i: f"n_words{i}" for i, k in a.items() if k}
