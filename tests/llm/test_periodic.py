"""Runs against a brute-force search over all periods."""

import hashlib
import re
import zlib

import numpy as np
from pyspark.sql import functions as F

from capindex.llm.periodic import find_runs, run_report, runs_of


def brute(w):
    out = []
    for q in range(1, len(w) // 4 + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            size = j - i + q
            if j > i and size >= max(6, 4 * q) and not any(all(w[k] == w[k + d] for k in range(i, i + size - d)) for d in range(1, q)):
                out.append((i, size, q))
            i = j + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def words_of(text, doc=None):
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", text or "") if x]
    h, n = zlib.crc32(str(doc).encode()), len(w)
    if doc is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    return w


def expected(doc, text):
    w = words_of(text, doc)
    code = {}
    runs = brute([code.setdefault(x, len(code)) for x in w])
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    kept = " ".join(x for i, x in enumerate(w) if i not in gone)
    best = min(runs, key=lambda r: (-r[1] / r[2], r[0], r[2]), default=(None, None, None))
    return (doc, len(runs), *best, 1000 * best[1] // best[2] if runs else None,
            hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in runs).encode()).hexdigest(), hashlib.sha256(kept.encode()).hexdigest())


def test_random_periods_equal_brute_force():
    rng = np.random.default_rng(5)
    for _ in range(250):
        w = []
        while len(w) < rng.integers(1, 400):
            p = int(rng.choice([1, 2, 3, 5, 7, 8, 9, 12, 15, 16, 17, 20, 31, 32, 33, 40]))
            unit = rng.integers(0, int(rng.integers(1, 4)), p).tolist()
            w += [unit[i % p] for i in range(int(rng.integers(p, 6 * p)))] + rng.integers(0, 3, int(rng.integers(0, 6))).tolist()
        assert [tuple(r) for r in runs_of(np.array([*w, -1]), len(w)).tolist()] == brute(w)


def test_long_periods_and_fractional_ends():
    unit = np.random.default_rng(1).integers(0, 50, 5_000).tolist()
    for p in (127, 128, 129, 1000, 4999):
        w = [-2, -3, *[unit[i % p] for i in range(4 * p + 3)], -4]
        assert runs_of(np.array([*w, -1]), len(w)).tolist() == [[2, 4 * p + 3, p]]
        assert not len(runs_of(np.array([unit[i % p] for i in range(4 * p - 1)] + [-1]), 4 * p - 1))


def test_report_equals_brute_force(spark, small_docs):
    rows = [(r.doc_id, r.text) for r in small_docs.select("doc_id", "text").collect() if len(r.text or "") < 6000]
    rows += [(-1, None), (-2, ""), (-3, " \t\n"), (-4, "a " * 40), (-4, "a " * 40), (-5, "x y x y x y x y z z z z z z"), (-6, "é\u00a0é " * 9 + "\u2003" * 8), (None, "q " * 12)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert sorted(map(tuple, run_report(df).collect()), key=str) == sorted((expected(*r) for r in rows), key=str)


def test_collapsed_texts_and_other_keys(spark):
    df = spark.createDataFrame([("k", "so so so so so so it is, it is, it is, it is, done", 1)], "id string, body string, runs int")
    r = find_runs(df, "id", "body").first()
    assert (r.id, r.collapsed, [tuple(x) for x in r.runs]) == ("k", "so it is, done", [(0, 6, 1), (6, 8, 2)])


def test_clashing_columns_and_empty_table(spark, small_docs):
    some = small_docs.limit(30)
    more = some.select("*", *[F.lit(1).alias(c) for c in ("key", "runs", "collapsed", "start", "length", "period", "b", "words")])
    assert sorted(map(tuple, run_report(more).collect())) == sorted(map(tuple, run_report(some).collect()))
    assert run_report(small_docs.limit(0)).count() == 0


def test_a_very_long_text(spark):
    text = " ".join(str(i % 90_001) for i in range(400_000)) + " end" + " tail" * 100_000
    r = find_runs(spark.createDataFrame([(1, text)], "doc_id bigint, text string")).first()
    assert [tuple(x) for x in r.runs] == [(0, 400_000, 90_001), (400_001, 100_000, 1)]
