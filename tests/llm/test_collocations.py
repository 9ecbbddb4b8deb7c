"""Phrase counts against plain counting, the quicksort alone, hot pairs, and exact scores."""

import random
import re
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from capindex.llm import collocations
from capindex.llm.collocations import multikey_counts, phrase_counts, phrase_report, score_phrases, top_phrases, without_parts


def plain_counts(rows, least):
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        text = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", text):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, 5):
                f.update((lang, " ".join(w[i : i + k])) for i in range(len(w) - k + 1))
    return {k: a for k, a in f.items() if a >= least}, {k: a for k, a in n.items() if a}


def plain_top(rows, least=30, top=2000):
    f, n = plain_counts(rows, least)
    out = []
    for (lang, phrase), a in f.items():
        w = phrase.split(" ")
        if len(w) < 2:
            continue
        cuts = [(f[lang, " ".join(w[:k])], f[lang, " ".join(w[k:])]) for k in range(1, len(w))]
        cut = min(cuts, key=lambda c: 2000000 * a // sum(c))
        holds = [b for (of, p), b in f.items() if of == lang and p != phrase and f" {phrase} " in f" {p} "]
        if not any(100 * b >= 80 * a for b in holds):
            out.append((lang, phrase, a, *cut, n[lang], 2000000 * a // sum(cut)))
    out.sort(key=lambda r: (r[0], -r[6], -r[2], r[1].encode()))
    ranked, seen = [], Counter()
    for r in out:
        seen[r[0]] += 1
        if seen[r[0]] <= top:
            ranked.append((r[0], seen[r[0]], *r[1:]))
    return ranked


def frame(spark, rows):
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "doc_id bigint, lang string, text string")


def made(seed, n=300, vocabulary=40):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(vocabulary)] + ["Ä", "é", "the", "THE", "日本", "a\u00a0b", "\x01"]
    sets = ["as soon as possible", "in spite of", "New York", "the the the the"]

    def text():
        parts = [rng.choice(sets) if rng.random() < 0.3 else rng.choice(words) for _ in range(rng.randrange(60))]
        return "".join(p + rng.choice([" ", " ", "  ", "\t", ". ", ",", "\n", " \r\n", "\x0b", ";"]) for p in parts)

    return [(rng.choice(["en", "en", "de", None]), text()) for _ in range(n)]


def test_counts_and_ranks_equal_plain_counting(spark):
    rows = [*made(1), ("en", None), ("en", ""), ("xx", " .,; "), (None, "only once"), ("", "w1 w2 " * 40)]
    phrases, totals = phrase_counts(frame(spark, rows))
    f, n = plain_counts(rows, 30)
    assert {(r.lang, r.phrase): r.a for r in phrases.collect()} == f
    assert {r.lang: r.n for r in totals.collect()} == n
    got = sorted(tuple(r) for r in phrase_report(frame(spark, rows)).collect())
    assert got == sorted(plain_top(rows)) and len(got) >= 20


def test_hot_pairs_and_small_chunks_change_nothing(spark, monkeypatch):
    rows = made(2, 200) + [("en", f"in spite of w{i % 7} w{i % 5}") for i in range(300)]
    want = sorted(plain_top(rows))
    monkeypatch.setattr(collocations, "HOT_LEAST", 40)
    monkeypatch.setattr(collocations, "CHUNK_BYTES", 400)
    monkeypatch.setattr(collocations, "CHUNK_ROWS", 50)
    assert sorted(tuple(r) for r in phrase_report(frame(spark, rows).repartition(7)).collect()) == want


def test_quicksort_counts_prefixes():
    rng = np.random.default_rng(0)
    for n in (0, 1, 5, 3000):
        keys = rng.integers(0, 6, (n, 4))
        for k in range(1, 4):
            keys[rng.random(n) < 0.1, k:] = -1
        weight = rng.integers(1, 5, n)
        want = Counter()
        for key, w in zip(keys.tolist(), weight.tolist(), strict=True):
            for k in range(1, 5):
                if key[k - 1] >= 0:
                    want[tuple(key[:k])] += w
        row, size, count = multikey_counts(keys, weight, 12, 2)
        got = {tuple(keys[r, :k].tolist()): c for r, k, c in zip(row.tolist(), size.tolist(), count.tolist(), strict=True)}
        assert got == {p: c for p, c in want.items() if c >= 12 and len(p) >= 2}


def test_scores_beyond_64_bits_and_ties(spark):
    big = 9_000_000_000_000_000
    rows = [("en", "x", 1, big), ("en", "y", 1, big + 1), ("en", "x y", 2, big - 1), ("en", "z", 1, big), ("en", "y z", 2, big - 1), ("en", "x y z", 3, big - 2)]
    got = {r.phrase: r for r in score_phrases(spark.createDataFrame(rows, "lang string, phrase string, words int, a bigint"),
                                              spark.createDataFrame([("en", big)], "lang string, n bigint")).collect()}
    assert got["x y"].score == 2000000 * (big - 1) // (2 * big + 1)
    assert (got["x y z"].l, got["x y z"].r) == (big, big - 1)  # both cuts score alike: the first stays
    assert {r.phrase for r in without_parts(spark.createDataFrame(list(got.values()))).collect()} == {"x y z"}


def test_top_is_cut_by_rank_and_ties_by_bytes(spark):
    rows = [("en", f"{w}1 {w}2. " * 30) for w in ("b", "a", "é", "z", "\U0001f600")]
    got = [(r.rank, r.phrase) for r in top_phrases(frame(spark, rows), top=4).orderBy("rank").collect()]
    assert got == [(1, "a1 a2"), (2, "b1 b2"), (3, "z1 z2"), (4, "é1 é2")]


def test_empty_table_and_clashing_columns(spark):
    assert phrase_report(frame(spark, [])).count() == 0
    assert phrase_report(frame(spark, [(None, None), ("en", "")])).count() == 0
    df = frame(spark, made(3, 120))
    more = df.select("*", *[F.lit(2).alias(c) for c in ("word", "route", "k", "phrase", "a", "n", "rank", "words")])
    assert sorted(map(tuple, phrase_report(more).collect())) == sorted(map(tuple, phrase_report(df).collect()))


def test_a_long_text_in_one_piece(spark):
    rows = [("en", "one two three four five " * 60_000)]
    assert sorted(map(tuple, phrase_report(frame(spark, rows)).collect())) == sorted(plain_top(rows))
