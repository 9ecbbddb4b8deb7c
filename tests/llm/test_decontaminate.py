import random
import re

from capindex.llm.decontaminate import contamination, contamination_report, decontaminated

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = {i: i + 32 for i in range(65, 91)}


def words(t):
    return WORD.findall((t or "").translate(LOWER))


def brute(text, items):
    w, hit, ids = words(text), set(), set()
    for item, t in items:
        v = words(t)
        k = min(10, len(v))
        windows = {tuple(v[i:i + k]) for i in range(len(v) - k + 1)} if v else set()
        for i in range(len(w) - k + 1):
            if k and tuple(w[i:i + k]) in windows:
                hit.update(range(i, i + k))
                ids.add(item)
    return len(w), len(hit), sorted(map(str, ids))


def test_equals_brute_force(spark):
    r = random.Random(3)
    vocabulary = ["alpha", "Beta", "gam", "été", "É", "x1", "the", "the", "the", "日本"]
    text = lambda n: " ".join(r.choice(vocabulary) for _ in range(n))
    items = [(i, text(r.choice([0, 1, 3, 7, 9, 10, 11, 14, 30]))) for i in range(25)] + [(99, None), (5, "one two three"), (100, "the " * 30)]
    docs = []
    for i in range(120):
        parts = [text(r.randint(0, 40))]
        if r.random() < 0.6:
            v = (r.choice(items)[1] or "").split()
            at = r.randint(0, max(0, len(v) - 8))
            parts += [" ".join(v[at:at + r.randint(5, 40)]), text(5)]
        docs.append((i, "; ".join(parts)))
    docs += [(500, None), (501, ""), (502, "the " * 500), (503, docs[0][1]), (503, docs[0][1]), (None, docs[1][1])]
    d = spark.createDataFrame(docs, "doc_id bigint, text string")
    b = spark.createDataFrame(items, "item_id bigint, text string")
    got = contamination(d, b).collect()
    assert len(got) == len(docs)
    want = [(i, *brute(t, items)) for i, t in docs]
    key = lambda x: (x[0] is None, x[0] or 0, x[1:])
    assert sorted([(r.doc_id, r.n_words, r.n_hit, r.items) for r in got], key=key) == sorted(want, key=key)
    clean = decontaminated(d.selectExpr("*", "1 as n_hit", "'x' as text_key"), b)
    assert sorted(r.text or "" for r in clean.collect()) == sorted(t or "" for (i, t), w in zip(docs, want) if not w[2])
    assert clean.columns == ["doc_id", "text", "n_hit", "text_key"]


def test_empty_tables(spark):
    d = spark.createDataFrame([(1, "a b c")], "doc_id bigint, text string")
    none = spark.createDataFrame([], "item_id bigint, text string")
    assert contamination_report(d, none).first().contaminated is False
    assert contamination_report(d.where("false"), none).count() == 0
    assert decontaminated(d, none).count() == 1
