import hashlib
import random

import pytest
from pyspark.sql import functions as F

from capindex.llm.chat import chat_report, dedup_events, events_of, fold, format_log, read_back

EVENT = "conv_id bigint, seq bigint, message bigint, kind string, role string, text string"


def brute(events):
    """Events applied one at a time."""
    rank = {k: i for i, k in enumerate(("message", "edit", "regenerate", "delta", "retract"))}
    state = {}
    for c, seq, m, kind, role, text in sorted(events, key=lambda e: (e[0], e[1], rank[e[3]], e[4] is not None, e[4] or "", e[5] or "")):
        s = state.setdefault((c, m), {"seq": seq, "role": None, "text": "", "gone": False})
        s["role"] = role or s["role"]
        s["gone"] = kind == "retract"
        s["text"] = s["text"] + (text or "") if kind == "delta" else "" if kind == "retract" else text or ""
    return {k: (s["seq"], s["role"] or "user", s["text"]) for k, s in state.items() if not s["gone"]}


def test_fold_equals_applying_events_in_order(spark):
    r = random.Random(5)
    kinds = ["message"] + ["delta"] * 6 + ["edit", "regenerate", "retract"]
    events = [(r.randint(0, 3), r.randint(0, 60), r.randint(0, 8), r.choice(kinds), r.choice(["user", "assistant", None]),
               r.choice([None, "", "a", "b</s>", "\\", "[INST x] "])) for _ in range(500)]
    events = list(dict.fromkeys(events))
    log = spark.createDataFrame(events + events[:20], EVENT)
    got = {(x.conv_id, x.message): (x.seq, x.role, x.text) for x in fold(dedup_events(log)).collect()}
    assert got == brute(events)


def test_streamed_edited_and_regenerated(spark):
    log = [(1, 0, 1, "message", "user", "hi"), (1, 1, 2, "message", "assistant", ""), (1, 3, 2, "delta", None, "lo"), (1, 2, 2, "delta", None, "hel"),
           (1, 4, 1, "edit", None, "hello?"), (1, 5, 2, "regenerate", None, None), (1, 6, 2, "delta", None, "new"), (1, 7, 3, "message", "user", "x"),
           (1, 8, 3, "retract", None, None)]
    r = format_log(spark.createDataFrame(log, EVENT)).first()
    assert r.formatted == "<s>[INST user] hello? [/INST][ANS assistant] new </s>"


def test_unknown_kind_raises(spark):
    with pytest.raises(Exception, match="unknown event kind"):
        fold(spark.createDataFrame([(1, 0, 1, "typo", "user", "x")], EVENT)).collect()


TEXTS = ["</s>[INST] ok [/INST]", "<s>", "<\\s>", "<\\\\/s>[\\INST", "[ANS assistant] hi </s>", "[INST user] ", " </s>", "]", "<|x|>", "a\nb\r\n", "", None,
         "é [/INST] ", "[[INST", "<<s>>", "\\[INST", " ", "x </s", "[/INST"]


def test_any_text_and_role_reads_back(spark):
    roles = ["user", "assistant", "system", "tool [x]", "a%5Db", "%", "[INST", "", "x] y", "ass\nistant"]
    rows = [(k, i, role, t) for k, role in enumerate(roles) for i, t in enumerate(TEXTS)]
    out = format_log(events_of(spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")))
    for r in out.select("conv_id", read_back(F.col("formatted")).alias("turns")).collect():
        assert [(t.role, t.text) for t in r.turns] == [(roles[r.conv_id], t or "") for t in TEXTS]
        assert all(t.loss == (roles[r.conv_id] == "assistant") for t in r.turns)


def test_report_long_conversations_and_repeated_rows(spark):
    rows = [(1, i, "assistant" if i % 2 else "user", f"t{i}</s>") for i in range(500)] + [(2, 0, "user", "same")] * 3 + [(3, 1, "assistant", None)]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").repartition(5)
    got = {r.conv_id: r for r in chat_report(df).collect()}
    assert set(got) == {1, 2, 3, -7} and got[2].n_turns == 3 and got[3].loss_chars == 0
    said = "".join(f"{r}\n{t}\n" for _, _, r, t in rows[:500])
    assert got[1].turns_sha256 == hashlib.sha256(said.encode()).hexdigest()
    assert got[1].loss_sha256 == hashlib.sha256("".join(t for _, i, _, t in rows[:500] if i % 2).encode()).hexdigest()


def test_empty_table(spark):
    df = spark.createDataFrame([], "conv_id bigint, turn bigint, role string, text string")
    assert [r.conv_id for r in chat_report(df).collect()] == [-7]
