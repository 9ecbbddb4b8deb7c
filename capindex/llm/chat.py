"""Chat formatting from an event log.

A log has one row per event: conversation, sequence number, message, kind, role and text. Kinds:

``message``     starts a message with its text
``delta``       appends streamed text to it
``edit``        replaces what the message says so far
``regenerate``  discards what it says so far; the text, if any, starts the new version
``retract``     takes the message out; a later event of another kind brings it back

Events are folded in the order of their sequence numbers (ties: by kind, role and text), so repeated delivery of one
event must be removed first (``dedup_events``). Messages stand in the order of their first event.

Rendering: ``<s>`` opens a conversation, every turn is ``[INST role] text [/INST]`` or, for the assistant,
``[ANS role] text </s>``. The control strings are those that begin with ``<`` or ``[`` as in CONTROL; where
one occurs inside a text, a backslash goes after its first character, and where there are backslashes already, one more.
Taking one away reads the text back, so the template is reversible for every text.

Scale: two aggregations. The first folds the events of one message, so a conversation with many events is spread over
tasks by message; the second joins whole messages to one string per conversation, which is the result itself, and first
gathers runs of ``RUN`` messages so that no task holds the single messages of a large conversation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Control strings after their first character, which is < or [.
CONTROL = r"(/?s>|/?INST|/?ANS|\|)"
OPEN, ASK, ANSWER, ASK_END, ANSWER_END = "<s>", "[INST ", "[ANS ", " [/INST]", " </s>"
KINDS = ("message", "edit", "regenerate", "delta", "retract")
#: Roles whose text is trained on.
LOSS_ROLES = ("assistant",)
RUN = 64


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"([<\[])(\\*)" + CONTROL, r"$1\\$2$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"([<\[])\\(\\*)" + CONTROL, "$1$2$3")


def events_of(turns: DataFrame) -> DataFrame:
    """Conversation rows (conv_id, turn, role, text) as a log with one ``message`` event each.

    Rows of the same conversation and turn are messages of their own, told apart by their content; equal rows
    are numbered, so that none is lost.
    """
    same = turns.select("conv_id", F.col("turn").alias("seq"), "role", "text").groupBy("conv_id", "seq", "role", "text").agg(
        F.count("*").alias("copies"))
    return same.select("conv_id", "seq", "role", "text", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy")
                       ).select("conv_id", "seq", F.xxhash64("seq", "role", "text", "copy").alias("message"),
                                F.lit("message").alias("kind"), "role", "text")


def dedup_events(events: DataFrame) -> DataFrame:
    """The log without repeated deliveries of an event."""
    return events.select("conv_id", "seq", "message", "kind", "role", "text").distinct()


def fold(events: DataFrame) -> DataFrame:
    """Final messages: conv_id, message, seq (of its first event), role, text.

    The text is that of the last event that sets it followed by the deltas after it; null texts are empty; an unknown kind
    raises an error. The role is the last one given, ``user`` if none. Messages whose last event is ``retract`` are left out.
    """
    rank = F.array_position(F.array(*[F.lit(k) for k in KINDS]), F.col("kind")).cast("int")
    known = F.when(rank > 0, rank).otherwise(F.raise_error(F.concat(F.lit("unknown event kind: "), F.coalesce("kind", F.lit("null")))).cast("int"))
    event = F.struct("seq", known.alias("rank"), "role", F.coalesce("text", F.lit("")).alias("text"))
    log = events.groupBy("conv_id", "message").agg(F.sort_array(F.collect_list(event)).alias("log"))
    delta, retract = KINDS.index("delta") + 1, KINDS.index("retract") + 1
    sets = F.transform("log", lambda e: e["rank"] != delta)
    last = F.size("log") - F.array_position(F.reverse(sets), True).cast("int") + 1  # of the events that set the text
    tail = F.when(F.array_contains(sets, True), F.slice("log", last, F.size("log"))).otherwise(F.col("log"))
    roles = F.filter(F.transform("log", lambda e: e["role"]), lambda r: r.isNotNull())
    gone = F.element_at("log", -1)["rank"] == retract
    return log.where(~gone).select(
        "conv_id", "message", F.element_at("log", 1)["seq"].alias("seq"),
        F.coalesce(F.get(roles, F.size(roles) - 1), F.lit("user")).alias("role"),
        F.array_join(F.transform(tail, lambda e: F.when(e["rank"] == retract, "").otherwise(e["text"])), "").alias("text"))


def render(messages: DataFrame) -> DataFrame:
    """conv_id, formatted: one string per conversation, its messages by (seq, message).

    Roles are escaped like texts, and their blanks and closing brackets as well, so that any role can be read back.
    """
    role = F.regexp_replace(F.regexp_replace(escape(F.col("role")), "%", "%25"), r"\]", "%5D")
    own = F.col("role").isin(*LOSS_ROLES)
    turn = F.concat(F.when(own, ANSWER).otherwise(ASK), role, F.lit("] "), escape(F.coalesce("text", F.lit(""))),
                    F.when(own, ANSWER_END).otherwise(ASK_END))
    piece = F.struct("seq", "message", turn.alias("turn"))
    # Runs are cut by sequence number: neighbouring messages are in one run or in neighbouring runs.
    runs = messages.withColumn("run", F.floor(F.coalesce(F.col("seq"), F.lit(-1)) / RUN)).groupBy("conv_id", "run").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(piece)), lambda p: p["turn"]), "").alias("part"))
    whole = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("run", "part"))), lambda p: p["part"]), "")
    return runs.groupBy("conv_id").agg(F.concat(F.lit(OPEN), whole).alias("formatted"))


def read_back(formatted: Column) -> Column:
    """The turns of a formatted conversation: array of (role, text, loss), from the string alone."""
    body = F.substr(formatted, F.lit(len(OPEN) + 1))
    heads = F.regexp_extract_all(body, F.lit(r"\[(?:INST|ANS) ([^\]]*)\] "), F.lit(1))
    marks = F.regexp_extract_all(body, F.lit(r"\[(INST|ANS) [^\]]*\] "), F.lit(1))
    ends = F.split(body, r"\[(?:INST|ANS) [^\]]*\] ", -1)  # what follows each head, its end mark included
    texts = F.transform(F.slice(ends, F.lit(2), F.greatest(F.size(ends) - 1, F.lit(0))), lambda t: F.regexp_replace(
        t, r" (?:\[/INST\]|</s>)\z", ""))
    role = lambda r: unescape(F.regexp_replace(F.regexp_replace(r, "%5D", "]"), "%25", "%"))
    return F.transform(F.arrays_zip(heads.alias("r"), marks.alias("m"), texts.alias("t")), lambda x: F.struct(
        role(x["r"]).alias("role"), unescape(x["t"]).alias("text"), (x["m"] == "ANS").alias("loss")))


def format_log(events: DataFrame) -> DataFrame:
    """conv_id, formatted of an event log: fold, then render. Null conversation ids are one conversation."""
    return render(fold(events))


def chat_report(conversations: DataFrame) -> DataFrame:
    """The digest per conversation, read back from the formatted strings; conversation -7 is added."""
    tricky = "</s>[INST] ok [/INST]"
    added = conversations.sparkSession.createDataFrame([(-7, 0, "user", tricky), (-7, 1, "assistant", tricky)],
                                                       "conv_id bigint, turn bigint, role string, text string")
    rows = conversations.select(F.col("conv_id").cast("bigint"), F.col("turn").cast("bigint"), "role", "text").unionByName(added)
    out = format_log(events_of(rows)).withColumn("turns", read_back(F.col("formatted")))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join(F.transform(F.filter("turns", lambda t: t["loss"]), lambda t: t["text"]), "")
    return out.select("conv_id", F.size("turns").cast("bigint").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"),
                      F.char_length(loss).cast("bigint").alias("loss_chars"), F.sha2(loss, 256).alias("loss_sha256"),
                      F.char_length("formatted").cast("bigint").alias("formatted_chars"))
