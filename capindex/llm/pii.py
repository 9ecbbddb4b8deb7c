"""PII spans: regular expressions propose, checksums confirm, nearby context words adjust the score.

Everything is built-in column expressions on one row, without a shuffle. Each kind is one pass of
``regexp_extract_all``; texts with a match are also ``split`` by the same pattern, and the running length of
gaps and matches gives the positions (code points, end exclusive). Matches are folded in blocks of ``BLOCK``, whose spans
count from the start of the block and are moved to their place when the blocks are put together: growing arrays are copied
inside a block only, and a text with a hundred thousand matches takes about a hundred times as long as one with a thousand.

Possessive quantifiers and look-behinds keep the patterns linear on long runs of word characters or digits;
they match exactly what the plain form of the pattern matches: none of the classes overlaps with what
follows it, and a leftmost match starts at the beginning of a run or at the end of the match before (\\G).
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from capindex.llm.common import text_or_empty

OCTET = r"0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
CONTEXT_CHARS = 48
#: Matches of a text that are folded together.
BLOCK = 64


def _digits(v: Column) -> Column:
    return F.regexp_replace(v, "[^0-9]", "")


def _card(v: Column) -> Column:
    d = _digits(v)
    return F.char_length(d).between(14, 19) & F.call_function("luhn_check", d)


def _mod97(v: Column) -> Column:
    """Remainder of an account number: first four characters moved to the end, letters as 10 to 35."""
    moved = F.concat(F.substr(v, F.lit(5)), F.substring(v, 1, 4))
    return F.aggregate(F.split(moved, "(?!^)(?!$)"), F.lit(0), lambda acc, c: F.when(
        c.rlike("[0-9]"), (acc * 10 + c.try_cast("int")) % 97).otherwise((acc * 100 + F.ascii(c) - 55) % 97))


def _iban(v: Column) -> Column:
    """The longest run of the candidate's blank-separated parts that passes mod 97, else null."""
    parts = F.split(v, " ")
    heads = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), " "))
    good = F.filter(heads, lambda h: F.char_length(F.translate(h, " ", "")).between(15, 34)
                    & (_mod97(F.translate(h, " ", "")) == 1))
    return F.when(F.size(good) > 0, F.element_at(good, -1))


@dataclass(frozen=True)
class Kind:
    """name; candidate pattern; a cheap test that texts without candidates fail; confirm: the confirmed value
    (a prefix of the candidate) or null; base: score of a confirmed span; context: words (Java regex) whose
    presence just before or after adds ``bonus``; least: spans that score lower are dropped."""

    name: str
    pattern: str
    hint: Callable[[Column], Column]
    confirm: Callable[[Column], Column]
    base: float
    context: str
    bonus: float = 0.25
    least: float = 0.0


#: The kinds in their listed order, the first four are the base kinds, whose spans always stay.
KINDS = (
    Kind("email", r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
         lambda t: t.contains("@"), lambda v: v, 0.7, r"\b(e-?mail|contact|write|courriel|correo|kontakt)\b"),
    Kind("ip", r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
         lambda t: t.contains("."), lambda v: F.when(v.rlike(rf"^{OCTET}(?:\.{OCTET}){{3}}$"), v), 0.6,
         r"\b(ip|host|server|address|adresse|ping)\b"),
    Kind("card", r"[0-9](?:[\x20-]?[0-9])++", lambda t: t.rlike(r"[0-9][\x20-]?[0-9]"), lambda v: F.when(_card(v), v),
         0.7, r"\b(card|visa|mastercard|credit|debit|karte|carte|tarjeta)\b"),
    Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda t: t.contains("+"),
         lambda v: F.when(F.char_length(_digits(v)).between(10, 15), v), 0.6,
         r"\b(call|phone|tel|mobile|fax|whatsapp|telefon|téléphone|teléfono)\b"),
    Kind("iban", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,38}(?![A-Za-z0-9])",
         lambda t: t.rlike("[A-Z]{2}[0-9]{2}"), _iban, 0.8, r"\b(iban|account|konto|compte|cuenta)\b", least=0.5),
    Kind("ssn", r"(?<![0-9-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])",
         lambda t: t.contains("-"), lambda v: v, 0.4, r"\b(ssn|social security|tax id)\b", least=0.5),
    Kind("secret", r"(?<![A-Za-z0-9_/+=-])[A-Za-z0-9_/+=-]{20,}+", lambda t: t.rlike("[=:]"),
         lambda v: F.when(v.rlike("[0-9]") & v.rlike("[A-Za-z]"), v), 0.4,
         r"(token|secret|passw(or)?d|api[_-]?key|bearer)\W{0,4}$", least=0.5),
)
BASE_KINDS = tuple(k.name for k in KINDS[:4])
SPAN = "array<struct<start:bigint,rank:int,kind:string,end:bigint,score:double>>"


def _spans(rank: int, kind: Kind, found: Column, gaps: Column) -> Column:
    """Confirmed spans of one kind. ``gaps[i]`` is the text before match i, so the context of a match is the end
    of the gap before it and the start of the gap after it: no position has to be searched again."""

    def step(acc: Column, i: Column) -> Column:
        value, before = F.get(found, i), F.get(gaps, i)
        start = acc["pos"] + F.char_length(before)
        good = kind.confirm(value)
        near = F.lower(F.right(before, F.lit(CONTEXT_CHARS))).rlike(kind.context) | F.lower(
            F.left(F.get(gaps, i + 1), F.lit(CONTEXT_CHARS))).rlike(kind.context.removesuffix("$"))
        span = F.struct(start.alias("start"), F.lit(rank).alias("rank"), F.lit(kind.name).alias("kind"),
                        (start + F.char_length(good)).alias("end"),
                        F.when(near, F.lit(min(1.0, kind.base + kind.bonus))).otherwise(F.lit(kind.base)).alias("score"))
        return F.struct(
            (start + F.char_length(value)).alias("pos"),
            F.concat(acc["out"], F.when(good.isNotNull(), F.array(span)).otherwise(F.array().cast(SPAN))).alias("out"))

    zero, n = F.lit(0).cast("bigint").alias("pos"), F.size(found)

    def block(b: Column) -> Column:
        return F.aggregate(F.sequence(b * BLOCK, F.least((b + 1) * BLOCK, n) - 1), F.struct(zero, F.array().cast(SPAN).alias("out")), step)

    def put(acc: Column, b: Column) -> Column:
        moved = F.transform(b["out"], lambda s: F.struct(
            (s["start"] + acc["pos"]).alias("start"), s["rank"].alias("rank"), s["kind"].alias("kind"),
            (s["end"] + acc["pos"]).alias("end"), s["score"].alias("score")))
        return F.struct((acc["pos"] + b["pos"]).alias("pos"), F.concat(acc["out"], F.array(moved)).alias("out"))

    blocks = F.transform(F.sequence(F.lit(0), F.floor((n - 1) / BLOCK).cast("int")), block)
    out = F.aggregate(blocks, F.struct(zero, F.array().cast(f"array<{SPAN}>").alias("out")), put, lambda acc: F.flatten(acc["out"]))
    if kind.least > 0:
        out = F.filter(out, lambda s: s["score"] >= kind.least)
    return F.when(F.size(found) > 0, out).otherwise(F.array().cast(SPAN))


def find_pii(df: DataFrame, text: str = "text", into: str = "pii") -> DataFrame:
    """``df`` with a column of spans (start, rank, kind, end, score), sorted by start and kind.

    Null and empty texts have an empty array. Rows are independent of each other: repeated rows get equal
    spans, an empty table stays empty, other columns pass through unchanged.
    """
    names = [f"__pii_{k.name}" for k in KINDS]
    none = F.array().cast("array<string>")
    body = "__pii_text"
    out = df.withColumn(body, text_or_empty(F.col(f"`{text}`")))
    out = out.withColumns({f"{n}_f": F.when(k.hint(F.col(body)), F.regexp_extract_all(F.col(body), F.lit(k.pattern), F.lit(0)))
                           .otherwise(none) for n, k in zip(names, KINDS, strict=True)})
    out = out.withColumns({f"{n}_g": F.when(F.size(f"{n}_f") > 0, F.split(F.col(body), k.pattern, -1)).otherwise(none)
                           for n, k in zip(names, KINDS, strict=True)})
    spans = [_spans(i, k, F.col(f"{n}_f"), F.col(f"{n}_g")) for i, (n, k) in enumerate(zip(names, KINDS, strict=True))]
    kept = [c for c in df.columns if c != into]
    return out.select(*[F.col(f"`{c}`") for c in kept], F.sort_array(F.concat(*spans)).alias(into))


def mask_pii(df: DataFrame, text: str = "text", spans: str = "pii") -> DataFrame:
    """``text`` with every span replaced by ``[kind]``; a span inside an earlier one is part of that one."""
    t, s = text_or_empty(F.col(f"`{text}`")), F.col(f"`{spans}`")
    n, parts, pos = F.size(s), F.array().cast("array<string>").alias("out"), "pos"
    # Pieces are cut from the text of a block, and as many blocks as there are spans in one: nothing is quadratic in the text.
    size = F.ceil(F.sqrt(n)).cast("int")

    def block(acc: Column, b: Column) -> Column:
        places = F.sequence(b * size, F.least((b + 1) * size, n) - 1)
        last = F.array_max(F.transform(places, lambda i: F.get(s, i)["end"]))
        own = F.substr(t, (acc[pos] + 1).cast("int"), F.greatest(last - acc[pos], F.lit(0)).cast("int"))

        def step(a: Column, x: Column, own: Column) -> Column:
            piece = F.substr(own, (a[pos] - acc[pos] + 1).cast("int"), (x["start"] - a[pos]).cast("int"))
            return F.when(x["start"] < a[pos], F.struct(F.greatest(a[pos], x["end"]).alias(pos), a["out"].alias("out"))
                          ).otherwise(F.struct(x["end"].alias(pos), F.concat(a["out"], F.array(
                              piece, F.concat(F.lit("["), x["kind"], F.lit("]")))).alias("out")))

        done = F.get(F.transform(F.array(own), lambda own: F.aggregate(
            places, F.struct(acc[pos].alias(pos), parts), lambda a, i: step(a, F.get(s, i), own),
            lambda a: F.struct(a[pos].alias(pos), F.array_join(a["out"], "").alias("text")))), 0)
        return F.get(F.transform(F.array(done), lambda d: F.struct(
            d[pos].alias(pos), F.concat(acc["out"], F.array(d["text"])).alias("out"))), 0)

    done = F.aggregate(
        F.sequence(F.lit(0), F.floor((n - 1) / size).cast("int")), F.struct(F.lit(0).cast("bigint").alias(pos), parts), block,
        lambda acc: F.concat(F.array_join(acc["out"], ""), F.substr(t, (acc[pos] + 1).cast("int"))))
    return df.withColumn(text, F.when(n > 0, done).otherwise(F.col(f"`{text}`")))


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def _of_kind(spans: str, kind: str) -> Column:
    return F.filter(spans, lambda s: s["kind"] == kind)


def pii_report(documents: DataFrame) -> DataFrame:
    """The digest per document: counts of the base kinds, hash of the base spans, all spans, best score."""
    found = find_pii(documents.select("doc_id", "text")).select("doc_id", "pii")
    count = {f"n_{k}": F.size(_of_kind("pii", k)).cast("bigint") for k in BASE_KINDS}
    base = F.filter("pii", lambda s: s["rank"] < len(BASE_KINDS))
    return found.select("doc_id", *[c.alias(n) for n, c in count.items()],
                        F.sha2(_joined(base), 256).alias("base_sha256"), _joined(F.col("pii")).alias("spans"),
                        F.array_max(F.transform("pii", lambda s: s["score"])).alias("best_score"))
