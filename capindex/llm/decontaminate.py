"""Benchmark decontamination by winnowing.

A text is a sequence of words. Of every run of ``SPAN`` words, the least hash among its ``K``-grams is a
fingerprint, so two texts that share ``SPAN`` words in a row share a fingerprint: the least hash of that run is the
same on both sides. Documents and benchmark items are joined on fingerprints; the hits (all positions of the
common k-grams in the documents found) are extended to whole windows of ``SPAN`` words, which are compared as words,
not as hashes. Items of fewer words have one window, themselves, and are fingerprinted whole.

Scale: fingerprints come from one row's words and are staged once (about 2 in 7 words, 8 bytes each). Only they
meet the benchmark, by a join that Spark broadcasts or shuffles by the benchmark's size; the words of the few
documents that share one are read again and exploded. Copies of one text are verified once. No pair of documents is
ever built.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from capindex.llm.common import ascii_lower, broadcast_if_small, grams, stage, text_or_empty

SPAN, K = 10, 5
#: Fixed value: what separates words after A-Z are lower-cased.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    return F.filter(F.split(ascii_lower(text_or_empty(text)), SEPARATORS, -1), lambda w: w != "")


def _winnowed(g: Column) -> Column:
    """The least hash of each ``SPAN - K + 1`` consecutive k-grams, each value once."""
    width = SPAN - K + 1
    return F.array_distinct(F.filter(F.transform(g, lambda x, i: F.when(
        i + width <= F.size(g), F.least(x, *[F.get(g, i + j) for j in range(1, width)]))), lambda x: x.isNotNull()))


def _hashed(df: DataFrame) -> DataFrame:
    """``df`` with a column words and n, h (word hashes) and g (k-gram hashes)."""
    out = df.withColumn("h", F.transform("words", lambda w: F.xxhash64(w))).withColumn("n", F.size("words"))
    return out.withColumn("g", grams(F.col("h"), K, F.col("n")))


def _whole(m: int) -> Column:
    """Hashes of all ``m``-grams, apart from those of other lengths."""
    return grams(F.col("h"), m, F.col("n"), seed=-m)


def _benchmark(items: DataFrame) -> tuple[DataFrame, DataFrame, list[int]]:
    """Fingerprints (f), windows (window, items) and the lengths of items shorter than a window (at most nine)."""
    rows = stage(_hashed(items.select(F.col("item_id"), words_of(F.col("text")).alias("words"))).where("n > 0"), "decon-items")
    short = sorted(r[0] for r in rows.where(F.col("n") < SPAN).select("n").distinct().collect())
    marks = _winnowed(F.col("g"))
    for m in short:
        marks = F.when(F.col("n") == m, _whole(m)).otherwise(marks)
    prints = stage(rows.select(F.explode(marks).alias("f")).distinct(), "decon-prints")
    width = F.least(F.col("n"), F.lit(SPAN))
    starts = F.sequence(F.lit(1), F.col("n") - width + 1)
    windows = rows.select("item_id", F.explode(F.transform(starts, lambda s: F.array_join(
        F.slice("words", s, width), " "))).alias("window")).groupBy("window").agg(F.collect_set("item_id").alias("items"))
    return prints, stage(windows, "decon-windows"), short


def contamination(documents: DataFrame, items: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row of ``documents``: doc, text_key (md5 of the text), n_words, n_hit, items (sorted as strings).

    A word inside any occurrence of an item's window is hit. Null and empty texts have no words and no hits; items
    without words have no windows; an item id given twice counts once, a null item id marks words but is not listed.
    Equal texts get equal results, whatever their ids; empty tables give no rows or no hits.
    """
    prints, windows, short = _benchmark(items.select("item_id", "text"))
    body = F.col(f"`{text}`")
    source = documents.select(F.col(f"`{doc}`").alias("doc_id"), text_or_empty(body).alias("text"))
    marks = F.concat(_winnowed(F.col("g")), *[F.array_distinct(_whole(m)) for m in short])
    rows = stage(_hashed(source.select("doc_id", F.md5("text").alias("text_key"), F.xxhash64("text").alias("text_hash"),
                                       words_of(F.col("text")).alias("words"))).select(
        "doc_id", "text_key", "text_hash", F.col("n").alias("n_words"), marks.alias("prints")), "decon-rows")
    prints = broadcast_if_small(prints, 16)
    shared = rows.select("text_hash", F.explode("prints").alias("f")).join(prints, "f", "left_semi").select("text_hash").distinct()
    found = broadcast_if_small(stage(shared, "decon-shared"), 16)
    texts = source.withColumn("text_hash", F.xxhash64("text")).join(found, "text_hash", "left_semi").select(
        F.md5("text").alias("text_key"), "text").dropDuplicates(["text_key"])
    hits = stage(_verified(texts, prints, windows, short), "decon-hits")
    out = rows.select("doc_id", "text_key", "n_words").join(broadcast_if_small(hits, 200), "text_key", "left")
    return out.select("doc_id", "text_key", F.col("n_words").cast("bigint").alias("n_words"),
                      F.coalesce("n_hit", F.lit(0)).cast("bigint").alias("n_hit"),
                      F.coalesce("items", F.array().cast("array<string>")).alias("items"))


def _verified(texts: DataFrame, prints: DataFrame, windows: DataFrame, short: list[int]) -> DataFrame:
    """(text_key, n_hit, items) of texts with a hit: positions of common k-grams, extended to the windows around them."""
    hashed = _hashed(texts.select("text_key", words_of(F.col("text")).alias("words")))
    w, n, reach = F.col("words"), F.col("n"), SPAN - K

    def place(f: Column, i: Column, m: int, back: int, ahead: int) -> Column:
        """Position, length of the windows sought, hash, and the words of all windows around the position."""
        first = F.greatest(i - back, F.lit(0))
        return F.struct(f.alias("f"), F.lit(m).alias("m"), first.alias("at"),
                        F.slice(w, first + 1, F.least(i + ahead, n) - first).alias("around"))

    places = [F.transform("g", lambda f, i: place(f, i, SPAN, reach, SPAN))]
    places += [F.transform(_whole(m), _place_of(place, m)) for m in short]
    at = hashed.select("text_key", F.explode(F.concat(*places)).alias("p")).select("text_key", "p.*").join(prints, "f", "left_semi")
    starts = F.when(F.size("around") >= F.col("m"), F.sequence(F.lit(0), F.size("around") - F.col("m")))
    found = at.select("text_key", "at", "m", "around", F.explode(starts).alias("s")).select(
        "text_key", (F.col("at") + F.col("s")).alias("start"), "m",
        F.array_join(F.slice("around", F.col("s") + 1, F.col("m")), " ").alias("window")).distinct()
    hit = found.join(broadcast_if_small(windows, 400), "window").groupBy("text_key").agg(
        F.sort_array(F.collect_set(F.struct("start", "m"))).alias("spans"),
        F.array_distinct(F.flatten(F.collect_set("items"))).alias("ids"))
    covered = F.aggregate(
        "spans", F.struct(F.lit(0).alias("end"), F.lit(0).alias("n")),
        lambda acc, x: F.struct(F.greatest(acc["end"], x["start"] + x["m"]).alias("end"),
                                (acc["n"] + F.greatest(F.lit(0), x["start"] + x["m"] - F.greatest(acc["end"], x["start"]))).alias("n")),
        lambda acc: acc["n"])
    return hit.select("text_key", covered.alias("n_hit"), F.sort_array(F.transform("ids", lambda i: i.cast("string"))).alias("items"))


def _place_of(place, m: int):
    return lambda f, i: place(f, i, m, 0, m)


def decontaminated(documents: DataFrame, items: DataFrame) -> DataFrame:
    """The rows of ``documents`` whose text shares no window with ``items``; all columns, nulls kept."""
    bad = contamination(documents, items).where("n_hit > 0").select(F.col("text_key").alias("__bad_text")).distinct()
    bad = broadcast_if_small(stage(bad, "decon-bad"), 64)
    return documents.join(bad, F.md5(text_or_empty(documents["text"])) == F.col("__bad_text"), "left_anti")


def contamination_report(documents: DataFrame, items: DataFrame) -> DataFrame:
    """The digest per document."""
    out = contamination(documents, items)
    return out.select("doc_id", "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"),
                      F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))
