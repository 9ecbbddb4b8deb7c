"""Phrase collocation mining: multikey three-way quicksort of suffix pointers, routed by leading words.

A suffix is the run of up to ``LONGEST`` words that starts at a word of a piece. Three jobs:

1. ``_word_counts``: occurrences of every word per language, added up per chunk of texts before the shuffle, and the word
   pairs that a chunk holds often. From them: the frequent words as a bitmap of fixed size, and the pairs that hold more
   than ``HOT_SHARE`` of all words (so there are at most 1 / HOT_SHARE of them).
2. ``_suffixes``: every chunk's suffixes, ended before a word that the bitmap excludes (a phrase with an infrequent word is
   infrequent; a false positive only costs room), equal ones added up, and routed by their two leading words. A hot pair
   is spread instead: its count, its three-word and its four-word suffixes are routed by two, three and four words.
   After that no route holds more than about ``HOT_SHARE`` of all suffixes.
3. ``_count_routes``: whole routes, chunk by chunk, are sorted by multikey three-way quicksort to depth ``LONGEST``: the sizes
   of its equal-partitions are the phrase counts, partitions smaller than ``least`` are abandoned.

Scores need the counts of a phrase's parts, which are frequent if the phrase is, so they come from joins of the table of
frequent phrases with itself. Counts and scores are exact integers.

Defined cases: null languages count as ``und``; null and blank texts have no words; an empty table has no phrases. Equal rows
count as often as they occur. Columns other than text and language are not read, so that their names can't clash.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from capindex.llm.common import broadcast_if_small, stage

LEAST = 30
TOP = 2000
LONGEST = 4
#: A pair with a larger share of all words (and ``HOT_LEAST`` occurrences) is routed by more of its words.
HOT_SHARE = 1e-5
HOT_LEAST = 20_000
#: Bits of the bitmap of frequent words.
BITS = 1 << 26
#: Bytes of text, and rows of suffixes, that a task holds at a time.
CHUNK_BYTES = 8 << 20
CHUNK_ROWS = 400_000

_STOP = b"."
_PIECES = bytes.maketrans(b".,;:!?\n\x0b\x0c\r", _STOP * 10)
_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def _chunks(batches):
    """(language, texts as bytes): at most about ``CHUNK_BYTES`` of a language at a time, or one longer text."""
    held: dict[str, list[bytes]] = {}
    size: dict[str, int] = {}
    for b in batches:
        texts = b.column("text").cast(pa.binary())
        for lang, text in zip(b.column("lang").to_pylist(), texts.to_pylist(), strict=True):
            if held and size.get(lang, 0) + len(text) > CHUNK_BYTES and held.get(lang):
                yield lang, held.pop(lang)
                size.pop(lang)
            held.setdefault(lang, []).append(text)
            size[lang] = size.get(lang, 0) + len(text)
            if sum(size.values()) > 2 * CHUNK_BYTES:
                big = max(size, key=size.get)
                yield big, held.pop(big)
                size.pop(big)
    yield from held.items()


def _tokens(texts: list[bytes]) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """Word codes in order, the words, and which codes are words (one code stands for the ends of pieces)."""
    text = _STOP.join(texts).lower().translate(_PIECES).replace(_STOP, b" . ")
    split = pc.ascii_split_whitespace(pa.array([text.strip()], pa.large_binary()).cast(pa.large_string())).flatten()
    coded = split.dictionary_encode()
    words = coded.dictionary
    is_word = ~pc.is_in(words, value_set=pa.array([".", ""], words.type)).to_numpy(zero_copy_only=False)
    return coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), words, is_word


def _hashes(lang: str, words: pa.Array) -> np.ndarray:
    seed = xxhash.xxh32_intdigest(lang.encode())
    return np.array([xxhash.xxh64_intdigest(w, seed) for w in words.cast(pa.large_binary()).to_pylist()], dtype=np.uint64)


def _route(h: np.ndarray, *columns: np.ndarray) -> np.ndarray:
    """One hash of the words in ``columns`` (codes; -1 for none)."""
    out = np.zeros(len(columns[0]), dtype=np.uint64)
    for c in columns:
        out = (out ^ np.where(c < 0, np.uint64(1), h[c])) * _M1
        out = (out ^ (out >> np.uint64(29))) * _M2
    return out.view(np.int64)


def _packed(columns: list[np.ndarray], size: int) -> np.ndarray:
    """One integer per row, equal for equal rows; entries are between -1 and ``size`` - 1."""
    key = columns[0] + 1
    for c in columns[1:]:
        if len(key) and int(key.max()) >= (1 << 62) // (size + 1):
            key = np.unique(key, return_inverse=True)[1]
        key = key * (size + 1) + c + 1
    return key


def _word_counts(batches):
    """Per chunk: every word's count, all words' number, and hashes of frequent pairs."""
    for lang, texts in _chunks(batches):
        idx, words, is_word = _tokens(texts)
        count = np.bincount(idx, minlength=len(words))
        count[~is_word] = 0
        seen = np.flatnonzero(count)
        total = int(count.sum())
        rows = [(words.take(pa.array(seen)).cast(pa.string()), pa.nulls(len(seen), pa.int64()), count[seen]),
                (pa.nulls(1, pa.string()), pa.nulls(1, pa.int64()), np.array([total]))]
        at = np.flatnonzero(is_word[idx[:-1]] & is_word[idx[1:]])
        pair, n = np.unique(idx[at] * len(words) + idx[at + 1], return_counts=True)
        often = n >= max(8, total * HOT_SHARE / 2)
        pair, n = pair[often], n[often]
        rows.append((pa.nulls(len(n), pa.string()), pa.array(_route(_hashes(lang, words), pair // len(words), pair % len(words))), n)
                    if len(n) else (pa.nulls(0, pa.string()), pa.nulls(0, pa.int64()), n))
        for word, route, k in rows:
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(k), pa.string()), word, route, pa.array(k, pa.int64())],
                                             names=["lang", "word", "route", "k"])


def _bit(lang: str, word: bytes) -> int:
    return xxhash.xxh64_intdigest(lang.encode() + b" " + word, 42) & (BITS - 1)


def _suffixes(lang: str, texts: list[bytes], frequent: np.ndarray, hot: np.ndarray):
    """Rows of one chunk: route, body (the words, a tab, the words counted from, the language), how often."""
    idx, words, is_word = _tokens(texts)
    bits = np.array([_bit(lang, w) for w in words.cast(pa.large_binary()).to_pylist()], dtype=np.int64)
    good = is_word & ((frequent[bits >> 6] >> (bits & 63).astype(np.uint64)) & np.uint64(1)).astype(bool)
    code = np.where(good, np.cumsum(good) - 1, -1)
    words = words.filter(pa.array(good))
    if not len(words):
        return
    full = np.concatenate([code[idx], np.full(LONGEST, -1)])
    cols = [full[: len(idx)]]
    for k in range(1, LONGEST):
        cols.append(np.where(cols[-1] < 0, -1, full[k : k + len(idx)]))
    at = np.flatnonzero(cols[1] >= 0)
    cols = [c[at] for c in cols]
    h = _hashes(lang, words)
    pair = _route(h, *cols[:2])
    spread = np.isin(pair, hot)
    plans = [(~spread, LONGEST, 2)] + ([(spread, k, k) for k in range(2, LONGEST + 1)] if spread.any() else [])
    for which, length, shortest in plans:
        part = [c[which] for c in cols[:length]]
        if length == shortest and length > 2:
            long_enough = part[-1] >= 0
            part = [c[long_enough] for c in part]
        if not len(part[0]):
            continue
        _, first, n = np.unique(_packed(part, len(words)), return_index=True, return_counts=True)
        part = [c[first] for c in part]
        texts_of = [words.take(pa.array(c, pa.int64(), mask=c < 0)).cast(pa.string()) for c in part]
        joined = pc.binary_join_element_wise(*texts_of, " ", null_handling="skip")
        body = pc.binary_join_element_wise(joined, f"{shortest}{lang}", "\t")
        # half a hash is enough to deal rows out: routes that share it are only counted in one go
        route = _route(h, *part[:shortest]).astype(np.int32)
        yield pa.RecordBatch.from_arrays([pa.array(route), body, pa.array(n.astype(np.int32))], names=["route", "body", "k"])


def multikey_counts(keys: np.ndarray, weight: np.ndarray, least: int, shortest: int = 1):
    """(row, length, count) arrays: each prefix of ``shortest`` words or more that rows of total weight ``least`` begin with.

    ``keys`` has a row of word codes per suffix, -1 after its end. All open partitions are split at once, each by a pivot
    of its own at its own depth, into the smaller, equal and larger keys; pointers move so that a partition stays together.
    An equal-partition is a prefix one word longer, and its weight that prefix's count.
    """
    ptr = np.flatnonzero(keys[:, 0] >= 0)
    seg, depth = np.zeros(len(ptr), dtype=np.int64), np.zeros(1, dtype=np.int64)
    found = []
    while len(ptr):
        k = len(depth)
        start = np.searchsorted(seg, np.arange(k))
        length = np.diff(np.append(start, len(ptr)))
        key = keys[ptr, depth[seg]]
        pivot = keys[ptr[start + length // 2], depth]
        side = np.sign(key - pivot[seg]) + 1
        part = seg * 3 + side
        size = np.bincount(part, weights=weight[ptr], minlength=3 * k).astype(np.int64)
        # pointers of a partition: the smaller ones first, then the equal and the larger ones
        to = np.empty(len(ptr), dtype=np.int64)
        at = start.copy()
        for s in range(3):
            mine = side == s
            run = np.cumsum(mine)
            before = run[start] - mine[start]
            to[mine] = (at[seg] + run - 1 - before[seg])[mine]
            at += np.bincount(seg[mine], minlength=k)
        moved, part_of = np.empty_like(ptr), np.empty_like(part)
        moved[to], part_of[to] = ptr, part
        depth = np.repeat(depth, 3)
        depth[1::3] += 1
        whole = (size >= least) & (np.arange(3 * k) % 3 == 1)
        first = np.searchsorted(part_of, np.flatnonzero(whole))
        found.append((moved[first], depth[whole], size[whole]))
        go = ((size >= least) & (depth < keys.shape[1]))[part_of]
        ptr, part_of = moved[go], part_of[go]
        go = keys[ptr, depth[part_of]] >= 0
        ptr, part_of = ptr[go], part_of[go]
        new = np.diff(part_of, prepend=-1) != 0
        seg, depth = np.cumsum(new) - 1, depth[part_of[new]]
    if not found:
        return tuple(np.zeros(0, dtype=np.int64) for _ in range(3))
    row, n, size = (np.concatenate(x) for x in zip(*found, strict=True))
    use = n >= shortest
    return row[use], n[use], size[use]


def _count_rows(lang: pa.DictionaryArray, phrases: pa.Array, shortest: np.ndarray, weight: np.ndarray, least: int):
    """Counts of whole routes."""
    split = pc.split_pattern(phrases, " ")
    length = pc.list_value_length(split).to_numpy(zero_copy_only=False).astype(np.int64)
    coded = split.flatten().dictionary_encode()
    flat = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    at = np.cumsum(length) - length
    keys = np.full((len(length), LONGEST), -1, dtype=np.int64)
    blank = pa.scalar(" ", phrases.type)
    for k in range(LONGEST):
        has = length > k
        keys[has, k] = flat[at[has] + k]
    # the language is a part of the first key
    keys[:, 0] += lang.indices.to_numpy(zero_copy_only=False).astype(np.int64) * len(coded.dictionary)
    names, words = lang.dictionary, coded.dictionary
    for s in np.unique(shortest):
        rows = np.flatnonzero(shortest == s)
        row, n, count = multikey_counts(keys[rows], weight[rows], least, int(s))
        row = rows[row]
        for k in range(2, LONGEST + 1):
            r = row[n == k]
            if len(r):
                parts = [words.take(pa.array(keys[r, j] % len(words))) for j in range(k)]
                yield pa.RecordBatch.from_arrays(
                    [names.take(pa.array(keys[r, 0] // len(words))), pc.binary_join_element_wise(*parts, blank),
                     pa.array(np.full(len(r), k, dtype=np.int32)), pa.array(count[n == k])], names=["lang", "phrase", "words", "a"])


def _count_routes(least: int):
    """Over rows sorted by route: chunks end where the route changes."""

    def run(batches):
        held: list[pa.RecordBatch] = []
        rows = 0
        for b in batches:
            if not b.num_rows:
                continue
            held.append(b)
            rows += b.num_rows
            if rows < CHUNK_ROWS:
                continue
            t = pa.Table.from_batches(held).combine_chunks()
            route = t.column("route").to_numpy()
            cut = int(np.searchsorted(route, route[-1]))
            if cut:
                yield from _of_table(t.slice(0, cut), least)
            # the last route may go on: its equal rows are added up
            held = _merged(t.slice(cut))
            rows = sum(h.num_rows for h in held)
        if held:
            yield from _of_table(pa.Table.from_batches(held), least)

    return run


def _merged(t: pa.Table) -> list[pa.RecordBatch]:
    return t.group_by(["route", "body"]).aggregate([("k", "sum")]).rename_columns(["route", "body", "k"]).cast(t.schema).combine_chunks().to_batches()


def _of_table(t: pa.Table, least: int):
    body = pc.split_pattern(t.column("body").combine_chunks().cast(pa.large_string()), "\t", max_splits=1)
    group = pc.list_element(body, 1).dictionary_encode()  # words counted from and language: a few values
    langs = pa.DictionaryArray.from_arrays(group.indices, pc.utf8_slice_codeunits(group.dictionary, 1))
    shortest = pc.utf8_slice_codeunits(group.dictionary, 0, 1).cast(pa.int64()).to_numpy(zero_copy_only=False)[group.indices.to_numpy()]
    for b in _count_rows(langs, pc.list_element(body, 0), shortest, t.column("k").to_numpy().astype(np.int64), least):
        yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.string()), b.column(1).cast(pa.string()), b.column(2), b.column(3)], names=b.schema.names)


def _bitmap(words: DataFrame) -> np.ndarray:
    """The bitmap of (lang, word): its entries are made in Spark, at most BITS / 64 of them."""
    bit = F.xxhash64(F.concat_ws(" ", "lang", "word").cast("binary")).bitwiseAND(F.lit(BITS - 1))
    entries = (words.select(bit.alias("bit")).select(F.shiftright("bit", 6).alias("at"), F.expr("shiftleft(1L, cast(bit & 63 AS int))").alias("bits"))
               .groupBy("at").agg(F.expr("bit_or(bits)").alias("bits")).collect())
    out = np.zeros(BITS >> 6, dtype=np.int64)
    if entries:
        out[np.array([e["at"] for e in entries])] = np.array([e["bits"] for e in entries])
    return out.view(np.uint64)


def phrase_counts(documents: DataFrame, least: int = LEAST, text: str = "text", lang: str = "lang") -> tuple[DataFrame, DataFrame]:
    """(phrases, totals): lang, phrase, words, a of all phrases of 1 to ``LONGEST`` words that occur ``least`` times or more
    (2 at least); lang, n: all words of each language."""
    spark = documents.sparkSession
    least = max(2, least)
    rows = documents.select(F.coalesce(F.col(f"`{lang}`").cast("string"), F.lit("und")).alias("lang"), F.col(f"`{text}`").cast("string").alias("text")).where("text is not null")
    counts = stage(rows.mapInArrow(_word_counts, "lang string, word string, route bigint, k bigint").groupBy("lang", "word", "route")
                   .agg(F.sum("k").alias("k")).where(F.col("k") >= F.when(F.col("word").isNull(), 0).otherwise(least)), "phrase-words")
    totals = counts.where("word is null and route is null and k > 0").select("lang", F.col("k").alias("n"))
    words = counts.where("word is not null").select("lang", F.col("word").alias("phrase"), F.lit(1).alias("words"), F.col("k").alias("a"))
    all_words = totals.agg(F.sum("n")).first()[0] or 0
    hot = counts.where(F.col("route").isNotNull() & (F.col("k") >= max(HOT_LEAST, all_words * HOT_SHARE))).select("route").collect()
    plan = spark.sparkContext.broadcast((_bitmap(counts.where("word is not null")), np.array([r["route"] for r in hot], dtype=np.int64)))

    def suffixes(batches):
        frequent, spread = plan.value
        for code, texts in _chunks(batches):
            yield from _suffixes(code, texts, frequent, spread)

    routed = rows.mapInArrow(suffixes, "route int, body string, k int").repartition("route").sortWithinPartitions("route")
    longer = stage(routed.mapInArrow(_count_routes(least), "lang string, phrase string, words int, a bigint"), "phrase-counts")
    return words.unionByName(longer), totals


def score_phrases(phrases: DataFrame, totals: DataFrame) -> DataFrame:
    """lang, phrase, words, a, l, r, n, score of every phrase of two words or more, scored by its weakest cut (ties: the
    earliest): floor(2000000 a / (l + r))."""
    part = F.split("phrase", " ")
    cuts = phrases.where("words > 1").select("lang", "phrase", "words", "a", F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k"), part.alias("p"))
    cuts = cuts.select("lang", "phrase", "words", "a", "k", F.array_join(F.slice("p", F.lit(1), F.col("k")), " ").alias("first"),
                       F.array_join(F.slice("p", F.col("k") + 1, F.col("words") - F.col("k")), " ").alias("rest"))
    n_of = phrases.select("lang", "phrase", "a")
    cuts = (cuts.join(n_of.select("lang", F.col("phrase").alias("first"), F.col("a").alias("l")), ["lang", "first"])
            .join(n_of.select("lang", F.col("phrase").alias("rest"), F.col("a").alias("r")), ["lang", "rest"]))
    score = F.expr("(CAST(a AS decimal(20, 0)) * 2000000BD) div (CAST(l AS decimal(20, 0)) + r)")
    weakest = cuts.select("lang", "phrase", "words", "a", F.struct(score.alias("score"), "k", "l", "r").alias("cut")).groupBy("lang", "phrase").agg(
        F.min("cut").alias("cut"), F.first("words").alias("words"), F.first("a").alias("a"))
    return weakest.join(broadcast_if_small(totals, 64), "lang").select("lang", "phrase", "words", "a", "cut.l", "cut.r", "n", "cut.score")


def without_parts(scored: DataFrame) -> DataFrame:
    """Leaves out phrases that lie in a longer one with 80 % of their count or more."""
    p = F.split("phrase", " ")
    inside = scored.where("words > 2").select(
        "lang", "a", F.explode(F.flatten(F.transform(F.sequence(F.lit(2), F.col("words") - 1), lambda n: F.transform(
            F.sequence(F.lit(1), F.col("words") - n + 1), lambda i: F.array_join(F.slice(p, i, n), " "))))).alias("phrase"))
    most = inside.groupBy("lang", "phrase").agg(F.max("a").alias("longer_a"))
    return scored.join(most, ["lang", "phrase"], "left").where("longer_a is null or 5 * longer_a < 4 * a").drop("longer_a")


def top_phrases(documents: DataFrame, top: int = TOP, least: int = LEAST, text: str = "text", lang: str = "lang") -> DataFrame:
    """Each language's ``top`` phrases by score, count and phrase: lang, rank, phrase, words, a, l, r, n, score."""
    phrases, totals = phrase_counts(documents, least, text, lang)
    kept = without_parts(stage(score_phrases(phrases, totals), "phrase-scores"))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = kept.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return ranked.select("lang", F.col("rank").cast("bigint").alias("rank"), "phrase", "words", "a", "l", "r", "n", "score")


def phrase_report(documents: DataFrame) -> DataFrame:
    """The contract's columns of :func:`top_phrases`."""
    return top_phrases(documents).drop("words")
