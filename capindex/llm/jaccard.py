"""N-gram Jaccard join: size-banded tiles with hashed bitmap signatures.

A document is the set of its word 5-grams (64-bit hashes). Two documents link when their sets' Jaccard similarity is at
least ``NUMER / DENOM``.

1. *Sets.* One pass over the texts gives each row its set's size, class (hash of the whole set: equal sets are one
   class from here on), bitmap signature (2 to 4 bits per gram, at ``gram mod bits``) and least grams.
2. *Prefixes.* In one order of all grams, two linked sets share a gram among their first
   ``n - ceil(0.8 n) + 1``. The order is (frequent, hash): grams that many least-gram lists share come last. They
   are known by a bitmap of fixed size; a gram that falls on a set bit by chance only comes later, the order stays total.
3. *Tiles.* Prefix grams that two classes share make tiles, cut by size band (a factor 1.25): partners are in the same
   or the next band.
4. *Stars.* Each class is compared with one pivot, the member of its tiles that shares most; verified links give
   first components, so that large groups of near copies need not be paired out.
5. *Tiles again, exactly.* In tiles that still hold two components, members of different components are compared:
   the places of the common gram and the sizes bound the overlap from above, then bit counts of the signatures do. What
   is left is verified. Tiles over ``BLOCK`` members are cut into blocks, and pairs of blocks are spread over tasks; in tiles
   over ``CROWD`` members signatures are wider, so that fewer pairs pass by chance.
6. *Verification* intersects the sorted gram arrays of the two classes.

A pair is left out only when a bound rules it out or both classes are connected already, so components are exact.
``jaccard_links``, which counts the links, leaves step 4 out and compares all members of the tiles, so that it has every link
between different classes. Pairs are made inside a task, block by block, and only those that pass the bounds are rows.

Documents without words have the empty set, link with nothing and are components of their own; null texts count as
empty; documents of fewer than five words are one gram, the whole sequence. Null ids are ignored by the least id. Grams
and classes are 64-bit hashes: of 10^10 classes, two are expected to collide about three times.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from capindex.llm.common import broadcast_if_small, stage
from capindex.llm.components import components

GRAM = 5
NUMER, DENOM = 4, 5
#: A gram in the least-gram lists of more classes than this is frequent.
FREQUENT = 16
#: Bits of the map of frequent grams: a bound of 512 KB, whatever the corpus.
MAP_BITS = 22
BLOCK = 4096
#: In tiles of more members, where pairs are many, signatures have this many bits per gram.
CROWD, WIDE = 64, 16
BAND = float(np.log(1.25))
_CACHE_WORDS = 200_000
_STEP = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5)]


class _Words(dict):
    """Word -> hash, for a bounded number of words."""

    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh3_64_intdigest(word)
        if len(self) < _CACHE_WORDS:
            self[word] = h
        return h


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def gram_set(text: str | None, words: dict) -> np.ndarray:
    """Sorted distinct gram hashes (uint64). bytes.lower and bytes.split know ASCII only, as asked."""
    w = (text or "").encode().lower().split()
    h = np.fromiter(map(words.__getitem__, w), dtype=np.uint64, count=len(w))
    if not len(h):
        return h
    k = min(GRAM, len(h))
    g = h[: len(h) - k + 1] * _STEP[0] + np.uint64(k)
    for i in range(1, k):
        g = _mix(g) + h[i : len(h) - k + 1 + i] * _STEP[i]
    return np.unique(_mix(g))


def required(n: np.ndarray) -> np.ndarray:
    """Least overlap of two sets whose sizes sum to ``n``: 4/9 of it, rounded up."""
    return -(-n * NUMER // (NUMER + DENOM))


def prefix_len(n: int) -> int:
    return n + (-n * NUMER // DENOM) + 1


def band_of(n: np.ndarray) -> np.ndarray:
    return np.floor(np.log(n) / BAND + 1e-9).astype(np.int64)


def signature(g: np.ndarray, per_gram: int = 2) -> bytes:
    """Bitmap of 64 bits or the power of two from ``per_gram`` to twice as many times the size; sizes within 1.25 differ by one
    doubling at most."""
    bits = max(64, 1 << int(per_gram * len(g) - 1).bit_length())
    out = np.zeros(bits, dtype=bool)
    out[(g & np.uint64(bits - 1)).astype(np.int64)] = True
    return np.packbits(out).tobytes()


def _texts(batches: Iterator[pa.RecordBatch], *columns: str):
    for b in batches:
        cols = [b.column(c).to_pylist() for c in columns]
        texts = b.column("text")
        for i in range(b.num_rows):
            yield (texts[i].as_py(), *[c[i] for c in cols])


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _class_of(g: np.ndarray) -> int:
    return _signed(xxhash.xxh3_64_intdigest(g.tobytes(), seed=len(g)))


def _chunks(rows, schema: pa.Schema, size: int = 2000):
    part: list = []
    for r in rows:
        part.append(r)
        if len(part) >= size:
            yield pa.RecordBatch.from_pylist(part, schema=schema)
            part = []
    if part:
        yield pa.RecordBatch.from_pylist(part, schema=schema)


def _sets(batches):
    words = _Words()
    schema = pa.schema([("doc_id", pa.int64()), ("text_hash", pa.int64()), ("n", pa.int32()), ("c", pa.int64()),
                        ("sig", pa.binary()), ("least", pa.list_(pa.int64()))])

    def rows():
        for text, doc, key in _texts(batches, "doc_id", "text_hash"):
            g = gram_set(text, words)
            n = len(g)
            yield {"doc_id": doc, "text_hash": key, "n": n, "c": _class_of(g) if n else None, "sig": signature(g) if n else None,
                   "least": g[: prefix_len(n)].view(np.int64) if n else None}

    yield from _chunks(rows(), schema)


def _prefixes(frequent: np.ndarray):
    """(gram, c, n, pos) of prefixes, once per class and task."""

    def run(batches):
        words, seen = _Words(), set()
        for b in batches:
            out = []
            for (text,) in _texts(iter([b])):
                g = gram_set(text, words)
                c = _class_of(g)
                if not len(g) or c in seen:
                    continue
                if len(seen) < _CACHE_WORDS:
                    seen.add(c)
                cell = (g >> np.uint64(64 - MAP_BITS)).astype(np.int64)
                late = (frequent[cell >> 3] >> (cell & 7).astype(np.uint8)) & 1 == 1
                first = np.concatenate([g[~late], g[late]])[: prefix_len(len(g))].view(np.int64)
                out.append((first, c, len(g)))
            if out:
                size = [len(x[0]) for x in out]
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.concatenate([x[0] for x in out])), pa.array(np.repeat([x[1] for x in out], size)),
                    pa.array(np.repeat([x[2] for x in out], size).astype(np.int32)),
                    pa.array(np.concatenate([np.arange(k, dtype=np.int32) for k in size]))], names=["gram", "c", "n", "pos"])

    return run


def _arrays(batches):
    words = _Words()
    seen: set = set()
    schema = pa.schema([("c", pa.int64()), ("grams", pa.list_(pa.int64()))])

    def rows():
        for (text,) in _texts(batches):
            g = gram_set(text, words)
            c = _class_of(g)
            if c not in seen:
                if len(seen) < _CACHE_WORDS:
                    seen.add(c)
                yield {"c": c, "grams": g.view(np.int64)}

    yield from _chunks(rows(), schema, 500)


def _wide(batches):
    """Signatures of ``WIDE`` bits per gram or more, once per class and task."""
    words, seen = _Words(), set()
    schema = pa.schema([("c", pa.int64()), ("sig", pa.binary())])

    def rows():
        for (text,) in _texts(batches):
            g = gram_set(text, words)
            c = _class_of(g)
            if c not in seen:
                if len(seen) < _CACHE_WORDS:
                    seen.add(c)
                yield {"c": c, "sig": signature(g, WIDE)}

    yield from _chunks(rows(), schema)


def _bits(sigs: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(sigs), dtype=np.uint64).reshape(len(sigs), -1)


def _fold(m: np.ndarray, width: int) -> np.ndarray:
    """A signature of twice the bits, as one of ``width`` words: bits that differ by half the length fall together."""
    while m.shape[1] > width:
        half = m.shape[1] // 2
        m = m[:, :half] | m[:, half:]
    return m


def _bounded(i: np.ndarray, j: np.ndarray, n: np.ndarray, sigs: list[bytes]) -> np.ndarray:
    """Which pairs of rows the bit counts can't rule out: a bit of one signature that the other lacks is a gram that it lacks."""
    width = np.fromiter((len(s) // 8 for s in sigs), dtype=np.int64, count=len(sigs))
    ok = np.zeros(len(i), dtype=bool)
    rows, at = {}, np.zeros(len(sigs), dtype=np.int64)
    for w in np.unique(width):
        own = np.flatnonzero(width == w)
        rows[w], at[own] = _bits([sigs[k] for k in own]), np.arange(len(own))
    for wi in rows:
        for wj in rows:
            both = np.flatnonzero((width[i] == wi) & (width[j] == wj))
            for part in np.array_split(both, 1 + len(both) * int(max(wi, wj)) // 1_000_000):  # some 8 MB an array
                if not len(part):
                    continue
                w = min(wi, wj)
                a, b = _fold(rows[wi][at[i[part]]], w), _fold(rows[wj][at[j[part]]], w)
                over = np.minimum(n[i[part]] - np.bitwise_count(a & ~b).sum(axis=1, dtype=np.int64),
                                  n[j[part]] - np.bitwise_count(b & ~a).sum(axis=1, dtype=np.int64))
                ok[part] = over >= required(n[i[part]] + n[j[part]])
    return ok


def _index_pairs(starts: np.ndarray, sizes: np.ndarray):
    """Index pairs within groups of consecutive rows, a bounded number at a time."""
    for m in np.unique(sizes):
        at = starts[sizes == m]
        if m <= 64:
            a, b = np.triu_indices(m, 1)
            for part in np.array_split(at, 1 + len(at) * len(a) // 200_000):
                yield (part[:, None] + a).ravel(), (part[:, None] + b).ravel()
        else:
            step = max(1, 200_000 // int(m))
            for s in at:
                for k in range(0, int(m), step):
                    a = np.arange(k, min(k + step, int(m)))
                    x, y = np.repeat(a, m), np.tile(np.arange(m), len(a))
                    keep = x < y
                    yield s + x[keep], s + y[keep]


def _tile_pairs(t: pa.Table, starts: np.ndarray) -> np.ndarray:
    """Pairs of classes (c, d) from complete tiles that the sizes, the places and the bit counts allow."""
    col = lambda k: t.column(k).to_numpy()
    n, pos, label, own, c = col("n").astype(np.int64), col("pos").astype(np.int64), col("label"), col("own"), col("c")
    block, one = col("block"), col("low") == col("high")
    sigs = t.column("sig").to_pylist()
    found = []
    for i, j in _index_pairs(starts, np.diff(np.r_[starts, len(c)])):
        need = required(n[i] + n[j])
        ok = (label[i] != label[j]) & (own[i] | own[j]) & (one[i] | (block[i] != block[j]))
        ok &= np.minimum(n[i] - pos[i], n[j] - pos[j]) >= need
        i, j = i[ok], j[ok]
        if len(i):
            ok = _bounded(i, j, n, sigs)
            found.append(np.stack([np.minimum(c[i], c[j])[ok], np.maximum(c[i], c[j])[ok]], axis=1))
    return np.unique(np.concatenate(found), axis=0) if found else np.empty((0, 2), dtype=np.int64)


TILE = ["gram", "band", "low", "high"]


def _tiles(batches):
    """Sorted tile rows to candidate pairs; the tile that a batch breaks off waits for the next one."""
    held = None
    for b in batches:
        t = pa.Table.from_batches([b])
        t = (pa.concat_tables([held, t]) if held is not None else t).combine_chunks()
        new = np.r_[True, np.zeros(len(t) - 1, dtype=bool)]
        for k in TILE:
            v = t.column(k).to_numpy()
            new[1:] |= v[1:] != v[:-1]
        starts = np.flatnonzero(new)
        held = t.slice(starts[-1])
        if len(starts) > 1:
            yield _pair_batch(_tile_pairs(t.slice(0, starts[-1]), starts[:-1]))
    if held is not None:
        yield _pair_batch(_tile_pairs(held.combine_chunks(), np.array([0])))


def _pair_batch(p: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(p[:, 0]), pa.array(p[:, 1])], names=["c", "d"])


def _bound_pairs(batches):
    for b in batches:
        n = np.concatenate([b.column("n").to_numpy(), b.column("m").to_numpy()]).astype(np.int64)
        k = b.num_rows
        ok = _bounded(np.arange(k), np.arange(k) + k, n, b.column("sig").to_pylist() + b.column("other").to_pylist())
        yield b.select(["c", "d"]).filter(pa.array(ok))


def _verified(batches):
    """Pairs whose sorted gram arrays meet often enough."""
    for b in batches:
        xs, ys, ok = b.column("grams"), b.column("others"), np.zeros(b.num_rows, dtype=bool)
        for r in range(b.num_rows):
            x, y = xs[r].values.to_numpy(), ys[r].values.to_numpy()
            at = np.searchsorted(y.view(np.uint64), x.view(np.uint64))
            both = int((y[np.minimum(at, len(y) - 1)] == x).sum())
            ok[r] = both >= required(len(x) + len(y))
        yield b.select(["c", "d"]).filter(pa.array(ok))


PAIR = "c bigint, d bigint"


def _texts_of(ids: DataFrame, docs: DataFrame, classes: DataFrame) -> DataFrame:
    """One text or its copies of each class."""
    keys = stage(classes.join(ids, "c").select("text_hash"), "jaccard-keys")
    return docs.join(broadcast_if_small(keys, 16), "text_hash", "left_semi").select("text")


def _signatures(ids: DataFrame, docs: DataFrame, classes: DataFrame) -> DataFrame:
    return stage(_texts_of(ids, docs, classes).mapInArrow(_wide, "c bigint, sig binary").dropDuplicates(["c"]), "jaccard-wide")


def _links(pairs: DataFrame, docs: DataFrame, classes: DataFrame) -> DataFrame:
    """The pairs of classes (c, d) that do link. Grams are made again from one text of each class, so that no table of
    all grams is kept."""
    need = pairs.select("c").union(pairs.select(F.col("d").alias("c"))).distinct()
    texts = _texts_of(need, docs, classes)
    grams = stage(texts.mapInArrow(_arrays, "c bigint, grams array<bigint>").dropDuplicates(["c"]), "jaccard-grams")
    both = pairs.join(grams, "c").join(grams.select(F.col("c").alias("d"), F.col("grams").alias("others")), "d")
    return stage(both.mapInArrow(_verified, PAIR), "jaccard-links")


def _frequent(rows: DataFrame) -> np.ndarray:
    """The map of frequent grams, summed by words of 64 cells: at most 2^16 of them reach the driver."""
    cells = rows.select(F.explode("least").alias("gram")).groupBy("gram").agg(F.count("*").alias("k")).where(
        F.col("k") > FREQUENT).select(F.shiftrightunsigned("gram", 64 - MAP_BITS).alias("cell"))
    words = cells.groupBy(F.shiftright("cell", 6).alias("w")).agg(F.expr("bit_or(shiftleft(1L, cast(cell & 63 as int)))").alias("b"))
    out = np.zeros(1 << (MAP_BITS - 6), dtype=np.int64)
    for r in words.collect():
        out[r["w"]] = r["b"]
    return out.view(np.uint8)


def _compare(documents: DataFrame, doc: str, text: str, every: bool) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rows with size and class of their sets, the classes, and links (c, d) between classes: enough to connect what is
    connected or, with ``every``, all of them once."""
    docs = documents.select(F.col(f"`{doc}`").cast("bigint").alias("doc_id"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    docs = docs.withColumn("text_hash", F.xxhash64("text"))
    rows = stage(docs.mapInArrow(_sets, "doc_id bigint, text_hash bigint, n int, c bigint, sig binary, least array<bigint>"), "jaccard-sets")
    sets = rows.where(F.col("n") > 0)
    classes = stage(sets.groupBy("c").agg(F.min("doc_id").alias("id"), F.min("text_hash").alias("text_hash"), F.min("n").alias("n")),
                    "jaccard-classes")

    prefixes = stage(docs.select("text").mapInArrow(_prefixes(_frequent(sets)), "gram bigint, c bigint, n int, pos int"), "jaccard-prefixes")
    shared = prefixes.groupBy("gram").agg(F.min("c").alias("x"), F.max("c").alias("y")).where("x <> y").select("gram")
    shared = broadcast_if_small(stage(shared, "jaccard-shared"), 16)
    band = F.floor(F.log(F.col("n").cast("double")) / BAND + 1e-9).cast("int")
    member = stage(prefixes.join(shared, "gram", "left_semi").dropDuplicates(["gram", "c"]).withColumn("band", band), "jaccard-members")
    sigs = stage(sets.join(broadcast_if_small(stage(member.select("c").distinct(), "jaccard-ids"), 16), "c", "left_semi").groupBy("c").agg(
        F.max("sig").alias("sig"), F.max("n").alias("n")), "jaccard-signatures")

    # Stars: the pivot of a tile is its member with the most shared grams; each class is compared with its commonest pivot.
    if not every:
        weight = member.groupBy("c").agg(F.count("*").alias("k"))
        weighed = member.select("gram", "band", "c").join(weight, "c")
        pivots = weighed.groupBy("gram", "band").agg(F.max(F.struct("k", "c")).alias("p")).select("gram", "band", F.col("p.c").alias("d"))
        votes = member.select("gram", "band", "c").join(pivots, ["gram", "band"]).where("c <> d").groupBy("c", "d").agg(F.count("*").alias("k"))
        star = votes.groupBy("c").agg(F.max(F.struct("k", "d")).alias("p")).select("c", F.col("p.d").alias("d"))
        bounded = star.join(sigs, "c").join(sigs.select(F.col("c").alias("d"), F.col("sig").alias("other"), F.col("n").alias("m")), "d")
        first = _links(stage(bounded.mapInArrow(_bound_pairs, PAIR), "jaccard-star"), docs, classes)
        labels = stage(components(first, "c", "d"), "jaccard-labels")

    # Tiles with two labels, all pairs that no bound rules out.
    if every:
        known = sigs.select("c", "sig", F.col("c").alias("label"))
    else:
        known = sigs.join(labels, F.col("c") == F.col("node"), "left").select("c", "sig", F.coalesce("label", "c").alias("label"))
    small = known.select("c", "label")
    both = member.withColumn("own", F.explode(F.array(F.lit(True), F.lit(False)))).withColumn(
        "band", F.when(F.col("own"), F.col("band")).otherwise(F.col("band") + 1)).join(small, "c")
    size = both.groupBy("gram", "band").agg(F.count("*").alias("k"), F.min("label").alias("x"), F.max("label").alias("y"),
                                            F.max("own").alias("any")).where("x <> y and any")
    blocks = F.ceil(F.col("k") / BLOCK).cast("int")
    crowded = (F.col("k") > CROWD).alias("crowded")
    split = stage(both.join(size.select("gram", "band", blocks.alias("blocks"), crowded), ["gram", "band"]).withColumn(
        "block", F.pmod(F.col("c"), F.col("blocks")).cast("int")).withColumn(
        "with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))), "jaccard-tiles")
    wide = _signatures(split.where("crowded").select("c").distinct(), docs, classes)
    sized = split.where("not crowded").join(known.select("c", "sig"), "c").unionByName(split.where("crowded").join(wide, "c"))
    tiles = sized.select("gram", "band", F.least("block", "with").alias("low"), F.greatest("block", "with").alias("high"), "block", "own",
                         "c", "n", "pos", "label", "sig")
    pairs = tiles.repartition(*TILE).sortWithinPartitions(*TILE).mapInArrow(_tiles, PAIR).distinct()
    second = _links(stage(pairs, "jaccard-pairs"), docs, classes)
    return rows, classes, second if every else first.unionByName(second)


def jaccard_classes(documents: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``documents``: doc_id, text_hash, n_shingles and component_id (least id of the linked documents)."""
    rows, classes, links = _compare(documents, doc, text, False)
    linked = stage(components(links, "c", "d"), "jaccard-linked")
    named = classes.join(linked, F.col("c") == F.col("node"), "left").select("c", "id", F.coalesce("label", "c").alias("label"))
    least = named.groupBy("label").agg(F.min("id").alias("component_id"))
    answer = stage(named.join(least, "label").select("c", "component_id"), "jaccard-answer")
    out = rows.select("doc_id", "text_hash", "n", "c").join(answer, "c", "left")
    return out.select("doc_id", "text_hash", F.col("n").cast("bigint").alias("n_shingles"),
                      F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def jaccard_links(documents: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``documents``: doc_id, text_hash, n_shingles and n_links, the number of other rows that link to it.

    Rows of one class link to each other; a link between classes counts as often as the other class has rows. All pairs of
    classes that the bounds allow are verified, so a group of k near copies costs up to k * (k - 1) / 2 rows of pairs.
    """
    rows, _, links = _compare(documents, doc, text, True)
    size = stage(rows.where(F.col("n") > 0).groupBy("c").agg(F.count("*").alias("k")), "jaccard-sizes")
    both = links.unionByName(links.select(F.col("d").alias("c"), F.col("c").alias("d")))
    others = both.join(size.select(F.col("c").alias("d"), "k"), "d").groupBy("c").agg(F.sum("k").alias("others"))
    many = size.join(others, "c", "left").select("c", (F.col("k") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"))
    out = rows.select("doc_id", "text_hash", "n", "c").join(many, "c", "left")
    return out.select("doc_id", "text_hash", F.col("n").cast("bigint").alias("n_shingles"),
                      F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"))


def one_of_each(documents: DataFrame) -> DataFrame:
    """``documents`` without those that link, directly or through others, to a document of a lesser id.

    Of rows that share the least id one stays: the one of the least text. Texts without words are no copies of anything;
    they stay, as do rows of groups whose ids are all null.
    """
    out = jaccard_classes(documents)
    keep = out.where("n_shingles > 0 and doc_id = component_id").groupBy("doc_id").agg(F.min("text_hash").alias("text_hash"))
    drop = out.where("n_shingles > 0 and component_id is not null").join(
        keep, ["doc_id", "text_hash"], "left_anti").select(F.col("doc_id").alias("__d"), F.col("text_hash").alias("__h")).distinct()
    drop = broadcast_if_small(stage(drop, "jaccard-drop"), 24)
    text = F.xxhash64(F.coalesce(documents["text"], F.lit("")))
    return documents.join(drop, documents["doc_id"].eqNullSafe(F.col("__d")) & (text == F.col("__h")), "left_anti")


def jaccard_report(documents: DataFrame) -> DataFrame:
    """The digest per document."""
    return jaccard_classes(documents).select("doc_id", "n_shingles", "component_id")
