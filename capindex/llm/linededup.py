"""Line dedup by pairwise alignment.

A line ends at a line break or at the end of a sentence, so that passages inside paragraphs are lines too; long ones
are cut further by winnowing: of each ``WINDOW`` words without such an end, after the one of the least hash. Where a
passage of 51 words stands in two documents, the lines between its first and its last window are the same and have 25
words, whatever its script or its white space. Words are what white space separates. A *run* is the
shortest sequence of lines from a given one on that has ``MIN_WORDS`` words; short lines that recur by chance make no
run. Of the documents with a run, the first by id keeps it and every later one is paired with that first one, so a run
that is shared by many documents costs one pair each. The two documents of a pair are aligned by patience diff; common
blocks of ``MIN_WORDS`` words or more are deleted from the later document.

Every line that is deleted stands in an earlier document, so the first holder of a block always keeps it.

Scale: one pass makes 8-byte hashes of lines, which are staged; runs are derived from them where they are needed and move as
(run, document) of 16 bytes. One aggregation, with partial sums, finds the first holder of each run that comes twice; only those are joined
on. Pairs carry line hashes, not texts. Texts are read a second time, and only those that lose lines go through
Python. A run or a first document that many share makes a skewed join, which Spark splits, as each side is joined by one key.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from itertools import pairwise

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from capindex.llm.common import broadcast_if_small, stage

MIN_WORDS = 25
#: Of so many words in a row one ends a line. The first and the last window of a passage of 2 * WINDOW + MIN_WORDS - 1 = 50
#: words, and a word that tells whether its end is a line's, leave MIN_WORDS between them.
WINDOW = 13
_ENDS = re.compile(r"((?<=[.!?])[ \t]+|\s*\n\s*)")


_BASE = np.uint64(0x9E3779B97F4A7C15)
_TABLE = [np.ones(1, dtype=np.uint64), np.ones(1, dtype=np.uint64)]
_SPACE = np.array([chr(c).isspace() for c in range(0x3002)])
_PLACE = np.cumprod(np.full(1024, _BASE))
_LOW = np.uint64(0xFFFFFFFF)
#: Texts are hashed together up to so many characters.
CHARS = 200_000
#: Runs go back to Spark in batches of so many.
ROWS = 50_000
#: Counted bytes up to which a side of a join is broadcast.
BROADCAST = 32 << 20


def cut_lines(text: str) -> list[str]:
    """Lines and the gaps after them, in turn: ``"".join`` gives the text back.

    Lines of more than ``WINDOW`` words are cut by winnowing, in every document after the same words of a passage.
    """
    parts = _ENDS.split(text)
    starts, stops, hashes, ends = _words(text)
    at = np.flatnonzero(_winnow(hashes, ends) & ~ends)
    gaps, place = [], 0
    for k, p in enumerate(parts):
        if k % 2:
            gaps.append((place, place + len(p)))
        place += len(p)
    gaps += zip(stops[at].tolist(), starts[at + 1].tolist(), strict=True)
    out, place = [], 0
    for start, stop in sorted(gaps):
        out += (text[place:start], text[start:stop])
        place = stop
    out.append(text[place:])
    return out


def _words(text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Place, end and hash of each word, as ``text.split()`` has them, and whether it ends a line by ``_ENDS`` or the text."""
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    inside = np.concatenate([[False], ~_SPACE.take(c, mode="clip"), [False]])
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    starts, stops = edges[::2], edges[1::2]
    if not len(starts):
        return starts, stops, np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=bool)
    first = np.repeat(starts, stops - starts)
    chars = np.flatnonzero(inside[1:-1])
    upto = np.cumsum(stops - starts) - (stops - starts)
    h = np.add.reduceat(c[chars] * _PLACE[(chars - first) & 1023], upto)
    h = (h ^ (h >> np.uint64(32))) * _BASE
    h ^= h >> np.uint64(29)
    for k in np.flatnonzero(stops - starts > 1024):
        h[k] = xxhash.xxh3_64_intdigest(text[starts[k] : stops[k]].encode("utf-8", "surrogatepass"))
    breaks = np.searchsorted(np.flatnonzero(c == 10), edges[1:-1])
    after, before = c[stops[:-1]], c[stops[:-1] - 1]
    ends = (breaks[1::2] > breaks[::2]) | ((after == 32) | (after == 9)) & ((before == 46) | (before == 33) | (before == 63))
    return starts, stops, h, np.concatenate([ends, [True]])


def _winnow(hashes: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Which words end a line: those that do anyway, and of each ``WINDOW`` words without one the least by the upper half of
    its hash, the last one of equals."""
    out = ends.copy()
    if len(hashes) >= WINDOW:
        low = np.where(ends, np.uint64(0), hashes | np.uint64(1 << 32)) & ~_LOW
        low, have = low | (_LOW - np.arange(len(hashes), dtype=np.uint64)), 1
        while have < WINDOW:
            step = min(have, WINDOW - have)
            low = np.minimum(low[:-step], low[step:])
            have += step
        out[(_LOW - (low & _LOW)).astype(np.int64)] = True
    return out


def line_places(parts: list[str]) -> list[int]:
    """Places, among all lines of ``cut_lines``, of those that have words."""
    return [i for i, line in enumerate(parts[::2]) if line and not line.isspace()]


def _lines(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash and number of words of each line that has words, and the number of lines of each text. A line's hash is the
    polynomial of its words' hashes, so that white space inside a line does not count."""
    starts, _, h, ends = _words("\n".join(texts))
    if not len(starts):
        return np.zeros(0, dtype=np.int64), starts, np.zeros(len(texts), dtype=np.int64)
    last = np.flatnonzero(_winnow(h, ends))
    first = np.concatenate([[0], last[:-1] + 1])
    sizes = last - first + 1
    x = np.add.reduceat(h * _PLACE[np.arange(len(h)) - np.repeat(first, sizes)], first) + sizes.astype(np.uint64)
    x = (x ^ (x >> np.uint64(32))) * _BASE
    upto = np.cumsum([len(t) + 1 for t in texts])
    return (x ^ (x >> np.uint64(29))).view(np.int64), sizes, np.diff(np.searchsorted(starts[first], upto), prepend=0)


def line_hashes(text: str) -> tuple[list[int], list[int]]:
    """Hash and number of words of each line that has words."""
    hashes, sizes, _ = _lines([text])
    return hashes.tolist(), sizes.tolist()


def run_ends(sizes: list[int], least: int = MIN_WORDS) -> np.ndarray:
    """For each line the end (exclusive) of its run; only for the lines that have one."""
    upto = np.cumsum(np.array(sizes, dtype=np.int64))
    ends = np.searchsorted(upto, upto - np.array(sizes, dtype=np.int64) + least) + 1
    return ends[ends <= len(sizes)]


def runs(hashes: list[int], sizes: list[int], least: int = MIN_WORDS) -> list[int]:
    """Hash of each run."""
    return _runs(np.array(hashes, dtype=np.int64), np.array(sizes, dtype=np.int64), np.array([len(sizes)]), least)[0].tolist()


def _runs(hashes: np.ndarray, sizes: np.ndarray, lines: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each run of texts of so many lines, the polynomial of its lines' hashes from differences of running sums, and
    the number of runs of each text."""
    ends = run_ends(sizes, least)
    upto = np.cumsum(lines)
    at = np.flatnonzero(ends <= np.repeat(upto, lines)[: len(ends)])
    if not len(at):
        return np.zeros(0, dtype=np.int64), np.zeros(len(lines), dtype=np.int64)
    ends, h = ends[at], hashes.view(np.uint64)
    power, inverse = _powers(len(h))
    total = np.concatenate([[np.uint64(0)], np.cumsum(h * power, dtype=np.uint64)])
    x = (total[ends] - total[at]) * inverse[at] + ends.astype(np.uint64) - at.astype(np.uint64)
    x = (x ^ (x >> np.uint64(32))) * _BASE
    return (x ^ (x >> np.uint64(29))).view(np.int64), np.diff(np.searchsorted(at, upto), prepend=0)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number, modulo 2**64, and their inverses."""
    if len(_TABLE[0]) < n:
        size = 1 << n.bit_length()
        steps = np.full(size, _BASE)
        steps[0] = 1
        back = np.full(size, np.uint64(pow(int(_BASE), -1, 1 << 64)))
        back[0] = 1
        _TABLE[:] = [np.cumprod(steps, dtype=np.uint64), np.cumprod(back, dtype=np.uint64)]
    return _TABLE[0][:n], _TABLE[1][:n]


def _chain(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest part of pairs, sorted by the first place, that rises in the second (patience sorting)."""
    tops: list[int] = []
    ends: list[int] = []
    back = [-1] * len(pairs)
    for k, (_, j) in enumerate(pairs):
        at = bisect_left(tops, j)
        if at:
            back[k] = ends[at - 1]
        if at == len(tops):
            tops.append(j)
            ends.append(k)
        else:
            tops[at], ends[at] = j, k
    out, k = [], ends[-1] if ends else -1
    while k >= 0:
        out.append(pairs[k])
        k = back[k]
    return out[::-1]


def patience(a: list[int], b: list[int]) -> dict[int, int]:
    """Aligned places of ``a`` and ``b``: common ends, then lines that are unique on both sides, then between those."""
    match: dict[int, int] = {}
    todo = [(0, len(a), 0, len(b))]
    while todo:
        i0, i1, j0, j1 = todo.pop()
        while i0 < i1 and j0 < j1 and a[i0] == b[j0]:
            match[i0] = j0
            i0, j0 = i0 + 1, j0 + 1
        while i0 < i1 and j0 < j1 and a[i1 - 1] == b[j1 - 1]:
            i1, j1 = i1 - 1, j1 - 1
            match[i1] = j1
        if i0 >= i1 or j0 >= j1:
            continue
        once: dict[int, int] = {}
        for j in range(j0, j1):
            once[b[j]] = -1 if b[j] in once else j
        seen: dict[int, int] = {}
        for i in range(i0, i1):
            seen[a[i]] = -1 if a[i] in seen else i
        anchors = _chain([(i, once[x]) for x, i in seen.items() if i >= 0 and once.get(x, -1) >= 0])
        if not anchors:
            continue
        match.update(anchors)
        edges = [(i0 - 1, j0 - 1), *anchors, (i1, j1)]
        todo += [(i + 1, x, j + 1, y) for (i, j), (x, y) in pairwise(edges)]
    return match


def common_blocks(later: list[int], sizes: list[int], first: list[int], first_sizes: list[int], least: int = MIN_WORDS) -> list[int]:
    """Lines of ``later`` in common blocks of ``least`` words. Blocks that changed places, which an alignment crosses, are
    found by their runs afterwards and extended as far as they go."""
    if later == first:
        return list(range(len(later))) if sum(sizes) >= least else []
    match = patience(later, first)
    cut: set[int] = set()
    block: list[int] = []

    def close() -> None:
        if sum(sizes[i] for i in block) >= least:
            cut.update(block)
        block.clear()

    for i in sorted(match):
        if block and (i != block[-1] + 1 or match[i] != match[block[-1]] + 1):
            close()
        block.append(i)
    close()
    if len(cut) == len(later):
        return sorted(cut)
    own = runs(later, sizes, least)
    todo = [i for i in range(len(own)) if i not in cut or i + 1 not in cut]
    where: dict[int, int] = {}
    for j, r in enumerate(runs(first, first_sizes, least) if todo else []):
        where.setdefault(r, j)
    for i in todo:
        j = where.get(own[i], -1)
        if j < 0 or i in cut and i + 1 in cut:
            continue
        k = 0
        while i + k < len(later) and j + k < len(first) and later[i + k] == first[j + k]:
            k += 1
        if sum(sizes[i : i + k]) >= least:
            cut.update(range(i, i + k))
    return sorted(cut)


LINES = "doc_id bigint, text_hash bigint, hashes array<bigint>, sizes array<int>"


def _listed(values: np.ndarray, many: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(many)]).astype(np.int32)), pa.array(values))


def _unlisted(lists: pa.ListArray) -> list[list[int]]:
    values, at = lists.values.to_numpy().tolist(), lists.offsets.to_numpy().tolist()
    return [values[i:j] for i, j in pairwise(at)]


def _hash_lines(batches):
    """Hashes and sizes of the lines of each text."""
    schema = pa.schema([("doc_id", pa.int64()), ("text_hash", pa.int64()), ("hashes", pa.list_(pa.int64())), ("sizes", pa.list_(pa.int32()))])
    for batch in batches:
        texts = batch.column("text").to_pylist()
        at = 0
        while at < len(texts):
            stop, chars = at + 1, len(texts[at])
            while stop < len(texts) and chars + len(texts[stop]) <= CHARS:
                chars += len(texts[stop])
                stop += 1
            hashes, sizes, lines = _lines(texts[at:stop])
            b = batch.slice(at, stop - at)
            yield pa.RecordBatch.from_arrays([
                b.column("doc_id"), b.column("text_hash"), _listed(hashes, lines), _listed(sizes.astype(np.int32), lines)], schema=schema)
            at = stop


def _all_runs(least: int):
    """(run, n): every run of every document."""
    def run(batches):
        for b in batches:
            hashes, sizes = b.column("hashes"), b.column("sizes")
            lines = np.diff(hashes.offsets.to_numpy())
            found, many = _runs(hashes.flatten().to_numpy(), sizes.flatten().to_numpy().astype(np.int64), lines, least)
            n = np.repeat(b.column("n").to_numpy(), many)
            for at in range(0, len(found), ROWS):
                yield pa.RecordBatch.from_arrays([pa.array(found[at : at + ROWS]), pa.array(n[at : at + ROWS])], names=["run", "n"])

    return run


def _align(least: int):
    def run(batches):
        for b in batches:
            found = [common_blocks(*row, least) for row in zip(*[_unlisted(b.column(c)) for c in (
                "hashes", "sizes", "first_hashes", "first_sizes")], strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("text_hash"), pa.array(found, pa.list_(pa.int32()))],
                                             names=["doc_id", "text_hash", "cut"])

    return run


def _numbered(lines: DataFrame) -> DataFrame:
    """``lines`` with ``n``, which rises in the order of documents, and one row of equal documents.

    Where no id is null or comes twice, ``n`` is the id. Else documents are sorted and numbered, null ids last, rows of one id
    by the hash of their text, and the table is staged anew.
    """
    if lines.groupBy("doc_id").count().where("`count` > 1 or doc_id is null").isEmpty():
        return lines.select(F.col("doc_id").alias("n"), "*")
    one = lines.groupBy("doc_id", "text_hash").agg(F.min("row").alias("row"))
    order = one.orderBy(F.col("doc_id").asc_nulls_last(), "text_hash").select("row", F.monotonically_increasing_id().alias("n"))
    return stage(lines.join(broadcast_if_small(stage(order, "lines-order"), 16, BROADCAST), "row"), "lines-numbered")


def duplicate_lines(documents: DataFrame, doc: str = "doc_id", text: str = "text", least: int = MIN_WORDS) -> DataFrame:
    """(doc_id, text_hash, cut): the lines to delete, as numbers among a document's lines with words; documents with none are left out."""
    docs = documents.select(F.col(f"`{doc}`").cast("bigint").alias("doc_id"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    docs = docs.withColumn("text_hash", F.xxhash64("text"))
    lines = _numbered(stage(docs.mapInArrow(_hash_lines, LINES).withColumn("row", F.monotonically_increasing_id()), "lines"))
    spread = lines.select("n", "hashes", "sizes").mapInArrow(_all_runs(least), "run bigint, n bigint")
    # A run that only one document has, twice, meets no later document below.
    first = spread.groupBy("run").agg(F.min("n").alias("first"), F.count("*").alias("holders")).where("holders > 1").drop("holders")
    first = broadcast_if_small(stage(first, "lines-first"), 16, BROADCAST)
    pairs = stage(spread.join(first, "run").where("n <> first").select("n", "first").distinct(), "lines-pairs")
    paired = stage(pairs.select("n").union(pairs.select("first")).distinct(), "lines-paired")
    own = lines.select("n", "doc_id", "text_hash", "hashes", "sizes")
    if paired.count() * 16 <= BROADCAST:
        own = own.join(F.broadcast(paired), "n", "left_semi")
    else:  # staged, so that Spark can split the joins below at a document that many are paired with
        own = stage(own.join(paired, "n", "left_semi"), "lines-own")
    both = pairs.join(own, "n").join(own.select(
        F.col("n").alias("first"), F.col("hashes").alias("first_hashes"), F.col("sizes").alias("first_sizes")), "first")
    cuts = both.mapInArrow(_align(least), "doc_id bigint, text_hash bigint, cut array<int>").where(F.size("cut") > 0)
    return cuts.groupBy("doc_id", "text_hash").agg(F.sort_array(F.array_distinct(F.flatten(F.collect_list("cut")))).alias("cut"))


def _delete(text_column: str):
    def run(batches):
        for b in batches:
            texts = []
            for text, cut in zip(b.column(text_column).to_pylist(), b.column("__cut").to_pylist(), strict=True):
                parts, gone = cut_lines(text), set(cut)
                at = {p for k, p in enumerate(line_places(parts)) if k in gone}
                texts.append("".join(x for i, x in enumerate(parts) if i // 2 not in at).strip())
            i = b.schema.get_field_index(text_column)
            out = b.set_column(i, b.schema.field(i), pa.array(texts, b.schema.field(i).type))
            yield out.select([c for c in b.schema.names if c != "__cut"])

    return run


def dedup_lines(documents: DataFrame, doc: str = "doc_id", text: str = "text", least: int = MIN_WORDS) -> DataFrame:
    """``documents`` without the blocks that an earlier document has; documents left without a word go.

    All columns stay; ``n_chars``, if there, follows the new text. Null and blank texts pass unchanged. Null ids come
    last; rows of one id are ordered by a hash of their text, and equal rows are one document: they lose the same lines. Lines
    that a document repeats within itself stay.
    """
    cuts = stage(duplicate_lines(documents, doc, text, least), "lines-cuts").select(
        F.col("doc_id").alias("__doc"), F.col("text_hash").alias("__hash"), F.col("cut").alias("__cut"))
    size = cuts.agg(F.sum(F.size("__cut") * 4 + 32)).first()[0] or 0
    cuts = F.broadcast(cuts) if size <= BROADCAST else cuts
    same = documents[doc].cast("bigint").eqNullSafe(F.col("__doc")) & (F.xxhash64(F.coalesce(documents[text], F.lit(""))) == F.col("__hash"))
    joined = documents.join(cuts, same, "left").drop("__doc", "__hash")
    whole = joined.where(F.col("__cut").isNull()).drop("__cut")
    changed = joined.where(F.col("__cut").isNotNull()).mapInArrow(_delete(text), documents.schema)
    changed = changed.where(F.col(f"`{text}`") != "")
    if "n_chars" in documents.columns:
        changed = changed.withColumn("n_chars", F.char_length(f"`{text}`").cast(documents.schema["n_chars"].dataType))
    return whole.unionByName(changed)


def line_report(documents: DataFrame) -> DataFrame:
    """The deduplicated documents with a digest of their text: doc_id, n_chars and text_md5 of what is left, changed."""
    before = documents.select("doc_id", "text")
    out = dedup_lines(before.withColumn("was", F.md5(F.coalesce("text", F.lit("")))))
    text = F.coalesce("text", F.lit(""))
    return out.select("doc_id", F.char_length(text).cast("bigint").alias("n_chars"), F.md5(text).alias("text_md5"),
                      (F.md5(text) != F.col("was")).alias("changed"))
