"""Periodic run detection by multi-scale minimizers.

A run is a stretch of consecutive words with smallest period q (words q apart are equal) and length >= max(``SHORTEST``,
``TIMES`` * q) that no neighbouring word extends with that period. Texts of a batch are one array of word codes with a code of
its own between any two texts, so no run leaves its text.

* Periods up to ``DIRECT`` are too short for minimizers: the lags 1 .. DIRECT are scanned directly.
* A scale P = 2 ``DIRECT``, 4 ``DIRECT``, ... finds the periods in (P/2, P]. Its seeds are hashes of P words; a place is a
  minimizer if it holds the least hash of some window of P/2 + 1 places. Inside a run of period q > P/2, P equal words
  occur again after q words and not before (they hold a whole period, which is no power of a shorter one), and windows q
  apart are equal, so their minima stand q apart: the run has two neighbouring equal minimizers at the distance q. A run of
  4 q words is long enough for that: q + P/2 + P <= 4 q.
* Every such pair is extended to both sides while words q apart are equal. Each lag is scanned only around its pairs, and once
  for a stretch. The stretch's smallest period decides: of stretches with equal start and length the least period stays.

``find_runs`` needs no shuffle: a text is one row, a task holds ``CHUNK_WORDS`` words or one longer text.

Defined cases: null and blank texts have no words and no runs, and collapse to an empty text; an empty table gives no rows; equal
rows give equal results; rows keep their null ids. Other columns are not read, so that their names can't clash.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from capindex.llm.common import words_of

SHORTEST = 6
TIMES = 4
DIRECT = 8
CHUNK_WORDS = 400_000
RUNS = "array<struct<start: bigint, length: bigint, period: bigint>>"


def _stretches(equal: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the stretches of at least ``least`` true entries."""
    edge = np.flatnonzero(np.diff(equal.astype(np.int8), prepend=0, append=0))
    start, end = edge[::2], edge[1::2]
    long_enough = end - start >= least
    return start[long_enough], end[long_enough]


def _slide(x: np.ndarray, size: int, pick) -> np.ndarray:
    """``pick`` (np.minimum or np.maximum) over each window of ``size`` entries, by doubling."""
    got = 1
    while got < size:
        step = min(got, size - got)
        x = pick(x[: len(x) - step], x[step:])
        got += step
    return x


def _minimizers(h: np.ndarray, window: int) -> np.ndarray:
    """Places that hold the least hash of some window."""
    if len(h) < window:
        return np.zeros(0, dtype=np.int64)
    least = _slide(h, window, np.minimum)
    around = np.concatenate([np.zeros(window - 1, dtype=h.dtype), least, np.zeros(window - 1, dtype=h.dtype)])
    return np.flatnonzero(_slide(around, window, np.maximum) == h)


def _doubled(h: np.ndarray, width: int) -> np.ndarray:
    """Hashes of 2 * ``width`` words from those of ``width`` words."""
    if len(h) <= width:
        return h[:0]
    x = h[: len(h) - width] * np.uint64(0x9E3779B97F4A7C15) + h[width:]
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


def _reach(x: np.ndarray, lag: int, at: int, step: int) -> int:
    """How many words beyond ``at`` (to the right, or to the left for ``step`` -1) equal those ``lag`` further on."""
    size, reach = 64, 0
    while True:
        if step > 0:
            a = x[at + reach : min(at + reach + size, len(x) - lag)]
            differ = np.flatnonzero(a != x[at + reach + lag : at + reach + lag + len(a)])
        else:
            lo = max(0, at - reach - size + 1)
            a = x[lo : max(lo, at - reach + 1)]
            differ = np.flatnonzero((a != x[lo + lag : lo + lag + len(a)])[::-1])
        if len(differ):
            return reach + int(differ[0])
        reach += len(a)
        if len(a) < size:
            return reach
        size *= 4


def runs_of(x: np.ndarray, longest: int) -> np.ndarray:
    """Rows (start, length, period) by start, then period: all runs in the codes ``x``, whose texts have at most ``longest``
    words."""
    found = []
    for q in range(1, min(DIRECT, longest // TIMES) + 1):
        start, end = _stretches(x[:-q] == x[q:], max(SHORTEST, TIMES * q) - q)
        found.append(np.stack([start, end - start + q, np.full(len(start), q)], axis=1))
    h, width = x.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F), 1
    scale = 2 * DIRECT
    while TIMES * (scale // 2 + 1) <= longest:
        while width < scale:
            h, width = _doubled(h, width), 2 * width
        at = _minimizers(h, scale // 2 + 1)
        at = at[np.argsort(h[at], kind="stable")]
        lag = np.diff(at)
        pair = np.flatnonzero((h[at[1:]] == h[at[:-1]]) & (lag > scale // 2) & (lag <= scale))
        done: dict[int, int] = {}
        rows = []
        for p, q in sorted(zip(at[pair].tolist(), lag[pair].tolist(), strict=True)):
            if p < done.get(q, 0):
                continue
            left, right = _reach(x, q, p - 1, -1), _reach(x, q, p, 1)
            done[q] = p + right
            if left + right + q >= max(SHORTEST, TIMES * q):
                rows.append((p - left, left + right + q, q))
        if rows:
            found.append(np.array(rows))
        scale *= 2
    runs = np.concatenate(found) if found else np.zeros((0, 3), dtype=np.int64)
    runs = runs[np.lexsort((runs[:, 2], runs[:, 1], runs[:, 0]))]
    same = np.zeros(len(runs), dtype=bool)
    same[1:] = (runs[1:, :2] == runs[:-1, :2]).all(axis=1)
    runs = runs[~same]
    return runs[np.lexsort((runs[:, 2], runs[:, 0]))]


def _coded(texts: list[bytes]) -> tuple[list[list[bytes]], np.ndarray, np.ndarray]:
    """Words of each text, all codes (a code of its own after each text), and where each text starts."""
    words = [t.split() for t in texts]  # bytes are split at blanks and the control characters tab to CR
    size = np.array([len(w) for w in words], dtype=np.int64)
    start = np.cumsum(size + 1) - size - 1
    x = np.empty(int(size.sum()) + len(words), dtype=np.int64)
    end = start + size
    inside = np.ones(len(x), dtype=bool)
    inside[end] = False
    code: dict[bytes, int] = {}
    x[inside] = np.fromiter((code.setdefault(w, len(code)) for ws in words for w in ws), dtype=np.int64, count=int(size.sum()))
    x[end] = len(code) + np.arange(len(words))
    return words, x, start


def _find(texts: list[bytes]):
    """(words, rows of runs with starts inside the text, whether each word stays) of each text."""
    words, x, start = _coded(texts)
    runs = runs_of(x, max(map(len, words), default=0))
    of = np.searchsorted(start, runs[:, 0], side="right") - 1
    # a word goes if some run holds it after that run's first period
    gone = np.zeros(len(x) + 1, dtype=np.int64)
    np.add.at(gone, runs[:, 0] + runs[:, 2], 1)
    np.add.at(gone, runs[:, 0] + runs[:, 1], -1)
    stays = np.cumsum(gone) == 0
    runs = runs.copy()
    runs[:, 0] -= start[of]
    bounds = np.searchsorted(of, np.arange(len(words) + 1))
    for i, ws in enumerate(words):
        yield ws, runs[bounds[i] : bounds[i + 1]], stays[start[i] : start[i] + len(ws)]


def _parts(texts: list[bytes]):
    """Texts in lists of about ``CHUNK_WORDS`` words (six bytes each), or of one longer text."""
    held, size = [], 0
    for t in texts:
        if held and size + len(t) > 6 * CHUNK_WORDS:
            yield held
            held, size = [], 0
        held.append(t)
        size += len(t)
    if held:
        yield held


def _batches(batches):
    for b in batches:
        for texts, at in _placed(pc.fill_null(b.column("text"), "").cast(pa.binary()).to_pylist()):
            runs, collapsed, digest = [], [], []
            for words, rows, stays in _find(texts):
                runs.append([{"start": s, "length": n, "period": q} for s, n, q in rows.tolist()])
                if not len(rows):
                    kept = b" ".join(words)
                else:
                    kept = b" ".join(w for w, s in zip(words, stays.tolist(), strict=True) if s)
                collapsed.append(kept.decode("utf-8", "replace"))
                digest.append(hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in rows.tolist()).encode()).hexdigest())
            kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
            yield pa.RecordBatch.from_arrays([b.column("key").slice(at, len(texts)), pa.array(runs, kind), pa.array(collapsed, pa.string()),
                                              pa.array(digest)], names=["key", "runs", "collapsed", "runs_sha256"])


def _placed(texts: list[bytes]):
    at = 0
    for part in _parts(texts):
        yield part, at
        at += len(part)


def find_runs(documents: DataFrame, key: str = "doc_id", text: str | Column = "text") -> DataFrame:
    """key, runs (start, length, period; by start, then period), collapsed (words of which each run keeps its first period,
    one blank apart) and runs_sha256 (of ``start,length,period`` lines) of every row."""
    text = F.col(f"`{text}`") if isinstance(text, str) else text
    rows = documents.select(F.col(f"`{key}`").alias("key"), text.cast("string").alias("text"))
    kind = rows.schema["key"].dataType.simpleString()
    out = rows.mapInArrow(_batches, f"key {kind}, runs {RUNS}, collapsed string, runs_sha256 string")
    return out.select(F.col("key").alias(key), "runs", "collapsed", "runs_sha256")


def planted(doc: Column, text: Column) -> Column:
    """The contract's test texts: where crc32(doc) % 10 = 0, the words from a on repeat with period p. Null ids have no crc32."""
    h = F.crc32(doc.cast("string"))
    g = F.floor(h / 10)

    def repeated(words: Column) -> Column:
        n = F.size(words)
        a = g % n
        p = F.lit(1) + F.floor((n - a) / (F.lit(3) + g % 8))
        at = F.sequence(F.lit(0).cast("bigint"), n.cast("bigint") - 1)
        return F.when(n > 0, F.array_join(F.transform(at, lambda i: F.get(words, F.when(i < a, i).otherwise(a + (i - a) % p).cast("int"))), " "))

    # inside transform() the words are a variable, split once; as an expression they would be split at every place
    return F.when(h % 10 == 0, F.coalesce(F.get(F.transform(F.array(words_of(text)), repeated), F.lit(0)), text)).otherwise(text)


def run_report(documents: DataFrame) -> DataFrame:
    """The contract's columns: the run of greatest length / period, and digests."""
    found = find_runs(documents, "doc_id", planted(F.col("doc_id"), F.col("text").cast("string")))
    # exact: a/p > b/q compares a * q with b * p; later runs win only if they are strictly better
    best = F.aggregate("runs", F.get("runs", F.lit(0)), lambda acc, r: F.when(r["length"] * acc["period"] > acc["length"] * r["period"], r).otherwise(acc))
    return found.select("doc_id", F.size("runs").cast("bigint").alias("n_runs"), best.alias("b"), "runs_sha256", F.sha2("collapsed", 256).alias("collapsed_sha256")).select(
        "doc_id", "n_runs", "b.start", "b.length", "b.period", F.expr("(1000 * b.length) div b.period").alias("exponent_milli"),
        "runs_sha256", "collapsed_sha256")
