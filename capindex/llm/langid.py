"""Language identification with language-bitmask n-gram filters.

A bit-sliced Bloom filter has, at each of its places, one bit per language. The AND of an n-gram's ``PROBES`` places is the
mask of all languages that contain it. For each language the set bits over a text's n-grams are counted and corrected for
false positives (fill share to the power of ``PROBES``); n-grams of every language count for none. The language with the
largest corrected share decides.

Learning: per language, the n-grams that occur in at least ``MIN_SHARE`` of its documents, from a sample of about ``SAMPLE``
documents per language, chosen by a hash of the id. A language has at most (mean different n-grams of a document) /
``MIN_SHARE`` of them, whatever the size of the corpus; they are the only thing that reaches the driver, and the filter
grows with them until a language's false positives stay below ``WRONG``. Texts are never shuffled: documents per language
are counted first, the few counts are joined with the scan, and a task sends on its counts of n-grams. Prediction is one
pass without a shuffle, a text at a time, in slices of ``SLICE`` characters, so that very long texts need little memory.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from capindex.llm.common import broadcast_if_small, stage

N = 4
PROBES = 3
SAMPLE = 3000
MIN_SHARE = 0.01
#: Share of the unknown n-grams that a language's filter may take for known ones.
WRONG = 0.01
SLICE = 1 << 19
SAMPLE_STEPS = 1_000_000
_OTHER = re.compile(r"[\W\d_]+")
_PRIMES = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)]


def held_out(doc: Column) -> Column:
    """The rows that nothing is learned from; null ids are not held out, but not learned from either."""
    return F.coalesce(F.crc32(doc.cast("string")) % 3 == 1, F.lit(False))


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


def gram_hashes(text: str):
    """Hashes of the n-grams of the lower-case letters, words apart by one blank; one array per slice."""
    for at in range(0, len(text), SLICE):
        # A slice reaches N - 1 characters into the next one.
        part = " " + _OTHER.sub(" ", text[at : at + SLICE + N - 1].lower()) + "  "
        x = np.frombuffer(part.encode("utf-32-le", "replace"), dtype=np.uint32).astype(np.uint64)
        h = x[: len(x) - N + 1] * _PRIMES[0]
        for k in range(1, N):
            h = (h ^ x[k : len(x) - N + 1 + k]) * _PRIMES[k]
        yield h ^ (h >> np.uint64(31))


@dataclass(frozen=True)
class Model:
    """languages in order; filter of shape (places, words of 64 languages); false positive rate per language; the language
    that was learned from most documents, for texts without a known n-gram."""

    languages: list[str]
    filter: np.ndarray
    wrong: np.ndarray
    usual: str = "und"

    def masks(self, h: np.ndarray) -> np.ndarray:
        out = None
        for p in places(h, len(self.filter)):
            row = self.filter[p]
            out = row if out is None else out & row
        return out

    def predict(self, text: str | None) -> tuple[str, float]:
        if not self.languages or not has_letter(text):
            return "und", 0.0
        hits, total = np.zeros(len(self.languages), dtype=np.int64), 0
        for h in gram_hashes(text):
            m = self.masks(h)
            of = np.bitwise_count(m).sum(axis=1)
            m = m[of < max(2, len(self.languages))]  # what every language has says nothing
            hits += np.array([int(((m[:, i >> 6] >> np.uint64(i & 63)) & np.uint64(1)).sum()) for i in range(len(hits))])
            total += len(h)
        share = np.clip((hits / max(1, total) - self.wrong) / (1 - self.wrong), 0, 1)
        if not share.any():
            return self.usual, 0.0
        best = int(np.argmax(share))
        return self.languages[best], float(share[best] / share.sum())


def places(h: np.ndarray, size: int):
    """``PROBES`` places of each hash, by double hashing."""
    step = (h >> np.uint64(32)) | np.uint64(1)
    for k in range(PROBES):
        yield ((h + np.uint64(k) * step) & np.uint64(size - 1)).astype(np.int64)


def build(grams: dict[str, np.ndarray], usual: str = "und") -> Model:
    """The filter of each language's n-gram hashes. With n of them a share of ``PROBES`` * n / size of the places is set, at
    most, so the size follows from ``WRONG``; it is a power of two."""
    languages = sorted(grams)
    largest = max((len(g) for g in grams.values()), default=1)
    size = 1 << max(12, int(PROBES * largest / WRONG ** (1 / PROBES)).bit_length())
    bits = np.zeros((size, max(1, -(-len(languages) // 64))), dtype=np.uint64)
    wrong = np.zeros(len(languages))
    for i, lang in enumerate(languages):
        bit = np.uint64(1) << np.uint64(i & 63)
        for p in places(grams[lang], size):
            bits[p, i >> 6] |= bit
        wrong[i] = ((bits[:, i >> 6] & bit) != 0).mean() ** PROBES
    return Model(languages, bits, wrong, usual)


def _distinct(batches):
    """(lang, gram, documents with it), counted per batch; a null gram counts the documents."""
    for b in batches:
        docs: dict[str, int] = {}
        seen: dict[str, list[np.ndarray]] = {}
        for lang, text in zip(b.column("lang").to_pylist(), b.column("text").to_pylist(), strict=True):
            docs[lang] = docs.get(lang, 0) + 1
            if has_letter(text):
                seen.setdefault(lang, []).append(np.unique(np.concatenate(list(gram_hashes(text)))))
        yield pa.RecordBatch.from_arrays([pa.array(list(docs), pa.string()), pa.nulls(len(docs), pa.int64()),
                                          pa.array(list(docs.values()), pa.int64())], names=["lang", "gram", "k"])
        for lang, arrays in seen.items():
            g, k = np.unique(np.concatenate(arrays), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(g)), pa.array(g.view(np.int64)), pa.array(k)], names=["lang", "gram", "k"])


def gram_counts(rows: DataFrame, count: DataFrame) -> DataFrame:
    """(lang, gram, k) over a sample of ``rows`` (key, text, lang); a null gram counts the documents.

    ``count`` has the rows of each language. It is joined with the scan, and is small: a model has a bit row per language."""
    part = F.pmod(F.xxhash64("key"), F.lit(SAMPLE_STEPS)) < F.lit(SAMPLE_STEPS * SAMPLE) / F.col("all")
    sample = rows.join(broadcast_if_small(count, 64), "lang").where(part)
    return sample.select("lang", "text").mapInArrow(_distinct, "lang string, gram bigint, k bigint").groupBy("lang", "gram").agg(F.sum("k").alias("k"))


def learn(labelled: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang") -> tuple[dict[str, np.ndarray], str]:
    """The common n-grams of each language, sorted, and the language of most documents (ties: the last by name)."""
    rows = labelled.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").cast("string").alias("text"),
                           F.col(f"`{lang}`").cast("string").alias("lang")).where("text is not null and lang is not null and key is not null")
    count = stage(rows.groupBy("lang").agg(F.count("*").alias("all")), "langid-counts")
    counts = stage(gram_counts(rows, count), "langid-grams")
    docs = counts.where("gram is null").select("lang", F.col("k").alias("docs"))
    often = counts.where("gram is not null").join(broadcast_if_small(docs, 64), "lang").where(
        F.col("k") >= F.greatest(F.lit(2), F.col("docs") * MIN_SHARE))
    found = often.select("lang", "gram").toArrow()
    names = np.array(found.column("lang").to_pylist(), dtype=object)
    hashes = found.column("gram").to_numpy().view(np.uint64)
    # A language that is too rare for a common n-gram is still a learned one.
    total = {r["lang"]: r["all"] for r in count.join(broadcast_if_small(docs, 64), "lang", "left_semi").collect()}
    return {k: np.sort(hashes[names == k]) for k in total}, max(((n, k) for k, n in total.items()), default=(0, "und"))[1]


def train(labelled: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang") -> Model:
    """Learn from rows with a text and a language; others are left out. No such rows: a model without languages."""
    return build(*learn(labelled, key, text, lang))


def identify(documents: DataFrame, model: Model, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, lang_pred and score (0 to 1) of every row; ``und`` and 0 for null texts and texts without a letter."""
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = shared.value
        for b in batches:
            found = [m.predict(t) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([f[0] for f in found], pa.string()),
                                              pa.array([f[1] for f in found], pa.float64())], names=["doc_id", "lang_pred", "score"])

    rows = documents.select(F.col(f"`{doc}`").cast("bigint").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id bigint, lang_pred string, score double")


def language_report(documents: DataFrame) -> DataFrame:
    """The digest per document; learns only from rows that are not held out."""
    model = train(documents.select("doc_id", "text", "lang").where(~held_out(F.col("doc_id"))))
    return identify(documents, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
