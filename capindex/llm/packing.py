"""Packing along a space-filling curve.

Every document's token counts are hashed to a vector, projected to ``DIMS`` dimensions and placed on a Hilbert curve.
Documents are range-sorted by their place on the curve; laid end to end in that order, they are one stream of tokens
that is cut every ``LENGTH`` ids. So neighbours in a sequence are alike, and only the very last sequence has padding.

Scale: one pass tokenizes and stages the ids (2 bytes each). The sort moves (row, place, count) only, and the start of
each document in the stream is a running sum inside its range plus the sum of the ranges before, of which there are as
many as shuffle partitions. Equal places (copies of one text) are sorted on by row number, so they are cut into ranges like
others. Pieces are made where the ids were staged: the join brings the starts to the ids.

Null texts count as empty and have the closing id only; equal rows are documents of their own; an empty table has no
pieces.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from capindex.llm.common import broadcast_if_small, stage

LENGTH = 4096
END_ID = 2
DIMS, ORDER, BUCKETS = 3, 10, 1024
#: Bytes of text that are tokenized together (or one longer text).
CHUNK_BYTES = 8 << 20
#: Words whose ids a worker remembers: of those that were not alone in their chunk, and up to so many letters.
_KEPT_WORDS, _KEPT_LETTERS = 300_000, 32


class WordTokens:
    """Token ids of whole texts, each different word of a chunk encoded once. Only the ids of a bounded number of words (some
    60 MB) are kept from one chunk to the next: words that were seen twice, as most others do not come again.

    The tokenizer's pattern never joins characters across white space, and a run of letters never joins the mark after
    it, so the ids of a text are those of its words in order. Words are cut at ASCII white space only.
    """

    def __init__(self, vocabulary: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(vocabulary)
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        vocabulary_ids = self.tokenizer.get_vocab()
        self.ends_word = np.zeros(max(vocabulary_ids.values()) + 1, dtype=bool)
        self.ends_word[[i for token, i in vocabulary_ids.items() if token.endswith("</w>")]] = True
        self.kept: dict[bytes, bytes] = {}

    def _encode(self, pieces: list[bytes]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast([p.decode() for p in pieces], add_special_tokens=False)
        return [np.array(e.ids, dtype=self.dtype).tobytes() for e in found]

    def _encode_letters(self, stems: list[bytes]) -> list[bytes]:
        """Runs of letters are one word each to the tokenizer, so that many are encoded as one text and told apart by the
        tokens that end a word; where a letter's lower case is no letter, their number differs and they are encoded one by one."""
        out: list[bytes] = []
        for at in range(0, len(stems), 2000):
            part = stems[at : at + 2000]
            ids = np.array(self.tokenizer.encode_batch_fast([b" ".join(part).decode()], add_special_tokens=False)[0].ids, dtype=self.dtype)
            ends = np.flatnonzero(self.ends_word[ids])
            if len(ends) != len(part) or ends[-1] != len(ids) - 1:
                out += self._encode(part)
                continue
            raw, ends = ids.tobytes(), ((ends + 1) * self.dtype.itemsize).tolist()
            out += [raw[a:b] for a, b in zip([0, *ends], ends, strict=False)]
        return out

    @staticmethod
    def _split(word: bytes) -> tuple[bytes, bytes, bool]:
        """Stem, mark after it, and whether the stem is a run of letters."""
        if word.isalpha():
            return word, b"", True
        mark = word[-1:] if word[-1] in b".,;:!?" else b""
        stem = word[:-1] if mark else word
        if stem.isalpha():
            return stem, mark, True
        if not stem.isascii() and stem.decode().isalpha():
            return stem, mark, True
        return word, b"", False

    def _of_words(self, words: list[bytes]) -> list[bytes]:
        """Ids of each word, as bytes."""
        parts = [self._split(w) if w else (b"", b"", True) for w in words]
        letters = list({a for a, _, run in parts if run and a})
        known = dict(zip(letters, self._encode_letters(letters), strict=True))
        others = list({p for a, b, run in parts for p in ((b,) if run else (a,)) if p} - known.keys())
        known.update(zip(others, self._encode(others), strict=True))
        known[b""] = b""
        return [known[a] + known[b] if b else known[a] for a, b, _ in parts]

    def ids(self, texts: list[str | None]) -> list[np.ndarray]:
        lowered = pa.array([_lowered((t or "").encode()) for t in texts], pa.large_binary()).cast(pa.large_string())
        split = pc.ascii_split_whitespace(lowered)
        coded = split.flatten().dictionary_encode()
        code = coded.indices.to_numpy(zero_copy_only=False)
        words = coded.dictionary.cast(pa.large_binary()).to_pylist()
        blobs = list(map(self.kept.get, words))
        new = [i for i, b in enumerate(blobs) if b is None]
        often = (np.bincount(code, minlength=len(words)) > 1).tolist()
        for i, b in zip(new, self._of_words([words[i] for i in new]), strict=True):
            blobs[i] = b
            if often[i] and len(self.kept) < _KEPT_WORDS and len(words[i]) <= _KEPT_LETTERS:
                self.kept[words[i]] = b
        flat = np.frombuffer(b"".join(blobs), dtype=self.dtype)
        size = np.fromiter(map(len, blobs), dtype=np.int64, count=len(blobs)) // self.dtype.itemsize
        first = np.cumsum(size) - size
        each = size[code]
        ends = np.concatenate([[0], np.cumsum(each)])
        # the ids of the words one after the other: place in the list of different words' ids
        ids = flat[np.repeat(first[code] - ends[:-1], each) + np.arange(ends[-1])] if len(flat) else flat
        of_text = ends[np.concatenate([[0], np.cumsum(pc.list_value_length(split).to_numpy(zero_copy_only=False))]).astype(np.int64)]
        return [ids[i:j] for i, j in zip(of_text[:-1].tolist(), of_text[1:].tolist(), strict=True)]


def _lowered(text: bytes) -> bytes:
    """The tokenizer lower-cases; doing so for ASCII first makes fewer words. Not where it could spell a special token."""
    return text if b"<|" in text else text.lower()


_LOADED: dict[int, WordTokens] = {}


def _tokens_of(vocabulary: str) -> WordTokens:
    """The worker's tokenizer, kept from one task to the next."""
    key = zlib.crc32(vocabulary.encode())
    if key not in _LOADED:
        _LOADED.clear()
        _LOADED[key] = WordTokens(vocabulary)
    return _LOADED[key]


def hilbert(points: np.ndarray, order: int = ORDER) -> np.ndarray:
    """Places on the Hilbert curve of integer points (rows of ``[0, 2**order)`` in any dimension), by Gray-code rotations
    from the highest bit down."""
    x = points.astype(np.int64).T.copy()
    dims = len(x)
    bit = 1 << (order - 1)
    while bit > 1:
        low = bit - 1
        for i in range(dims):
            high = (x[i] & bit) != 0
            swap = np.where(high, 0, (x[0] ^ x[i]) & low)
            x[0] = np.where(high, x[0] ^ low, x[0] ^ swap)
            x[i] ^= swap
        bit >>= 1
    for i in range(1, dims):
        x[i] ^= x[i - 1]
    turn = np.zeros_like(x[0])
    bit = 1 << (order - 1)
    while bit > 1:
        turn = np.where((x[-1] & bit) != 0, turn ^ (bit - 1), turn)
        bit >>= 1
    x ^= turn
    place = np.zeros_like(x[0])
    for b in range(order - 1, -1, -1):
        for i in range(dims):
            place = (place << 1) | ((x[i] >> b) & 1)
    return place


def _projection() -> np.ndarray:
    return np.random.RandomState(9).standard_normal((BUCKETS, DIMS))


def curve_places(ids: list[np.ndarray], projection: np.ndarray) -> np.ndarray:
    """Places of documents: hashed counts (logarithms, unit length), projected and cut to ``ORDER`` bits per dimension."""
    row = np.repeat(np.arange(len(ids)), [len(x) for x in ids])
    hashed = (np.concatenate(ids).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - 10)
    v = np.log1p(np.bincount(row * BUCKETS + hashed.astype(np.int64), minlength=len(ids) * BUCKETS).reshape(len(ids), BUCKETS))
    at = (v @ projection) / np.maximum(1e-9, np.sqrt((v * v).sum(axis=1)))[:, None]
    return hilbert(np.clip((at / 6 + 0.5) * (1 << ORDER), 0, (1 << ORDER) - 1).astype(np.int64))


def _tokenize(vocabulary):
    schema = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("n", pa.int64()), ("place", pa.int64()), ("ids", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]):
        words, projection = _tokens_of(vocabulary.value), _projection()
        end = np.array([END_ID], dtype=words.dtype)
        for batch in batches:
            size = pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            chunk = np.cumsum(size) // CHUNK_BYTES
            for at in np.flatnonzero(np.diff(chunk, prepend=-1)).tolist():
                b = batch.slice(at, int(np.searchsorted(chunk, chunk[at], side="right")) - at)
                ids = [np.concatenate([x, end]) for x in words.ids(b.column("text").to_pylist())]
                places = [curve_places(ids[i : i + 512], projection) for i in range(0, len(ids), 512)]
                yield pa.RecordBatch.from_arrays([
                    b.column("row"), b.column("doc_id"), pa.array([len(x) for x in ids], pa.int64()),
                    pa.array(np.concatenate(places)), pa.array([x.tobytes() for x in ids], pa.binary())], schema=schema)

    return run


def _running(batches):
    """Start of each row within its range, in the order of the rows."""
    total, part = 0, TaskContext.get().partitionId()
    for b in batches:
        n = b.column("n").to_numpy()
        ends = total + np.cumsum(n)
        yield pa.RecordBatch.from_arrays([b.column("row"), b.column("n"), pa.array(np.full(len(n), part, dtype=np.int64)),
                                          pa.array(ends - n)], names=["row", "n", "part", "within"])
        total = int(ends[-1]) if len(n) else total


def _cut(width: int):
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"]

    def run(batches):
        for b in batches:
            docs, starts, blobs = b.column("doc_id").to_pylist(), b.column("stream").to_pylist(), b.column("ids").to_pylist()
            out: list[list] = [[] for _ in names]
            for doc, stream, blob, n in zip(docs, starts, blobs, b.column("n").to_pylist(), strict=True):
                ids = np.frombuffer(blob, dtype="<u2" if len(blob) == 2 * n else "<u4").astype("<u4")
                at = 0
                while at < n:
                    offset = (stream + at) % width
                    k = min(n - at, width - offset)
                    piece = ids[at : at + k].tobytes()
                    for col, v in zip(out, (doc, at, k, zlib.crc32(piece), n, (stream + at) // width, offset, piece), strict=True):
                        col.append(v)
                    at += k
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out[:-1]] + [pa.array(out[-1], pa.binary())], names=names)

    return run


PIECE = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint, ids binary"


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def pack(documents: DataFrame, vocabulary: str | None = None, length: int = LENGTH, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """Pieces of documents in sequences: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, ids (uint32, little-endian).

    ``vocabulary`` is the tokenizer file on the driver; its content (a few MB) is broadcast.
    """
    spark = documents.sparkSession
    with open(vocabulary or default_vocabulary(), encoding="utf-8") as f:
        content = spark.sparkContext.broadcast(f.read())
    rows = documents.select(F.monotonically_increasing_id().alias("row"), F.col(f"`{doc}`").cast("bigint").alias("doc_id"),
                            F.col(f"`{text}`").cast("string").alias("text"))
    tokens = stage(rows.mapInArrow(_tokenize(content), "row bigint, doc_id bigint, n bigint, place bigint, ids binary"), "pack-tokens")
    order = tokens.select("row", "n", "place").repartitionByRange("place", "row").sortWithinPartitions("place", "row")
    order = stage(order.select("row", "n").mapInArrow(_running, "row bigint, n bigint, part bigint, within bigint"), "pack-order")
    # One row per range: the window below is over that many rows, not over documents.
    sums = order.groupBy("part").agg(F.sum("n").alias("s"))
    before = sums.select("part", (F.sum("s").over(Window.orderBy("part")) - F.col("s")).alias("before"))
    starts = order.join(F.broadcast(before), "part").select("row", (F.col("before") + F.col("within")).alias("stream"))
    starts = broadcast_if_small(stage(starts, "pack-starts"), 24)
    return tokens.join(starts, "row").select("doc_id", "n", "stream", "ids").mapInArrow(_cut(length), PIECE)


def sequences(pieces: DataFrame, length: int = LENGTH, pad: int = 0) -> DataFrame:
    """sequence_id, ids (array of ints): pieces in order, padded to ``length`` unless their number is a power of two."""

    def join(key, t):
        t = t.sort_by("offset")
        ids = np.frombuffer(b"".join(t.column("ids").to_pylist()), dtype="<u4").astype(np.int32)
        if len(ids) & (len(ids) - 1):
            ids = np.concatenate([ids, np.full(length - len(ids), pad, dtype=np.int32)])
        return pa.table({"sequence_id": pa.array([key[0].as_py()], pa.int64()), "ids": pa.array([ids], pa.list_(pa.int32()))})

    return pieces.select("sequence_id", "offset", "ids").groupBy("sequence_id").applyInArrow(join, "sequence_id bigint, ids array<int>")


def packing_report(documents: DataFrame) -> DataFrame:
    """The digest per piece."""
    return pack(documents).drop("ids")
