import zlib
from collections import defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

from capindex.llm.packing import WordTokens, default_vocabulary, hilbert, pack, packing_report, sequences

ODD = ["<|endoftext|> hi", "<|ENDOFTEXT|> Hi", "É É Z̈ ß ẞ", "a\x1cb\x85c\xa0d é ÀÉ x.y, don't I'll ''s …. 12.5 . , 각 한국 日本。", "\n\t ", None, "x" * 3000,
       "It's. he's, O'Re! Á. ﬁ ǅ İstanbul ΑΣ. ΟΔΟΣ", "a .b ..c?! end?!", "é ́x .́", "word.​next"]


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(default_vocabulary())


def test_word_cache_equals_the_tokenizer(tokenizer, small_docs):
    texts = ODD + [r.text for r in small_docs.limit(50).collect()]
    with open(default_vocabulary()) as f:
        words = WordTokens(f.read())
    for _ in range(2):
        for t, got in zip(texts, words.ids(texts), strict=True):
            assert np.frombuffer(got, dtype="<u2").tolist() == tokenizer.encode(t or "", add_special_tokens=False).ids


@pytest.mark.parametrize("dims,order", [(2, 4), (3, 3), (4, 2)])
def test_hilbert_curve_visits_neighbours(dims, order):
    side = 1 << order
    points = np.stack(np.meshgrid(*[range(side)] * dims, indexing="ij"), axis=-1).reshape(-1, dims)
    place = hilbert(points, order)
    assert sorted(place.tolist()) == list(range(side**dims))
    assert (np.abs(np.diff(points[np.argsort(place)], axis=0)).sum(axis=1) == 1).all()


def check(pieces, want, length):
    docs, seqs = defaultdict(list), defaultdict(list)
    for p in pieces:
        docs[p.doc_id].append(p)
        seqs[p.sequence_id].append(p)
        assert p.length > 0 and zlib.crc32(bytes(p.ids)) == p.ids_crc32 and len(p.ids) == 4 * p.length
    for s, ps in seqs.items():
        at = 0
        for p in sorted(ps, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at == length or s == max(seqs)
    assert set(seqs) == set(range(len(seqs)))
    got = defaultdict(list)
    for d, ps in docs.items():
        open_ = sorted(ps, key=lambda p: (p.sequence_id, p.offset))
        while open_:
            chain, rest, at = [], [], 0
            for p in open_:
                if p.start == at and at < p.doc_tokens:
                    chain.append(p)
                    at += p.length
                else:
                    rest.append(p)
            assert at == chain[0].doc_tokens
            got[d].append(b"".join(bytes(p.ids) for p in chain))
            open_ = rest
    assert {d: sorted(v) for d, v in got.items()} == {d: sorted(v) for d, v in want.items()}


def test_every_id_lies_in_one_piece(spark, small_docs, tokenizer):
    rows = [(r.doc_id, r.text) for r in small_docs.collect()] + [(10_000 + i, t) for i, t in enumerate(ODD)] + [(3, "same row")] * 4 + [(None, "no id")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(6).selectExpr("*", "'x' as ids", "1 as row")
    want = defaultdict(list)
    for d, t in rows:
        want[d].append(np.array(tokenizer.encode(t or "", add_special_tokens=False).ids + [2], dtype="<u4").tobytes())
    pieces = pack(df)
    check(pieces.collect(), want, 4096)
    full = sequences(pieces).collect()
    assert all(len(r.ids) == 4096 or len(r.ids) & (len(r.ids) - 1) == 0 for r in full)


def test_empty_table(spark):
    assert packing_report(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0
