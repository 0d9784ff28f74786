import zlib

import numpy as np
import pytest
from public_tokenizers import path as public
from tokenizers import Tokenizer

from textloom.llm import huffman_store as hs

TEXTS = [None, "", "Hello world", "a  b\tc\n", "x<|endoftext|>y İΣ's é q\x85w ﬁ", "word " * 700, "Hello world"]


def expected(docs):
    tok, at, out = Tokenizer.from_file(public("word_bpe_49k.json")), 0, []
    for doc_id, text in sorted(docs, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or "")):
        ids = [*tok.encode(text or "", add_special_tokens=False).ids, 1]
        out.append((doc_id, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    return out


def test_round_trip(spark, sf_tables):
    docs = [(i * 3 % 50, t) for i, t in enumerate(TEXTS * 6)] + [(None, "no id")]
    got = hs.op3_huffman_store(spark, sf_tables(documents=([(*d, "x") for d in docs], "doc_id long, text string, part string")))
    key = lambda r: r[1]
    assert sorted(map(tuple, got.collect()), key=key) == expected(docs)


def test_empty_table(spark, sf_tables):
    assert hs.op3_huffman_store(spark, sf_tables(documents=([], "doc_id long, text string"))).collect() == []


@pytest.mark.parametrize("limit", [4, 9, 20])
def test_code_is_complete_and_limited(limit):
    counts = np.array([1, 1, 2, 3, 5, 8, 13, 21, 34, 55, 0, 89])
    n = hs.code_lengths(counts, limit)
    assert n.max() <= limit and n[10] == 0 and sum(0.5 ** n[n > 0].astype(float)) == 1
    if limit == 20:  # as a plain Huffman code
        import heapq

        heap, total = sorted(counts[counts > 0].tolist()), 0
        while len(heap) > 1:
            a = heapq.heappop(heap) + heapq.heappop(heap)
            total += a
            heapq.heappush(heap, a)
        assert total == int((counts * n).sum())


def test_lanes_decode_alone():
    rng = np.random.default_rng(1)
    ids = rng.zipf(1.3, 5000).clip(1, 300) - 1
    n = hs.code_lengths(np.bincount(ids))
    payload, marks = hs.pack_bits(ids, n, hs.canonical(n))
    assert len(marks) == -(-5000 // hs.LANE)
    assert (hs.unpack_lanes([payload, payload], [marks, marks], [5000, 5000], hs.decoding_table(n)) == np.tile(ids, 2)).all()
