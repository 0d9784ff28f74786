import random
import zlib
from collections import defaultdict

import numpy as np
from public_tokenizers import path as public
from tokenizers import Tokenizer

from textloom.llm import packing


def test_limits_and_tiling():
    rng = random.Random(3)
    p = packing.VectorPacker(64, 5, 40)
    size, head, out = {}, {}, []
    for n in range(400):
        size[n], head[n] = rng.choice([1, 2, 3, 10, 30, 63, 64, 65, 300]), rng.randrange(0, 20)
        out += p.add(n, size[n], head[n])
        if n % 100 == 99:
            out += p.pack(10)
    out += p.pack()
    seen = defaultdict(list)
    for s in out:
        total = sum(x[2] for x in s)
        assert 0 < total <= 64 and len(s) <= 5 and sum(p.loss_of(x) for x in s) <= 40
        for n, start, length in s:
            seen[n].append((start, length))
    short = [s for s in out if sum(x[2] for x in s) < 64]
    assert all(len(s) == 5 or sum(p.loss_of(x) for x in s) == 40 for s in short[:-1])  # closed by another limit
    for n in size:
        at = 0
        for start, length in sorted(seen[n]):
            assert start == at and length > 0
            at += length
        assert at == size[n]


def test_query(spark, sf_tables):
    texts = [None, "", "one two three", "long " * 9000, "Ünïcode text, again"] * 8
    docs = [(i, t, 1) for i, t in enumerate(texts)] + [(3, "same id", 2), (None, "no id", 3)]
    rows = packing.op8_vector_packing(spark, sf_tables(documents=(docs, "doc_id long, text string, sequence_id long"))).collect()
    tok = Tokenizer.from_file(public("word_bpe_49k.json"))
    want = sorted([*tok.encode(t or "", add_special_tokens=False).ids, 2] for _, t, _ in docs)
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[(r.doc_id, r.doc_tokens)].append(r)
        by_seq[r.sequence_id].append(r)
    assert sum(r.length for r in rows) == sum(map(len, want))
    for (doc_id, n), pieces in by_doc.items():
        if doc_id not in (3,):
            ids = [*tok.encode(next(t for d, t, _ in docs if d == doc_id) or "", add_special_tokens=False).ids, 2]
            at = 0
            for r in sorted(pieces, key=lambda r: r.start):
                assert r.start == at and r.ids_crc32 == zlib.crc32(np.array(ids[at : at + r.length], "<u4").tobytes())
                at += r.length
            assert at == n == len(ids)
    for pieces in by_seq.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert 0 < at <= 4096
    # one short sequence in all, however many tasks there are
    assert sum(sum(r.length for r in pieces) < 4096 for pieces in by_seq.values()) == 1


def test_heads_and_loss_limit(spark):
    rng = random.Random(4)
    rows = [(i, "some words to learn " * rng.randrange(1, 60), rng.choice([None, -3, 0, 1, 7, 40, 10_000])) for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, prompt int")
    got = packing.pack(docs, public("word_bpe_49k.json"), max_tokens=256, max_segments=8, max_loss=100, head="prompt").collect()
    head, by_seq, by_doc = {i: max(1, h or 0) for i, _, h in rows}, defaultdict(list), defaultdict(int)
    for r in got:
        by_seq[r.sequence_id].append((r.length, r.start + r.length - max(r.start, min(head[r.doc_id], r.start + r.length)), r.loss_tokens))
        by_doc[r.doc_id, r.doc_tokens] += r.length
    assert len(by_doc) == 200 and all(n == total for (_, n), total in by_doc.items())
    for pieces in by_seq.values():
        assert len(pieces) <= 8 and sum(p[0] for p in pieces) <= 256 and sum(p[1] for p in pieces) <= 100
        assert all(want == loss for _, want, loss in pieces)


def test_empty_table(spark, sf_tables):
    assert packing.op8_vector_packing(spark, sf_tables(documents=([], "doc_id long, text string"))).collect() == []


def test_rests_are_read_by_all_tasks(spark, sf_tables):
    """Rests are dealt anew, so the scan of the pieces isn't one task's."""
    sf = sf_tables(documents=([(i, "some words " * i) for i in range(40)], "doc_id long, text string"))
    docs = spark.read.parquet(f"{sf}/documents.parquet").repartition(8)
    got = packing.pack(docs, public(packing.TOKENIZER))
    assert "Coalesce" not in got._jdf.queryExecution().executedPlan().toString()
    assert got.count() >= 40
