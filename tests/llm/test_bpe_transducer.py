import hashlib
import random

import public_tokenizers as public
import tiktoken

from textloom.llm import bpe_transducer as bt

PATH = public.path("byte_bpe_50k.tiktoken")


def library():
    return tiktoken.Encoding("own", pat_str=public.PATTERN, mergeable_ranks=bt.read_ranks(PATH), special_tokens={})


def test_query(spark, sf_tables):
    rng = random.Random(5)
    alphabet = "aàb  \n\t.!?éß中😀'sthe0019-_ñ\0́"
    texts = [None, "", "  ", "the " * 5000, "x" * 30000] + ["".join(rng.choice(alphabet) for _ in range(rng.randrange(200))) for _ in range(300)]
    docs = [(i, t) for i, t in enumerate(texts)] + [(None, "null id"), (7, "again"), (7, "again")]
    got = bt.op10_bpe_transducer(spark, sf_tables(documents=([(*d, 1) for d in docs], "doc_id long, text string, n_tokens int"))).collect()
    sha, lib, want = lambda b: hashlib.sha256(b).hexdigest(), library(), []
    for i, t in docs:
        ids = lib.encode_ordinary(t or "")
        want.append((i, len(ids), sha(" ".join(map(str, ids)).encode()), sha((t or "").encode()), len(t or "")))
    key = lambda r: (r[0] is None, r[0] or 0, *r[1:])
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)


def test_any_bytes():
    fst, rng, lib = bt.transducer(PATH), random.Random(6), library()
    for _ in range(3000):
        s = bytes(rng.choice(b"\xc3\xa9\xe4\xb8\xadabt he\x00\xff") for _ in range(rng.randrange(1, 25)))
        assert list(fst.encode(s)) == lib._core_bpe.encode_single_piece(s)


def test_states_can_be_dropped(monkeypatch):
    monkeypatch.setattr(bt, "MAX_STATES", 50)
    fst, lib = bt.BpeTransducer(bt.read_ranks(PATH)), library()
    for word in ("internationalisation", "counterrevolutionaries", "antidisestablishment") * 3:
        assert list(fst.encode(word.encode())) == lib.encode_ordinary(word)


def test_streamed_text_and_decode(spark):
    lib = library()
    text = "naïve 😀 " * 50
    pieces = list(bt.decode_stream(lib.encode_ordinary(text), bt.transducer(PATH).bytes_of, chunk=1))
    assert "".join(t for _, t in pieces) == text and b"".join(b for b, _ in pieces) == text.encode()
    docs = spark.createDataFrame([(1, text), (2, None), (3, "plain")], "doc_id long, text string")
    back = bt.decode(bt.encode(docs, PATH, public.PATTERN), PATH).collect()
    assert {r.doc_id: r.text for r in back} == {1: text, 2: "", 3: "plain"}
