import hashlib
import zlib

import duckdb
import pytest

from textloom.llm import merkle_manifest as mm

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, leaf int, tree string, idx int"


def h(*x):
    return hashlib.sha256("".join(x).encode()).hexdigest()


def leaf(doc_id, source, lang, n_chars, text):
    return h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n_chars, text)))


def tree(nodes, fanout):
    """The root of some digests, and each one's siblings by level as (left, right)."""
    paths, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        runs = [nodes[i : i + fanout] for i in range(0, len(nodes), fanout)]
        for k, i in enumerate(at):
            run, place = runs[i // fanout], i % fanout
            paths[k].append(("".join(run[:place]), "".join(run[place + 1 :])))
        nodes, at = [h(*r) for r in runs], [i // fanout for i in at]
    return nodes[0], paths


def expected(docs, fanout=2):
    langs = sorted({d[2] for d in docs}, key=lambda x: (x is not None, (x or "").encode()))
    trees = {}
    for lang in langs:
        own = sorted((d for d in docs if d[2] == lang), key=lambda d: (d[0] is not None, d[0] or 0, leaf(*d)))
        trees[lang] = own, *tree([leaf(*d) for d in own], fanout)
    root, tops = tree([trees[x][1] for x in langs], fanout)
    out = []
    for k, lang in enumerate(langs):
        own, subroot, paths = trees[lang]
        for d, path in zip(own, paths, strict=True):
            i, source, _, n, text = d
            new = n + 1 if i is not None and zlib.crc32(str(i).encode()) % 7 == 0 and n is not None else n
            x = leaf(i, source, lang, new, text)
            for left, right in path + tops[k]:
                x = h(left, x, right)
            out.append((i, leaf(*d), subroot, root, h(*(a + b for a, b in path + tops[k])), x, x == root))
    return sorted(out, key=repr)


def some(n=230):
    docs = [(i * 37 % 1009, f"s{i % 3}" if i % 5 else None, ("en", "de", "日", "fr", "z")[min(i % 7, 4)], i if i % 4 else None, f"text é日 {i % 11}" * (i % 6) if i % 9 else None) for i in range(n)]
    docs += [(5000, "s", None, 1, "x"), (None, "s", "en", 2, "a"), (None, "s", "en", 2, "a"), (7, "s", "en", 3, "b"), (7, "s", "en", 3, "b"), (7, "t", "en", 3, "c"), (-3, "s", "only", 1, "long " * 30_000), (8, None, "", None, None)]
    return docs


@pytest.mark.parametrize("small", [0, 10_000])
def test_query(spark, sf_tables, monkeypatch, small):
    monkeypatch.setattr(mm, "SMALL", small)
    monkeypatch.setattr(mm, "BROADCAST_PARENTS", small)
    monkeypatch.setattr(mm, "BROADCAST_TREES", small)
    docs = some(60 if not small else 230)
    sf = sf_tables(documents=([(*d, 1, "clash", 2) for d in docs], SCHEMA))
    got = mm.op12_merkle_manifest(spark, sf).select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")
    rows = sorted((tuple(r) for r in got.collect()), key=repr)
    assert rows == expected(docs) and {r[-1] for r in rows} == {True, False}
    if small:
        con = duckdb.connect()
        con.sql(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet/*.parquet'")
        assert sorted(con.sql(mm.oracle()).fetchall(), key=repr) == rows


@pytest.mark.parametrize("docs", [[], [(1, "s", "en", 1, "x")], [(7, "s", None, None, None)], [(1, "s", "en", 1, "x"), (2, "s", "de", 1, "x"), (3, "s", "de", 1, "x")]])
def test_few_rows(spark, sf_tables, docs):
    sf = sf_tables(documents=([(*d, 1, "clash", 2) for d in docs], SCHEMA))
    got = mm.op12_merkle_manifest(spark, sf).select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")
    assert sorted((tuple(r) for r in got.collect()), key=repr) == (expected(docs) if docs else [])


def test_wider_fanout_and_subroots(spark):
    docs = some(150)
    rows = spark.createDataFrame([(d[0], d[2], bytes.fromhex(leaf(*d))) for d in docs], "doc_id long, lang string, hash binary")
    out, subroots = mm.manifest(rows, "lang", "doc_id", fanout=5)
    found = (mm.F.col("hash"), mm.F.col("subroot"), mm.F.col("root"), mm.proof(mm.F.col("path")), mm.folded(mm.F.col("hash"), mm.F.col("path")))
    got = out.select("row.doc_id", *(mm.hexed(x).alias(f"c{k}") for k, x in enumerate(found)))
    want = expected(docs, 5)
    assert sorted((tuple(r) for r in got.collect()), key=repr) == sorted(((*r[:5], r[3]) for r in want), key=repr)
    langs = [r.lang for r in subroots.collect()]
    assert langs == sorted(langs, key=lambda x: (x is not None, (x or "").encode())) and {r[2] for r in want} == {r.subroot for r in subroots.collect()}
