"""Stored indexes and stores against full scans."""

import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from textloom.operators import postings, retrieval
from textloom.sources import versions

DOCS = "doc_id long, text string"


def docs(spark, n=300, seed=1):
    rng = random.Random(seed)
    words = [f"w{int(rng.paretovariate(0.7))}" for _ in range(4000)]
    return spark.createDataFrame([(i, " ".join(rng.choices(words, k=rng.choice([3, 40, 200])))) for i in range(n)], DOCS)


def hits(df):
    return [(r.doc_id, r.chunk_no, round(r.score, 9), r.text) for r in df.collect()]


def scanned(chunked, query, k):
    return hits(retrieval.bm25_topk(chunked, query, k))


@pytest.fixture(scope="module")
def index(spark, tmp_path_factory):
    path = f"{tmp_path_factory.mktemp('index')}/i"
    with pytest.MonkeyPatch.context() as m:
        m.setattr(postings, "BLOCK_CHUNKS", 16)
        postings.put(docs(spark), path, 4)
    return path


@pytest.mark.parametrize("query", ["w1 w2 w2 W900", "w77", "nothing here", "", "w1", "w3 w5 w8 w13 w21 w34"])
@pytest.mark.parametrize("first, k", [(1, 3), (32, 10), (2, 5000)])
def test_topk_is_that_of_a_scan(spark, index, monkeypatch, query, first, k):
    monkeypatch.setattr(postings, "FIRST_BLOCKS", first)
    assert hits(postings.Index(spark, index).topk(query, k)) == scanned(retrieval.chunk_table(docs(spark)), query, k)


def test_blocks_are_skipped_and_bounds_hold(spark, index):
    ix = postings.Index(spark, index)
    weights = ix.weights(retrieval.query_terms("w40 w41 w3"))
    bounds = {r.block: r.bound for r in ix.bounds(weights).collect()}
    each = ix._scores(ix.rows(list(weights)), weights).join(ix.chunks, ["doc_id", "chunk_no"])
    blocks = ix.rows(list(weights)).select("block", F.explode("entries").alias("e")).select("block", "e.doc_id", "e.chunk_no").distinct()
    rows = each.join(blocks, ["doc_id", "chunk_no"]).collect()
    assert rows and all(r.score <= bounds[r.block] for r in rows)
    best = sorted((r.score for r in rows), reverse=True)[2]
    assert sum(b < best for b in bounds.values()) > len(bounds) / 4  # of these no entry is read


def test_a_question_reads_its_terms_only(spark, index):
    ix = postings.Index(spark, index)
    plan = ix.rows(["w40"])._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(term), EqualTo(term,w40)]" in plan or "In(term" in plan
    read = ix.rows(["w40"])
    assert read.count() < ix.postings.count() / 50


def test_replace_drop_and_null(spark, tmp_path):
    path = f"{tmp_path}/i"
    postings.put(docs(spark, 60), path, 4)
    before = postings.Index(spark, path)
    new = spark.createDataFrame([(3, "w1 fresh words"), (4, None), (100, "w1 w1 w1")], DOCS)
    postings.put(new, path)
    postings.drop(spark.createDataFrame([(5,), (999,)], "doc_id long"), path)
    want = docs(spark, 60).where("doc_id not in (3, 4, 5)").unionByName(new)
    for query in ("w1 w2", "fresh", "w9 w10"):
        assert hits(postings.Index(spark, path).topk(query, 8)) == scanned(retrieval.chunk_table(want), query, 8)
    assert before.topk("w1", 5).count() == 5  # an older version still answers
    versions.vacuum(spark, path)
    assert hits(postings.Index(spark, path).topk("w1 w2", 8)) == scanned(retrieval.chunk_table(want), "w1 w2", 8)
    postings.drop(want.select("doc_id"), path)
    assert hits(postings.Index(spark, path).topk("w1", 5)) == []
    assert hits(postings.Index(spark, f"{tmp_path}/none").topk("w1", 5)) == []


def shuffled(spark):
    """Bytes that the session's stages have written for shuffles."""
    sc = spark.sparkContext
    sc._jsc.sc().listenerBus().waitUntilEmpty()
    none = sc._gateway.new_array(sc._jvm.double, 0)
    stages = sc._jsc.sc().statusStore().stageList(None, False, False, none, sc._jvm.java.util.ArrayList())
    return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))


def test_a_build_shuffles_neither_texts_nor_postings(spark, tmp_path):
    path = f"{tmp_path}/i"
    rows = docs(spark, 1000)
    texts = rows.agg(F.sum(F.length("text"))).first()[0]
    before = shuffled(spark)
    postings.put(rows, path, 4)
    postings.put(rows.where("doc_id % 10 = 0"), path)
    postings.drop(rows.where("doc_id % 10 = 1"), path)
    assert shuffled(spark) - before < texts / 50


@pytest.mark.parametrize("ids", [0, 1_000_000])
def test_slices_and_pieces(spark, tmp_path, monkeypatch, ids):
    for name, value in (("BLOCK_CHUNKS", 5), ("SLICE_WORDS", 700), ("BATCH_ENTRIES", 40), ("BROADCAST_IDS", ids)):
        monkeypatch.setattr(postings, name, value)
    path = f"{tmp_path}/i"
    more = spark.createDataFrame([(None, "w1 of no id"), (700, ""), (701, " ?! a"), (702, "w1 w1")], DOCS)
    postings.put(docs(spark, 200).unionByName(more), path, 3)
    postings.put(docs(spark, 40, seed=2), path)
    want = retrieval.chunk_table(docs(spark, 200).where("doc_id >= 40").unionByName(docs(spark, 40, seed=2)).unionByName(more))
    ix = postings.Index(spark, path)
    for query in ("w1 w2", "w3 w5 w8 w13"):
        # a chunk without an id counts, but is no answer
        assert hits(ix.topk(query, 12)) == [h for h in scanned(want, query, 13) if h[0] is not None][:12]
    rows = ix.postings.select("term", "block", "n", "max_f", "least_words", "entries").collect()
    assert all(r.n == len(r.entries) and r.max_f == max(e.f for e in r.entries) and r.least_words == min(e.n_words for e in r.entries) for r in rows)
    of = {}
    for r in rows:
        for e in r.entries:
            of.setdefault(r.block, set()).add((e.doc_id, e.chunk_no))
    assert max(map(len, of.values())) == 5 and sum(map(len, of.values())) == len(set().union(*of.values()))  # a chunk is in one block


def test_the_updated_index_keeps_one_version(spark):
    from textloom.plans import index_queries

    base = Path(spark.conf.get("spark.checkpoint.dir").removeprefix("file://"))
    before = set(base.glob("updated-*"))
    got = index_queries.index_updated(spark, "/root/testdata/sf0.01").collect()
    (path,) = set(base.glob("updated-*")) - before
    assert len(got) == 10 and len(list(path.glob("data/*"))) == 1 and len(list(path.glob("manifests/*"))) == 1


def test_hybrid_is_that_of_a_scan(spark, index):
    rng = random.Random(5)
    vectors = spark.createDataFrame([(i, [rng.gauss(0, 1) for _ in range(6)]) for i in range(0, 300, 3)] + [(1, None), (2, [1.0])], "doc_id long, embedding array<float>")
    ask = [rng.gauss(0, 1) for _ in range(6)]
    both = retrieval.chunk_table(docs(spark)).join(vectors, "doc_id", "left")
    for query in ("w1 w40", "nothing"):
        assert hits(postings.Index(spark, index).hybrid(query, vectors, ask, 7)) == hits(retrieval.search(both, query, ask, 7))


# --- the chunk store ------------------------------------------------------------


def stored(spark, path):
    return sorted((r.doc_id, r.text) for r in retrieval.load_chunks(spark, path).collect())


def test_chunk_store_forgets(spark, tmp_path):
    path = f"{tmp_path}/c"
    put = lambda *rows: retrieval.save_chunks(spark.createDataFrame(list(rows), DOCS), path, parts=2)
    put((1, "old one"), (2, "two"))
    put((1, None))
    assert stored(spark, path) == [(2, "two")]
    retrieval.clear_chunks(spark, path)
    assert stored(spark, path) == []
    put((3, "three"))
    assert stored(spark, path) == [(3, "three")]
    retrieval.drop_chunks(spark.createDataFrame([(3,)], "doc_id long"), path)
    assert stored(spark, path) == []


def test_a_failed_save_changes_nothing(spark, tmp_path, monkeypatch):
    path = f"{tmp_path}/c"
    retrieval.save_chunks(spark.createDataFrame([(1, "one"), (2, "two")], DOCS), path, parts=2)
    bad = spark.createDataFrame([(1, "new")], DOCS).select("doc_id", F.when(F.col("doc_id") == 1, F.raise_error(F.lit("x"))).otherwise(F.col("text")).alias("text"))
    with pytest.raises(Exception):
        retrieval.save_chunks(bad, path)
    assert stored(spark, path) == [(1, "one"), (2, "two")]
    # the data is written, its manifest is not
    monkeypatch.setattr(versions, "MANIFEST", "part nonsense")
    with pytest.raises(Exception):
        retrieval.save_chunks(spark.createDataFrame([(1, "new")], DOCS), path)
    monkeypatch.undo()
    assert stored(spark, path) == [(1, "one"), (2, "two")]
    # a manifest that was never committed
    (tmp_path / "c" / "manifests" / "2").mkdir()
    assert stored(spark, path) == [(1, "one"), (2, "two")]


# --- substrings -------------------------------------------------------------------


def test_substrings_are_those_of_a_scan(spark, tmp_path, monkeypatch):
    from textloom.operators import text_index

    rng = random.Random(7)
    parts = ["alpha ", "Beta\n", "GAMMA é ", "日本語 ", "δelta\n", "x", "yz ", "needle "]
    rows = [(i, "".join(rng.choices(parts[:-1], k=rng.randrange(60))) + ("Hay NeeDle\nstack" if i % 97 == 5 else "")) for i in range(400)] + [(900, None), (901, ""), (902, "İstanbul ΣΑΣ\n" * 300)]
    docs = spark.createDataFrame(rows, DOCS).repartition(3)
    path = f"{tmp_path}/s"
    text_index.build(docs, path, 400)
    total = spark.read.parquet(f"{path}/filters").count()
    assert total > 20 and spark.read.parquet(f"{path}/texts").count() == len(rows)
    for query in ("needle", "NEEDLE", "é", "日本", "yz alpha", "x", "σας", "i̇stanbul", "nowhere at all", "", "a\nb"):
        want = [tuple(r) for r in retrieval.grep(docs, query, 10_000).collect()]
        assert [tuple(r) for r in text_index.search(spark, path, query, 10_000).collect()] == want, query
    few = text_index.blocks(spark, path, "needle").count()
    assert 0 < few < total / 4 and text_index.blocks(spark, path, "nowhere at all").count() < total / 20
    monkeypatch.setattr(text_index, "LISTED_BLOCKS", 1)
    assert text_index.search(spark, path, "needle", 100).count() == retrieval.grep(docs, "needle", 100).count() > 1


@pytest.mark.parametrize("seed", range(5))
def test_filters_never_deny(seed):
    import numpy as np

    from textloom.operators import text_index

    rng = np.random.default_rng(seed)
    texts = [bytes(rng.integers(97, 110, rng.integers(0, 200)).astype(np.uint8)) for _ in range(30)]
    n_bits, bits = text_index.block_filter(texts)
    for t in texts:
        for _ in range(20):
            if len(t) > 3:
                lo = int(rng.integers(0, len(t) - 3))
                piece = t[lo : lo + int(rng.integers(3, 12))]
                assert text_index.may_hold(n_bits, bits, text_index.trigrams(np.frombuffer(piece, np.uint8)))
    absent = sum(text_index.may_hold(n_bits, bits, text_index.trigrams(rng.integers(0, 90, 4).astype(np.uint8))) for _ in range(1000))
    assert absent < 10
