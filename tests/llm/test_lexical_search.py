import random

import duckdb
import numpy as np

from textloom.llm import lexical_search as ls


def sql_rows(sf, query):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet/*.parquet'")
    return sorted(map(repr, con.sql(query).fetchall()))


def test_query(spark, sf_tables, monkeypatch):
    monkeypatch.setattr(ls, "BLOCK_ITEMS", 4)
    monkeypatch.setitem(ls.LARGE_ROWS, "parquet.block.size", "1000")
    rng = random.Random(3)
    words = [f"w{k}" for k in range(30)] + ["Ünï", "ünï", "A1", "a1", "日本", "x\x00y", "İK"]
    texts = [" ,.\n"[rng.randrange(4)].join(rng.choices(words, k=rng.randrange(40))) for _ in range(400)]
    texts += [None, "", " .,; ", "W1", "w1 " * 5000, "café-au-lait W2\tw3", *texts[:30]]
    docs = [(i * 7 % 997, t, "x", "y") for i, t in enumerate(texts)] + [(None, "w1 w2", "x", "y"), (None, "w1 w2", "x", "y"), (3, texts[0], "x", "y")]
    items = [(1, "w1 w1 W2"), (2, None), (3, ""), (4, "nothing-known"), (None, "a1 日本"), (5, "w5 " * 40), (6, " ".join(words)), (6, "w7"), (6, "w7"), (7, "ünï"), (8, "w29 x y")]
    sf = sf_tables(documents=(docs, "doc_id long, text string, terms string, part string"), benchmark=([(*r, 1) for r in items], "item_id long, text string, rank int"))
    rows = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "20")  # so that a task meets several shards
    try:
        got = [tuple(r) for r in ls.op11_lexical_search(spark, sf).collect()]
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows)
    assert sorted(map(repr, got)) == sql_rows(sf, ls.oracle())
    assert {r[0] for r in got} == {1, None, 5, 6, 7, 8} and any(r[2] is None for r in got)


def test_empty_tables(spark, sf_tables, tmp_path):
    sf = sf_tables(documents=([], "doc_id long, text string"), benchmark=([(1, "a")], "item_id long, text string"))
    assert ls.op11_lexical_search(spark, sf).collect() == []


def test_no_items(spark, sf_tables):
    sf = sf_tables(documents=([(1, "a")], "doc_id long, text string"), benchmark=([], "item_id long, text string"))
    assert ls.op11_lexical_search(spark, sf).collect() == []


def test_selection_keeps_ties():
    rng = np.random.default_rng(4)
    for _ in range(200):
        n = int(rng.integers(1, 60))
        score, ids, null = rng.integers(0, 4, n), rng.integers(0, 50, n), rng.random(n) < 0.1
        want = sorted((i for i in range(n) if score[i] > 0), key=lambda i: (-score[i], not null[i], ids[i]))[:10]
        assert [(score[i], null[i], ids[i]) for i in ls.best(score, ids, null, 10)] == [(score[i], null[i], ids[i]) for i in want]


def test_one_index_serves_other_questions(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"common word{i % 3} only{i}") for i in range(20)], "doc_id long, text string")
    ls.build(docs, f"{tmp_path}/index")
    ask = lambda text, k: [(r.rank, r.doc_id) for r in ls.search(spark, f"{tmp_path}/index", spark.createDataFrame([(1, text)], "item_id long, text string"), k).orderBy("rank").collect()]
    assert ask("only7 word1", 3) == [(1, 7), (2, 1), (3, 4)] and ask("common", 2) == [(1, 0), (2, 1)]
