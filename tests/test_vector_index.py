"""The vector index against brute force."""

import numpy as np
import pytest

from textloom.operators import retrieval
from textloom.operators import vector_index as vi

KIND = "vec_id long, embedding array<float>, label int"
SF = "/root/testdata/sf0.1"


def clustered(n=3000, dims=24, seed=1):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(40, dims))
    x = centres[rng.integers(0, 40, n)] + 0.4 * rng.normal(size=(n, dims))
    return x.astype(np.float32)


@pytest.fixture(scope="module")
def indexed(spark, tmp_path_factory):
    rows = [(i, v.tolist(), 0) for i, v in enumerate(clustered())]
    rows += [(5000, None, 0), (5001, [0.0] * 24, 0), (5002, [float("nan")] * 24, 0), (5003, [1.0] * 7, 0), (5004, [None] + [1.0] * 23, 0), (5005, rows[3][1], 0), (5006, [], 0)]
    path = f"{tmp_path_factory.mktemp('vectors')}/v"
    df = spark.createDataFrame(rows, KIND)
    vi.build(df, path, lists=32)
    return df.cache(), path


@pytest.mark.parametrize("who", [3, 700, 2999])
def test_all_lists_are_exact(spark, indexed, who):
    df, path = indexed
    x = clustered().astype(np.float64)
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    cos = np.append(unit @ unit[who], unit[3] @ unit[who])
    ids = np.append(np.arange(len(x)), 5005)
    order = np.lexsort((ids, -cos.round(12)))[:10]
    got = vi.search(df, path, x[who].tolist(), 10).collect()
    assert [r.vec_id for r in got] == ids[order].tolist() and np.allclose([r.score for r in got], cos[order], atol=1e-9)


def test_codes_keep_within_their_errors(spark, indexed):
    x = clustered()
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    q = vi.quantiser(spark, indexed[1])
    lists, codes, error = q.encode(unit)
    for who in (1, 5, 9):
        heads, tables = q.tables(unit[who])
        score = heads[lists] + tables[np.arange(len(tables)), codes].sum(1)
        assert (np.abs(score - unit @ unit[who]) <= error + vi.ROUNDING).all()
    assert error.mean() < 0.5


def test_few_are_compared_and_few_lists_read(spark, indexed):
    df, path = indexed
    assert spark.read.parquet(f"{path}/codes").count() == 3001  # all but those without a direction
    rows = spark.read.schema(vi.ROWS).parquet(f"{path}/codes").where("list IN (1, 2)")
    assert "PartitionFilters: [list#" in rows._jdf.queryExecution().executedPlan().toString()
    found = [vi.recall(vi.search(df, path, clustered()[w].tolist(), 10, probes=8), vi.search(df, path, clustered()[w].tolist(), 10)) for w in range(0, 2000, 400)]
    assert np.mean(found) >= 0.95


def test_odd_questions_and_empty_table(spark, indexed, tmp_path):
    df, path = indexed
    assert vi.search(df, path, [0.0] * 24, 5).collect() == [] == vi.search(df, path, [1.0] * 3, 5).collect()
    none = spark.createDataFrame([], KIND)
    vi.build(none, f"{tmp_path}/none")
    assert vi.search(none, f"{tmp_path}/none", [1.0], 5).collect() == []


def test_recall_on_the_whole_table(spark, tmp_path):
    """Recall at 10 over 20 of the table's vectors, which lie in no clusters: so most lists have to be read."""
    df = spark.read.parquet(f"{SF}/embeddings.parquet").cache()
    vi.build(df, f"{tmp_path}/e")
    found = []
    for r in df.where("vec_id % 100 = 7").limit(20).collect():
        ask = [float(v) for v in r.embedding]
        found.append(vi.recall(vi.search(df, f"{tmp_path}/e", ask, 10, probes=48), retrieval.cosine_topk(df, ask, 10)))
    assert np.mean(found) >= 0.95
