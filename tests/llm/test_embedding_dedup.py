import duckdb
import numpy as np

from textloom.llm.embedding_dedup import links_between, near_duplicates, op5_pca_tiles

SF = "/root/testdata/sf0.01"


def brute(rows, threshold=0.93):
    """All pairs; vec_ids are distinct here."""
    good = [(i, np.array(v, np.float64), lab) for i, v, lab in rows if v and lab is not None and not any(c is None for c in v) and np.isfinite(np.array(v, float)).all() and any(v)]
    links = {i: set() for i, _, _ in rows}
    for a in range(len(good)):
        for b in range(a):
            (i, x, p), (j, y, q) = good[a], good[b]
            if p == q and len(x) == len(y) and x @ y / np.sqrt((x @ x) * (y @ y)) >= threshold:
                links[i].add(j)
                links[j].add(i)
    component = {}
    for i in sorted(links):
        todo = [i] if i not in component else []
        while todo:
            k = todo.pop()
            if k not in component:
                component[k] = i
                todo += links[k]
    return {i: (len(links[i]), component[i], component[i] == i) for i in links}


def answer(df):
    return {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in df.collect()}


def test_against_all_pairs(spark):
    rows = duckdb.sql(f"SELECT vec_id, embedding, label FROM '{SF}/embeddings.parquet'").fetchall()
    assert answer(op5_pca_tiles(spark, SF)) == brute(rows)
    # this table holds no pair so close: the same with a threshold that some reach
    want = brute(rows, 0.4)
    assert any(n for n, _, _ in want.values())
    assert answer(near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int"), 0.4)) == want


def test_large_cells(spark, monkeypatch):
    from textloom.llm import embedding_dedup

    monkeypatch.setattr(embedding_dedup, "TILE", 200)  # several tiles that meet
    rng = np.random.default_rng(1)
    centre = rng.normal(size=16)
    rows = [(i, [float(x) for x in centre + 0.25 * rng.normal(size=16)], i % 2) for i in range(1500)]
    assert answer(near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int"))) == brute([(i, np.float32(v).tolist(), lab) for i, v, lab in rows])


def test_bounds_drop_no_pair():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(200, 24)) * np.linspace(3, 0.2, 24)
    x /= np.linalg.norm(x, axis=1)[:, None]
    i, j = links_between(x, x, 0.8)
    assert {*zip(i.tolist(), j.tolist(), strict=True)} >= {*zip(*(k.tolist() for k in np.nonzero(x @ x.T >= 0.8)), strict=True)}


def test_repeated_ids_copies_and_doubles(spark):
    """Rows with one vec_id are one node with each row's links; null ids link with nothing."""
    rows = [(1, [1.0, 0.0], 0)] * 3 + [(2, [1.0, 0.1], 0), (2, [0.0, 1.0], 0), (3, [0.1, 1.0], 0), (None, [1.0, 0.0], 0), (4, [-1.0, 0.0], 0)]
    for kind in ("float", "double"):
        got = near_duplicates(spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>, label int")).collect()
        assert sorted((r.vec_id or 0, r.n_links, r.component_id or 0) for r in got) == [(0, 0, 0), (1, 3, 1), (1, 3, 1), (1, 3, 1), (2, 1, 1), (2, 3, 1), (3, 1, 1), (4, 0, 4)]


def test_threshold_is_met_exactly_by_tiles(spark):
    """Planted pairs on both sides of the threshold, in many dimensions."""
    rng = np.random.default_rng(4)
    rows = []
    for k in range(150):
        x = rng.normal(size=64)
        x /= np.linalg.norm(x)
        y = rng.normal(size=64)
        y -= (y @ x) * x
        y /= np.linalg.norm(y)
        c = 0.93 + rng.uniform(-0.02, 0.02)
        rows += [(2 * k, x.tolist(), k % 3), (2 * k + 1, (c * x + np.sqrt(1 - c * c) * y).tolist(), k % 3)]
    want = brute(rows)
    assert 40 < sum(n for n, _, _ in want.values()) / 2 < 110
    assert answer(near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"))) == want


def test_cases(spark):
    schema = "vec_id long, embedding array<float>, label int, unit string, node int"
    rows = [
        (1, [1.0, 0.0], 0, "clash", 5), (2, [1.0, 0.0], 0, None, None), (3, [1.0, 0.0], 1, None, None), (4, [0.0, 0.0], 0, None, None), (5, None, 0, None, None),
        (6, [1.0, None], 0, None, None), (7, [float("nan"), 1.0], 0, None, None), (8, [float("inf"), 1.0], 0, None, None), (9, [1.0, 0.0], None, None, None), (10, [1.0, 0.0, 0.0], 0, None, None), (11, [], 0, None, None),
    ]
    alone = {i: (0, i, True) for i in range(3, 12)}
    assert answer(near_duplicates(spark.createDataFrame(rows, schema))) == {1: (1, 1, True), 2: (1, 1, False)} | alone
    assert near_duplicates(spark.createDataFrame([], schema)).count() == 0
