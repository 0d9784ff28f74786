import random
import re

import pytest

from textloom.llm import near_dedup as nd


def expected(docs, size=2):
    def shingles(text):
        w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({i: i + 32 for i in range(65, 91)}))
        return {tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else ({tuple(w)} if w else set())

    sets = [shingles(t) for _, t in docs]
    root = list(range(len(docs)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            same = docs[i][0] == docs[j][0]
            if docs[i][0] is not None and docs[j][0] is not None and (a and sets[j] and (same or 100 * len(a & sets[j]) >= 80 * len(a | sets[j]))):
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(docs):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    return [(d, len(s), c := None if d is None else least[find(i)], c == d) for i, ((d, _), s) in enumerate(zip(docs, sets, strict=True))]


def variants(rng, n, words, changes):
    base = [f"w{rng.randrange(5000)}" for _ in range(words)]
    for _ in range(n):
        own = list(base)
        for _ in range(rng.randrange(changes)):
            own[rng.randrange(words)] = f"x{rng.randrange(10**6)}"
        yield " ".join(own)


def key(r):
    return tuple((x is None, x or 0) for x in r)


@pytest.mark.parametrize("block", [nd.BLOCK_SHINGLES, 700])
def test_query(spark, sf_tables, monkeypatch, block):
    monkeypatch.setattr(nd, "TILE", 48)  # several runs a region
    monkeypatch.setattr(nd, "BLOCK_SHINGLES", block)  # and with few shingles, several blocks a run
    rng = random.Random(9)
    texts = [None, "", " \n", "One", "one", "one two", "ONE  two", "one two three", "É é"]
    for words, changes in ((40, 6), (150, 20), (400, 45), (12, 3)):
        texts += variants(rng, 60, words, changes)
    texts += [" ".join(f"v{rng.randrange(900)}" for _ in range(rng.randrange(1, 60))) for _ in range(200)] + ["word " * 20000]
    docs = [(i * 7 % 1009, t) for i, t in enumerate(texts)]
    docs += [docs[30], docs[30], (None, docs[40][1]), (docs[50][0], docs[12][1]), (5000, docs[100][1])]
    got = nd.op2_minhash_forest(spark, sf_tables(documents=([(*d, 0) for d in docs], "doc_id long, text string, node long"))).collect()
    assert sorted(map(tuple, got), key=key) == sorted(expected(docs), key=key)


def test_deduplicate_keeps_columns(spark):
    docs = spark.createDataFrame([(3, "a b c d e f g", "x"), (1, "a b c d e f g", "y"), (2, "other words here", None), (None, "z", "n")], "doc_id long, text string, kept string")
    got = nd.deduplicate(docs)
    assert got.columns == docs.columns and sorted((r.doc_id or 0) for r in got.collect()) == [0, 1, 2]


def test_deduplicate_repeated_and_null_ids(spark):
    rows = [(1, "a b c d e f g", 1)] * 5 + [(None, "a b c d e f g", 2)] * 3 + [(2, "one two three four five six", 3), (2, "other words stand in this one", 4), (4, "other words stand in this one", 5)]
    rows += [(None, "only null ids have this text", 6)] * 4 + [(None, "", 7), (None, None, 8), (5, "", 9), (5, "", 9), (6, "single row", 10)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n int").repartition(4)
    got = nd.deduplicate(docs).collect()
    assert sorted(r.doc_id or 0 for r in got) == [0, 0, 0, 1, 2, 5, 6]
    assert sorted(r.n for r in got if r.doc_id is None) == [6, 7, 8] and all(tuple(r) in rows for r in got)
    assert sorted(map(repr, nd.deduplicate(docs.repartition(2)).collect())) == sorted(map(repr, got))


def test_empty_table(spark, sf_tables):
    assert nd.op2_minhash_forest(spark, sf_tables(documents=([], "doc_id long, text string"))).collect() == []


def test_real_table_against_all_pairs(spark):
    """Recall on the table at hand is 1: the same components as all pairs of its sets give."""
    docs = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()]
    got = nd.op2_minhash_forest(spark, "/root/testdata/sf0.001").collect()
    assert sorted(map(tuple, got), key=key) == sorted(expected(docs), key=key)


def test_seams_are_read_by_all_tasks(spark):
    from textloom.llm.near_dedup import HASHES, neighbours

    classes = spark.createDataFrame([(i, bytes([i % 5] * HASHES)) for i in range(40)], "node long, signature binary")
    got = neighbours(classes)
    assert "Coalesce" not in got._jdf.queryExecution().executedPlan().toString()
    assert got.count() > 0


def test_two_threads_at_once(spark, sf_tables):
    """Queries that run at the same time delete no table of each other."""
    from concurrent.futures import ThreadPoolExecutor

    from textloom.llm.near_dedup import op2_minhash_forest

    docs = [(i, " ".join(f"w{i // 3}x{k}" for k in range(20)) + f" end{i % 3}") for i in range(90)]
    sf = sf_tables(documents=(docs, "doc_id long, text string"))
    with ThreadPoolExecutor(2) as pool:
        both = list(pool.map(lambda _: op2_minhash_forest(spark, sf).orderBy("doc_id").collect(), range(2)))
    assert both[0] == both[1] and [r.component_id for r in both[0]] == [i - i % 3 for i in range(90)]


def test_blocks_of_a_tile(spark, monkeypatch):
    """Any two rows whose sizes allow a link meet in a block or two, and no two blocks hold more than four times the bound."""
    monkeypatch.setattr(nd, "BLOCK_SHINGLES", 1000)
    rng = random.Random(5)
    sizes = {k: rng.choice([5, 90, 100, 400, 480, 990]) + rng.randrange(9) for k in range(118)} | {118: 5, 119: 5}
    tiles = spark.createDataFrame([(k // 60 if k < 118 else 9, k, k) for k in sizes], "tile long, node long, group long")
    lengths = spark.createDataFrame(list(sizes.items()), "node long, n long")
    met, held = set(), {}
    for r in nd.in_blocks(tiles, lengths, 80).collect():
        assert r.n == sizes[r.node] and r.group == r.node
        held.setdefault((r.tile, r.left, r.right), []).append(r.node)
    for nodes in held.values():
        assert len(set(nodes)) == len(nodes) and sum(sizes[k] for k in nodes) < 4000
        met |= {(a, b) for a in nodes for b in nodes}
    of = {r.node: r.tile for r in tiles.collect()}
    assert all((a, b) in met for a in sizes for b in sizes if of[a] == of[b] and 100 * min(sizes[a], sizes[b]) >= 80 * max(sizes[a], sizes[b]))
    assert len([key for key in held if key[0] == 0]) > 3 and [key for key in held if key[0] == 9] == [(9, 0, 0)]


def test_bucket_is_compared_whole():
    """Two that resemble each other are candidates wherever they stand in their bucket; rows of a bucket that is too large are noted."""
    import numpy as np

    rng = np.random.default_rng(3)
    paths = rng.integers(0, 256, (200, nd.DEPTH + 1)).astype(np.uint8)
    paths[:, : nd.BASE_DEPTH + 1] = 7
    paths[:, nd.BASE_DEPTH + 1] = np.arange(200)  # so sorted
    paths[150, nd.BASE_DEPTH + 2 :] = paths[3, nd.BASE_DEPTH + 2 :]
    assert [x.tolist() for x in nd.candidates(paths, 0)] == [[3], [150]]
    assert not nd.full_rows(paths, 199).any() and nd.full_rows(paths, 198).all()
    paths[:60, 0] = 6
    assert nd.full_rows(paths, 100).tolist() == [False] * 60 + [True] * 140


def test_links_of_a_large_region(spark, sf_tables, monkeypatch):
    """All texts resemble each other and only few pairs are linked, which lie in no run of their region together."""
    monkeypatch.setattr(nd, "TILE", 2)
    monkeypatch.setattr(nd, "PASSES", (range(1),))
    monkeypatch.setattr(nd, "LIST", 16, raising=False)
    rng = random.Random(4)
    base, texts = [f"w{k}" for k in range(300)], []
    for k in range(120):
        own = list(base)
        for at in rng.sample(range(300), 27):
            own[at] = f"x{k}x{at}"
        texts.append(" ".join(own))
        for at in rng.sample(range(300), 14):
            own[at] = f"y{k}y{at}"
        texts.append(" ".join(own))
    docs = list(enumerate(texts))
    got = nd.op2_minhash_forest(spark, sf_tables(documents=(docs, "doc_id long, text string"))).collect()
    want = expected(docs)
    assert 60 < len({r[2] for r in want}) < 200
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)


def test_few_open_classes_take_one_pass(spark, sf_tables, monkeypatch):
    """A pass over few classes costs more than its work, so what the first one leaves open is joined exactly."""
    monkeypatch.setattr(nd, "TILE", 4)
    passes, ordered = [], nd._ordered
    monkeypatch.setattr(nd, "_ordered", lambda trees: passes.append(trees) or ordered(trees))
    rng = random.Random(6)
    base, texts = [f"w{k}" for k in range(300)], []
    for k in range(30):
        for letter, changes in (("x", 27), ("y", 14)):
            own = list(base if letter == "x" else own)
            for at in rng.sample(range(300), changes):
                own[at] = f"{letter}{k}{letter}{at}"
            texts.append(" ".join(own))
    docs = list(enumerate(texts))
    got = nd.op2_minhash_forest(spark, sf_tables(documents=(docs, "doc_id long, text string"))).collect()
    want = expected(docs)
    assert len({r[2] for r in want}) > 10
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)
    assert len(passes) == 1


def test_links_of_full_buckets(spark, sf_tables, monkeypatch):
    """Texts of common passages share buckets and are no candidates of each other; pairs among them are found."""
    monkeypatch.setattr(nd, "BUCKET", 20, raising=False)
    monkeypatch.setattr(nd, "LIST", 16, raising=False)
    rng = random.Random(6)
    passages, texts = [" ".join(f"p{k}w{i}" for i in range(5)) for k in range(60)], []
    for k in range(300):
        own = rng.sample(passages, 36)
        texts.append(" ".join(own))
        if k % 5 == 0:
            texts.append(" ".join([*own[:-3], *(f"own{k}n{i}" for i in range(15))]))
    docs = list(enumerate(texts)) + [(10, texts[77]), (None, texts[9])]
    got = nd.op2_minhash_forest(spark, sf_tables(documents=(docs, "doc_id long, text string"))).collect()
    assert sorted(map(tuple, got), key=key) == sorted(expected(docs), key=key)


def test_rows_of_a_list_meet(spark):
    """Any two groups' rows of a key share a tile, of a few blocks at most; a key of one group has none."""
    rng = random.Random(8)
    rows = {(k % 3, node, node % 7, group) for k in range(3) for node in range(60) for group in [0 if node < 45 else rng.randrange(20)]}
    rows |= {(5, node, 1, 9) for node in range(100)} | {(6, 1, 1, 2), (6, 2, 1, 3)}
    held = {}
    for r in nd.in_lists(spark.createDataFrame(sorted(rows), "key long, node long, n long, group long"), 10).collect():
        held.setdefault(r.tile, []).append((r.node, r.group))
        assert (r.node, r.n, r.group) in {x[1:] for x in rows}
    met = {(a[0], b[0]) for tile in held.values() for a in tile for b in tile}
    assert all((a[1], b[1]) in met for a in rows for b in rows if a[0] == b[0] and a[3] != b[3])
    assert sorted(held[6]) == [(1, 2), (2, 3)] and all(g != 9 for tile in held.values() for _, g in tile)
    assert max(map(len, held.values())) < 45


def test_exact_bounds_drop_no_link():
    """Linked sets share a shingle of their first ones in any order, and their parity bits pass."""
    import numpy as np
    import pyarrow as pa

    rng = np.random.default_rng(2)
    sets = []
    for n in (1, 2, 4, 5, 9, 10, 60, 400, 3000):
        base = rng.integers(0, 1 << 64, n + n // 4 + 1, dtype=np.uint64)
        sets += [np.unique(rng.permutation(base)[: n + rng.integers(0, n // 4 + 1)]) for _ in range(12)]
    frequent = np.sort(np.concatenate(sets).view(np.int64))[::3].copy()
    batch = pa.RecordBatch.from_arrays([pa.array([s.tobytes() for s in sets]), *(pa.array(range(len(sets))) for _ in range(3))], ["shingles", "node", "n", "group"])
    first = {}
    for b in nd._prefixes(80, frequent, np.arange(len(frequent)) % 5)([batch]):
        for r in b.to_pylist():
            first.setdefault(r["node"], set()).add(r["key"])
    size, group = np.array([len(s) for s in sets]), np.arange(len(sets))
    may = nd.may_link(np.stack([nd.parity(s) for s in sets]), size, group, 80, 0, len(sets))[0]
    count = 0
    for i, a in enumerate(sets):
        for j, b in enumerate(sets):
            both = len(np.intersect1d(a, b))
            if i != j and 100 * both >= 80 * (len(a) + len(b) - both):
                count += 1
                assert may[i, j] and first[i] & first[j]
    assert count > 50
    exact = nd.spanning_links(sets, group, 80, True)
    roots = nd._Roots(len(sets))
    assert all(roots.join(i, j) for i, j in exact)
    assert all(roots.find(i) == roots.find(j) for i in range(len(sets)) for j in range(i) if nd.linked([sets[i], sets[j]], 80)[0, 1])
