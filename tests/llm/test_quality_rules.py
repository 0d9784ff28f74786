import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from textloom.llm import quality_rules as qr


def base(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    twice, inside = Counter(windows), set()
    for i, w in enumerate(windows):
        if twice[w] > 1:
            inside |= set(range(i, i + 5))
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    n = len(words)
    return (n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(inside), n < 10 or 100 * len(inside) > 20 * n)


def prose(rng, n=60):
    return " ".join("".join(rng.choice("etaoinshrdlu") for _ in range(rng.randrange(2, 8))) for _ in range(n)) + "."


def test_counts_and_verdicts(spark, sf_tables):
    rng = random.Random(1)
    texts = [None, "", "a b", "x y z " * 50, " one two\x1cthree", "l\nl\n l\n\n\nl\r", "a b c d e " * 2 + "f"] + [prose(rng) for _ in range(600)]
    junk = [" ".join(w + "%%%" for w in prose(rng).split()) for _ in range(30)]
    rows = [(i, t, rng.choice(["en", None]), rng.choice(["s", "t", None])) for i, t in enumerate(texts + junk + ["A" * 50_000 + " long"])]
    rows += [rows[20], (None, prose(rng), "xx", "rare")]
    got = qr.op4_robust_outliers(spark, sf_tables(documents=([(*r, False) for r in rows], "doc_id long, text string, lang string, source string, kept boolean"))).collect()
    assert len(got) == len(rows)
    by_id = {r.doc_id: r for r in got}
    for i, t, *_ in rows:
        assert tuple(by_id[i])[1:7] == base(t)
    clean, bad = range(7, 607), range(607, 637)
    assert all(by_id[i].kept for i in clean) and not any(by_id[i].kept for i in bad) and by_id[None].kept
    assert not any(by_id[i].kept for i in (0, 1, 2, 3))


def test_estimate_resists_outliers(spark):
    rng = np.random.default_rng(2)
    inner = rng.normal(0.3, 0.2, (3000, qr.DIMS))
    rows = np.concatenate([inner, rng.normal(3, 0.1, (700, qr.DIMS))])
    frame = spark.createDataFrame([("g", *map(float, r)) for r in rows], "key string, " + ",".join(f"x{i} double" for i in range(qr.DIMS)))
    got = qr.estimates(frame).first()
    assert np.abs(np.array(got["mean"]) - 0.3).max() < 0.05


@pytest.mark.parametrize("junk", [0.28, 0.33, 0.4])
def test_much_junk(spark, junk):
    rng = np.random.default_rng(5)
    n, floor = 3000, np.array(qr.FLOOR)
    bad = int(junk * n)
    rows = np.concatenate([rng.normal(0, 1, (n - bad, qr.DIMS)), rng.normal(10, 1, (bad, qr.DIMS))]) * floor
    columns = ",".join(f"x{i} double" for i in range(qr.DIMS))
    frame = spark.createDataFrame([("g", *map(float, r)) for r in rows], "key string," + columns)
    model = qr.estimates(frame)
    assert model.count() == 1 and model.first()["n"] == n
    far = frame.join(model, "key").select("x0", qr._distance([F.col(f"x{i}") for i in range(qr.DIMS)], "mean", "inverse").alias("d")).collect()
    rejected = {good: [r.d > qr.CUTOFF for r in far if (r.x0 < 5 * floor[0]) == good] for good in (True, False)}
    assert np.mean(rejected[False]) > 0.99 and np.mean(rejected[True]) < 0.01


def test_a_third_of_a_source_is_spam(spark, sf_tables):
    rng = random.Random(6)
    texts = [(prose(rng), False) for _ in range(400)] + [(" ".join(w + "%%%" for w in prose(rng).split()), True) for _ in range(200)]
    rows = [(i, t, "en", "small" if i % 20 == 0 else "s") for i, (t, _) in enumerate(texts)]
    got = {r.doc_id: r.kept for r in qr.op4_robust_outliers(spark, sf_tables(documents=(rows, "doc_id long, text string, lang string, source string"))).collect()}
    assert all(got[i] != bad for i, (_, bad) in enumerate(texts))


def test_keys_are_split_beyond_the_broadcast_bound(spark, monkeypatch):
    rng = np.random.default_rng(7)
    frame = spark.createDataFrame([(str(k % 3), *map(float, r)) for k, r in enumerate(rng.normal(0, 1, (900, qr.DIMS)))], "key string," + ",".join(f"x{i} double" for i in range(qr.DIMS)))
    small = sorted(qr.estimates(frame).collect())
    monkeypatch.setattr(qr, "BROADCAST_GROUPS", 1)
    large = sorted(qr.estimates(frame).collect())
    assert len(large) == 3 and all(a.n == b.n and np.allclose(a["mean"], b["mean"], atol=0.05) for a, b in zip(small, large, strict=True))


def test_empty_table(spark, sf_tables):
    assert qr.op4_robust_outliers(spark, sf_tables(documents=([], "doc_id long, text string, lang string, source string"))).collect() == []


def test_estimates_against_all_subsets(spark):
    """Small groups, whose halves nearly lie in a plane: hardly a half of a group has a smaller determinant than the one found, and rows far off are in neither."""
    import itertools

    rng, n, d = np.random.default_rng(11), 13, qr.DIMS
    groups = []
    for k in range(5):
        x = rng.normal(size=(n, d)) @ rng.normal(size=(d, d)) * 3
        x[:k] += 40  # up to four rows far off
        groups.append(x)
    rows = [(str(k), *map(float, v)) for k, x in enumerate(groups) for v in x]
    found = qr.estimates(spark.createDataFrame(rows, "key string, " + ", ".join(f"x{i} double" for i in range(d)))).collect()
    assert len(found) == len(groups)
    halves, shares = np.array(list(itertools.combinations(range(n), -(-n // 2)))), []
    for r in found:
        k, x = int(r.key), groups[int(r.key)]
        inverse = np.zeros((d, d))
        for (i, j), v in zip(qr.PAIRS, r.inverse, strict=True):
            inverse[i, j] = inverse[j, i] = v
        size = -np.linalg.slogdet(inverse)[1]
        own = x[halves] - x[halves].mean(1, keepdims=True)
        cov = own.transpose(0, 2, 1) @ own / halves.shape[1] * qr.CONSISTENCY + np.diag(np.square(qr.FLOOR))
        every = np.linalg.slogdet(cov)[1]
        shares.append((every < size - 1e-6).mean())
        assert size >= every.min() - 1e-6
        assert not set(halves[every.argmin()]) & set(range(k))
        far = [(v - r.mean) @ inverse @ (v - r.mean) for v in x]
        assert not k or min(far[:k]) > 10 * qr.CUTOFF
    assert max(shares) < 0.1 and np.mean(shares) < 0.03
