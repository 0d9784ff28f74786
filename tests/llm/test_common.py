import json
import os
import random
import string
import threading

import numpy as np
import pyarrow as pa
import pytest
from public_tokenizers import path as public
from tokenizers import Tokenizer

from textloom.llm import common
from textloom.llm.common import connected, discard, finished, fresh, job, joined_by, placed, sliced, slices, written
from textloom.llm.word_tokens import WordEncoder


def test_slices_bound_rows_and_bytes():
    b = pa.RecordBatch.from_pydict({"text": ["x" * 100] * 50 + ["y" * 100_000] + [None] * 20})
    parts = list(slices([b], 16, 2000))
    assert pa.Table.from_batches(parts).equals(pa.Table.from_batches([b]))
    assert all(len(p) <= 16 and (p.nbytes <= 2000 or len(p) == 1) and p.column(0).offset == 0 for p in parts)
    double = sliced(lambda x: pa.array([None if v is None else 2 * v for v in x.to_pylist()], pa.string()), 7)
    assert double(b.column("text")).to_pylist()[50] == "y" * 200_000 and len(double(b.column("text").slice(0, 0))) == 0


@pytest.mark.parametrize("n", [2, 100_000])
def test_connected_long_path(spark, n, monkeypatch):
    """A path needs the most steps; nothing is left unfinished."""
    monkeypatch.setattr(common, "STAR_EDGES", 400)
    rng = np.random.default_rng(1)
    ids = rng.permutation(n).tolist()
    edges = spark.createDataFrame(list(zip(ids, ids[1:], strict=False)), "a long, b long").repartition(8)
    got = connected(edges).collect()
    assert len(got) == n and all(r.component == 0 for r in got)


def test_connected_hub_nulls_and_repeats(spark):
    edges = [(0, i) for i in range(1, 1500)] + [(5000, 5001), (5001, 5000), (5001, 5001), (None, 3), (7000, None)] + [(5001, 5002)] * 3
    got = {r.node: r.component for r in connected(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(1500)} | {5000: 5000, 5001: 5000, 5002: 5000}
    assert connected(spark.createDataFrame([], "a long, b long")).collect() == []


def test_few_edges_are_not_shuffled(spark):
    sc, keys = spark.sparkContext, ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")
    before = [spark.conf.get(k) for k in keys]
    edges = written(spark.range(100).selectExpr("id as a", "id div 10 as b"))
    try:
        for k, v in zip(keys, ("50", "false"), strict=True):
            spark.conf.set(k, v)
        sc.setJobGroup("few edges", "")
        got = connected(edges)
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
        for k, v in zip(keys, before, strict=True):
            spark.conf.set(k, v)
    tracker = sc.statusTracker()
    stages = {k for job_id in tracker.getJobIdsForGroup("few edges") for k in tracker.getJobInfo(job_id).stageIds}
    assert stages and sum(tracker.getStageInfo(k).numTasks for k in stages) < 50
    assert {r.node: r.component for r in got.collect()} == dict.fromkeys(range(100), 0)


def test_hot_keys_are_joined_alike(spark):
    rows = spark.createDataFrame([("hot", i) for i in range(1200)] + [("cold", 1), ("none", 2)], "k string, i int")
    values = spark.createDataFrame([("hot", 1, 1200), ("cold", 2, 1)], "k string, v int, n long")
    got = joined_by(rows, values, "k", "n", 1202)
    assert got.count() == 1201 and got.where("k = 'cold'").first().v == 2


def test_tables_are_discarded(spark):
    with job() as own:
        kept = written(spark.range(3))
        path = own[-1]
        with job() as inner:
            written(spark.range(4))
            assert len(inner) == 1
        assert len(own) == 2
        discard(spark, own, (path,))
        assert own == [path] and kept.count() == 3
        discard(spark, own)
    assert not own and not os.path.exists(path.removeprefix("file://"))


def test_a_thread_leaves_others_tables(spark):
    """A table written by another thread between a job's begin and its end stays."""
    begun, made = threading.Barrier(2), {}

    def other():
        begun.wait(60)
        with job():
            made["df"] = written(spark.range(7))
        begun.wait(60)

    thread = threading.Thread(target=other)
    thread.start()
    with job() as own:
        written(spark.range(2))
        begun.wait(60)
        begun.wait(60)
        discard(spark, own)
    thread.join()
    assert made["df"].count() == 7


def test_a_finished_query_leaves_its_result_alone(spark):
    made = []

    @finished
    def query(spark, sf):
        first = written(spark.range(5))
        made.extend(first.inputFiles())
        return first.where("id > 1")

    assert query(spark, "").count() == 3 and made and not any(os.path.exists(f.removeprefix("file://")) for f in made)


def test_places(spark):
    rows = [(i * 7919 % 1000, None if i % 50 == 0 else f"v{i % 3}") for i in range(1000)] + [(5, "v0")] * 300 + [(None, "v1")]
    got = placed(spark.createDataFrame(rows, "n long, s string"), "s", "n").orderBy("place").collect()
    key = lambda r: (r[1] is not None, r[1] or "", r[0] is not None, r[0] or 0)
    assert [r.place for r in got] == list(range(1301)) and [(r.n, r.s) for r in got] == sorted(rows, key=key)
    assert placed(spark.createDataFrame([], "n long"), "n").collect() == []


def test_fresh(spark):
    assert fresh(spark.createDataFrame([], "Rules int, rules_ int"), "rules") == "rules__"


def test_encoder_keeps_no_more_than_it_remembers():
    enc = WordEncoder(public("word_bpe_49k.json"))
    texts = pa.array(["short words " + " ".join(f"{k}long" * 30 for k in range(50)), None])
    first = enc.encode(texts)
    size = len(enc.flat), len(enc.known)
    for _ in range(5):
        again = enc.encode(texts)
        assert (again[0] == first[0]).all() and (again[1] == first[1]).all()
    assert (len(enc.flat), len(enc.known)) == size and enc.lens.sum() == len(enc.flat)


def test_encoder_gives_the_librarys_ids():
    rng, tok = random.Random(3), Tokenizer.from_file(public("word_bpe_49k.json"))
    parts = ["a", "the", "Qu", "É", "é", "ñ", "ß", "ẞ", "ÿ", "Ÿ", "×", "÷", "ª", "µ", "İ", "Σ", "Σς", "ﬁ", "\u0301", "\u0338", "\xad", "\x85", "\xa0", "\x00", "\x1f", "9", "½", "٣", "語", "한", "😀"]
    parts += [*string.punctuation, "'s", "'LL", "<|endoftext|>", "<|", "</w>", "_", " ", " ", "\n", "\t"]
    texts = ["".join(rng.choices(parts, k=rng.randrange(30))) for _ in range(3000)] + ["", None, "É" * 300 + "!" * 300, "...", "'"]
    enc = WordEncoder(public("word_bpe_49k.json"))
    for some in (texts[:1000], texts, [], ["", None]):
        want = [tok.encode(t or "", add_special_tokens=False).ids for t in some]
        ids, n = enc.encode(pa.array(some, pa.string()))
        assert n.tolist() == [len(w) for w in want] and ids.tolist() == [i for w in want for i in w]


def test_encoder_learns_a_word_once_in_all_cases_and_before_all_marks():
    enc = WordEncoder(public("word_bpe_49k.json"))
    words = [f"{a}{b}ñ" for a in "abcdefg" for b in "uvwxyz"]
    enc.encode(pa.array([" ".join(f"{w} {w.upper()} {w.title()}, {w}!" for w in words)]))
    assert len(enc.known) == len(words) + 3  # "", "," and "!"


@pytest.mark.parametrize("change", ["rules", "added"])
def test_encoder_under_other_rules(tmp_path, change):
    with open(public("word_bpe_49k.json")) as f:
        file = json.load(f)
    if change == "rules":
        file["normalizer"]["normalizers"].pop()  # upper case stays
    else:
        file["added_tokens"].append({**file["added_tokens"][0], "id": 49408, "content": "Stop!"})
    path = str(tmp_path / "other.json")
    with open(path, "w") as f:
        json.dump(file, f)
    texts, tok = ["Hello HELLO, hello! Stop! stop!", "éÉ É."], Tokenizer.from_file(path)
    ids, n = WordEncoder(path).encode(pa.array(texts))
    want = [tok.encode(t, add_special_tokens=False).ids for t in texts]
    assert n.tolist() == [len(w) for w in want] and ids.tolist() == [i for w in want for i in w]
