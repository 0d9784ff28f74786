import random

import numpy as np
import pytest

from textloom.llm import toxicity as tx
from textloom.llm.common import held_out

SF = "/root/testdata/sf0.1"


@pytest.mark.parametrize(
    "text, words",
    [("You IDIOT!", " you idiot "), ("1d10t m0r0n", " idiot moron "), ("ѕtuріd ｓｃｕｍ", " stupid scum "), ("st​upid p@thetic", " stupid pathetic "), ("idiot$$$ 100 $5", " idiot 100 5 "), ("", "  ")],
)
def test_fold(text, words):
    assert tx.fold(text) == words


def test_exceptions_and_length():
    lexicon = tx.Lexicon({" trash ": 3.0, " clown ": 3.0, " vequ": 2.0})
    assert lexicon.features("the trash can by the clown fish")[2] == 0
    assert lexicon.features("trash, vequade and a clown")[2] == 3
    assert lexicon.features("trash")[1] > lexicon.features("trash " + "word " * 500)[1]


def test_learned_terms_and_copies(spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("aeioulnrst") for _ in range(6))
    docs, labels = [], []
    for i in range(1500):
        words = [word() for _ in range(30)]
        toxic = i % 5 == 0
        if toxic:
            for _ in range(3):
                words[rng.randrange(30)] = "grob" + rng.choice(["ian", "ling", "heit", "zeug"])
        if i % 25 == 0:
            words = ["copied", "passage", "grobling", "ofwords", "everywhere"] * 4  # one toxic text, many times
        docs.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    docs, labels = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    lexicon = tx.learn(docs, labels)
    assert " grob" in lexicon.weights and " passage " not in lexicon.weights
    both = tx.judged(docs, lexicon).join(labels, "doc_id").collect()
    assert all((r.toxicity.score >= 0.5) == bool(r.toxic) for r in both)


@pytest.mark.parametrize("text, words", [("ídiot ÏDÏÖT", " idiot idiot "), ("you i d i o t !", " you idiot "), ("vitamins a b c", " vitamins a b c ")])
def test_fold_accents_and_spelling(text, words):
    assert tx.fold(text) == words


def test_automaton_against_plain_search():
    """Every term, its weight and the exceptions, by looking each up at every place."""
    rng = random.Random(11)
    for _ in range(60):
        word = lambda: "".join(rng.choice("abc") for _ in range(rng.randrange(1, 6)))
        weights = {t: rng.randrange(1, 9) / 2 for w in {word() for _ in range(6)} for t in rng.sample(tx.terms_of(w), 1)}
        exceptions = tuple({f"{word()} {word()}" for _ in range(3)})
        text = " ".join(word() for _ in range(rng.randrange(80)))
        folded, best = tx.fold(text), {}
        for term, w in weights.items():
            for at in range(len(folded)):
                if folded.startswith(term, at):
                    best[at] = max(w, best.get(at, 0.0))
        for phrase in exceptions:
            p = f" {phrase} "
            for lo in range(len(folded)):
                if folded.startswith(p, lo):
                    best = {at: w for at, w in best.items() if not lo <= at < lo + len(p) - 1}
        got = tx.Lexicon(weights, exceptions).features(text)
        assert got[2] == len(best) and abs(np.expm1(got[0]) - sum(best.values())) < 1e-9


def test_very_long_text():
    lexicon = tx.Lexicon({" idiot ": 3.0})
    assert lexicon.features("kind words " * 500_000 + "idiot")[2] == 1


@pytest.mark.parametrize("text, words", [("a$$hole $cum", " asshole cum scum "), ("@$$hole, @idiot", " hole asshole idiot aidiot "), ("costs $5 or 5$", " costs 5 or 5 ")])
def test_fold_signs(text, words):
    assert tx.fold(text) == words


def test_terms_stay_when_the_corpus_grows(spark, monkeypatch):
    monkeypatch.setattr(tx, "SEED", ())
    usual = ["an", "you", "the", "such", "these", "what", "that", "stupid", "total", "real"]
    weights = []
    for n in (200, 1000, 5000):
        rng = random.Random(n)
        word = lambda: "".join(rng.choice("aeioulnrst") for _ in range(5))  # noqa: B023, E731
        rows = []
        for i in range(3 * n):
            words = [word() for _ in range(12)]
            if i % 3 == 0:  # natural prose: an insult follows few different words
                words[5:7] = [rng.choice(usual), "grobian"]
                if i % 9 == 0:  # a passage inside many toxic texts
                    words[8:8] = ["copied", "passage", "everywhere"]
            rows.append((i, " ".join(words), int(i % 3 == 0)))
        rows += [(3 * n + k, "boring repeated message here", 1) for k in range(n)]
        docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
        learned = tx.learn(docs.select("doc_id", "text"), docs.select("doc_id", "toxic")).weights
        assert " passage " not in learned and " repeated " not in learned
        weights.append(learned[" grobian "])
    assert all(b >= a for a, b in zip(weights, weights[1:], strict=False))


def test_held_out_accuracy(spark):
    got = tx.op9_lexicon_toxicity(spark, SF).alias("g").join(spark.read.parquet(f"{SF}/labels.parquet").alias("l"), "doc_id").where("held_out and toxic is not null").select("toxic", "predicted").collect()
    assert len(got) > 300 and sum(r.toxic == r.predicted for r in got) / len(got) > 0.98


def test_cases(spark, sf_tables):
    rows = [(1, None, 5), (2, "", 5), (3, "you idiot moron", 5), (3, "you idiot moron", 5), (None, "kind words", 5)]
    got = tx.op9_lexicon_toxicity(spark, sf_tables(documents=(rows, "doc_id long, text string, score int"), labels=([], "doc_id long, quality int, toxic int"))).collect()
    assert sorted(((r.doc_id or 0), r.predicted) for r in got) == [(0, 0), (1, 0), (2, 0), (3, 1), (3, 1)]
    empty = spark.createDataFrame([], "doc_id long, text string, more int")
    assert tx.reject(empty, spark.createDataFrame([(1, None), (None, 1)], "doc_id long, toxic int")).collect() == []
    assert spark.createDataFrame([(5,), (None,)], "doc_id long").select(held_out()).collect()[1][0] is False
