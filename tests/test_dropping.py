"""The trained word dropper: decoding against brute force, held-out accuracy, exact ratios."""

import itertools

import numpy as np
import pytest

from textloom.functions import kernels
from textloom.operators import dropping as d
from textloom.operators import training
from textloom.plans import index_queries as iq

SF = "/root/testdata/sf0.01"


def value(labels, keep, chain):
    total = chain[4 + labels[0]] + sum(chain[2 * a + b] for a, b in itertools.pairwise(labels))
    return total + sum(e for e, x in zip(keep, labels, strict=True) if x)


@pytest.mark.parametrize("seed", range(40))
def test_decoding_against_all_labellings(seed):
    rng = np.random.default_rng(seed)
    n = int(rng.integers(1, 9))
    keep, chain = rng.normal(size=n), rng.normal(size=6) * rng.integers(0, 3)
    every = {x: value(x, keep, chain) for x in itertools.product((0, 1), repeat=n)}
    assert every[tuple(d.best_labels(keep, chain))] == pytest.approx(max(every.values()))
    want = [max(v for x, v in every.items() if x[i]) - max(v for x, v in every.items() if not x[i]) for i in range(n)]
    assert np.allclose(d.margins(keep, chain), want)


def test_no_words():
    assert d.best_labels(np.zeros(0), np.zeros(6)) == [] and len(d.margins(np.zeros(0), np.zeros(6))) == 0 and d.features([]).shape[0] == 0


@pytest.fixture(scope="module")
def rows(spark):
    got = iq.word_dropping_learned(spark, SF).collect()
    assert len(got) == 536
    return got


def test_held_out_accuracy(rows):
    held = [r for r in rows if r.held_out]
    n = sum(r.n_words for r in held)
    majority = max(sum(r.n_kept for r in held), n - sum(r.n_kept for r in held)) / n
    accuracy = sum(r.n_right for r in held) / n
    assert 0.5 < majority < accuracy and accuracy > majority + 0.5 * (1 - majority)


def test_ratio_is_met(spark):
    rows = training.label_words(iq.word_pairs(spark, SF)).limit(200)
    w = d.fit(rows, 2)
    for r in rows.limit(20).collect():
        n = len(r.words)
        scores = d.ranks(r.words, w)
        for ratio in (0.1, 1 / 3, 0.75):
            kept = sorted(scores, reverse=True)[max(1, int(n * ratio)) - 1]
            assert sum(s >= kept for s in scores) == max(1, int(n * ratio))
    text = "Basically, in order to read this, it is able to wait. Fine words follow here"
    third = spark.createDataFrame([(text,), (None,), ("",)], "t string").select(d.dropped("t", w, 0.5).alias("x"), d.dropped("t", w).alias("y")).collect()
    words = [x for x in kernels._WORD.findall(third[0].x) if x.isalnum()]
    every = kernels._WORD.findall(text)
    top = sorted(zip(d.ranks(every, w), every, strict=True), reverse=True)[: len(every) // 2]
    assert sorted(x.lower() for x in words) == sorted(x.lower() for _, x in top if x.isalnum())
    assert third[1].x is None and third[2].x == "" and third[0].y


def test_nothing_to_learn_from(spark):
    none = spark.createDataFrame([([], []), (None, None), (["a"], [1, 0])], "words array<string>, labels array<int>")
    w = d.fit(none)
    assert not w.any() and d.best_labels(d.emissions(d.features(["a", "b"]), w[:-6]), w[-6:]) == [1, 1]
