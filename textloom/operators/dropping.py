"""A trained labeller of words to keep or drop: a chain of two labels over hashed features of words.

It learns from pairs of a text and its compressed form (``training.label_words``).
Each round, every task runs an averaged perceptron over its own texts, beginning
with the weights of the round before; the tasks' weights are mixed in proportion
to the words they have seen, so how texts fall into tasks shows in the weights.  A task hands on one vector of ``2 ** BITS`` weights,
whatever its rows, and these are added up before one comes to the driver.

``keep_scores`` are differences of the best labelling with a word kept and the
best with it dropped, pressed between 0 and 1; ``kernels.drop_words`` takes them
as it takes any scores, so a target ratio is met by the words that matter most.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textloom.functions import kernels

#: Weights of features; the last six are the chain's: label to label, and first label.
BITS = 18
ROUNDS = 5
DROP, KEEP = 0, 1
_CHAIN = 6


def features(words: list[str]) -> np.ndarray:
    """Hashed features of each word: itself, its neighbours and pairs with them, ending, shape."""
    low = [w.lower() for w in words]
    before, after = ["<s>", *low][: len(low)], [*low[1:], "</s>"][: len(low)]
    shape = [re.sub(r"[^\W\d_]", "a", re.sub(r"\d", "0", w))[:4] for w in words]
    kinds = (low, before, after, list(map("{}|{}".format, before, low)), list(map("{}|{}".format, low, after)), [w[-3:] for w in low], shape, ["bias"] * len(words))
    mask = (1 << BITS) - 1
    return np.array([[zlib.crc32(f"{k}={x}".encode("utf-8", "surrogatepass")) & mask for x in kind] for k, kind in enumerate(kinds)], np.int64).reshape(len(kinds), -1).T


def emissions(at: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Score of keeping each word over dropping it."""
    return weights[at].sum(1)


def best_labels(keep: np.ndarray, chain: np.ndarray) -> list[int]:
    """The labelling of most score (Viterbi); ties keep.  ``chain`` holds label to label, row by row, and the first label's."""
    (dd, dk, kd, kk), (d, k) = chain[:4].tolist(), chain[4:6].tolist()
    k, back = k + (float(keep[0]) if len(keep) else 0.0), []
    for e in keep[1:].tolist():
        to_d, to_k = (KEEP, k + kd) if k + kd >= d + dd else (DROP, d + dd), (KEEP, k + kk) if k + kk >= d + dk else (DROP, d + dk)
        back.append((to_d[0], to_k[0]))
        d, k = to_d[1], to_k[1] + e
    label = KEEP if k >= d else DROP
    out = [label] if len(keep) else []
    for pair in reversed(back):
        label = pair[label]
        out.append(label)
    return out[::-1]


def margins(keep: np.ndarray, chain: np.ndarray) -> np.ndarray:
    """For each word, the best score with it kept less the best with it dropped."""
    n, (dd, dk, kd, kk) = len(keep), chain[:4].tolist()
    ahead, behind = np.zeros((n, 2)), np.zeros((n, 2))
    e = keep.tolist()
    for i in range(n):
        d, k = (chain[4], chain[5]) if not i else (max(ahead[i - 1, 0] + dd, ahead[i - 1, 1] + kd), max(ahead[i - 1, 0] + dk, ahead[i - 1, 1] + kk))
        ahead[i] = d, k + e[i]
    for i in range(n - 2, -1, -1):
        d, k = behind[i + 1, 0], behind[i + 1, 1] + e[i + 1]
        behind[i] = max(dd + d, dk + k), max(kd + d, kk + k)
    total = ahead + behind
    return total[:, KEEP] - total[:, DROP]


def _counts(labels: list[int]) -> np.ndarray:
    """How often the labelling uses each of the chain's weights."""
    out = np.zeros(_CHAIN)
    if labels:
        out[4 + labels[0]] = 1
        np.add.at(out, 2 * np.array(labels[:-1], np.int64) + np.array(labels[1:], np.int64), 1)
    return out


def _learned(start: np.ndarray):
    """One pass of an averaged perceptron over a task's texts: its summed weights, weighed by words, and the words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # the average is w - u / steps: u holds each change times the step it was made at
        w, u, step, seen = start.copy(), np.zeros_like(start), 0, 0
        for b in batches:
            for words, labels in zip(b.column("words").to_pylist(), b.column("labels").to_pylist(), strict=True):
                if not words:
                    continue
                at, gold = features(words), list(labels)
                told = best_labels(emissions(at, w[:-_CHAIN]), w[-_CHAIN:])
                seen += len(words)
                if told != gold:
                    change = np.array(gold, np.float64) - np.array(told, np.float64)
                    on = np.flatnonzero(change)
                    rows, by = at[on].ravel(), np.repeat(change[on], at.shape[1])
                    np.add.at(w, rows, by)
                    np.add.at(u, rows, by * step)
                    more = _counts(gold) - _counts(told)
                    w[-_CHAIN:] += more
                    u[-_CHAIN:] += more * step
                step += 1
        if seen:
            average = (w - u / step) * seen
            on = np.flatnonzero(average)
            yield pa.RecordBatch.from_arrays([pa.array(np.append(on, -1)), pa.array(np.append(average[on], seen))], ["at", "value"])

    return run


def fit(labelled: DataFrame, rounds: int = ROUNDS) -> np.ndarray:
    """Weights from ``labelled(words, labels)``; rows without words teach nothing."""
    rows = labelled.select("words", F.col("labels").cast("array<int>").alias("labels")).where("size(words) > 0 AND size(words) = size(labels)")
    w = np.zeros((1 << BITS) + _CHAIN)
    for _ in range(rounds):
        # one number a weight, whatever the corpus
        mixed = rows.mapInArrow(_learned(w), "at bigint, value double").groupBy("at").agg(F.sum("value").alias("value")).toPandas()
        seen = mixed.loc[mixed["at"] == -1, "value"].sum()
        if not seen:
            break
        mixed = mixed[mixed["at"] >= 0]
        w = np.zeros_like(w)
        w[mixed["at"].to_numpy()] = mixed["value"].to_numpy() / seen
    return w


def keep_scores(words: list[str], weights: np.ndarray) -> list[float]:
    """Between 0 and 1, over a half for words that the best labelling keeps."""
    m = margins(emissions(features(words), weights[:-_CHAIN]), weights[-_CHAIN:])
    return (1 / (1 + np.exp(-np.clip(m, -30, 30)))).tolist()


def ranks(words: list[str], weights: np.ndarray) -> list[float]:
    """The words' order by how much better it is to keep them, as scores that no two words share: of equals the earlier is kept."""
    m = margins(emissions(features(words), weights[:-_CHAIN]), weights[-_CHAIN:])
    out = np.empty(len(words))
    out[np.lexsort((np.arange(len(words)), -m))] = np.arange(len(words), 0, -1)
    return out.tolist()


def predicted(labelled: DataFrame, weights: np.ndarray) -> DataFrame:
    """``labelled`` rows with the labels that the weights give, as ``predicted``."""

    def labels(words: list[str]) -> list[int]:
        return best_labels(emissions(features(words), weights[:-_CHAIN]), weights[-_CHAIN:]) if words else []

    @F.arrow_udf(T.ArrayType(T.IntegerType()))
    def told(column: pa.Array) -> pa.Array:
        return pa.array([None if x is None else labels(x) for x in column.to_pylist()], pa.list_(pa.int32()))

    return labelled.withColumn("predicted", told("words"))


def dropped(text: Column | str, weights: np.ndarray, target_ratio: float | None = None) -> Column:
    """The text without the words that the weights drop, or with the share ``target_ratio`` of its words that they would rather keep; punctuation stays."""
    scores = keep_scores if target_ratio is None else ranks
    return kernels.column(lambda t: kernels.drop_words(t, lambda words: scores(words, weights), target_ratio=target_ratio), T.StringType())(text)
