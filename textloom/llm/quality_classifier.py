"""Operator 7: quality classifier by a factorisation machine.

Method: a document is a sparse vector: hashed words (their share, square
rooted), buckets of structure statistics, and metadata of the row (its stored
length, whether that agrees with the text).  The score is a logistic of bias,
linear weights and all pairwise interactions through ``RANK`` factors, in time
linear in the entries: sum over factors of ((sum v x)^2 - sum (v x)^2) / 2.

It is fitted with AdaGrad on at most ``TRAIN_ROWS`` labelled rows that are not
held out, drawn by a hash of id and text; the sample is bounded, so it is
gathered and fitted on the driver.  Scoring covers all rows.  Labels, language,
source and doc_id are no inputs of a score.

Cases: null or empty text is a vector of structure alone and gets a score;
repeated and null doc_ids are scored row by row; without labels every score is
0.5; a missing or null n_chars counts as unknown; an empty table gives no rows.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm.common import held_out, labelled_sample, sliced, slices, table
from textloom.llm.text_stats import text_stats

SLOTS, RANK = 1 << 14, 8
TRAIN_ROWS = 8_000
EPOCHS, RATE, DECAY, BATCH = 6, 0.05, 1e-5, 64
THRESHOLD = 0.3
SEED = 7
#: Structure: shares by bucket; each has a slot of its own after the words' slots.
SHARES = ("n_symbols", "n_upper", "n_digits", "n_punct")
SHARE_EDGES = np.array([0.001, 0.005, 0.01, 0.02, 0.04, 0.07, 0.1, 0.15, 0.25, 0.4])
LENGTH_EDGES = np.array([1, 5, 10, 20, 50, 100, 200, 500, 1000, 3000, 10000])
BUCKETS = 16
STRUCTURE = (*SHARES, "repeat", "dup_lines", "distinct", "word_length", "line_length", "length", "n_chars")
SIZE = SLOTS + BUCKETS * len(STRUCTURE)


class _Slots:
    def __init__(self) -> None:
        self.known: dict[str, int] = {}

    def of(self, words: list[str]) -> np.ndarray:
        if len(self.known) > 400_000:
            self.known.clear()
        got, known = np.empty(len(words), np.int32), self.known
        for i, w in enumerate(words):
            slot = known.get(w)
            if slot is None:
                slot = zlib.crc32(w.encode()) % SLOTS
                if len(w) < 40:
                    known[w] = slot
            got[i] = slot
        return got


_memory: list[_Slots] = []


def _slots() -> _Slots:
    if not _memory:
        _memory.append(_Slots())
    return _memory[0]


def vectors(texts: pa.Array, n_chars: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(row, slot, value)`` of all entries, in order of row."""
    n = len(texts)
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    s = text_stats(texts)
    words = pc.ascii_split_whitespace(pc.ascii_lower(texts))
    flat = words.flatten()
    row = np.repeat(np.arange(n, dtype=np.int64), np.diff(words.offsets.to_numpy()))
    real = pc.greater(pc.binary_length(flat), 0).to_numpy(zero_copy_only=False)
    coded = flat.filter(pa.array(real)).dictionary_encode()
    slot = _slots().of(coded.dictionary.to_pylist())[coded.indices.to_numpy()]
    at, count = np.unique(row[real] * SLOTS + slot, return_counts=True)
    row, slot = at // SLOTS, at % SLOTS
    value = np.sqrt(count / np.maximum(1, s["n_words"])[row])
    chars, words_n = np.maximum(1, s["word_chars"]), np.maximum(1, s["n_words"])
    stored = n_chars.fill_null(-1).to_numpy(zero_copy_only=False)
    length = np.fromiter((len(t) for t in texts.to_pylist()), np.int64, n)
    lines = np.maximum(1, s["n_lines"])
    buckets = [
        *(np.searchsorted(SHARE_EDGES, s[k] / chars, "right") for k in SHARES),
        np.searchsorted(SHARE_EDGES, s["n_repeat_words"] / words_n, "right"),
        np.searchsorted(SHARE_EDGES, s["n_dup_lines"] / lines, "right"),
        np.minimum(10, 10 * s["n_distinct"] // words_n),
        np.minimum(15, s["word_chars"] // words_n),
        np.searchsorted(LENGTH_EDGES, s["n_words"] / lines, "right"),
        np.searchsorted(LENGTH_EDGES, s["n_words"], "right"),
        np.where(stored < 0, 0, np.where(stored == length, 1, 2)),
    ]
    extra = np.column_stack([SLOTS + k * BUCKETS + b for k, b in enumerate(buckets)]).ravel()
    row = np.concatenate([row, np.repeat(np.arange(n), len(buckets))])
    order = np.argsort(row, kind="stable")
    return row[order], np.concatenate([slot, extra])[order], np.concatenate([value, np.full(len(extra), 1.0)])[order]


class FactorisationMachine:
    def __init__(self, bias: float, linear: np.ndarray, factors: np.ndarray):
        self.bias, self.linear, self.factors = bias, linear, factors

    def raw(self, row: np.ndarray, slot: np.ndarray, value: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Scores before the logistic, and the factor sums by row."""
        vx = self.factors[slot] * value[:, None]
        total, square = np.zeros((n, RANK)), np.zeros(n)
        if len(row):
            first = np.flatnonzero(np.diff(row, prepend=-1))
            total[row[first]] = np.add.reduceat(vx, first)
            square[row[first]] = np.add.reduceat((vx * vx).sum(1), first)
        linear = np.bincount(row, self.linear[slot] * value, minlength=n)
        return self.bias + linear + 0.5 * ((total**2).sum(1) - square), total

    def score(self, row: np.ndarray, slot: np.ndarray, value: np.ndarray, n: int) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.raw(row, slot, value, n)[0], -35, 35)))


def train(row: np.ndarray, slot: np.ndarray, value: np.ndarray, y: np.ndarray) -> FactorisationMachine:
    """AdaGrad over shuffled mini-batches; the same sample gives the same model."""
    rng = np.random.default_rng(SEED)
    rate = np.clip(y.mean(), 0.01, 0.99) if len(y) else 0.5
    fm = FactorisationMachine(float(np.log(rate / (1 - rate))), np.zeros(SIZE), rng.normal(0, 0.01, (SIZE, RANK)))
    g_bias, g_lin, g_fac = 1.0, np.ones(SIZE), np.ones((SIZE, RANK))
    bounds = np.searchsorted(row, np.arange(len(y) + 1))
    for _ in range(EPOCHS):
        order = rng.permutation(len(y))
        for k in range(0, len(y), BATCH):
            own = order[k : k + BATCH]
            at = np.concatenate([np.arange(bounds[i], bounds[i + 1]) for i in own])
            r = np.repeat(np.arange(len(own)), bounds[own + 1] - bounds[own])
            s, x = slot[at], value[at]
            raw, total = fm.raw(r, s, x, len(own))
            err = 1 / (1 + np.exp(-np.clip(raw, -35, 35))) - y[own]
            e = (err[r] * x)[:, None]
            grad = e * (total[r] - fm.factors[s] * x[:, None])
            u, back = np.unique(s, return_inverse=True)
            lin = np.bincount(back, e[:, 0], minlength=len(u)) + DECAY * fm.linear[u]
            fac = np.column_stack([np.bincount(back, grad[:, f], minlength=len(u)) for f in range(RANK)]) + DECAY * fm.factors[u]
            g_bias += err.sum() ** 2
            g_lin[u] += lin**2
            g_fac[u] += fac**2
            fm.bias -= RATE * err.sum() / np.sqrt(g_bias)
            fm.linear[u] -= RATE * lin / np.sqrt(g_lin[u])
            fm.factors[u] -= RATE * fac / np.sqrt(g_fac[u])
    fm.linear, fm.factors = fm.linear.astype(np.float32), fm.factors.astype(np.float32)
    return fm


def _entries(rows):
    for b in slices(rows):
        row, slot, value = vectors(b.column("text"), b.column("n_chars"))
        y = b.column("label").to_numpy(zero_copy_only=False)
        ends = pa.array(np.searchsorted(row, np.arange(len(y) + 1)).astype(np.int32))
        each = [pa.ListArray.from_arrays(ends, pa.array(x)) for x in (slot.astype(np.int32), value.astype(np.float32))]
        yield pa.RecordBatch.from_arrays([*each, pa.array(y.astype(np.int32))], ["slots", "values", "label"])


def fit(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> FactorisationMachine:
    """A model from at most ``rows`` labelled rows of ``docs(doc_id, text, n_chars)`` that are not held out."""
    if "n_chars" not in docs.columns:
        docs = docs.withColumn("n_chars", F.lit(None))
    some = labelled_sample(docs.withColumn("n_chars", F.col("n_chars").cast("long")), labels, "quality", rows, "n_chars").select("text", "n_chars", "label")
    got: pd.DataFrame = some.mapInArrow(_entries, "slots array<int>, values array<float>, label int").limit(rows).toPandas()
    # tasks may hand in their rows in any order, and the model depends on it
    got = got.iloc[sorted(range(len(got)), key=lambda i: (list(got["slots"].iat[i]), list(got["values"].iat[i]), got["label"].iat[i]))]
    size = np.array([len(x) for x in got["slots"]], np.int64)
    row = np.repeat(np.arange(len(got)), size)
    slot = np.concatenate([*got["slots"], np.zeros(0, np.int64)]).astype(np.int64)
    value = np.concatenate([*got["values"], np.zeros(0)]).astype(np.float64)
    return train(row, slot, value, got["label"].to_numpy(float))


def scored(docs: DataFrame, model: FactorisationMachine) -> DataFrame:
    """``docs`` with ``quality_score``."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)

    def run(texts: pa.Array, n_chars: pa.Array) -> pa.Array:
        return pa.array(shared.value.score(*vectors(texts, n_chars), len(texts)).astype(np.float64))

    n_chars = F.col("n_chars").cast("long") if "n_chars" in docs.columns else F.lit(None).cast("long")
    return docs.withColumn("quality_score", F.arrow_udf(sliced(run), "double")("text", n_chars))


def op7_factorisation_machine(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    docs = docs.select("doc_id", "text", *(["n_chars"] if "n_chars" in docs.columns else []))
    rows = scored(docs, fit(docs, table(spark, sf_dir, "labels")))
    score = F.col("quality_score")
    return rows.select("doc_id", held_out().alias("held_out"), score.alias("score"), (score >= THRESHOLD).cast("int").alias("predicted"))
