"""Operator 9: toxicity by a weighted lexicon and Aho-Corasick.

Method: texts are folded (compatibility forms, accents, homoglyphs of other scripts,
invisible characters, digits and signs that stand for letters, words spelt letter
by letter, case), reduced to words with one space between, and scanned once for all terms by an Aho-Corasick
automaton.  A term is a word or the beginning of a word.  Matches inside an
exception phrase don't count.  The sum of weights and its share of the text's
length go through a logistic curve.

Weights are learned from labelled rows that are not held out.  Copies of a text
count as one text.  A term needs ``MIN_SHARE`` of the toxic texts and must be
rare in others; its weight is the log ratio of these shares.  So that a passage
inside many texts doesn't make all its words toxic, two texts that hold the term
must seldom have the same word before it, or the same word after it: the chance
of that is estimated without bias, so it doesn't drift with the corpus' size.
These counts are Spark aggregates over all labelled rows; as a
term needs a share of the toxic texts, the lexicon's size doesn't grow with the
corpus.  The curve's three numbers are fitted on at most ``CURVE_ROWS`` rows.

Cases: null or empty text scores as a text without matches; rows with null or
repeated doc_ids are scored row by row; without labels (or with one class only)
``SEED`` and a fixed curve are used; an empty table gives no rows; other columns
are kept by ``reject`` and not read by the query.
"""

from __future__ import annotations

import re
import unicodedata
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textloom.llm.common import fresh, held_out, labelled_texts, sampled, sliced, slices, small_or_shuffled, table, written

MIN_SHARE, MIN_TEXTS = 0.01, 5
#: A term's rate in other texts may be this part of its rate in toxic ones.
MAX_CLEAN = 0.05
#: Chance that two texts with a term have the same word before it, or after it.
MAX_SAME = 0.4
STEM_CHARS = (4, 5, 6)
CURVE_ROWS = 20_000
THRESHOLD = 0.5
SMOOTH_WORDS = 50
#: Used besides what is learned: common English insults.
SEED = ("idiot", "moron", "stupid", "scum", "pathetic", "worthless", "disgusting", "loser", "trash", "imbecile", "dumbass", "bastard", "bitch", "asshole", "retard", "whore", "slut")
SEED_WEIGHT = 3.0
#: Matches inside these are no insults.
EXCEPTIONS = ("trash can", "trash bin", "trash bag", "white trash can", "take out the trash", "pond scum layer", "clown fish", "clown school", "circus clown", "sore loser clause", "not stupid", "not worthless", "worthless check", "slut in swedish", "retard the spread", "retard the growth")

#: Letters of other scripts that look like these of ASCII.
HOMOGLYPHS = {
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "х": "x", "у": "y", "і": "i", "ѕ": "s", "ј": "j", "һ": "h", "ԁ": "d", "ԛ": "q", "ԝ": "w", "м": "m", "т": "t", "к": "k", "в": "b", "н": "h", "г": "r",
    "α": "a", "ε": "e", "ο": "o", "ρ": "p", "ι": "i", "κ": "k", "ν": "v", "τ": "t", "υ": "u", "χ": "x", "ω": "w", "η": "n",
    "ı": "i", "ł": "l", "ø": "o", "ɑ": "a", "ɡ": "g", "ⅼ": "l", "ʟ": "l", "ɪ": "i", "ꜱ": "s",
}
INVISIBLE = "\u00ad\u200b\u200c\u200d\u2060\ufeff"
DIGITS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s"}

_FOLD = {ord(k): v for k, v in HOMOGLYPHS.items()} | dict.fromkeys(map(ord, INVISIBLE))
_DIGITS = str.maketrans(DIGITS)
_INSIDE = re.compile(r"[0134578]+(?=[a-z])|(?<=[a-z])[0134578]+|(?<=[a-z])[@$]+(?=[a-z])")
#: Signs before a word are letters of it or none (@name, $cum): both readings are kept.
_BEFORE = re.compile(r"(?<![^\W_])([@$]+)([a-z][^\W_]*)")
_GAPS = re.compile(r"[\W_]+")
#: Accents and other marks on letters.
_MARKS = re.compile("[\u0300-\u036f]+")
#: A word spelt letter by letter.
_SPELT = re.compile(r"(?<= )[a-z](?: [a-z]){3,}(?= )")


def fold(text: str) -> str:
    """Words of a text as the lexicon spells them, with a space before and after each."""
    if not text.isascii():
        text = _MARKS.sub("", unicodedata.normalize("NFKD", text).lower()).translate(_FOLD)
    text = _INSIDE.sub(lambda m: m.group().translate(_DIGITS), text.lower())
    if "@" in text or "$" in text:
        text = _BEFORE.sub(lambda m: f"{m[2]} {m[1].translate(_DIGITS)}{m[2]}", text)
    return _SPELT.sub(lambda m: m.group().replace(" ", ""), f" {_GAPS.sub(' ', text).strip()} ")


def terms_of(word: str) -> list[str]:
    """A word and its beginnings, as the automaton's keys."""
    return [f" {word} ", *(f" {word[:k]}" for k in STEM_CHARS if len(word) > k)]


class Lexicon:
    def __init__(self, weights: dict[str, float], exceptions: tuple[str, ...] = EXCEPTIONS, curve: tuple[float, float, float] = (-4.0, 2.0, 20.0)):
        self.weights, self.exceptions, self.curve = weights, exceptions, curve
        self.automaton = None

    def __getstate__(self):
        return self.weights, self.exceptions, self.curve

    def __setstate__(self, state):
        self.__init__(*state)

    def features(self, text: str) -> tuple[float, float, int]:
        """log(1 + weights), weights by length, and the number of matches."""
        if self.automaton is None:
            import ahocorasick

            self.automaton = ahocorasick.Automaton()
            for term, w in self.weights.items():
                self.automaton.add_word(term, (len(term), w))
            for phrase in self.exceptions:
                self.automaton.add_word(f" {phrase} ", (len(phrase) + 2, 0.0))
            if len(self.automaton):
                self.automaton.make_automaton()
        words = fold(text)
        if not len(self.automaton):
            return 0.0, 0.0, 0
        best: dict[int, float] = {}  # by the word's place: the longest beginning and the whole word are one match
        spared: list[tuple[int, int]] = []
        for end, (size, w) in self.automaton.iter(words):
            at = end - size + 1
            if w:
                best[at] = max(w, best.get(at, 0.0))
            else:
                spared.append((at, end))
        for lo, hi in spared:
            for at in [at for at in best if lo <= at < hi]:
                del best[at]
        total = sum(best.values())
        return float(np.log1p(total)), total / (words.count(" ") + SMOOTH_WORDS), len(best)

    def score(self, x: np.ndarray) -> np.ndarray:
        a, b, c = self.curve
        return 1 / (1 + np.exp(-np.clip(a + b * x[:, 0] + c * x[:, 1], -500, 500)))


# --- learning ---------------------------------------------------------------


def _counted(n: dict[str, float]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(n), pa.string()), pa.array(list(n.values()), pa.float64())], ["term", "n"])


def _terms(wanted: frozenset[str] | None):
    """Texts that hold each term, a copied text's ``weight`` being its part of one text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            n: defaultdict[str, float] = defaultdict(float)
            for text, weight in zip(b.column("text").to_pylist(), b.column("weight").to_pylist(), strict=True):
                terms = {t for w in set(fold(text).split()) for t in terms_of(w)}
                for t in terms if wanted is None else wanted & terms:
                    n[t] += weight
            yield _counted(n)

    return run


def _contexts(wanted: frozenset[str]):
    """Texts by term and the words around its first place, where ``side`` is 0 before and 1 after."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            n: defaultdict[tuple[str, int, str], float] = defaultdict(float)
            for text, weight in zip(b.column("text").to_pylist(), b.column("weight").to_pylist(), strict=True):
                words, seen = ["", *fold(text).split(), ""], set()
                for i, w in enumerate(words[1:-1], 1):
                    for t in wanted.intersection(terms_of(w)) - seen:
                        seen.add(t)
                        n[t, 0, words[i - 1]] += weight
                        n[t, 1, words[i + 1]] += weight
            cols = list(zip(*n, strict=True)) or [[], [], []]
            types = (pa.string(), pa.int32(), pa.string())
            yield pa.RecordBatch.from_arrays([*(pa.array(c, t) for c, t in zip(cols, types, strict=True)), pa.array(list(n.values()), pa.float64())], ["term", "side", "word", "n"])

    return run


def _weighted(rows: DataFrame) -> DataFrame:
    """``rows(text, label)`` with ``weight``, one by the number of rows with the label and text.  Only hashes leave their rows."""
    on = [F.col("label"), F.xxhash64("text").alias("h"), F.length("text").alias("size")]
    copies = rows.select(*on).groupBy("label", "h", "size").agg(F.count("*").alias("copies")).where("copies > 1")
    all_rows = rows.select("text", *on).join(small_or_shuffled(written(copies)), ["label", "h", "size"], "left")
    return all_rows.select("text", "label", (1 / F.coalesce("copies", F.lit(1))).alias("weight"))


def _features(lexicon: Lexicon):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            x = [lexicon.features(t or "") for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in x], pa.float64()), pa.array([r[1] for r in x], pa.float64()), b.column("label")], ["x0", "x1", "label"])

    return run


def _curve(x: np.ndarray, y: np.ndarray) -> tuple[float, float, float]:
    """Logistic regression by Newton steps with a small ridge."""
    a = np.column_stack([np.ones(len(x)), x])
    w, ridge = np.zeros(3), np.diag([1e-3, 1e-2, 1e-2])
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        step = np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + ridge, a.T @ (y - p) - ridge @ w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return tuple(float(v) for v in w)


def learn(docs: DataFrame, labels: DataFrame) -> Lexicon:
    """A lexicon from the labelled rows of ``docs(doc_id, text)`` that are not held out."""
    rows = labelled_texts(docs, labels, "toxic")
    seed = {f" {w} ": SEED_WEIGHT for w in SEED}
    texts = _weighted(rows)
    count = {r["label"]: r["n"] for r in texts.groupBy("label").agg(F.round(F.sum("weight")).alias("n")).collect()}  # two rows
    n_toxic, n_clean = count.get(1, 0), count.get(0, 0)
    if not n_toxic or not n_clean:
        return Lexicon(seed)
    toxic, clean = texts.where("label = 1").select("text", "weight"), texts.where("label = 0").select("text", "weight")
    least = max(MIN_TEXTS, MIN_SHARE * n_toxic)

    def totals(df: DataFrame, wanted: frozenset[str] | None) -> DataFrame:
        return df.mapInArrow(_terms(wanted), "term string, n double").groupBy("term").agg(F.round(F.sum("n")).alias("n"))

    often = {r["term"]: r["n"] for r in totals(toxic, None).where(F.col("n") >= least).toLocalIterator()}
    elsewhere = {r["term"]: r["n"] for r in totals(clean, frozenset(often)).toLocalIterator()}
    rare = {t: n for t, n in often.items() if elsewhere.get(t, 0) / n_clean <= MAX_CLEAN * n / n_toxic}
    around = toxic.mapInArrow(_contexts(frozenset(rare)), "term string, side int, word string, n double").groupBy("term", "side", "word").agg(F.round(F.sum("n")).alias("n"))
    same = around.groupBy("term", "side").agg((F.sum(F.col("n") * (F.col("n") - 1)) / (F.sum("n") * (F.sum("n") - 1))).alias("same"))
    weights = dict(seed)
    for r in same.groupBy("term").agg(F.max("same").alias("same")).toLocalIterator():
        term = r["term"]
        if r["same"] <= MAX_SAME:
            weights[term] = float(np.log((rare[term] + 0.5) / (n_toxic + 1)) - np.log((elsewhere.get(term, 0) + 0.5) / (n_clean + 1)))
    lexicon = Lexicon({t: max(0.1, w) for t, w in weights.items()})
    some = sampled(rows, CURVE_ROWS).select("text", "label")
    x = some.mapInArrow(_features(lexicon), "x0 double, x1 double, label int").limit(CURVE_ROWS).toPandas()
    lexicon.curve = _curve(x[["x0", "x1"]].to_numpy(), x["label"].to_numpy(float))
    return lexicon


# --- scoring ----------------------------------------------------------------

VERDICT = T.StructType([T.StructField("score", T.DoubleType()), T.StructField("n_matches", T.LongType())])


def judged(docs: DataFrame, lexicon: Lexicon, name: str = "toxicity") -> DataFrame:
    """``docs`` with the struct ``name``: ``score`` and ``n_matches``."""

    def verdict(texts: pa.Array) -> pa.Array:
        x = np.array([lexicon.features(t or "") for t in texts.to_pylist()], float).reshape(-1, 3)
        return pa.StructArray.from_arrays([pa.array(lexicon.score(x)), pa.array(x[:, 2].astype(np.int64))], ["score", "n_matches"])

    return docs.withColumn(name, F.arrow_udf(sliced(verdict), VERDICT)("text"))


def reject(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that score below the threshold, with their columns."""
    name = fresh(docs, "toxicity")
    return judged(docs, learn(docs, labels), name).where(F.col(f"{name}.score") < THRESHOLD).select(*docs.columns)


def op9_lexicon_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    rows = judged(docs, learn(docs, table(spark, sf_dir, "labels")))
    score = F.col("toxicity.score")
    return rows.select("doc_id", held_out().alias("held_out"), score.alias("score"), (score >= THRESHOLD).cast("int").alias("predicted"), "toxicity.n_matches")
