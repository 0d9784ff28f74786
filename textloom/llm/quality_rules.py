"""Operator 4: quality rules with robust multivariate outliers.

Method: minimum-covariance-determinant estimates per language and source.  Each
document gives a vector of transformed statistics (arcsine square roots of
symbol, capital, digit and punctuation shares, and the log word length).  Per
group, three deterministic starts around the medians (median deviations,
correlations of bounded values, correlations of directions) go through C-steps:
each takes the mean and covariance of the half of all rows with the least
Mahalanobis distance, until the determinant stops falling.  The estimate of
least determinant is kept, so just under half of a group may be junk.  Every
step is a grouped aggregate over the statistics of all documents, so a group of
any size is summed map-side and never gathered.  A document is rejected when its
squared distance passes ``CUTOFF``, a quantile of the chi-square distribution.

Groups with fewer than ``MIN_GROUP`` rows use the estimate of their language,
and that of all documents if the language is small too.  ``FLOOR`` is added to
the standard deviations, so that a statistic which nearly never varies (no
digits) doesn't turn a phone number into an outlier.

Cases: null or empty text has no words and fails the base rules; null lang or
source is a group of its own; repeated rows and doc_ids are judged row by row;
an empty table gives no rows; other columns are kept by ``reject`` and not read
by the query.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textloom.llm.common import fresh, sliced, small_or_shuffled, table, written
from textloom.llm.text_stats import NAMES, text_stats

MIN_WORDS, REPEAT_PERCENT = 10, 20
SUBSET, MIN_GROUP = 0.5, 200
#: Quantile 0.999 of the chi-square distribution with five degrees of freedom.
CUTOFF = 20.515
#: Makes the covariance of the inner half of a normal cloud in five dimensions that of the whole.
CONSISTENCY = 1.912
#: C-steps end where the log determinant falls by less.
LEAST_FALL = 1e-3
#: Estimates are broadcast up to this number (some 400 bytes each); beyond, their keys are split by ``SALTS``.
BROADCAST_GROUPS, SALTS = 100_000, 64
#: Word characters by which shares of short texts are drawn to the usual share.
SHRINK = 40
USUAL = {"n_symbols": 0.0, "n_upper": 0.016, "n_digits": 0.0, "n_punct": 0.028}
#: Least standard deviations: symbols, capitals, digits, punctuation, word length.
FLOOR = (0.03, 0.05, 0.15, 0.05, 0.1)
DIMS = len(FLOOR)
PAIRS = [(i, j) for i in range(DIMS) for j in range(i, DIMS)]


def _stats(texts: pa.Array) -> pa.Array:
    return pa.StructArray.from_arrays([pa.array(v, pa.int64()) for v in text_stats(texts).values()], list(NAMES))


stats_of = F.arrow_udf(sliced(_stats), T.StructType([T.StructField(n, T.LongType()) for n in NAMES]))


def vector(s: str) -> list[Column]:
    """The transformed statistics of the struct column ``s``."""
    chars = F.col(f"{s}.word_chars") + SHRINK
    shares = [F.asin(F.sqrt((F.col(f"{s}.{n}") + SHRINK * usual) / chars)) for n, usual in USUAL.items()]
    return [*shares, F.log(chars / (F.col(f"{s}.n_words") + SHRINK / 5))]


def base_failed(s: str) -> Column:
    return (F.col(f"{s}.n_words") < MIN_WORDS) | (100 * F.col(f"{s}.n_repeat_words") > REPEAT_PERCENT * F.col(f"{s}.n_words"))


def _name(c: str) -> Column:
    return F.coalesce(F.concat(F.lit("="), F.col(c)), F.lit("-"))


def _distance(x: list[Column], mean: str, inverse: str) -> Column:
    d = [v - F.element_at(mean, i + 1) for i, v in enumerate(x)]
    terms = [(1 if i == j else 2) * F.element_at(inverse, k + 1) * d[i] * d[j] for k, (i, j) in enumerate(PAIRS)]
    return reduce(lambda a, b: a + b, terms)


def _rows(key, start, n, mean, cov) -> pd.DataFrame:
    """Estimates by key and start, from means and covariances."""
    cov = cov + np.diag(np.square(FLOOR))
    upper = [[float(m[i, j]) for i, j in PAIRS] for m in np.linalg.inv(cov)]
    return pd.DataFrame({"key": key, "start": start, "n": n, "mean": [list(map(float, m)) for m in mean], "inverse": upper, "size": np.linalg.slogdet(cov)[1]})


def _matrices(pdf: pd.DataFrame, names: list[str]) -> np.ndarray:
    out = np.zeros((len(pdf), DIMS, DIMS))
    for name, (i, j) in zip(names, PAIRS, strict=True):
        out[:, i, j] = out[:, j, i] = pdf[name]
    return out


def _starts(rows):
    """Three estimates for each group around its medians; their sizes aren't comparable and count as infinite."""
    for pdf in rows:
        spread = np.array(pdf["spread"].to_list(), float).reshape(-1, DIMS)
        scale = spread[:, :, None] * spread[:, None, :]
        kinds = [np.eye(DIMS)[None], *(_matrices(pdf, [f"{kind}{k}" for k in range(len(PAIRS))]) for kind in "bd")]
        for start, kind in enumerate(kinds):
            yield _rows(pdf["key"], start, pdf["n"], pdf["mean"], kind * scale).assign(size=np.inf)


def _inverse(rows):
    """Estimates from the groups' sums; ``before`` is the log determinant of the step before."""
    for pdf in rows:
        cov = _matrices(pdf, [f"c{k}" for k in range(len(PAIRS))]) * CONSISTENCY
        yield _rows(pdf["key"], pdf["start"], pdf["n"], pdf["mean"], cov).assign(before=pdf["before"])


MODEL = "key string, start int, n long, mean array<double>, inverse array<double>, size double"


def _with(vectors: DataFrame, model: DataFrame, n: int) -> DataFrame:
    """``vectors(key, salt, ..)`` with the ``n`` rows of ``model`` by key; no key is one task."""
    if n <= BROADCAST_GROUPS:
        return vectors.join(F.broadcast(model), "key")
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")
    return vectors.join(model.select("*", salts), ["key", "salt"])


def _salted(rows: DataFrame) -> DataFrame:
    return written(rows.withColumn("salt", (F.monotonically_increasing_id() % SALTS).cast("int")))


def estimates(vectors: DataFrame) -> DataFrame:
    """``key, n, mean, inverse`` by group of ``vectors(key, x0..)``; x0.. without nulls."""
    xs = [f"x{i}" for i in range(DIMS)]
    x = [F.col(c) for c in xs]
    vectors = _salted(vectors.select("key", *xs))
    med = written(vectors.groupBy("key").agg(F.count("*").alias("n"), F.array(*(F.percentile_approx(c, 0.5) for c in xs)).alias("mean")))
    groups = med.count()
    off = [F.abs(c - F.element_at("mean", i + 1)) for i, c in enumerate(x)]
    spread = _with(vectors, med, groups).groupBy("key").agg(F.first("n").alias("n"), F.first("mean").alias("mean"), F.array(*(F.greatest(F.lit(FLOOR[i]), 1.4826 * F.percentile_approx(o, 0.5)) for i, o in enumerate(off))).alias("spread"))
    z = [(c - F.element_at("mean", i + 1)) / F.element_at("spread", i + 1) for i, c in enumerate(x)]
    scaled = _with(vectors, written(spread), groups).select("key", "n", "mean", "spread", *(v.alias(f"z{i}") for i, v in enumerate(z)))
    long = reduce(lambda a, b: a + b, (F.col(f"z{i}") * F.col(f"z{i}") for i in range(DIMS)))
    bounded = [F.avg(F.tanh(f"z{i}") * F.tanh(f"z{j}")).alias(f"b{k}") for k, (i, j) in enumerate(PAIRS)]
    directions = [F.avg(F.when(long > 0, F.col(f"z{i}") * F.col(f"z{j}") / long).otherwise(0.0)).alias(f"d{k}") for k, (i, j) in enumerate(PAIRS)]
    start = scaled.groupBy("key").agg(F.first("n").alias("n"), F.first("mean").alias("mean"), F.first("spread").alias("spread"), *bounded, *directions)
    active, steps = written(start.mapInPandas(_starts, MODEL)), []
    while left := active.count():
        far = _with(vectors, active, left).select("key", "start", _distance(x, "mean", "inverse").alias("d"))
        cut = far.groupBy("key", "start").agg(F.percentile_approx("d", SUBSET).alias("cut"))
        model = written(active.join(cut, ["key", "start"]))
        inner = _with(vectors, model, left).where(_distance(x, "mean", "inverse") <= F.col("cut"))
        sums = inner.groupBy("key", "start").agg(F.first("n").alias("n"), F.first("size").alias("before"), F.array(*(F.avg(c) for c in xs)).alias("mean"), *(F.covar_pop(xs[i], xs[j]).alias(f"c{k}") for k, (i, j) in enumerate(PAIRS)))
        steps.append(written(sums.mapInPandas(_inverse, MODEL + ", before double")))
        active = steps[-1].where(F.col("size") < F.col("before") - LEAST_FALL).drop("before")
    every = reduce(DataFrame.unionByName, (s.drop("before") for s in steps)) if steps else active
    best = every.groupBy("key").agg(F.min(F.struct("size", "start", "n", "mean", "inverse")).alias("m"))
    return written(best.select("key", "m.n", "m.mean", "m.inverse"))


def fit(docs: DataFrame) -> DataFrame:
    """``by_source, mean, inverse``: the estimate for each language and source of ``docs(text, lang, source)``."""
    rows = docs.select(_name("lang").alias("by_lang"), F.concat_ws("\u0001", _name("lang"), _name("source")).alias("by_source"), stats_of("text").alias("s"))
    rows = rows.where(~base_failed("s"))
    vectors = written(rows.select("by_lang", "by_source", *(v.alias(f"x{i}") for i, v in enumerate(vector("s")))))
    # the group whose estimate each source uses; only these groups are estimated
    groups = written(vectors.groupBy("by_source", "by_lang").agg(F.count("*").alias("n")))
    by_lang = Window.partitionBy("by_lang")
    sized = groups.withColumn("n_lang", F.sum("n").over(by_lang))
    own, lang = F.col("n") >= MIN_GROUP, F.col("n_lang") >= MIN_GROUP
    uses = sized.withColumn("uses", F.when(own, F.col("by_source")).when(lang, F.col("by_lang")).otherwise("*"))
    uses = written(uses.withColumn("lang_used", F.max(F.col("uses") == F.col("by_lang")).over(by_lang)))
    any_all = F.lit(bool(uses.where("uses = '*'").head(1)))
    keys = F.filter(F.array(F.when(any_all, "*"), F.when(F.col("lang_used"), F.col("by_lang")), F.when(F.col("uses") == F.col("by_source"), F.col("by_source"))), lambda k: k.isNotNull())
    xs = [f"x{i}" for i in range(DIMS)]
    keyed = _with(_salted(vectors.select(F.col("by_source").alias("key"), *xs)), uses.select(F.col("by_source").alias("key"), keys.alias("keys")), uses.count())
    model = estimates(keyed.select(F.explode("keys").alias("key"), *xs))
    return written(uses.join(small_or_shuffled(model.withColumnRenamed("key", "uses"), BROADCAST_GROUPS), "uses").select("by_source", "mean", "inverse"))


def judged(docs: DataFrame, model: DataFrame, name: str = "rules") -> DataFrame:
    """``docs`` with the struct ``name``: its counts, ``base_failed``, ``distance`` and ``kept``."""
    by, of = fresh(docs, "by_source"), fresh(docs, "model")
    rows = docs.withColumn(name, stats_of("text")).withColumn(by, F.concat_ws("\u0001", _name("lang"), _name("source")))
    to = model.select(F.col("by_source").alias(by), F.struct("mean", "inverse").alias(of))
    rows = rows.join(small_or_shuffled(to, BROADCAST_GROUPS), by, "left")
    failed = base_failed(name)
    distance = F.when(~failed, _distance(vector(name), f"{of}.mean", f"{of}.inverse"))
    rows = rows.withColumn(name, F.col(name).withField("base_failed", failed).withField("distance", distance))
    kept = ~failed & (F.coalesce(F.col(f"{name}.distance"), F.lit(0.0)) <= CUTOFF)
    return rows.withColumn(name, F.col(name).withField("kept", kept)).drop(by, of)


def reject(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that pass base rules and the outlier test, with their columns."""
    name = fresh(docs, "rules")
    return judged(docs, fit(docs), name).where(f"{name}.kept").select(*docs.columns)


def op4_robust_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    rows = judged(docs, fit(docs))
    return rows.select("doc_id", *(f"rules.{n}" for n in NAMES[:5]), "rules.base_failed", "rules.kept", "rules.distance")
