"""A vector index: inverted lists by k-means, residuals in product-quantised codes, exact ranking of what may be best.

Lists and codebooks are fitted on a bounded sample; every vector is indexed.
A row keeps, beside its code, how far its vector lies from what the code says:
so each score is known within that distance, and only rows whose score may
reach the k-th best are compared in full.  A search over all lists is exact; one
over the nearest lists reads only their folders.

Vectors are compared by cosine.  Null and zero vectors, vectors with null or
non-finite components, and such of another length than most of the sample have
no direction that could be compared and are not indexed.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.functions.text import cosine

#: Vectors on which lists and codebooks are fitted at most: those of the least hashes.
FIT_ROWS = 20_000
#: Lists, parts of a vector that are coded by themselves, and codes of a part.
LISTS, PARTS, CODES = 64, 8, 256
#: Rounds of k-means.
ROUNDS = 12
#: A score in single precision may differ by so much from that in double precision.
ROUNDING = 1e-5

ROWS = "vec_id bigint, code binary, error float, list int"
SCORED = "vec_id bigint, list int, score float, error float"


def kmeans(x: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    """Centres of ``k`` groups at most; empty groups take the farthest rows."""
    k = min(k, len(x))
    centres = x[rng.choice(len(x), k, replace=False)].copy()
    for _ in range(ROUNDS):
        near, far = nearest(x, centres)
        n = np.bincount(near, minlength=k)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, x)
        centres = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], centres)
        empty = np.flatnonzero(n == 0)
        centres[empty] = x[np.argsort(-far, kind="stable")[: len(empty)]]
    return centres


def nearest(x: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centre of each row and its squared distance, some rows at a time."""
    near, far, norms = np.zeros(len(x), np.int64), np.zeros(len(x), x.dtype), (centres**2).sum(1)
    for lo in range(0, len(x), 4096):
        d = norms - 2 * x[lo : lo + 4096] @ centres.T
        near[lo : lo + 4096] = d.argmin(1)
        far[lo : lo + 4096] = d.min(1) + (x[lo : lo + 4096] ** 2).sum(1)
    return near, far


@dataclass
class Quantiser:
    """``centres`` of the lists, and for each part of a residual its codebook; parts are cut at ``cuts``."""

    centres: np.ndarray
    cuts: list[int]
    books: list[np.ndarray]

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """List, codes and error of unit vectors."""
        lists, _ = nearest(x, self.centres)
        rest = x - self.centres[lists]
        codes = np.zeros((len(x), len(self.books)), np.uint8)
        for p, book in enumerate(self.books):
            own = rest[:, self.cuts[p] : self.cuts[p + 1]]
            codes[:, p] = nearest(own, book)[0]
            rest[:, self.cuts[p] : self.cuts[p + 1]] -= book[codes[:, p]]
        return lists, codes, np.sqrt((rest**2).sum(1))

    def tables(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Products of a unit vector with all centres, and with all codes of each part."""
        t = np.zeros((len(self.books), CODES), np.float32)
        for p, book in enumerate(self.books):
            t[p, : len(book)] = book @ q[self.cuts[p] : self.cuts[p + 1]]
        return (self.centres @ q).astype(np.float32), t


def fit(sample: np.ndarray, lists: int = LISTS, parts: int = PARTS, seed: int = 0) -> Quantiser:
    """A quantiser of unit vectors."""
    rng, dims = np.random.default_rng(seed), sample.shape[1]
    centres = kmeans(sample, lists, rng)
    rest = sample - centres[nearest(sample, centres)[0]]
    cuts = np.linspace(0, dims, min(parts, dims) + 1).astype(int).tolist()
    return Quantiser(centres, cuts, [kmeans(rest[:, a:b], CODES, rng) for a, b in zip(cuts, cuts[1:], strict=False)])


def _units(column: pa.Array, dims: int) -> tuple[np.ndarray, np.ndarray]:
    """Unit vectors of the rows that have ``dims`` finite components and are not zero, and the places of these rows."""
    flat = column.cast(pa.list_(pa.float64()))
    n = flat.value_lengths().fill_null(-1).to_numpy()
    at = np.flatnonzero(n == dims)
    x = flat.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)
    norm = np.sqrt((x**2).sum(1)) if len(x) else np.zeros(0)
    good = np.isfinite(norm) & (norm > 0)
    return (x[good] / norm[good, None]).astype(np.float32), at[good]


def _encoded(q: Quantiser):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, at = _units(b.column("embedding"), q.centres.shape[1])
            lists, codes, error = q.encode(x)
            yield pa.RecordBatch.from_arrays([b.column("vec_id").take(pa.array(at)), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(error.astype(np.float32)), pa.array(lists.astype(np.int32))], ["vec_id", "code", "error", "list"])

    return run


def build(vectors: DataFrame, path: str, lists: int = LISTS, parts: int = PARTS) -> None:
    """The index of ``vectors(vec_id, embedding)`` below ``path``: codes by list, and the quantiser."""
    spark = vectors.sparkSession
    rows = vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), "embedding")
    usable = rows.where("size(embedding) > 0 AND NOT exists(embedding, x -> x IS NULL)")
    some = usable.orderBy(F.xxhash64("vec_id", "embedding")).limit(FIT_ROWS).select("embedding").toArrow()["embedding"].combine_chunks()
    n = some.value_lengths().to_numpy()
    dims = int(np.bincount(n).argmax()) if len(n) else 1
    x, _ = _units(some, dims)
    q = fit(x, lists, parts) if len(x) else Quantiser(np.zeros((1, dims), np.float32), [0, dims], [np.zeros((1, dims), np.float32)])
    books = [(-1, q.centres.shape[1], q.centres.astype("<f4").tobytes())] + [(p, q.cuts[p + 1] - q.cuts[p], book.astype("<f4").tobytes()) for p, book in enumerate(q.books)]
    spark.createDataFrame(books, "part int, dims int, centres binary").coalesce(1).write.parquet(f"{path}/quantiser")
    rows.mapInArrow(_encoded(q), ROWS).write.partitionBy("list").parquet(f"{path}/codes")


def quantiser(spark: SparkSession, path: str) -> Quantiser:
    rows = {r.part: np.frombuffer(r.centres, "<f4").reshape(-1, r.dims) for r in spark.read.parquet(f"{path}/quantiser").collect()}  # a row a part
    books = [rows[p] for p in range(len(rows) - 1)]
    return Quantiser(rows[-1], np.cumsum([0, *(b.shape[1] for b in books)]).tolist(), books)


def _approximate(heads: np.ndarray, tables: np.ndarray):
    """Scores by codes, within the rows' errors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column("list").to_numpy()
            codes = np.frombuffer(b"".join(b.column("code").to_pylist()), np.uint8).reshape(-1, len(tables))
            score = heads[lists] + tables[np.arange(len(tables)), codes].sum(1)
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("list"), pa.array(score.astype(np.float32)), b.column("error")], ["vec_id", "list", "score", "error"])

    return run


def search(vectors: DataFrame, path: str, query: list[float], k: int = 4, probes: int | None = None) -> DataFrame:
    """``vec_id, score`` of the ``k`` vectors most like ``query`` with a cosine over 0, of the ``probes`` nearest lists or of all; ties by id.

    ``vectors`` are those that were indexed.  Of the lists that are searched the
    answer is exact.
    """
    spark = vectors.sparkSession
    q = quantiser(spark, path)
    unit = np.array(query, np.float64)
    if len(unit) != q.centres.shape[1] or not np.isfinite(unit).all() or not unit.any():
        return vectors.select("vec_id", F.lit(0.0).alias("score")).limit(0)
    unit = (unit / np.sqrt((unit**2).sum())).astype(np.float32)
    heads, tables = q.tables(unit)
    rows = spark.read.schema(ROWS).parquet(f"{path}/codes")
    if probes is not None and probes < len(heads):
        rows = rows.where(F.col("list").isin(nearest_lists(q, unit, probes)))
    scored = rows.mapInArrow(_approximate(heads, tables), SCORED)
    # no score differs from its code's by more than the code's error
    low = scored.select((F.col("score") - F.col("error") - ROUNDING).alias("low")).orderBy(F.desc("low")).limit(k).collect()
    least = low[-1].low if len(low) == k else -2.0
    may = scored.where(F.col("score") + F.col("error") + ROUNDING >= F.lit(float(least))).select("vec_id").distinct()
    exact = cosine(F.col("embedding"), F.array(*map(F.lit, map(float, query))))
    found = vectors.where(F.size("embedding") == len(query)).join(may, "vec_id", "left_semi").select("vec_id", exact.alias("score"))
    return found.where("score > 0 AND NOT isnan(score)").orderBy(F.desc("score"), "vec_id").limit(k)


def nearest_lists(q: Quantiser, unit: np.ndarray, probes: int) -> list[int]:
    far = ((q.centres - unit) ** 2).sum(1)
    return np.argsort(far, kind="stable")[:probes].tolist()


def recall(found: DataFrame, wanted: DataFrame) -> float:
    """Share of ``wanted(vec_id)`` that ``found`` has; both are top-k reports."""
    want = {r.vec_id for r in wanted.select("vec_id").collect()}
    return len(want & {r.vec_id for r in found.select("vec_id").collect()}) / max(1, len(want))
