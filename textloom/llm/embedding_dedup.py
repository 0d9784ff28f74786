"""Operator 5: embedding near-duplicates by PCA-ordered tiled comparison.

Method: vectors are made unit length and turned to principal axes (one
covariance aggregate over all vectors; a rotation keeps cosines).  They are
sorted by their cells along the leading axes and cut into *tiles* of at most
``TILE`` neighbours, each with its bounds on these axes.  The distance of unit
vectors at cosine c is sqrt(2 - 2c), so two tiles meet only where their bounds
are no further apart.  Within a pair of tiles the products of leading
dimensions are accumulated first, in single precision with slack, then ``STEP``
dimensions at a time; a pair is dropped as soon as its sum plus the product of
both suffix norms can't reach the threshold.  What remains is confirmed in
double precision on the stored values.

Vectors with equal bits and label are one representative with a weight, so
copies are never compared with each other.  A tile travels as one packed row, a
vector once for each tile that its own meets; a pair of tiles gives link counts
by vector and a spanning forest of its links, not the links.

Cases: a null vector or label, a zero vector, and vectors with null, NaN or
infinite components link with nothing; vectors of different length don't link;
equal vec_ids are one node, whose links are counted by row; a null vec_id is
linked with nothing; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textloom.llm.common import connected, joined_by, slices, small_or_shuffled, stars, table, written

THRESHOLD = 0.93
#: Axes whose cells order the vectors, and whose bounds a tile has.
AXES = 8
TILE, STEP = 4096, 16
#: Axes whose cells deal out tiles to be met.
CELL_AXES = 3
#: Rows of a tile that are compared at once, and pairs that are confirmed at once.
ROWS, PAIRS = 256, 1 << 16
#: Slack of the bounds in single and double precision; whatever passes them is confirmed.
LOOSE, SLACK = 1e-5, 1e-9


def _prepared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each vector's length, digest and bytes; null for what can't be linked."""
    for b in slices(batches, 10_000):
        vectors = b.column("embedding")
        values = vectors.flatten().to_numpy(zero_copy_only=False)
        size = vectors.value_lengths().fill_null(0).to_numpy()
        row = np.repeat(np.arange(len(b)), size)
        good = (np.bincount(row, ~np.isfinite(values), len(b)) == 0) & (np.bincount(row, values != 0, len(b)) > 0)
        good &= b.column("label").is_valid().to_numpy(zero_copy_only=False) & b.column("vec_id").is_valid().to_numpy(zero_copy_only=False)
        ends = np.concatenate([[0], np.cumsum(size)])
        raw = [values[ends[i] : ends[i + 1]].tobytes() if ok else None for i, ok in enumerate(good.tolist())]
        keys = [None if r is None else hashlib.blake2b(r, digest_size=16).digest() for r in raw]
        yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("label"), pa.array(size.astype(np.int32)), pa.array(keys, pa.binary()), pa.array(raw, pa.binary())], ["vec_id", "label", "dims", "key", "vector"])


def _matrix(raw: list[bytes], dtype: str) -> np.ndarray:
    """Stored vectors of one length, in double precision."""
    return np.frombuffer(b"".join(raw), dtype).astype(np.float64).reshape(len(raw), -1)


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def _by_dims(b: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray]]:
    """Places of a batch's rows by vector length."""
    dims = b.column("dims").to_numpy()
    for d in np.unique(dims).tolist():
        yield d, np.flatnonzero(dims == d)


_SUMS = pa.schema([("dims", pa.int32()), ("n", pa.int64()), ("total", pa.binary()), ("products", pa.binary())])


def _totals(sums: dict[int, list]) -> pa.RecordBatch:
    rows = [{"dims": d, "n": n, "total": t.tobytes(), "products": p.tobytes()} for d, (n, t, p) in sums.items()]
    return pa.RecordBatch.from_pylist(rows, _SUMS)


def _outer(dtype: str):
    """Sums for the covariance: one row a task and vector length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, list] = {}
        for b in slices(batches, 10_000):
            for d, at in _by_dims(b):
                x = _unit(_matrix(b.column("vector").take(pa.array(at)).to_pylist(), dtype))
                own = sums.setdefault(d, [0, np.zeros(d), np.zeros((d, d))])
                own[0] += len(x)
                own[1] += x.sum(0)
                own[2] += x.T @ x
        yield _totals(sums)

    return run


def _add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The sums of a task's rows, read one by one."""
    sums: dict[int, list] = {}
    for b in batches:
        for d, n, total, products in zip(*(b.column(c).to_pylist() for c in _SUMS.names), strict=True):
            own = sums.setdefault(d, [0, np.zeros(d), np.zeros((d, d))])
            own[0] += n
            own[1] += np.frombuffer(total)
            own[2] += np.frombuffer(products).reshape(d, d)
    yield _totals(sums)


def axes(reps: DataFrame, dtype: str) -> dict[int, np.ndarray]:
    """Principal axes by vector length, the widest first."""
    kinds = "dims int, n long, total binary, products binary"
    sums = reps.select("dims", "vector").mapInArrow(_outer(dtype), kinds).repartition(16).mapInArrow(_add, kinds).coalesce(1).mapInArrow(_add, kinds)
    out = {}
    for r in sums.collect():  # a matrix for each vector length
        d = r["dims"]
        mean = np.frombuffer(r["total"]) / r["n"]
        cov = np.frombuffer(r["products"]).reshape(d, d) / r["n"] - np.outer(mean, mean)
        out[d] = np.linalg.eigh((cov + cov.T) / 2)[1][:, ::-1]
    return out


def _coded(basis: dict[int, np.ndarray], width: float, dtype: str):
    """Each vector's cells along the leading axes, a byte an axis."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 10_000):
            codes = np.zeros((len(b), AXES), np.uint8)
            for d, at in _by_dims(b):
                lead = _unit(_matrix(b.column("vector").take(pa.array(at)).to_pylist(), dtype)) @ basis[d][:, :AXES]
                codes[at[:, None], np.arange(lead.shape[1])] = np.clip(np.floor(lead / width) + 128, 0, 255)
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("label", "dims", "node", "copies", "vector")), pa.array([c.tobytes() for c in codes], pa.binary())], ["label", "dims", "node", "copies", "vector", "code"])

    return run


TILES = "tile long, label string, dims int, lo array<double>, hi array<double>, nodes binary, copies binary, vectors binary"


def _tiles(basis: dict[int, np.ndarray], dtype: str, size: int):
    """Packed runs of at most ``size`` neighbours with one label and length in a sorted task."""
    names = [x.split()[0] for x in TILES.split(", ")]

    def packed(number: int, label: str, dims: int, rows: list[tuple]) -> pa.RecordBatch:
        node, copies, raw = zip(*rows, strict=True)
        lead = _unit(_matrix(raw, dtype)) @ basis[dims][:, :AXES]
        cols = ([number], [label], [dims], [lead.min(0).tolist()], [lead.max(0).tolist()], [np.array(node, np.int64).tobytes()], [np.array(copies, np.int64).tobytes()], [b"".join(raw)])
        kinds = (pa.int64(), pa.string(), pa.int32(), pa.list_(pa.float64()), pa.list_(pa.float64()), pa.binary(), pa.binary(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, last, rows = TaskContext.get().partitionId() << 32, None, []
        for b in batches:
            for label, dims, *row in zip(*(b.column(c).to_pylist() for c in ("label", "dims", "node", "copies", "vector")), strict=True):
                if rows and ((label, dims) != last or len(rows) == size):
                    yield packed(number, *last, rows)
                    number, rows = number + 1, []
                last = label, dims
                rows.append(tuple(row))
        if rows:
            yield packed(number, *last, rows)

    return run


def meeting(tiles: DataFrame, width: float) -> DataFrame:
    """``t1, t2``: tiles whose bounds are within ``width`` of each other; every tile meets itself.

    Bounds are dealt to cells of ``width`` along the first ``CELL_AXES`` axes,
    so that the tiles of one large label meet under many keys; a pair is told in
    the least cell that both reach, and in no other.
    """
    meta = tiles.select("tile", "label", "dims", "lo", "hi")
    cell = lambda c, k: F.coalesce(F.floor(F.get(c, F.lit(k)) / width), F.lit(0))

    def dealt(side: str, wider: int) -> DataFrame:
        rows = meta.select("label", "dims", F.col("tile").alias(f"t{side}"), F.col("lo").alias(f"lo{side}"), F.col("hi").alias(f"hi{side}"))
        for k in range(CELL_AXES):
            first = cell(f"lo{side}", k) - wider
            rows = rows.select("*", first.alias(f"f{side}{k}"), F.explode(F.sequence(first, cell(f"hi{side}", k) + wider)).alias(f"c{k}"))
        return rows

    gap = F.zip_with(F.zip_with("lo2", "hi1", lambda a, b: a - b), F.zip_with("lo1", "hi2", lambda a, b: a - b), lambda a, b: F.greatest(a, b, F.lit(0.0)))
    apart = F.aggregate(gap, F.lit(0.0), lambda s, g: s + g * g)
    both = dealt("1", 0).join(dealt("2", 1), ["label", "dims", *(f"c{k}" for k in range(CELL_AXES))])
    least = reduce(lambda x, y: x & y, (F.col(f"c{k}") == F.greatest(f"f1{k}", f"f2{k}") for k in range(CELL_AXES)))
    return both.where(least & (F.col("t1") <= F.col("t2")) & (apart <= width * width)).select("t1", "t2")


def links_between(x: np.ndarray, y: np.ndarray, threshold: float, step: int = STEP) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs whose cosine may reach ``threshold``: leading dimensions first, dropped by suffix norms."""
    d = x.shape[1]
    sx = np.sqrt(np.maximum(0, np.cumsum((x**2)[:, ::-1], 1)[:, ::-1]))
    sy = np.sqrt(np.maximum(0, np.cumsum((y**2)[:, ::-1], 1)[:, ::-1]))
    first = min(d, step)
    sums = x[:, :first].astype(np.float32) @ y[:, :first].astype(np.float32).T
    if first < d:
        sums += np.outer(sx[:, first], sy[:, first]).astype(np.float32)
    i, j = np.nonzero(sums >= threshold - LOOSE)
    s = np.einsum("ij,ij->i", x[i, :first], y[j, :first])
    for k in range(first, d, step):
        e = min(d, k + step)
        s = s + np.einsum("ij,ij->i", x[i, k:e], y[j, k:e])
        rest = sx[i, e] * sy[j, e] if e < d else 0.0
        on = s + rest >= threshold - SLACK
        i, j, s = i[on], j[on], s[on]
    return i, j


def cosine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row by row in double precision: product by the root of the squared lengths' product."""
    return np.einsum("ij,ij->i", a, b) / np.sqrt(np.einsum("ij,ij->i", a, a) * np.einsum("ij,ij->i", b, b))


def _compared(basis: dict[int, np.ndarray], dtype: str, threshold: float):
    none = pd.array([], "Int64")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        """A row a vector with its links here, and a row a link of a spanning forest."""
        pdf = pdf.sort_values("tile")
        node = [np.frombuffer(x, np.int64) for x in pdf["nodes"]]
        copies = [np.frombuffer(x, np.int64) for x in pdf["copies"]]
        stored = [np.frombuffer(x, dtype).astype(np.float64).reshape(len(n), -1) for x, n in zip(pdf["vectors"], node, strict=True)]
        turned = [_unit(v) @ basis[int(pdf["dims"].iloc[0])] for v in stored]
        count = [np.zeros(len(n), np.int64) for n in node]
        forest = np.zeros(0, np.int64), np.zeros(0, np.int64)
        r = len(node) - 1  # the same tile where it meets itself
        for k in range(0, len(node[0]), ROWS):
            i, j = links_between(turned[0][k : k + ROWS], turned[r], threshold)
            i = i + k
            if not r:
                i, j = i[i < j], j[i < j]
            for at in range(0, len(i), PAIRS):
                a, b = i[at : at + PAIRS], j[at : at + PAIRS]
                yes = cosine(stored[0][a], stored[r][b]) >= threshold
                a, b = a[yes], b[yes]
                np.add.at(count[0], a, copies[r][b])
                np.add.at(count[r], b, copies[0][a])
                if len(a):
                    forest = stars(np.concatenate([forest[0], node[0][a]]), np.concatenate([forest[1], node[r][b]]))
        some = [np.flatnonzero(c) for c in count[: r + 1]]
        at, n = np.concatenate([x[s] for x, s in zip(node, some, strict=True)]), np.concatenate([c[s] for c, s in zip(count, some, strict=True)])
        one = pd.DataFrame({"a": none.take([-1] * len(at), allow_fill=True), "b": none.take([-1] * len(at), allow_fill=True), "node": pd.array(at, "Int64"), "n_links": pd.array(n, "Int64")})
        m = len(forest[0])
        two = pd.DataFrame({"a": pd.array(forest[0], "Int64"), "b": pd.array(forest[1], "Int64"), "node": none.take([-1] * m, allow_fill=True), "n_links": none.take([-1] * m, allow_fill=True)})
        return pd.concat([one, two])

    return run


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` for each row of ``vectors(vec_id, embedding, label)``."""
    single = vectors.schema["embedding"].dataType == T.ArrayType(T.FloatType())
    kind, dtype = ("array<float>", "<f4") if single else ("array<double>", "<f8")
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"), F.col("embedding").cast(kind).alias("embedding"))
    rows = written(rows.mapInArrow(_prepared, "vec_id long, label string, dims int, key binary, vector binary"))
    good = rows.where("key is not null")
    reps = good.groupBy("label", "key").agg(F.min("vec_id").alias("vec_id"), F.count("*").alias("copies"), F.any_value("dims").alias("dims"), F.any_value("vector").alias("vector"))
    # a representative's number; two may share a vec_id
    reps = written(reps.withColumn("node", F.monotonically_increasing_id()))
    basis = axes(reps, dtype)
    width = float(np.sqrt(max(0.0, 2 - 2 * threshold))) + 1e-6
    coded = reps.mapInArrow(_coded(basis, width, dtype), "label string, dims int, node long, copies long, vector binary, code binary")
    order = ["label", "dims", "code", "node"]
    tiles = written(coded.repartitionByRange(-(-max(1, reps.count()) // (4 * TILE)), *order).sortWithinPartitions(*order).mapInArrow(_tiles(basis, dtype, TILE), TILES))
    pairs = written(meeting(tiles, width))
    sides = pairs.select("t1", "t2", F.col("t1").alias("tile")).unionByName(pairs.where("t1 <> t2").select("t1", "t2", F.col("t2").alias("tile")))
    meets = tiles.select("tile", "dims", "nodes", "copies", "vectors").join(small_or_shuffled(sides), "tile")
    found = written(meets.groupBy("t1", "t2").applyInPandas(_compared(basis, dtype, threshold), "a long, b long, node long, n_links long"))
    groups = connected(found.where("a is not null").select("a", "b"))
    counts = found.where("node is not null").groupBy("node").agg(F.sum("n_links").alias("others"))
    of_rep = reps.select("node", F.struct("label", "key").alias("key"), "vec_id", "copies").join(groups, "node", "left").withColumn("group", F.coalesce("component", "node")).join(counts, "node", "left")
    least = of_rep.groupBy("group").agg(F.min("vec_id").alias("least"), F.count("*").alias("n"))
    of_key = joined_by(of_rep, written(least), "group", "n", reps.count()).select("key", "least", "copies", (F.coalesce("others", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    mine = joined_by(good.select("vec_id", F.struct("label", "key").alias("key")), of_key, "key", "copies", rows.count()).select("vec_id", "n_links", "least")
    # an id with several vectors joins their groups
    ids = mine.select("vec_id", "least").distinct()
    several = ids.join(small_or_shuffled(written(ids.groupBy("vec_id").count().where("count > 1").select("vec_id"))), "vec_id")
    joined = connected(several.select(F.col("vec_id").alias("a"), F.col("least").alias("b")))
    mine = mine.join(small_or_shuffled(joined.withColumnRenamed("node", "least")), "least", "left").select("vec_id", "n_links", F.coalesce("component", "least").alias("component_id"))
    rest = rows.where("key is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    out = mine.unionByName(rest)
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


def op5_pca_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings"))


def oracle() -> str:
    """DuckDB SQL for the query: every pair of rows with one label."""
    return f"""
WITH RECURSIVE v AS (SELECT row_number() OVER () AS r, vec_id, label, embedding::DOUBLE[] AS x FROM embeddings),
g AS (SELECT * FROM v WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(x) > 0 AND len(list_filter(x, lambda c: c IS NULL OR NOT isfinite(c))) = 0 AND len(list_filter(x, lambda c: c <> 0)) > 0),
p AS (SELECT i.r AS r, i.vec_id AS a, j.vec_id AS b FROM g i JOIN g j ON i.label = j.label AND i.r <> j.r AND len(i.x) = len(j.x)
  WHERE list_dot_product(i.x, j.x) / sqrt(list_dot_product(i.x, i.x) * list_dot_product(j.x, j.x)) >= {THRESHOLD}),
l AS (SELECT DISTINCT a, b FROM p WHERE a <> b),
t(a, b) AS (SELECT vec_id, vec_id FROM v WHERE vec_id IS NOT NULL UNION SELECT t.a, l.b FROM t JOIN l ON t.b = l.a),
c AS (SELECT a, min(b) AS component_id FROM t GROUP BY a), n AS (SELECT r, count(*) AS n_links FROM p GROUP BY r)
SELECT vec_id, coalesce(n_links, 0)::BIGINT AS n_links, component_id, coalesce(vec_id = component_id, true) AS kept FROM v LEFT JOIN c ON a = vec_id LEFT JOIN n USING (r)
"""
