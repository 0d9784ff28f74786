"""Shared plumbing: tables in the cluster's shared folder, Arrow slices, joins on hot keys, and components."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from functools import wraps

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII letters only: ``lower()`` would also change other scripts.
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: A slice of an Arrow batch that a Python worker works on at once: rows, and bytes of its columns.
SLICE_ROWS, SLICE_BYTES = 1000, 4 << 20
#: Bytes of an Arrow batch, in place of Spark's default.
BATCH_BYTES, DEFAULT_BATCH_BYTES = 4 << 20, "67108864"
#: A key is hot when it holds one row in so many, and ``HOT_ROWS`` at least: so there are never more hot keys than ``HOT_PARTS``.
HOT_PARTS, HOT_ROWS = 10_000, 1000
#: Edges that a task makes stars of at once (some 100 bytes each).
STAR_EDGES = 500_000


def bounded_batches(spark: SparkSession) -> None:
    """Lets Spark cut Arrow batches at ``BATCH_BYTES``, unless the session has a bound of its own.

    Spark's default of 64 MB costs an executor some hundred MB a task.  The
    value is the same for all operators, so none undoes what another set.
    """
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key) in (DEFAULT_BATCH_BYTES, f"{DEFAULT_BATCH_BYTES}b"):
        spark.conf.set(key, str(BATCH_BYTES))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the folder, as the queries read it."""
    bounded_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- Arrow slices -----------------------------------------------------------


def slices(batches, rows: int = SLICE_ROWS, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches in slices of at most ``rows`` rows and some ``most`` bytes; a longer single row is a slice of its own.

    The session's batch settings stay as the user has them.
    """
    for b in batches:
        n, at = len(b), 0
        while at < n:
            k = min(rows, n - at)
            while k > 1 and b.slice(at, k).nbytes > most:
                k = (k + 1) // 2
            # copied, so that no function meets an offset
            yield b if k == n else b.take(pa.array(range(at, at + k), pa.int64()))
            at += k
    released()


def released() -> None:
    """Gives memory that a task has freed back to the system: workers stay for later tasks."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def sliced(fn: Callable[..., pa.Array], rows: int = SLICE_ROWS) -> Callable[..., pa.Array]:
    """A function of Arrow arrays, called slice by slice."""

    def run(*columns: pa.Array) -> pa.Array:
        whole = pa.RecordBatch.from_arrays(list(columns), [str(k) for k in range(len(columns))])
        parts = [fn(*b.columns) for b in slices([whole], rows)] or [fn(*columns)]
        return pa.concat_arrays(parts)

    return run


# --- tables of a job --------------------------------------------------------

_tables: ContextVar[list[str] | None] = ContextVar("tables", default=None)


@contextmanager
def job() -> Iterator[list[str]]:
    """The paths of the tables that this thread writes inside; they go to the job around this one at its end.

    Each thread has jobs of its own, so none deletes what another has written.
    """
    outer, own = _tables.get(), []
    token = _tables.set(own)
    try:
        yield own
    finally:
        _tables.reset(token)
        if outer is not None:
            outer += own


def discard(spark: SparkSession, own: list[str], keep: tuple[str, ...] = ()) -> None:
    """Deletes a job's tables but those to ``keep``; call it once the results that read them are stored."""
    for path in [p for p in own if p not in keep]:
        own.remove(path)
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def finished(query: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    """The query with its result stored, and all other tables that it has written deleted."""

    @wraps(query)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        with job() as own:
            result = written(query(spark, sf_dir))
            discard(spark, own, (own[-1],))
        return result

    return run


def shared_dir(spark: SparkSession) -> str:
    """A new path below the folder that driver and executors share.

    The cluster names it in ``spark.checkpoint.dir``.  Where that is unset, a
    session on one machine, as in tests, gets a folder of its own; a cluster is
    told to name one.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = "/tmp/checkpoints/textloom"
    path = f"{base.rstrip('/')}/textloom-{uuid.uuid4().hex}"
    own = _tables.get()
    if own is not None:
        own.append(path)
    return path


def written(df: DataFrame) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: cuts lineage, survives lost executors."""
    path = shared_dir(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def fresh(df: DataFrame, name: str) -> str:
    """``name``, lengthened until no column of ``df`` has it in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def placed(df: DataFrame, *order: str, name: str = "place") -> DataFrame:
    """``df`` as a written table with each row's place, from 0, in the order of the columns ``order``, nulls first.

    Rows are dealt by range and sorted within their range, so no task meets
    more than its part, however many rows share a key; a range's first place is
    the number of rows before it, and one number a range comes to the driver.
    Rows equal in all of ``order`` take the places between them in any order,
    which stays as written.
    """
    at = fresh(df, "__at")
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = df.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    rows = written(rows.withColumn(at, F.monotonically_increasing_id()))  # the range above bit 33, the row in it below
    part = F.shiftright(at, 33)
    counts = dict(rows.groupBy(part.alias("part")).agg(F.count("*").alias("n")).collect())
    before = np.cumsum([0, *(counts.get(k, 0) for k in range(max(counts, default=0)))]).tolist()
    first = F.get(F.lit(before).cast("array<long>"), part.cast("int"))
    return rows.withColumn(name, first + F.col(at).bitwiseAND(F.lit((1 << 33) - 1))).drop(at)


# --- joins ------------------------------------------------------------------


def small_or_shuffled(df: DataFrame, max_rows: int = 1_000_000) -> DataFrame:
    """``df``, whose rows are a few dozen bytes, marked for broadcast up to ``max_rows`` counted rows."""
    return F.broadcast(df) if df.count() <= max_rows else df


def joined_by(rows: DataFrame, values: DataFrame, key: str, count: str, total: int, keep: bool = False) -> DataFrame:
    """``rows`` joined with ``values`` (one row a ``key``, with the ``count`` of rows that hold it) where keys may be hot.

    Keys with more than ``total / HOT_PARTS`` rows are at most ``HOT_PARTS``, so
    their values are broadcast and their rows stay where they are; the others
    are shuffled.  Rows whose key has no value are left out.  The count is dropped
    unless it is to ``keep``.
    """
    least = max(HOT_ROWS, total // HOT_PARTS)
    dropped = () if keep else (count,)
    hot = F.broadcast(values.where(F.col(count) >= least).drop(*dropped))
    cold = values.where(F.col(count) < least).drop(*dropped)
    return rows.join(hot, key).unionByName(rows.join(hot.select(key), key, "left_anti").join(cold, key))


# --- components -------------------------------------------------------------


def stars(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each node of the edges that is not the smallest of its component, and that smallest one."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    to = np.arange(len(nodes))
    while True:
        p, q = to[x], to[y]
        on = p != q
        if not on.any():
            break
        np.minimum.at(to, np.maximum(p[on], q[on]), np.minimum(p[on], q[on]))
        while (to[to] != to).any():
            to = to[to]
    low = to != np.arange(len(nodes))
    return nodes[low], nodes[to[low]]


def _stars(roots: bool):
    """The edges of a task, some at a time, as stars; with ``roots``, where a task has all edges, each star's middle too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = np.zeros(0, np.int64)
        held = none, none

        def out(more: np.ndarray = none) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate([h, more])) for h in held], ["u", "v"])

        for b in batches:
            held = tuple(np.concatenate([h, b.column(c).to_numpy()]) for h, c in zip(held, ("u", "v"), strict=True))
            if len(held[0]) >= STAR_EDGES:
                held = stars(*held)
                if not roots and 2 * len(held[0]) >= STAR_EDGES:
                    yield out()
                    held = none, none
        held = stars(*held)
        yield out(np.unique(held[1]) if roots else none)

    return run


def _least(edges: DataFrame, total: int) -> DataFrame:
    """``edges(u, v)`` with the least of u and all v of that u as ``m``; a hub's edges aren't gathered."""
    low = edges.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count("*").alias("n"))
    return joined_by(edges, low, "u", "n", total)


def connected(edges: DataFrame) -> DataFrame:
    """``(node, component)`` for every node of ``edges(a, b)``, as a written table; component is the smallest node.

    Each task first makes stars of its own edges where they are, ``STAR_EDGES`` at a time;
    if so many are left at most, one task makes stars of these, and nothing is shuffled.
    While these aren't stars as a whole, large-star and small-star steps follow, and stars by task again: each
    shuffles the edge list only, the edge count never grows, and the number of
    rounds grows with the logarithm of the longest path at most.  A node with
    very many edges is joined by broadcast (``joined_by``).  Each round is
    written to the shared folder, and the round before deleted.  No edges give
    no rows.
    """
    with job() as own:
        e, rooted = _contracted(edges, own)
        if not rooted:
            e = written(e.unionByName(e.select(F.col("v").alias("u"), "v").distinct()))
            discard(edges.sparkSession, own, (own[-1],))
    return e.select(F.col("u").alias("node"), F.col("v").alias("component"))


def _contracted(edges: DataFrame, own: list[str]) -> tuple[DataFrame, bool]:
    """``u, v``: each node that isn't the smallest of its component, with that smallest one; and whether the smallest ones have rows too."""
    spark = edges.sparkSession
    e = edges.select(F.greatest("a", "b").cast("long").alias("u"), F.least("a", "b").cast("long").alias("v")).where("u is not null and v is not null and u <> v")
    e = written(e.mapInArrow(_stars(False), "u long, v long"))
    total = e.count()
    if total > STAR_EDGES:
        e = written(e.distinct())
        total = e.count()
    while total:
        parts = -(-total // STAR_EDGES)
        e = written(e.coalesce(parts).mapInArrow(_stars(parts == 1), "u long, v long"))
        discard(spark, own, (own[-1],))
        if parts == 1:
            return e, True
        ends = e.select("u", F.lit(1).alias("as_leaf"), F.lit(0).alias("as_root")).unionByName(e.select(F.col("v").alias("u"), F.lit(0).alias("as_leaf"), F.lit(1).alias("as_root")))
        ends = ends.groupBy("u").agg(F.sum("as_leaf").alias("leaf"), F.max("as_root").alias("root"))
        total, crossed = ends.agg(F.sum("leaf"), F.count_if(F.expr("leaf > 1 or leaf = 1 and root = 1"))).first()
        if not crossed:
            break
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _least(both, 2 * total).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        small = _least(large, total).select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        e = written(small.where("u <> v").distinct())
        total = e.count()
    return e, False


# --- labels -----------------------------------------------------------------


def held_out(doc_id: str = "doc_id"):
    """Rows from which no label is learned: crc32 of the id's text is a multiple of 5; null ids are not held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("long").cast("string")) % 5 == 0, F.lit(False))


def known_labels(labels: DataFrame, label: str) -> DataFrame:
    """``doc_id, label`` of rows that may be learned from; null labels and ids are left out, of several for an id the largest counts."""
    known = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & ~held_out())
    return known.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col(label).cast("int")).alias("label"))


def labelled_texts(docs: DataFrame, labels: DataFrame, label: str, *more: str) -> DataFrame:
    """``doc_id, text, label`` (and ``more`` columns) of the rows from which labels may be learned, as a written table."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), *more)
    return written(texts.join(small_or_shuffled(known_labels(labels, label)), "doc_id"))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, n: int, *more: str) -> DataFrame:
    """``text, label`` (and ``more`` columns) of the ``n`` documents with a label whose ids hash least; rows that share an id come on top.

    Ids alone are joined and ranked, so only the sample's texts are read out.
    """
    h = F.xxhash64("doc_id")
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id"))
    known = written(known_labels(labels, label).join(ids, "doc_id", "left_semi"))
    last = known.select(h.alias("h")).orderBy("h").limit(n).agg(F.max("h")).first()[0]
    some = known.where(h <= last) if last is not None else known.limit(0)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), *more)
    return texts.join(F.broadcast(some), "doc_id").drop("doc_id")  # n ids at most


def sampled(rows: DataFrame, n: int) -> DataFrame:
    """The ``n`` rows of ``rows(doc_id, text, ...)`` with the least hash of id and text; copies of the last one may come on top.

    Only hashes are sorted and gathered, so no task reads the texts of others.
    """
    key = F.xxhash64("doc_id", "text")
    last = rows.select(key.alias("h")).orderBy("h").limit(n).agg(F.max("h")).first()[0]
    return rows.where(key <= last) if last is not None else rows.limit(0)
