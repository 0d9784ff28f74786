"""An inverted index of chunks, kept by document and read by term.

The index has parts by document.  A part holds its chunks and its postings: a
row for each term and block, where a block is a set of chunks of about one
length, so that its bound is close.  A posting row keeps the largest number of
occurrences and the least length of its entries: with these no entry of the row
scores more than ``bound``, whatever the corpus has become meanwhile.

Postings are made by the tasks that read a part's stored chunks, slice by
slice, and written by them: neither texts nor postings are shuffled, so a build
needs no more disk than the version that it writes.

A question reads the rows of its terms only.  It first scores the blocks that
promise most; a block whose bounds add up to less than the k-th score found
there is skipped.  The answer is that of a full scan.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from functools import reduce
from operator import add

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textloom.functions import fixed
from textloom.functions.text import WORD_CHARS, WORD_GAP, cosine, words
from textloom.operators.retrieval import _idf, chunk_table, query_terms
from textloom.sources import versions

#: Chunks of a block at most; they are of one part, one slice and about one length.
BLOCK_CHUNKS = 512
#: Words of a slice (but for what its last batch is over), so that a task's memory doesn't follow its chunks.
SLICE_WORDS = 2_000_000
#: Entries that a task passes on at a time.
BATCH_ENTRIES = 100_000
#: Ids put or dropped at once that are sent to all tasks; with more, the old chunks are shuffled.
BROADCAST_IDS = 1_000_000
#: Blocks that are scored first, to learn what the k-th score is at least.
FIRST_BLOCKS = 32
#: Blocks that may still hold one of the best, up to which their numbers are sent to all tasks.
BROADCAST_BLOCKS = 100_000
#: A bound is a sum in another order than the score.
SLACK = 1 + 1e-9

CHUNKS = "doc_id bigint, chunk_no int, n_words int, text string"
POSTINGS = "term string, block bigint, n bigint, max_f bigint, least_words int, entries array<struct<doc_id:bigint,chunk_no:int,f:bigint,n_words:int>>"
#: Row groups are small and sorted by term, so that most are skipped by their least and largest term.
OPTIONS = {"parquet.block.size": str(4 << 20), "compression": "zstd"}


ENTRY = pa.struct([("doc_id", pa.int64()), ("chunk_no", pa.int32()), ("f", pa.int64()), ("n_words", pa.int32())])
NUMBER = 20  # bits of a block's number in its task, and of a task's number


def _blocks(part: np.ndarray, n_words: np.ndarray, doc_id: np.ndarray, size: int) -> np.ndarray:
    """A block for each chunk, from 0: its part, its length by quarters of powers of two, then ``size`` chunks at most in the order of their lengths."""
    length = np.floor(4 * np.log2(n_words + 1)).astype(np.int64)
    order = np.lexsort((doc_id, n_words, length, part))
    starts = np.ones(len(order), bool)
    starts[1:] = (np.diff(part[order]) != 0) | (np.diff(length[order]) != 0)
    at = np.arange(len(order))
    rank = at - np.maximum.accumulate(np.where(starts, at, 0))
    blocks = np.empty(len(order), np.int64)
    blocks[order] = np.cumsum(rank % size == 0) - 1
    return blocks


def _slices(batches: Iterable[pa.RecordBatch], slice_words: int) -> Iterator[pa.Table]:
    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += pc.sum(batch.column("n_words")).as_py() or 0
        if n >= slice_words:
            yield pa.Table.from_batches(held)
            held, n = [], 0
    if held:
        yield pa.Table.from_batches(held)


def _slice_postings(held: pa.Table, first: int, size: int) -> tuple[pa.RecordBatch, int]:
    """Posting rows of some chunks with lower-case texts, by term and block, and the number of blocks; these are numbered from ``first``."""
    doc_id = held.column("doc_id").combine_chunks()
    part, chunk_no, n_words = (held.column(c).to_numpy() for c in ("part", "chunk_no", "n_words"))
    ids = pc.fill_null(doc_id, 0).to_numpy()
    block = _blocks(part, n_words, ids, size)
    order = np.lexsort((chunk_no, ids, block))
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))

    lists = pc.split_pattern_regex(held.column("lower").combine_chunks(), WORD_GAP)
    found = lists.flatten()
    long = pc.greater_equal(pc.binary_length(found), WORD_CHARS)
    coded, of = found.filter(long).dictionary_encode(), pc.list_parent_indices(lists).filter(long)
    by_term = pc.sort_indices(coded.dictionary).to_numpy()
    rank = np.empty(len(by_term), np.int64)
    rank[by_term] = np.arange(len(by_term))
    places = max(1, len(order))
    key, f = np.unique(rank[coded.indices.to_numpy()] * places + place[of.to_numpy()], return_counts=True)
    term, place = np.divmod(key, places)
    at = order[place]
    new = np.ones(len(at), bool)
    new[1:] = (np.diff(term) != 0) | (np.diff(block[at]) != 0)
    starts = np.flatnonzero(new)
    lead, cuts = at[starts], np.append(starts, len(at))
    least = lambda x: np.minimum.reduceat(x, starts) if len(starts) else x

    values = [doc_id.take(pa.array(at)), pa.array(chunk_no[at]), pa.array(f), pa.array(n_words[at])]
    entries = pa.StructArray.from_arrays([v.cast(kind.type) for v, kind in zip(values, ENTRY, strict=True)], fields=list(ENTRY))
    columns = {
        "part": pa.array(part[lead], pa.int32()),
        "term": coded.dictionary.take(pa.array(by_term[term[starts]])).cast(pa.string()),
        "block": pa.array((part[lead].astype(np.int64) << 2 * NUMBER) + first + block[lead]),
        "n": pa.array(np.diff(cuts), pa.int64()),
        "max_f": pa.array(-least(-f), pa.int64()),
        "least_words": pa.array(least(n_words[at]), pa.int32()),
        "entries": pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), entries),
    }
    return pa.RecordBatch.from_pydict(columns), int(block.max(initial=-1)) + 1


def _made(size: int, slice_words: int, batch_entries: int) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """What makes posting rows of a task's chunks, slice by slice."""

    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = TaskContext.get().partitionId() << NUMBER
        for held in _slices(batches, slice_words):
            made, blocks = _slice_postings(held, first, size)
            first += blocks
            upto = made.column("entries").offsets.to_numpy()
            cuts = [*np.unique(np.searchsorted(upto[:-1], np.arange(0, upto[-1], batch_entries))), made.num_rows]
            for lo, hi in zip(cuts, cuts[1:]):
                yield made.slice(lo, hi - lo)

    return rows


def _postings(chunked: DataFrame) -> DataFrame:
    """Posting rows of ``chunked(part, doc_id, chunk_no, n_words, text)``, made where the chunks lie; a term and block may have several."""
    held = chunked.select("part", "doc_id", "chunk_no", "n_words", F.lower("text").alias("lower"))
    return held.mapInArrow(_made(BLOCK_CHUNKS, SLICE_WORDS, BATCH_ENTRIES), f"part int, {POSTINGS}").sortWithinPartitions("part", "term", "block")


def put(docs: DataFrame, path: str, parts: int = 64) -> None:
    """Indexes ``docs(doc_id, text)`` in place of what the index below ``path`` had under their ids; only their parts are built again.

    A null text leaves nothing under its id.  An index keeps the number of
    parts that it began with.
    """
    spark = docs.sparkSession
    parts = versions.current(spark, path)[2] or parts
    new = chunk_table(docs).select("doc_id", "chunk_no", F.size(words(F.col("text"))).alias("n_words"), "text")
    _replace(docs, new, path, parts)


def drop(ids: DataFrame, path: str) -> None:
    """Takes the documents ``ids(doc_id)`` out of the index."""
    parts = versions.current(ids.sparkSession, path)[2]
    if parts is not None:
        _replace(ids, None, path, parts)


def _replace(ids: DataFrame, new: DataFrame | None, path: str, parts: int) -> None:
    """The chunks ``new``, if any, in place of those of ``ids``, in the parts that hold one of the ids."""
    spark, ids = ids.sparkSession, ids.select("doc_id")
    dealt = ids.groupBy(versions.part_of("doc_id", parts).alias("part")).count().collect()  # parts at most
    touched = [r.part for r in dealt]
    if set(touched) & set(versions.current(spark, path)[1]):
        # a few ids are sent to the chunks, so that these are not shuffled
        gone = F.broadcast(ids) if sum(r["count"] for r in dealt) <= BROADCAST_IDS else ids
        old = versions.load(spark, path, "chunks", CHUNKS, touched).join(gone, "doc_id", "left_anti")
        rows = old if new is None else old.unionByName(new.select(old.columns))
    else:
        rows = spark.createDataFrame([], CHUNKS) if new is None else new
    versions.save(spark, path, {"chunks": rows.withColumn("part", versions.part_of("doc_id", parts)), "postings": _postings}, touched, parts, OPTIONS)


class Index:
    """The current version of the index below ``path``; saves after this do not change what it answers."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark = spark
        folders = versions.current(spark, path)[1]
        read = lambda name, schema: spark.read.schema(schema).parquet(*(f"{f}/{name}/part={p}" for p, f in sorted(folders.items()))) if folders else spark.createDataFrame([], schema)
        self.chunks, self.postings = read("chunks", CHUNKS), read("postings", POSTINGS)
        # a column of numbers, whatever the texts
        self.n_chunks, self.avg_words = self.chunks.agg(F.count("*"), F.coalesce(F.avg("n_words"), F.lit(0.0))).first()

    def rows(self, terms: list[str]) -> DataFrame:
        """The posting rows of some terms: the filter reaches the files."""
        return self.postings.where(F.col("term").isin(terms))

    def _part(self, term: Column, f: Column, n_words: Column, weights: dict[str, float]) -> Column:
        by_term = F.create_map(*(F.lit(x) for kv in weights.items() for x in kv))[term]
        return by_term * f * (fixed.K1 + 1) / (f + fixed.K1 * (1 - fixed.B + fixed.B * n_words / F.lit(self.avg_words)))

    def weights(self, asked: Counter[str]) -> dict[str, float]:
        """Weight of each of the question's terms that the index holds."""
        held = self.rows(list(asked)).groupBy("term").agg(F.sum("n").alias("df"))
        idf = _idf(F.lit(self.n_chunks), F.col("df"))
        return {r.term: asked[r.term] * r.idf for r in held.select("term", idf.alias("idf")).collect()}  # the question's terms at most

    def _scores(self, rows: DataFrame, weights: dict[str, float]) -> DataFrame:
        """A chunk has one entry a term; these are added in the terms' order, so that equal chunks score the same to the last bit."""
        each = rows.select("term", F.explode("entries").alias("e"))
        part = self._part(F.col("term"), F.col("e.f"), F.col("e.n_words"), weights)
        by_term = [F.coalesce(F.max(F.when(F.col("term") == t, part)), F.lit(0.0)) for t in sorted(weights)]
        return each.groupBy(F.col("e.doc_id").alias("doc_id"), F.col("e.chunk_no").alias("chunk_no")).agg(reduce(add, by_term).alias("score"))

    def scores(self, query: str) -> DataFrame:
        """``doc_id, chunk_no, score`` of every chunk with a term of the query."""
        weights = self.weights(query_terms(query))
        if not weights:
            return self.spark.createDataFrame([], "doc_id bigint, chunk_no int, score double")
        return self._scores(self.rows(list(weights)), weights)

    def bounds(self, weights: dict[str, float]) -> DataFrame:
        """``block, bound``: what no chunk of the block can exceed."""
        rows = self.rows(list(weights)).groupBy("block", "term").agg(F.max("max_f").alias("f"), F.min("least_words").alias("n"))
        part = self._part(F.col("term"), F.col("f"), F.col("n"), weights)
        return rows.groupBy("block").agg((F.sum(part) * SLACK).alias("bound"))

    def topk(self, query: str, k: int = 4) -> DataFrame:
        """``doc_id, chunk_no, text, score`` of the ``k`` best chunks; ties by document and chunk."""
        weights = self.weights(query_terms(query))
        order = [F.desc("score"), "doc_id", "chunk_no"]
        if not weights:
            return self.chunks.select("doc_id", "chunk_no", "text", F.lit(0.0).alias("score")).limit(0)
        rows, bounds = self.rows(list(weights)), self.bounds(weights)
        ahead = [r.block for r in bounds.orderBy(F.desc("bound"), "block").limit(FIRST_BLOCKS).collect()]
        first = self._scores(rows.where(F.col("block").isin(ahead)), weights).orderBy(*order).limit(k).collect()
        least = first[-1].score if len(first) == k else 0.0
        rest = bounds.where((F.col("bound") >= least) & ~F.col("block").isin(ahead)).select("block")
        few = rest.limit(BROADCAST_BLOCKS + 1).collect()
        if len(few) <= BROADCAST_BLOCKS:
            rest_rows = rows.where(F.col("block").isin([r.block for r in few])) if len(few) <= 1000 else rows.join(F.broadcast(rest), "block", "left_semi")
        else:
            rest_rows = rows.join(rest, "block", "left_semi")
        best = self.spark.createDataFrame(first, "doc_id bigint, chunk_no int, score double")
        if few:
            best = best.unionByName(self._scores(rest_rows, weights)).orderBy(*order).limit(k)
        return self.chunks.join(F.broadcast(best), ["doc_id", "chunk_no"]).select("doc_id", "chunk_no", "text", "score").orderBy(*order)

    def hybrid(self, query: str, vectors: DataFrame, vector: list[float], k: int = 4) -> DataFrame:
        """Half cosine, half words, each by its largest value, of chunks and their documents' ``vectors(doc_id, embedding)``."""
        cos = vectors.where(F.size("embedding") == len(vector)).select("doc_id", cosine(F.col("embedding"), F.array(*map(F.lit, map(float, vector)))).alias("cos"))
        # no text is read: the chunks' numbers, the question's postings, the vectors
        both = self.chunks.select("doc_id", "chunk_no").join(cos, "doc_id", "left").join(self.scores(query).withColumnRenamed("score", "bm"), ["doc_id", "chunk_no"], "left")
        both = both.select("doc_id", "chunk_no", F.coalesce("cos", F.lit(0.0)).alias("cos"), F.coalesce("bm", F.lit(0.0)).alias("bm")).where("cos <> 0 OR bm <> 0")
        stored = versions.scratch(self.spark, "hybrid")
        both.write.parquet(stored)  # read for the largest values, and for the answer
        both = self.spark.read.schema("doc_id bigint, chunk_no int, cos double, bm double").parquet(stored)
        top = both.agg(F.max("cos").alias("cos"), F.max("bm").alias("bm")).first()
        by = lambda c, most: F.col(c) / F.lit(most) if most is not None and most > 0 else F.lit(0.0)
        scored = both.select("doc_id", "chunk_no", (0.5 * by("cos", top.cos) + 0.5 * by("bm", top.bm)).alias("score"))
        best = scored.where("score > 0").orderBy(F.desc("score"), "doc_id", "chunk_no").limit(k)
        return self.chunks.join(F.broadcast(best), ["doc_id", "chunk_no"]).select("doc_id", "chunk_no", "text", "score").orderBy(F.desc("score"), "doc_id", "chunk_no")
