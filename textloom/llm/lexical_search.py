"""Ranked lexical search: document-sharded postings with integer impacts, scored term by term.

A shard is a slice of documents (``SLICE_BYTES`` of text, or one longer text)
and one row of the index: its document ids, its terms, and the postings of all
terms in compressed sparse rows: ``sizes`` holds the length of each term's row,
``docs`` the documents' ordinals in the shard and ``impacts`` their integer
impacts, row after row.  An impact holds all of a posting's score but its
term's weight, one factor for a term's whole row, kept in the ``lexicon``.

A block of items is scored in one pass over the shards: each item has a dense
accumulator of its shard's documents, to which its terms' rows are added one
term at a time.  A task keeps the best of its shards for each item, so it hands
on ``k`` rows an item; tasks' rows are merged in two steps.

Cases: null and empty texts, and texts without a term, are not counted and
never found, and items without a term find nothing; equal scores are ordered
by doc_id, nulls first; each row is a document of its own, also where ids
repeat, and each item row is asked by itself, its null id told as null; further
columns, whatever their names, are not read; empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textloom.llm.common import LOWER, UPPER, finished, placed, shared_dir, slices, table, written

#: A term is a maximal run of ASCII letters and digits and of all characters beyond ASCII.
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Items scored in one pass over the index; their terms go to every task.
BLOCK_ITEMS = 256
#: Groups into which tasks' best rows are merged first.
MERGE = 64
#: Of a shard: documents at most, so that a batch of short texts is still one row of bounded size.
SHARD_DOCS = 65_536

_BYTES = np.arange(256, dtype=np.uint8)
_IN_TERM = np.array([b >= 128 or chr(b).isalnum() for b in range(256)])
_LOWERED = np.where((_BYTES >= 65) & (_BYTES <= 90), _BYTES + 32, _BYTES).astype(np.uint8)

SHARD = "ids array<bigint>, terms array<string>, sizes array<int>, docs binary, impacts binary"
_SHARD = pa.schema([("ids", pa.list_(pa.int64())), ("terms", pa.list_(pa.string())), ("sizes", pa.list_(pa.int32())), ("docs", pa.binary()), ("impacts", pa.binary())])
#: Shards are large rows: pages and row groups are cut by bytes after each row, not after a hundred.
LARGE_ROWS = {"parquet.page.size.row.check.min": "1", "parquet.page.size.row.check.max": "1", "parquet.block.size.row.check.min": "1", "parquet.block.size.row.check.max": "1", "parquet.block.size": str(16 << 20)}


def term_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(TERM)), F.lit(0)).cast("long")


def terms_in(text: Column) -> Column:
    return F.regexp_extract_all(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), F.lit(f"({TERM})"))


# --- building -----------------------------------------------------------------


def tokenized(texts: pa.Array) -> tuple[pa.DictionaryArray, np.ndarray]:
    """All terms of the texts in order, and the text of each; terms are cut and lowered as bytes, which is exact in UTF-8."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    bounds = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[bounds[0] : bounds[-1]]
    bounds = bounds - bounds[0]
    on = _IN_TERM[data]
    begins = on.copy()
    begins[1:] &= ~on[:-1]
    first = bounds[:-1][np.diff(bounds) > 0]
    begins[first] = on[first]
    at = np.flatnonzero(begins)
    kept = np.concatenate([[0], np.cumsum(on)])
    cuts = np.concatenate([kept[at], kept[-1:]])
    terms = pa.LargeStringArray.from_buffers(len(at), pa.py_buffer(cuts), pa.py_buffer(_LOWERED[data[on]]))
    return terms.dictionary_encode(), np.searchsorted(bounds, at, "right") - 1


def impact(tf: np.ndarray, n: np.ndarray, total: int, length: int) -> np.ndarray:
    """A posting's score without its term's weight, in 64-bit integers."""
    m = 100 - 75 + (75 * n * total) // length
    return (1_000_000_000 * tf) // (1000 * tf + 8 * m)


def _shard(ids: pa.Array, texts: pa.Array, total: int, length: int) -> dict:
    coded, doc = tokenized(texts)
    docs = len(texts)
    n = np.bincount(doc, minlength=docs).astype(np.int64)
    key, tf = np.unique(coded.indices.to_numpy().astype(np.int64) * docs + doc, return_counts=True)
    term, doc = np.divmod(key, max(docs, 1))
    impacts = impact(tf.astype(np.int64), n[doc], total, max(length, 1))
    return {"ids": ids, "terms": coded.dictionary, "sizes": pa.array(np.bincount(term, minlength=len(coded.dictionary)).astype(np.int32)), "docs": doc.astype("<u4").tobytes(), "impacts": impacts.astype("<u4").tobytes()}


def _shards(total: int, length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, SHARD_DOCS):
            s = _shard(b.column(0), b.column(1), total, length)
            one = lambda x, kind: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x.cast(kind))
            yield pa.RecordBatch.from_arrays([one(s["ids"], pa.int64()), one(s["terms"], pa.string()), one(s["sizes"], pa.int32()), pa.array([s["docs"]], pa.binary()), pa.array([s["impacts"]], pa.binary())], schema=_SHARD)

    return run


def build(docs: DataFrame, path: str) -> None:
    """The index of ``docs(doc_id, text)`` below ``path``: ``shards``, ``lexicon`` and ``corpus``."""
    spark = docs.sparkSession
    counts = docs.select(term_count(F.col("text")).alias("n")).agg(F.count_if(F.col("n") > 0).alias("documents"), F.coalesce(F.sum("n"), F.lit(0)).alias("terms"))
    counts.write.parquet(f"{path}/corpus")
    total, length = spark.read.parquet(f"{path}/corpus").first()
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where(F.length("text") > 0)
    rows.mapInArrow(_shards(total, length), SHARD).write.options(**LARGE_ROWS).parquet(f"{path}/shards")
    held = spark.read.schema(SHARD).parquet(f"{path}/shards").select(F.explode(F.arrays_zip("terms", "sizes")).alias("x"))
    lexicon = held.groupBy(F.col("x.terms").alias("term")).agg(F.sum("x.sizes").alias("df"))
    ratio = F.lit(2 * total + 2).cast("double") / (2 * F.col("df") + 1).cast("double")
    lexicon.withColumn("weight", F.floor(1000 * F.log(ratio)).cast("long")).write.parquet(f"{path}/lexicon")


# --- scoring -------------------------------------------------------------------


def best(score: np.ndarray, ids: np.ndarray, null: np.ndarray, k: int) -> np.ndarray:
    """Places of the ``k`` highest scores over 0, equal ones by id, nulls first: all that tie with the k-th are compared."""
    at = np.flatnonzero(score > 0)
    if len(at) > k:
        least = score[at[np.argpartition(score[at], len(at) - k)[len(at) - k]]]
        at = at[score[at] >= least]
    return at[np.lexsort((ids[at], ~null[at], -score[at]))][:k]


def _scored(items: list[tuple], k: int):
    """``items``: for each its id, and its terms' words and factors (weight times repeats)."""
    words = sorted({w for _, own in items for w, _ in own})
    code = {w: i for i, w in enumerate(words)}
    plans = [(np.array([code[w] for w, _ in own], np.int64), np.array([f for _, f in own], np.int64)) for _, own in items]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = pa.array(words, pa.string())
        kept = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)) for _ in items]
        for b in batches:
            for r in range(len(b)):
                ids = b.column("ids")[r].values
                null = ids.is_null().to_numpy(zero_copy_only=False)
                ids = pc.fill_null(ids, 0).to_numpy()
                sizes = b.column("sizes")[r].values.to_numpy()
                docs, impacts = (np.frombuffer(b.column(c)[r].as_buffer(), "<u4") for c in ("docs", "impacts"))
                ends = np.cumsum(sizes, dtype=np.int64)
                rows = pc.fill_null(pc.index_in(asked, value_set=b.column("terms")[r].values), -1).to_numpy()
                total = np.zeros(len(ids), np.int64)
                for i, (terms, factors) in enumerate(plans):
                    total[:] = 0
                    for row, factor in zip(rows[terms].tolist(), factors.tolist(), strict=True):
                        if row >= 0:
                            own = slice(ends[row] - sizes[row], ends[row])
                            total[docs[own]] += factor * impacts[own].astype(np.int64)
                    at = best(total, ids, null, k)
                    if len(at):
                        both = [np.concatenate([x, y[at]]) for x, y in zip(kept[i], (total, ids, null), strict=True)]
                        top = best(*both, k)
                        kept[i] = tuple(x[top] for x in both)
        n = [len(x[0]) for x in kept]
        if sum(n):
            score, ids, null = (np.concatenate(x) for x in zip(*kept, strict=True))
            place = np.repeat(np.arange(len(items), dtype=np.int32), n)
            group = np.full(len(place), TaskContext.get().partitionId() % MERGE, np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(place), pa.array(group), pa.array(ids, mask=null), pa.array(score)], ["item", "part", "doc_id", "score"])

    return run


def search(spark: SparkSession, path: str, items: DataFrame, k: int = 10) -> DataFrame:
    """``item_id, rank, doc_id, score``: the ``k`` best documents of the index at ``path`` for each row of ``items(item_id, text)``."""
    asked = placed(items.select("item_id", "text"), "item_id", "text", name="item")
    total = asked.count()
    lexicon = spark.read.parquet(f"{path}/lexicon")
    terms = asked.select("item", F.explode(terms_in(F.col("text"))).alias("term")).groupBy("item", "term").agg(F.count("*").alias("times"))
    terms = written(terms.join(lexicon, "term").select("item", "term", (F.col("times") * F.col("weight")).alias("factor")))
    shards = spark.read.schema(SHARD).parquet(f"{path}/shards")
    found = []
    for lo in range(0, total, BLOCK_ITEMS):
        own: dict[int, list] = {}
        for item, term, factor in terms.where(F.col("item").between(lo, lo + BLOCK_ITEMS - 1)).orderBy("item", "term").toLocalIterator():
            own.setdefault(item, []).append((term, factor))
        if own:
            best_of = shards.mapInArrow(_scored(list(own.items()), k), "item int, part int, doc_id long, score long")
            numbers = F.lit(list(own)).cast("array<long>")
            found.append(best_of.withColumn("item", F.get(numbers, F.col("item"))))
    if not found:
        return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")

    def ranked(rows: DataFrame, *group: str) -> DataFrame:
        place = F.row_number().over(Window.partitionBy(*group).orderBy(F.desc("score"), F.asc_nulls_first("doc_id")))
        return rows.withColumn("rank", place).where(F.col("rank") <= k)

    rows = ranked(ranked(reduce(DataFrame.unionByName, found), "item", "part"), "item")
    return rows.join(asked.select("item", "item_id"), "item").select("item_id", "rank", "doc_id", "score")


@finished
def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best documents of each benchmark item, from an index of all documents."""
    path = shared_dir(spark)
    build(table(spark, sf_dir, "documents"), path)
    return search(spark, path, table(spark, sf_dir, "benchmark"))


def oracle() -> str:
    """DuckDB SQL for the query, without an index."""
    terms = f"regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{TERM}')"
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {terms} AS terms FROM documents),
c AS (SELECT count(*) FILTER (len(terms) > 0) AS docs, sum(len(terms))::BIGINT AS length FROM d),
p AS (SELECT r, doc_id, n, term, count(*) AS tf FROM (SELECT r, doc_id, len(terms) AS n, unnest(terms) AS term FROM d) GROUP BY ALL),
w AS (SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM p, c GROUP BY term, docs),
q AS (SELECT i, item_id, term, count(*) AS times FROM (SELECT row_number() OVER () AS i, item_id, unnest({terms}) AS term FROM benchmark) GROUP BY ALL),
s AS (SELECT i, item_id, r, doc_id, sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 75 + ((75 * n * docs) // length)))))::BIGINT AS score
      FROM q JOIN w USING (term) JOIN p USING (term), c GROUP BY ALL HAVING score > 0),
k AS (SELECT *, row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id NULLS FIRST) AS rank FROM s)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM k WHERE rank <= 10
"""
