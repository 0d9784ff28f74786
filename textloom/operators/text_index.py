"""An index for substrings: texts in blocks, and for each block a filter of the byte trigrams that its texts hold.

A search first asks the filters, which are small; only blocks that may hold all
trigrams of what is looked for are read.  A filter never denies what is there,
so the hits are those of a scan.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.operators.retrieval import grep

#: Bytes of text of a block, about; one longer text is a block of its own.
BLOCK_BYTES = 256 << 10
#: Bits of a filter for each trigram, and places of a trigram in it.
BITS, HASHES = 16, 4
#: Blocks up to which their numbers go into the scan's own filter.
LISTED_BLOCKS = 2000
#: A row group is about a block, so that the scan skips the others.
OPTIONS = {"parquet.block.size": str(1 << 20), "parquet.page.size.row.check.min": "10", "parquet.block.size.row.check.min": "10", "parquet.block.size.row.check.max": "100"}

TEXTS = "block bigint, doc_id bigint, text string"
FILTERS = "block bigint, n_bits bigint, filter binary"


def trigrams(data: np.ndarray) -> np.ndarray:
    """The distinct runs of three bytes, as numbers."""
    x = data.astype(np.uint32)
    return np.unique(x[:-2] << 16 | x[1:-1] << 8 | x[2:]) if len(x) > 2 else np.zeros(0, np.uint32)


def places(grams: np.ndarray, n_bits: int) -> np.ndarray:
    """The bits of each trigram; ``n_bits`` is a power of two."""
    g = grams.astype(np.uint64)
    one = g * np.uint64(0x9E3779B97F4A7C15)
    two = (g ^ np.uint64(0xABCDEF)) * np.uint64(0xC2B2AE3D27D4EB4F) | np.uint64(1)
    return ((one[:, None] >> np.uint64(20)) + np.arange(HASHES, dtype=np.uint64) * (two[:, None] >> np.uint64(20))) & np.uint64(n_bits - 1)


def block_filter(texts: list[bytes]) -> tuple[int, bytes]:
    """Bits and bytes of the filter of some texts; trigrams that would lie across two texts do no harm."""
    grams = trigrams(np.frombuffer(b"\n".join(texts), np.uint8))
    n_bits = 1 << max(6, int(BITS * len(grams) - 1).bit_length())
    on = np.zeros(n_bits, np.uint8)
    on[places(grams, n_bits).ravel()] = 1
    return n_bits, np.packbits(on).tobytes()


def may_hold(n_bits: int, bits: bytes, grams: np.ndarray) -> bool:
    at = places(grams, n_bits).ravel().astype(np.int64)
    data = np.frombuffer(bits, np.uint8)
    return bool((data[at >> 3] >> (7 - (at & 7)) & 1).all())


def _blocked(most: int):
    """Rows with their block's number: some rows after another of a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, size = TaskContext.get().partitionId() << 32, 0
        for b in batches:
            numbers = []
            for k in pc.fill_null(pc.binary_length(b.column("text")), 0).to_pylist():
                if size and size + k > most:
                    block, size = block + 1, 0
                numbers.append(block)
                size += k
            yield pa.RecordBatch.from_arrays([pa.array(numbers, pa.int64()), b.column("doc_id"), b.column("text")], ["block", "doc_id", "text"])

    return run


def _filters(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A filter for each block of sorted rows; a block that two batches share is held until it is whole."""
    held: list[bytes] = []
    block = None

    def out() -> pa.RecordBatch:
        n_bits, bits = block_filter(held)
        return pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.array([n_bits], pa.int64()), pa.array([bits], pa.binary())], ["block", "n_bits", "filter"])

    for b in batches:
        for k, text in zip(b.column("block").to_pylist(), b.column("low").to_pylist(), strict=True):
            if k != block:
                if block is not None:
                    yield out()
                block, held = k, []
            held.append((text or "").encode())
    if block is not None:
        yield out()


def build(docs: DataFrame, path: str, block_bytes: int = BLOCK_BYTES) -> None:
    """The index of ``docs(doc_id, text)`` below ``path``."""
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(_blocked(block_bytes), TEXTS)
    rows.write.options(**OPTIONS).parquet(f"{path}/texts")
    # lowered as the search lowers; a file's rows come in their order, but a file may be cut between tasks, so blocks are brought together
    low = spark.read.schema(TEXTS).parquet(f"{path}/texts").select("block", F.lower("text").alias("low"))
    low.repartition("block").sortWithinPartitions("block").mapInArrow(_filters, FILTERS).write.parquet(f"{path}/filters")


def blocks(spark: SparkSession, path: str, query: str) -> DataFrame | None:
    """``block`` of those that may hold the query in some case; none are ruled out (``None``) by fewer than three bytes."""
    grams = trigrams(np.frombuffer(query.lower().encode(), np.uint8))
    if not len(grams):
        return None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            on = [may_hold(n, f, grams) for n, f in zip(b.column("n_bits").to_pylist(), b.column("filter").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("block").filter(pa.array(on, pa.bool_()))], ["block"])

    return spark.read.schema(FILTERS).parquet(f"{path}/filters").mapInArrow(run, "block bigint")


def candidates(spark: SparkSession, path: str, query: str) -> DataFrame:
    """``doc_id, text`` of the blocks that may hold the query."""
    texts, may = spark.read.schema(TEXTS).parquet(f"{path}/texts"), blocks(spark, path, query)
    if may is not None:
        few = may.limit(LISTED_BLOCKS + 1).collect()
        texts = texts.where(F.col("block").isin([r.block for r in few])) if len(few) <= LISTED_BLOCKS else texts.join(may, "block", "left_semi")
    return texts.select("doc_id", "text")


def search(spark: SparkSession, path: str, query: str, k: int = 50) -> DataFrame:
    """``doc_id, line_no, line`` of the first ``k`` lines that hold the query in any case: what ``grep`` finds in all texts."""
    return grep(candidates(spark, path, query), query, k)
