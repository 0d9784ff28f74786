"""Operator 3: token ids in canonical length-limited Huffman blocks.

Method: ids are counted over all documents, code lengths come from the
package-merge algorithm (optimal under ``MAX_BITS``), codes are canonical, so a
file needs only the code length of each id.  A block holds whole documents and
is decoded by itself; every ``LANE`` tokens it records a bit offset, and all
lanes of a batch of blocks are decoded side by side with one table look-up a
token.

File format (two Parquet tables below one path, written by Spark):

* ``code``: ``id``, ``bits`` (0 < bits <= MAX_BITS) for every id that occurs;
* ``blocks``: ``part``, ``block`` (order: by part, then block), ``doc_ids``
  (ascending), ``doc_tokens`` (ids a document, end id included), ``marks``
  (little-endian uint32: bit offset of token 0, LANE, 2 * LANE, ...), ``payload``.

Cases: a null text counts as empty and holds the end id alone; a null doc_id
sorts first and is kept; repeated doc_ids keep a row each, in the order of
their texts' digests; an empty table gives empty tables; other columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textloom.llm.common import shared_dir, slices, table
from textloom.llm.word_tokens import encoder, public_path

MAX_BITS = 20
LANE = 256
BLOCK_TOKENS = 1 << 16
TOKENIZER = "word_bpe_49k.json"
END_ID = 1
#: Rows of text per Arrow batch: a batch looks its words up in all that the worker knows, so larger ones cost less.
BATCH_ROWS, BATCH_BYTES = 4000, 16 << 20


# --- the code -------------------------------------------------------------


def code_lengths(counts: np.ndarray, max_bits: int = MAX_BITS) -> np.ndarray:
    """Optimal code lengths up to ``max_bits`` by package-merge; 0 where the count is 0."""
    used = np.flatnonzero(counts)
    out = np.zeros(len(counts), np.uint8)
    if len(used) < 2:
        out[used] = 1
        return out
    if len(used) > 1 << max_bits:
        raise ValueError("more ids than codes of that length")
    leaf = used[np.argsort(counts[used], kind="stable")]
    weight = counts[leaf].astype(np.int64)
    n = len(leaf)
    # each level: items in order of weight, as (is a leaf) marks; packages are pairs of the level below
    level, marks = weight, [np.ones(n, bool)]
    for _ in range(max_bits - 1):
        pairs = level[: len(level) // 2 * 2].reshape(-1, 2).sum(1)
        both = np.concatenate([weight, pairs])
        order = np.argsort(both, kind="stable")
        level = both[order]
        marks.append(order < n)
    take, bits = 2 * n - 2, np.zeros(n, np.int64)
    for mark in reversed(marks):
        leaves = int(mark[:take].sum())
        bits[:leaves] += 1
        take = 2 * (take - leaves)
    out[leaf] = bits
    return out


def canonical(lengths: np.ndarray) -> np.ndarray:
    """Codes in order of (length, id)."""
    codes = np.zeros(len(lengths), np.uint64)
    ids = np.flatnonzero(lengths)
    ids = ids[np.argsort(lengths[ids], kind="stable")]
    at = lengths[ids].astype(np.uint64)
    if len(ids):
        top = np.uint64(at.max())
        step = np.uint64(1) << (top - at)
        codes[ids] = (np.cumsum(step) - step) >> (top - at)
    return codes


def decoding_table(lengths: np.ndarray, max_bits: int = MAX_BITS) -> np.ndarray:
    """For every ``max_bits`` window of bits: ``id << 8 | bits``."""
    ids = np.flatnonzero(lengths)
    ids = ids[np.argsort(lengths[ids], kind="stable")]
    wide = (1 << (max_bits - lengths[ids].astype(np.int64))) if len(ids) else np.zeros(0, np.int64)
    tab = np.zeros(1 << max_bits, np.uint32)
    full = np.repeat((ids.astype(np.uint32) << np.uint32(8)) | lengths[ids], wide)
    tab[: len(full)] = full
    return tab


def pack_bits(ids: np.ndarray, lengths: np.ndarray, codes: np.ndarray) -> tuple[bytes, np.ndarray]:
    """Payload of a block and the bit offsets of its lanes."""
    n = lengths[ids].astype(np.int64)
    if not len(ids):
        return b"", np.zeros(0, np.uint32)
    begin = np.cumsum(n) - n
    code, word, off = codes[ids], begin >> 6, begin & 63
    over = off + n - 64
    here = np.where(over > 0, code >> np.maximum(over, 0).astype(np.uint64), code << np.maximum(-over, 0).astype(np.uint64))
    words = np.zeros(int(begin[-1] + n[-1] + 63) // 64 + 1, np.uint64)
    first = np.flatnonzero(np.diff(word, prepend=-1))
    words[word[first]] = np.bitwise_or.reduceat(here, first)
    cut = np.flatnonzero(over > 0)
    words[word[cut] + 1] |= code[cut] << (64 - over[cut]).astype(np.uint64)
    return words.astype(">u8").tobytes(), begin[::LANE].astype(np.uint32)


def unpack_lanes(payloads: list[bytes], marks: list[np.ndarray], counts: list[int], tab: np.ndarray, max_bits: int = MAX_BITS) -> np.ndarray:
    """Ids of several blocks, one after another; all their lanes advance together."""
    base = np.cumsum([0, *(len(p) for p in payloads)])
    data = np.frombuffer(b"".join(payloads) + bytes(8), np.uint8).astype(np.uint32)
    window = (data[:-3] << 24) | (data[1:-2] << 16) | (data[2:-1] << 8) | data[3:]
    pos = np.concatenate([m.astype(np.int64) + 8 * b for m, b in zip(marks, base, strict=False)] or [np.zeros(0, np.int64)])
    left = np.concatenate([np.minimum(LANE, c - LANE * np.arange(len(m))) for m, c in zip(marks, counts, strict=True)] or [np.zeros(0, np.int64)])
    out = np.zeros((LANE, len(pos)), np.uint32)
    down = np.uint32(32 - max_bits)
    for k in range(int(left.max()) if len(left) else 0):
        got = tab[(window[pos >> 3] << (pos & 7).astype(np.uint32)) >> down]
        out[k] = got >> np.uint32(8)
        pos = np.minimum(pos + (got & np.uint32(255)), 8 * int(base[-1]))
    return out.T[np.arange(LANE) < left[:, None]]


# --- writing --------------------------------------------------------------


def id_type(tokenizer_path: str, end_id: int) -> str:
    """Two bytes an id where the vocabulary allows it."""
    return "<u2" if max(encoder(tokenizer_path).tokenizer.get_vocab_size(), end_id + 1) <= 1 << 16 else "<u4"


def _tokenize(path: str, end_id: int, dtype: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, seq = encoder(path), 0
        for b in slices(batches, BATCH_ROWS, BATCH_BYTES):
            flat, n = enc.encode(b.column("text"))
            ends = np.cumsum(n)
            ids = np.insert(flat.astype(dtype), ends, end_id)
            cuts = np.concatenate([[0], ends + np.arange(1, len(n) + 1)]) * ids.itemsize
            binary = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(n), [None, pa.py_buffer(cuts.astype(np.int64)), pa.py_buffer(ids)])
            order = pa.array(np.arange(seq, seq + len(n)), pa.int64())
            seq += len(n)
            yield pa.RecordBatch.from_arrays([b.column("part"), order, b.column("doc_id"), binary.cast(pa.binary())], ["part", "seq", "doc_id", "ids"])

    return run


def token_table(docs: DataFrame, tokenizer_path: str, end_id: int, dtype: str) -> DataFrame:
    """Every document's ids of ``dtype`` with the end id, ``part`` and ``seq`` giving the order by doc_id."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    tie = F.xxhash64("text")  # so that one id with many texts isn't one task
    rows = rows.repartitionByRange("doc_id", tie).sortWithinPartitions("doc_id", tie, "text")
    return rows.withColumn("part", F.spark_partition_id()).select("part", "doc_id", "text").mapInArrow(_tokenize(tokenizer_path, end_id, dtype), "part int, seq long, doc_id long, ids binary")


def _count(dtype: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1, np.int64)
        for b in batches:
            n = np.bincount(np.frombuffer(b"".join(x.as_buffer() for x in b.column(0)), dtype))
            if len(n) > len(total):
                total = np.concatenate([total, np.zeros(len(n) - len(total), np.int64)])
            total[: len(n)] += n
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], ["id", "n"])

    return run


def _blocks(lengths: np.ndarray, codes: np.ndarray, dtype: str):
    def block(part: int, seq: int, docs: list, n: list[int], parts: list[np.ndarray]) -> dict:
        payload, marks = pack_bits(np.concatenate(parts), lengths, codes)
        return {"part": part, "block": seq, "doc_ids": docs, "doc_tokens": n, "marks": marks.astype("<u4").tobytes(), "payload": payload}

    schema = pa.schema([("part", pa.int32()), ("block", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("doc_tokens", pa.list_(pa.int32())), ("marks", pa.binary()), ("payload", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq, docs, n, held = None, 0, [], [], []
        for b in batches:
            done = []
            for p, s, d, ids in zip(b.column("part").to_pylist(), b.column("seq").to_pylist(), b.column("doc_id").to_pylist(), b.column("ids"), strict=True):
                if held and (p != part or sum(n) >= BLOCK_TOKENS):
                    done.append(block(part, seq, docs, n, held))
                    docs, n, held = [], [], []
                if not held:
                    part, seq = p, s
                docs.append(d)
                held.append(np.frombuffer(ids.as_buffer(), dtype))
                n.append(len(held[-1]))
            if done:
                yield pa.RecordBatch.from_pylist(done, schema)
        if held:
            yield pa.RecordBatch.from_pylist([block(part, seq, docs, n, held)], schema)

    return run


def write(docs: DataFrame, path: str, tokenizer_path: str, end_id: int = END_ID) -> None:
    """Encode ``docs(doc_id, text)`` to files below ``path``, in ascending doc_id order."""
    spark = docs.sparkSession
    dtype = id_type(tokenizer_path, end_id)
    token_table(docs, tokenizer_path, end_id, dtype).write.option("compression", "zstd").parquet(f"{path}/ids")
    ids = spark.read.parquet(f"{path}/ids")
    # as many rows as the vocabulary has ids, whatever the corpus
    counted = ids.select("ids").mapInArrow(_count(dtype), "id int, n long").groupBy("id").agg(F.sum("n").alias("n")).toPandas()
    counts = np.zeros(int(counted["id"].max()) + 1 if len(counted) else 1, np.int64)
    counts[counted["id"]] = counted["n"]
    lengths = code_lengths(counts)
    at = np.flatnonzero(lengths)
    rows = pa.table({"id": pa.array(at.astype(np.int32)), "bits": pa.array(lengths[at].astype(np.int32))})
    spark.createDataFrame(rows).coalesce(1).write.parquet(f"{path}/code")
    kinds = "part int, block long, doc_ids array<long>, doc_tokens array<int>, marks binary, payload binary"
    ids.mapInArrow(_blocks(lengths, canonical(lengths), dtype), kinds).write.option("compression", "none").parquet(f"{path}/blocks")


# --- reading --------------------------------------------------------------


def _decode(lengths: np.ndarray):
    schema = pa.schema([("part", pa.int32()), ("block", pa.int64()), ("at", pa.int64()), ("doc_id", pa.int64()), ("ids", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tab = decoding_table(lengths)
        for b in slices(batches, 32):
            n = b.column("doc_tokens").to_pylist()
            marks = [np.frombuffer(x, "<u4") for x in b.column("marks").to_pylist()]
            flat = unpack_lanes(b.column("payload").to_pylist(), marks, [sum(x) for x in n], tab).astype("<u4")
            sizes = np.array([y for x in n for y in x], np.int64)
            cuts = np.concatenate([[0], np.cumsum(sizes)]) * 4
            binary = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(sizes), [None, pa.py_buffer(cuts), pa.py_buffer(flat)])
            each = np.array([len(x) for x in n])
            take = pa.array(np.repeat(np.arange(len(b)), each))
            at = np.concatenate([np.arange(x) for x in each])
            yield pa.RecordBatch.from_arrays([b.column("part").take(take), b.column("block").take(take), pa.array(at), b.column("doc_ids").flatten(), binary.cast(pa.binary())], schema=schema)

    return run


def read(spark: SparkSession, path: str) -> DataFrame:
    """``part, block, at, doc_id, ids`` (little-endian uint32 bytes) of every document in the files."""
    code = spark.read.parquet(f"{path}/code").toPandas()
    lengths = np.zeros(int(code["id"].max()) + 1 if len(code) else 1, np.uint8)
    lengths[code["id"]] = code["bits"]
    return spark.read.parquet(f"{path}/blocks").mapInArrow(_decode(lengths), "part int, block long, at long, doc_id long, ids binary")


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        ids = b.column("ids")
        n = [len(x.as_buffer()) // 4 for x in ids]
        crc = [zlib.crc32(x.as_buffer()) for x in ids]
        yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("part", "block", "at", "doc_id")), pa.array(n, pa.int64()), pa.array(crc, pa.int64())], ["part", "block", "at", "doc_id", "n_tokens", "ids_crc32"])


def op3_huffman_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, as read back from the files."""
    path = shared_dir(spark)
    write(table(spark, sf_dir, "documents"), path, public_path(TOKENIZER))
    rows = read(spark, path).mapInArrow(_digest, "part int, block long, at long, doc_id long, n_tokens long, ids_crc32 long")
    # one row a part; parts are at most as many as shuffle partitions
    sums = spark.read.parquet(f"{path}/blocks").groupBy("part").agg(F.sum(F.aggregate("doc_tokens", F.lit(0).cast("long"), lambda a, x: a + x)).alias("n")).toPandas().sort_values("part")
    sums["base"] = sums["n"].cumsum() - sums["n"]
    base = spark.createDataFrame(sums[["part", "base"]].astype("int64"), "part long, base long")
    w = Window.partitionBy("part").orderBy("block", "at").rowsBetween(Window.unboundedPreceding, -1)
    inside = rows.withColumn("inside", F.coalesce(F.sum("n_tokens").over(w), F.lit(0)))
    return inside.join(F.broadcast(base), "part").select("doc_id", (F.col("base") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32")
