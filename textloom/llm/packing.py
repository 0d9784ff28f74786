"""Operator 8: vector bin packing of examples into training sequences.

Method: an example is a vector (tokens, segments, loss-bearing tokens) and a
sequence has a limit in each.  The open sequence takes the example that fits
with the largest dot product of demand and remaining room, each dimension
weighted by the pool's mean demand, so that long and short examples meet.
When none fits, the best one is cut to the room that is left.  Multiples of the
token limit are cut off first and fill sequences of their own.

Each input partition is packed by itself in one pass, with a pool of some
thousand examples in memory: no shuffle, and no example needs another task.
What a task can't fill in the end, less than a sequence or so, goes with its
token ids to a second, small packing step over all tasks' rests, so that about
one sequence in ``REST_TOKENS`` tokens of rests is short.  A sequence that the
limits of segments or loss close early stays whole; short ones are padded.

Cases: a null text counts as empty and is its end id alone; null and repeated
doc_ids are packed like others, row by row; an empty table gives no pieces;
other columns are not read, but for the one that ``head`` names.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm.common import finished, slices, table, written
from textloom.llm.word_tokens import encoder, public_path

TOKENIZER = "word_bpe_49k.json"
END_ID = 2
MAX_TOKENS, MAX_SEGMENTS, MAX_LOSS = 4096, 64, 4096
BATCH_ROWS = 3000
#: Examples that wait for the next batch, so that each choice has a wide pool.
POOL = 256
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, sequence_tokens long, loss_tokens long"

#: Tokens of rests that one task of the second step takes.
REST_TOKENS = 4_000_000
#: A rest has its token ids, and the number of the document's tokens without loss, instead of a sequence.
RESTS = f"{PIECES}, head long, ids binary"

#: (example, start, length) of a piece.
Piece = tuple[int, int, int]


class VectorPacker:
    """Packs examples by number; ``head`` of their tokens bear no loss (a prompt, a first token)."""

    def __init__(self, tokens: int = MAX_TOKENS, segments: int = MAX_SEGMENTS, loss: int = MAX_LOSS):
        if min(tokens, segments, loss) < 1:
            raise ValueError("limits are positive")
        self.limit = np.array([tokens, segments, loss], np.int64)
        self.pool: list[Piece] = []
        self.head: dict[int, int] = {}

    def loss_of(self, piece: Piece) -> int:
        n, start, length = piece
        return max(0, start + length - max(start, self.head[n]))

    def room_for(self, n: int, start: int, room: int, loss: int) -> int:
        """The longest piece from ``start`` within ``room`` tokens and ``loss`` loss-bearing ones."""
        return min(room, max(0, self.head[n] - start) + loss)

    def add(self, n: int, length: int, head: int = 1) -> list[list[Piece]]:
        """Takes an example; gives the sequences that it fills alone."""
        self.head[n], start, full = head, 0, []
        top, _, loss = self.limit.tolist()
        while length - start >= top and self.room_for(n, start, top, loss) == top:
            full.append([(n, start, top)])
            start += top
        while length - start > 0:
            part = self.room_for(n, start, min(length - start, top), loss)
            self.pool.append((n, start, part))
            start += part
        return full

    def pack(self, keep: int = 0) -> Iterator[list[Piece]]:
        """Sequences, until at most ``keep`` pieces wait."""
        item = self.pool
        need = np.array([(p[2], 1, self.loss_of(p)) for p in item], np.int64).reshape(-1, 3)
        alive, left = np.ones(len(item), bool), len(item)
        weight = need.mean(0) / self.limit**2.0 if left else np.ones(3)
        while left > keep:
            room, sequence = self.limit.copy(), []
            while left and room[0] and room[1]:
                fits = alive & (need[:, 0] <= room[0]) & (need[:, 2] <= room[2])
                score = need @ (weight * room)
                best = int(np.argmax(np.where(fits, score, -1.0)))
                if fits[best]:
                    sequence.append(item[best])
                    room -= need[best]
                    alive[best], left = False, left - 1
                    continue
                best = int(np.argmax(np.where(alive, score, -1.0)))
                n, start, length = item[best]
                part = self.room_for(n, start, int(min(room[0], length)), int(room[2]))
                if part:
                    sequence.append((n, start, part))
                    item[best] = (n, start + part, length - part)
                    need[best] = (length - part, 1, self.loss_of(item[best]))
                break
            yield sequence
        self.pool = [p for p, on in zip(item, alive.tolist(), strict=True) if on]


_NAMES = [x.split()[0] for x in RESTS.split(", ")]


class _Writer:
    """Rows of sequences, and of rests, for examples ``(doc_id, first token's place, ids, document's tokens, head)`` by number."""

    def __init__(self, packer: VectorPacker, base: int):
        self.packer, self.base, self.made, self.held = packer, base, 0, {}

    def add(self, n: int, doc_id: int | None, begin: int, ids: np.ndarray, total: int, head: int) -> list[list[Piece]]:
        self.held[n] = doc_id, begin, ids, total, head
        return self.packer.add(n, len(ids), max(0, head - begin))

    def rows(self, sequences: list[list[Piece]], rests: list[list[Piece]] = ()) -> pa.RecordBatch:
        out = []
        for sequence in sequences:
            at, total = 0, sum(p[2] for p in sequence)
            for p in sequence:
                n, start, length = p
                doc_id, begin, ids, whole, _ = self.held[n]
                out.append((doc_id, begin + start, length, zlib.crc32(ids[start : start + length]), whole, self.base | self.made, at, total, self.packer.loss_of(p), None, None))
                at += length
            self.made += 1
        for n, start, length in (p for sequence in rests for p in sequence):
            doc_id, begin, ids, whole, head = self.held[n]
            out.append((doc_id, begin + start, length, None, whole, None, None, None, None, head, ids[start : start + length].tobytes()))
        columns = list(zip(*out, strict=True)) or [[]] * len(_NAMES)
        return pa.RecordBatch.from_arrays([pa.array(c, pa.binary() if name == "ids" else pa.int64()) for name, c in zip(_NAMES, columns, strict=True)], _NAMES)

    def forget(self) -> None:
        """Keeps what waits, copied, so that its batch can go."""
        own = {p[0] for p in self.packer.pool}
        self.held = {n: (h[0], h[1], h[2].copy(), *h[3:]) for n, h in self.held.items() if n in own}
        self.packer.head = {n: self.packer.head[n] for n in own}


def _pack(path: str, end_id: int, limits: tuple[int, int, int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, out, seen = encoder(path), _Writer(VectorPacker(*limits), TaskContext.get().partitionId() << 36), 0
        for b in slices(batches, BATCH_ROWS):
            flat, counts = enc.encode(b.column("text"))
            ends = np.cumsum(counts)
            ids = np.insert(flat.astype("<u4"), ends, end_id)
            cuts = np.concatenate([[0], ends + np.arange(1, len(counts) + 1)]).tolist()
            done: list[list[Piece]] = []
            for k, (doc_id, head) in enumerate(zip(b.column("doc_id").to_pylist(), b.column("head").to_pylist(), strict=True)):
                own = ids[cuts[k] : cuts[k + 1]]
                done += out.add(seen, doc_id, 0, own, len(own), head)
                seen += 1
            done += out.packer.pack(POOL)
            yield out.rows(done)
            out.forget()
        last = list(out.packer.pack())
        short = [s for s in last if sum(p[2] for p in s) < limits[0]]
        yield out.rows([s for s in last if s not in short], short)

    return run


def _repack(limits: tuple[int, int, int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, seen = _Writer(VectorPacker(*limits), 1 << 62 | TaskContext.get().partitionId() << 36), 0
        for b in slices(batches, BATCH_ROWS):
            done = []
            for doc_id, start, ids, total, head in zip(*(b.column(c).to_pylist() for c in ("doc_id", "start", "ids", "doc_tokens", "head")), strict=True):
                done += out.add(seen, doc_id, start, np.frombuffer(ids, "<u4"), total, head)
                seen += 1
            done += out.packer.pack(POOL)
            yield out.rows(done)
            out.forget()
        yield out.rows(list(out.packer.pack()))

    return run


def pack(docs: DataFrame, tokenizer_path: str, end_id: int = END_ID, max_tokens: int = MAX_TOKENS, max_segments: int = MAX_SEGMENTS, max_loss: int = MAX_LOSS, head: str | None = None) -> DataFrame:
    """Pieces of ``docs(doc_id, text)`` in sequences under all three limits.

    A document's first token has no context and bears no loss; nor do the first
    ``docs[head]`` tokens (a prompt's), where that column is named.  Pieces of a
    document tile its ids; ``sequence_id`` is unique, ``offset`` is gapless.
    """
    heads = F.greatest(F.lit(1), F.col(head).cast("long")) if head else F.lit(1).cast("long")  # a null counts as 1
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", heads.alias("head"))
    limits = max_tokens, max_segments, max_loss
    first = written(rows.mapInArrow(_pack(tokenizer_path, end_id, limits), RESTS))
    rests = first.where("ids is not null")
    parts = -(-(rests.agg(F.sum("length")).first()[0] or 1) // REST_TOKENS)
    again = rests.repartition(parts).mapInArrow(_repack(limits), RESTS)
    return first.where("ids is null").unionByName(again).drop("head", "ids")


@finished
def op8_vector_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), public_path(TOKENIZER))
