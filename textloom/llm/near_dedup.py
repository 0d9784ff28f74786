"""Operator 2: near duplicates by MinHash and an LSH forest.

Method: a text's set of word shingles is hashed to 64 bits; texts with equal
sets are one *class*, whatever their number.  Each class has ``HASHES`` MinHash
values, of which the low byte is kept.  The forest has ``TREES`` orders: each
sorts all classes by another sequence of ``DEPTH`` of these values.  Classes
that share the first ``BASE_DEPTH`` values of an order are a *bucket*, and all of
a bucket are candidates of each other.  Candidates whose values agree to
``SKETCH_AGREES``, well below the threshold, join their *regions*.  Of a bucket
of more than ``BUCKET`` + 1 classes only the ``WINDOW`` next ones on either side,
those with the longest common prefixes, are compared at this point; the bucket
is noted as *full*.

Links are confirmed on full shingle sets.  A region of at most ``TILE`` classes
is compared whole.  A larger one is sorted by each order of the forest, its
prefixes deepened until ``TILE`` classes are left, and each such run compared,
but for classes that agree with none they aren't yet joined with; where such
regions hold few classes in all, by the first orders only.  A region
that its links hold together is done, as no comparison could change the answer.
A run whose sets hold more than ``BLOCK_SHINGLES`` shingles is ordered by set
size and cut into blocks of so many, and pairs of blocks are compared, so no task
meets more than two; pairs of blocks whose sizes lie too far apart for any link
are left out.  Only a spanning forest of the links leaves a task.

The rest is exact.  Full buckets and large regions that the links so far don't
hold together are *open*.  Their classes are joined by shingles: in any order of
all shingles, two sets that are linked share one of the first n - ceil(0.8 n) + 1
of either, so only these are shuffled, the rarest first.  Lists of one shingle in
which only one component occurs have nothing to add; longer ones than ``LIST`` are
cut into blocks, and pairs of blocks meet, but for those of one component.  Pairs
in a list are compared by parity bits, which differ in no more places than the
sets differ in shingles, so they drop no link; what is left is confirmed on full
sets.  Components of all these links are the answer.

All orders are range-partitioned sorts, so a region of any size is spread over
tasks; runs that end at the edge of a task are joined by a second pass over the
edges.  Nothing grows with the number of copies.

Cases: a text without words (null, empty) has no shingles and is linked with
nothing; fewer words than a shingle make one shingle; rows with equal texts are
one class; rows with equal doc_ids are one node, so their links add up; a null
doc_id is linked with nothing; an empty table gives no rows; other columns are
not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textloom.llm.common import LOWER, UPPER, connected, finished, fresh, joined_by, slices, small_or_shuffled, table, written
from textloom.llm.text_stats import mix

HASHES, TREES, DEPTH, BASE_DEPTH = 128, 24, 64, 3
WINDOW, BUCKET = 16, 256
SKETCH_AGREES = 0.6
TILE = 512
#: Shingles (8 bytes each) of a block; one longer set is a block of its own.
BLOCK_SHINGLES = 2_000_000
#: Rows of a shingle's list that are a block, and parity bits of a set.
LIST, PARITY = 1024, 2048
#: Shingles that come last in the order of the exact way: the most frequent ones in some ``ORDER_SETS`` sets.
FREQUENT, ORDER_SETS = 200_000, 5000
#: The orders by which large regions are cut, pass by pass; most regions are done after the first.
PASSES = (range(1), range(1, 8), range(8, TREES))
#: Up to so many classes in large regions there is one pass, by the orders of the first two; what it leaves open is joined exactly, as ever.
FEW_OPEN = 20_000
#: Tiles of more classes are sketched before sets are compared; beyond so many pairs a class, all sets are compared at once.
SKETCHED, PAIRS_A_CLASS = 48, 64
#: Regions' texts are fetched by a broadcast of ids up to this number (16 bytes each), else by a shuffle.
BROADCAST_IDS = 1_000_000
#: Sets whose parity bits (256 bytes each) are broadcast.
BROADCAST_BITS = 50_000
#: Places of classes in tiles (24 bytes each) that are broadcast, so that only the sets they need are shuffled.
BROADCAST_TILES = 500_000

_rng = np.random.default_rng(20240229)
_MULTIPLY = (_rng.integers(0, 1 << 32, HASHES, dtype=np.uint64) | 1).astype(np.uint32)
_ADD = _rng.integers(0, 1 << 32, HASHES, dtype=np.uint64).astype(np.uint32)
#: The MinHash values that each tree reads, in its order.
_ORDERS = np.array([_rng.permutation(HASHES)[:DEPTH] for _ in range(TREES)])
_UPPER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
#: A random 64-bit value for each byte, and the multiplier of a word's polynomial hash.
_BYTE = _rng.integers(0, 1 << 64, 256, dtype=np.uint64)
_FACTOR = np.uint64(0x9E3779B97F4A7C15)


def word_hashes(words: pa.LargeStringArray) -> np.ndarray:
    """64-bit hashes of words that aren't empty: a polynomial over their bytes, mixed."""
    offsets = np.frombuffer(words.buffers()[1], np.int64)[words.offset : words.offset + len(words) + 1]
    if not len(words):
        return np.zeros(0, np.uint64)
    raw = np.frombuffer(words.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
    size, begin = np.diff(offsets), offsets[:-1] - offsets[0]
    powers = np.ones(int(size.max()), np.uint64)
    np.multiply.accumulate(np.full(len(powers) - 1, _FACTOR), out=powers[1:])
    place = np.arange(len(raw), dtype=np.int64) - np.repeat(begin, size)
    return mix(np.add.reduceat(_BYTE[raw] * powers[place], begin) + size.astype(np.uint64))


def shingle_sets(texts: pa.Array, size: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes by text."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    raw = np.frombuffer(bytes(texts.buffers()[2] or b"").translate(_UPPER), np.uint8)
    low = pa.LargeStringArray.from_buffers(len(texts), texts.buffers()[1], pa.py_buffer(raw), texts.buffers()[0], texts.null_count, texts.offset)
    split = pc.ascii_split_whitespace(low)
    bounds = split.offsets.to_numpy()
    flat = split.flatten()
    real = pc.greater(pc.binary_length(flat), 0).to_numpy(zero_copy_only=False)
    doc = np.repeat(np.arange(len(texts)), np.diff(bounds))[real]
    coded = flat.filter(pa.array(real)).dictionary_encode()
    h = word_hashes(coded.dictionary)[coded.indices.to_numpy()]
    n_words = np.bincount(doc, minlength=len(texts))
    ends = np.cumsum(n_words)
    out = []
    for end, n in zip(ends.tolist(), n_words.tolist(), strict=True):
        own = h[end - n : end]
        k = min(size, n)
        key = np.full(max(0, n - k + 1) if n else 0, k, np.uint64)
        for i in range(k):
            key = mix(key + own[i : i + len(key)])
        out.append(np.unique(key))
    return out


def signature(shingles: np.ndarray) -> np.ndarray:
    """The low bytes of ``HASHES`` MinHash values of a set that is not empty."""
    low = (shingles >> np.uint64(32)).astype(np.uint32)
    best = np.full(HASHES, 0xFFFFFFFF, np.uint32)
    for k in range(0, len(low), 256):
        x = low[k : k + 256, None] * _MULTIPLY
        x ^= x >> np.uint32(15)
        x += _ADD
        x *= np.uint32(0x2C1B3C6D)
        np.minimum(best, x.min(0), out=best)
    return best.astype(np.uint8)


def _features(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            sets = shingle_sets(b.column("text"), size)
            keys = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets]
            signs = [signature(s).tobytes() if len(s) else None for s in sets]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()), pa.array(keys, pa.binary()), pa.array(signs, pa.binary())], ["doc_id", "n_shingles", "set_key", "signature"])

    return run


class _Roots:
    """Which of ``n`` things are one by now."""

    def __init__(self, n: int):
        self.to = list(range(n))

    def find(self, i: int) -> int:
        to = self.to
        while to[i] != i:
            to[i] = to[to[i]]
            i = to[i]
        return i

    def join(self, i: int, j: int) -> bool:
        i, j = self.find(i), self.find(j)
        if i == j:
            return False
        self.to[max(i, j)] = min(i, j)
        return True


def _bytes(column: pa.Array, width: int) -> np.ndarray:
    """A binary column of one width as a matrix."""
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(len(column), width)


# --- the forest -------------------------------------------------------------


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each class and tree: the tree's number, then the values in its order."""
    for b in slices(batches):
        signs = _bytes(b.column("signature"), HASHES)
        for t, order in enumerate(_ORDERS):
            paths = np.concatenate([np.full((len(b), 1), t, np.uint8), signs[:, order]], 1)
            yield pa.RecordBatch.from_arrays([pa.array([p.tobytes() for p in paths], pa.binary()), b.column("node")], ["path", "node"])


def _heads(paths: np.ndarray) -> np.ndarray:
    """The buckets of rows: tree and first values."""
    return np.ascontiguousarray(paths[:, : BASE_DEPTH + 1]).view(np.uint32).ravel()


def full_rows(paths: np.ndarray, bucket: int) -> np.ndarray:
    """Which rows of sorted ``paths`` lie in a bucket of more than ``bucket`` + 1 rows."""
    head, far = _heads(paths), bucket + 1
    at = np.flatnonzero(head[:-far] == head[far:])
    mark = np.zeros(len(head) + 1, np.int64)
    mark[at] += 1
    mark[at + far + 1] -= 1
    return np.cumsum(mark)[:-1] > 0


def candidates(paths: np.ndarray, new: int, bucket: int = BUCKET) -> tuple[np.ndarray, np.ndarray]:
    """Places in sorted ``paths`` of a bucket's rows that may be linked; only those with the later one at ``new`` or after.

    Rows of full buckets meet those next to them.
    """
    head, full = _heads(paths), full_rows(paths, bucket)
    left, right = [], []
    for step in range(1, min(max(WINDOW, bucket), len(paths) - 1) + 1):
        at = np.flatnonzero(head[:-step] == head[step:])
        if not len(at):
            break
        at = at[at + step >= new]
        if step > WINDOW:
            at = at[~(full[at] & full[at + step])]
        at = at[(paths[at, 1:] == paths[at + step, 1:]).mean(1) >= SKETCH_AGREES]
        left.append(at)
        right.append(at + step)
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *left]), np.concatenate([none, *right])


def _neighbours(edges: bool, bucket: int):
    """A spanning forest of the candidates in a sorted task, and the rows of full buckets (by ``path``'s head); with ``edges``, also the rows of its first and last bucket."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("path", pa.binary()), ("node", pa.int64())])

    def pairs(paths: np.ndarray, nodes: np.ndarray, new: int) -> pa.RecordBatch:
        i, j = candidates(paths, new, bucket)
        roots = _Roots(len(nodes))
        kept = [k for k, (x, y) in enumerate(zip(i.tolist(), j.tolist(), strict=True)) if roots.join(x, y)]
        none = pa.nulls(len(kept))
        return pa.RecordBatch.from_arrays([pa.array(nodes[i[kept]]), pa.array(nodes[j[kept]]), none.cast(pa.binary()), none.cast(pa.int64())], schema=schema)

    def rows(paths: np.ndarray, nodes: np.ndarray) -> pa.RecordBatch:
        none = pa.nulls(len(nodes), pa.int64())
        return pa.RecordBatch.from_arrays([none, none, pa.array([p.tobytes() for p in paths], pa.binary()), pa.array(nodes)], schema=schema)

    def edge(paths: np.ndarray, nodes: np.ndarray, at: int) -> pa.RecordBatch:
        on = (paths[:, : BASE_DEPTH + 1] == paths[at, : BASE_DEPTH + 1]).all(1)
        return rows(paths[on], nodes[on])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        paths, nodes, told, first = np.zeros((0, DEPTH + 1), np.uint8), np.zeros(0, np.int64), np.zeros(0, bool), edges
        for b in slices(batches, 8192):
            old = len(nodes)
            paths, nodes = np.concatenate([paths, _bytes(b.column("path"), DEPTH + 1)]), np.concatenate([nodes, b.column("node").to_numpy()])
            if first and len(nodes) > bucket:
                yield edge(paths[: bucket + 1], nodes[: bucket + 1], 0)
                first = False
            yield pairs(paths, nodes, old)
            told = np.concatenate([told, np.zeros(len(b), bool)])
            full = full_rows(paths, bucket)
            yield rows(paths[full & ~told, : BASE_DEPTH + 1], nodes[full & ~told])
            paths, nodes, told = paths[-bucket - 1 :].copy(), nodes[-bucket - 1 :].copy(), (told | full)[-bucket - 1 :]
        if first and len(nodes):
            yield edge(paths, nodes, 0)
        if edges and len(nodes):
            yield edge(paths, nodes, -1)

    return run


def forest(classes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``a, b``: candidates among ``classes(node, signature)``, enough of them to hold their regions together; ``bin, node``: full buckets, some rows of which come twice."""
    kind = "a long, b long, path binary, node long"
    rows = classes.mapInArrow(_forest, "path binary, node long")
    found = written(rows.repartitionByRange("path", "node").sortWithinPartitions("path", "node").mapInArrow(_neighbours(True, BUCKET), kind))
    # two buckets of each task, up to BUCKET + 1 rows of either; all tasks read, one compares
    ends = found.where(F.length("path") > BASE_DEPTH + 1).select("path", "node").distinct()
    seams = written(ends.repartition(1).sortWithinPartitions("path", "node").mapInArrow(_neighbours(False, BUCKET), kind))
    both = found.unionByName(seams)
    full = both.where(F.length("path") == BASE_DEPTH + 1).select(F.hex("path").alias("bin"), "node")
    return both.where("a <> b").select("a", "b"), written(full)


def neighbours(classes: DataFrame) -> DataFrame:
    """``a, b``: candidates among ``classes(node, signature)``, enough of them to hold their regions together."""
    return forest(classes)[0]


# --- links ------------------------------------------------------------------


def _sets(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            sets = shingle_sets(b.column("text"), size)
            yield pa.RecordBatch.from_arrays([b.column("node"), pa.array([len(s) for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())], ["node", "n", "shingles"])

    return run


def linked(sets: list[np.ndarray], percent: int) -> np.ndarray:
    """Whether 100 * intersection >= percent * union, for all of ``sets`` with each other."""
    values, codes = np.unique(np.concatenate(sets), return_inverse=True)
    n = np.array([len(s) for s in sets])
    row = np.repeat(np.arange(len(n)), n)
    both = np.zeros((len(n), len(n)), np.float32)
    order = np.argsort(codes, kind="stable")
    row, codes = row[order], codes[order]
    bounds = np.searchsorted(codes, np.arange(0, len(values) + 4096, 4096))
    for lo, hi in zip(bounds, bounds[1:], strict=False):  # 4,096 shingles at a time
        dense = np.zeros((len(n), 4096), np.float32)
        dense[row[lo:hi], codes[lo:hi] % 4096] = 1
        both += dense @ dense.T
    return 100 * both >= percent * (n[:, None] + n[None, :] - both)


def _similar(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Pairs whose MinHash values agree well enough, the most alike first."""
    signs = np.stack([signature(s) for s in sets])
    left, right, how = [], [], []
    for i in range(0, len(sets), 32):
        agree = (signs[i : i + 32, None] == signs[None, i:]).mean(2)
        x, y = np.nonzero(agree >= SKETCH_AGREES)
        on = x < y
        left.append(x[on] + i)
        right.append(y[on] + i)
        how.append(agree[x[on], y[on]])
    order = np.argsort(-np.concatenate(how), kind="stable")
    return np.concatenate(left)[order], np.concatenate(right)[order]


def parity(shingles: np.ndarray) -> np.ndarray:
    """Whether an odd number of a set's shingles fall on each of ``PARITY`` places, as bits in 64-bit words."""
    odd = np.bincount((shingles % np.uint64(PARITY)).astype(np.int64), minlength=PARITY) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.uint64)


def may_link(bits: np.ndarray, size: np.ndarray, group: np.ndarray, percent: int, first: int, last: int) -> tuple[np.ndarray, np.ndarray]:
    """For rows ``first`` to ``last`` and all rows: whether they may be linked and are of two groups, and in how many bits they differ.

    Bits differ in no more places than sets differ in shingles, and linked sets
    differ in at most (100 - percent) / (100 + percent) of their sizes' sum.
    """
    a, n = bits[first:last], size[first:last, None]
    differ = np.bitwise_count(a[:, None] ^ bits[None]).sum(2, dtype=np.int64)
    on = ((100 + percent) * differ <= (100 - percent) * (n + size)) & (100 * np.minimum(n, size) >= percent * np.maximum(n, size))
    return on & (group[first:last, None] != group), differ


def _possible(sets: list[np.ndarray], group: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """All pairs of different groups that may be linked, those that differ least first."""
    bits, size, left, right, how = np.stack([parity(s) for s in sets]), np.array([len(s) for s in sets]), [], [], []
    for i in range(0, len(sets), 32):
        on, differ = may_link(bits, size, group, percent, i, i + 32)
        x, y = np.nonzero(on)
        later = x + i < y
        x, y = x[later], y[later]
        left.append(x + i)
        right.append(y)
        how.append(differ[x, y] / (size[x + i] + size[y]))
    order = np.argsort(np.concatenate(how), kind="stable")
    return np.concatenate(left)[order], np.concatenate(right)[order]


def spanning_links(sets: list[np.ndarray], group: np.ndarray, percent: int, exact: bool = False) -> list[tuple[int, int]]:
    """Links between ``sets`` that join all groups that any of their links joins; with ``exact``, without sketches."""
    n, size, out = len(sets), np.array([len(s) for s in sets]), []
    if n <= SKETCHED:
        i, j = np.triu_indices(n, 1)
    else:
        i, j = _possible(sets, group, percent) if exact else _similar(sets)
    on = (group[i] != group[j]) & (100 * np.minimum(size[i], size[j]) >= percent * np.maximum(size[i], size[j]))
    i, j = i[on], j[on]
    all_at_once = linked(sets, percent) if len(i) > PAIRS_A_CLASS * n else None
    if all_at_once is not None:
        on = all_at_once[i, j]
        i, j = i[on], j[on]
    roots = _Roots(int(group.max()) + 1 if n else 0)
    for a, b in zip(i.tolist(), j.tolist(), strict=True):
        x, y = int(group[a]), int(group[b])
        if roots.find(x) != roots.find(y):
            if all_at_once is None:
                both = len(np.intersect1d(sets[a], sets[b], assume_unique=True))
                if 100 * both < percent * (size[a] + size[b] - both):
                    continue
            roots.join(x, y)
            out.append((a, b))
    return out


def in_blocks(tiles: DataFrame, lengths: DataFrame, percent: int) -> DataFrame:
    """``tile, left, right, node, n, group``: the rows of ``tiles(tile, node, group)`` for each two blocks that are compared, as a written table.

    ``lengths(node, n)`` are the sizes of the nodes' sets; a tile within
    ``BLOCK_SHINGLES`` is one block, and compared with itself.
    """
    sized = written(lengths.join(small_or_shuffled(tiles, BROADCAST_TILES), "node"))
    heavy = written(sized.groupBy("tile").agg(F.sum("n").alias("total")).where(F.col("total") > BLOCK_SHINGLES).select("tile"))
    whole = lambda df: df.select("tile", F.lit(0).cast("long").alias("left"), F.lit(0).cast("long").alias("right"), "node", "n", "group")
    if heavy.isEmpty():
        return whole(sized)
    heavy = small_or_shuffled(heavy)
    before = F.sum("n").over(Window.partitionBy("tile").orderBy("n", "node").rowsBetween(Window.unboundedPreceding, -1))
    cut = written(sized.join(heavy, "tile").withColumn("block", F.floor(F.coalesce(before, F.lit(0)) / BLOCK_SHINGLES)))
    ends = cut.groupBy("tile", "block").agg(F.min("n").alias("least"), F.max("n").alias("most"))
    left, right = (ends.select("tile", F.col("block").alias(side), F.col(end).alias(f"{side}_{end}")) for side, end in (("left", "most"), ("right", "least")))
    # a tile has at most as many blocks as classes
    pairs = left.join(right, "tile").where((F.col("left") <= F.col("right")) & (100 * F.col("left_most") >= percent * F.col("right_least")))
    sides = pairs.select("tile", "left", "right", F.explode(F.array_distinct(F.array("left", "right"))).alias("block"))
    parts = cut.join(sides, ["tile", "block"]).select("tile", "left", "right", "node", "n", "group")
    return written(whole(sized.join(heavy, "tile", "left_anti")).unionByName(parts))


def _tile(percent: int, exact: bool):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        sets = [np.frombuffer(x, np.uint64) for x in pdf["shingles"]]
        node, group = pdf["node"].to_numpy(), np.unique(pdf["group"].to_numpy(), return_inverse=True)[1]
        out = [(int(node[i]), int(node[j])) for i, j in spanning_links(sets, group, percent, exact)]
        return pd.DataFrame(out, columns=["a", "b"], dtype="int64")

    return run


def _ordered(trees: range):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            signs = _bytes(b.column("signature"), HASHES)
            for t in trees:
                paths = np.concatenate([np.full((len(b), 1), t, np.uint8), signs[:, _ORDERS[t]]], 1)
                yield pa.RecordBatch.from_arrays([b.column("region"), b.column("node"), b.column("group"), pa.array([p.tobytes() for p in paths], pa.binary())], ["region", "node", "group", "path"])

    return run


def may_join(paths: np.ndarray, group: np.ndarray) -> np.ndarray:
    """Which rows agree with a row of another group."""
    out = np.zeros(len(group), bool)
    if (group != group[0]).any():
        for i in range(0, len(group), 64):
            close = (paths[i : i + 64, None, 1:] == paths[None, :, 1:]).mean(2) >= SKETCH_AGREES
            out[i : i + 64] = (close & (group[i : i + 64, None] != group[None, :])).any(1)
    return out


def _cut(size: int):
    """Runs of at most ``size`` neighbours of a region in a sorted task, numbered; of each run the rows that may join groups."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tile = TaskContext.get().partitionId() << 32
        held = np.zeros(0, np.int64), np.zeros((0, DEPTH + 1), np.uint8), np.zeros(0, np.int64), np.zeros(0, np.int64)

        def runs(last: bool) -> Iterator[pa.RecordBatch]:
            """Whole runs of what is held; the last one waits for more unless ``last``."""
            nonlocal tile, held
            region, paths, node, group = held
            ends = np.flatnonzero((region[1:] != region[:-1]) | (paths[1:, 0] != paths[:-1, 0])) + 1
            start = 0
            for end in [*ends.tolist(), len(region)]:
                while start < end and (last or end < len(region) or end - start >= size):
                    cut = slice(start, min(end, start + size))
                    on = np.flatnonzero(may_join(paths[cut], group[cut])) + start
                    if len(on):
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(on), tile)), pa.array(node[on]), pa.array(group[on])], ["tile", "node", "group"])
                    tile, start = tile + 1, cut.stop
            held = tuple(x[start:].copy() for x in held)

        for b in slices(batches, 8192):
            new = b.column("region").to_numpy(), _bytes(b.column("path"), DEPTH + 1), b.column("node").to_numpy(), b.column("group").to_numpy()
            held = tuple(map(np.concatenate, zip(held, new, strict=True)))
            yield from runs(False)
        yield from runs(True)

    return run


def _shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in slices(batches):
        yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(b"".join(b.column("shingles").to_pylist()), np.int64))], ["key"])


def _prefixes(percent: int, frequent: np.ndarray, often: np.ndarray):
    """The first shingles of each set, rarest first: linked sets share one of them."""

    def first(shingles: np.ndarray) -> np.ndarray:
        place = np.minimum(np.searchsorted(frequent, shingles), max(0, len(frequent) - 1))
        count = np.where(frequent[place] == shingles, often[place], 0) if len(frequent) else np.zeros(len(shingles), np.int64)
        return shingles[np.lexsort((shingles, count))[: len(shingles) + percent * len(shingles) // -100 + 1]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            own = [first(np.frombuffer(x, np.int64)) for x in b.column("shingles").to_pylist()]
            take = pa.array(np.repeat(np.arange(len(b)), [len(x) for x in own]))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(own)), *(b.column(c).take(take) for c in ("node", "n", "group"))], ["key", "node", "n", "group"])

    return run


def _parities(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in slices(batches):
        bits = [parity(np.frombuffer(x, np.uint64)).tobytes() for x in b.column("shingles").to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column("node"), b.column("n"), pa.array(bits, pa.binary())], ["node", "n", "bits"])


def in_lists(firsts: DataFrame, block: int) -> DataFrame:
    """``tile, node, n, group``: the rows of ``firsts(key, node, n, group)`` that meet for a key, without those that meet no other group.

    A list of at most ``block`` rows is a tile; a longer one is cut into blocks by group,
    and a large group into several, and each two blocks that hold two groups are one.
    """
    lists = written(firsts.groupBy("key").agg(F.min("group").alias("low"), F.max("group").alias("high"), F.count("*").alias("rows")).where("low < high").select("key", "rows"))
    rows = written(joined_by(firsts, lists, "key", "rows", firsts.count(), keep=True))
    short = rows.where(F.col("rows") <= block).select(F.col("key").alias("tile"), "node", "n", "group")
    long = rows.where(F.col("rows") > block)
    if long.isEmpty():
        return short
    # at most as many as rows / block
    big = small_or_shuffled(written(long.groupBy("key", "group").agg(F.ceil(F.count("*") / block).alias("parts")).where("parts > 1")))
    of_group = F.xxhash64(F.lit(1), "group", F.pmod(F.xxhash64("node"), "parts"))
    shared = F.xxhash64(F.lit(2), F.pmod(F.xxhash64("group"), F.ceil(F.col("rows") / block)))
    cut = written(long.join(big, ["key", "group"], "left").withColumn("block", F.when(F.col("parts").isNotNull(), of_group).otherwise(shared)).select("key", "block", "node", "n", "group"))
    ends = written(cut.groupBy("key", "block").agg(F.min("group").alias("low"), F.max("group").alias("high")))
    left, right = (ends.select("key", *(F.col(c).alias(f"{side}_{c}") for c in ("block", "low", "high"))) for side in ("left", "right"))
    pairs = left.join(right, "key").where((F.col("left_block") <= F.col("right_block")) & (F.least("left_low", "right_low") < F.greatest("left_high", "right_high")))
    tile = F.xxhash64("key", "left_block", "right_block").alias("tile")
    sides = pairs.select("key", tile, F.explode(F.array_distinct(F.array("left_block", "right_block"))).alias("block"))
    return short.unionByName(cut.join(sides, ["key", "block"]).select("tile", "node", "n", "group"))


def _meet(percent: int):
    """Of each tile in a sorted task the rows that may be linked with another group; tiles that leave the same nodes get one number."""
    words = PARITY // 64

    def joins(bits: np.ndarray, size: np.ndarray, group: np.ndarray) -> np.ndarray:
        return np.concatenate([may_link(bits, size, group, percent, i, i + 32)[0].any(1) for i in range(0, len(size), 32)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros((0, words), np.uint64)

        def tiles(last: bool) -> Iterator[pa.RecordBatch]:
            nonlocal held
            tile, node, size, group, bits = held
            cuts = [0, *(np.flatnonzero(tile[1:] != tile[:-1]) + 1).tolist(), *([len(tile)] if last else [])]
            out = []
            for start, end in zip(cuts, cuts[1:], strict=False):
                on = np.flatnonzero(joins(bits[start:end], size[start:end], group[start:end])) + start
                if len(on):
                    nodes, at = np.unique(node[on], return_index=True)
                    number = int.from_bytes(hashlib.blake2b(nodes.tobytes(), digest_size=8).digest(), "little", signed=True)
                    out.append((np.full(len(nodes), number), nodes, group[on[at]]))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out, strict=True)], ["tile", "node", "group"])
            held = tuple(x[cuts[-1] :].copy() for x in held)

        for b in slices(batches, 8192):
            new = *(b.column(c).to_numpy() for c in ("tile", "node", "n", "group")), _bytes(b.column("bits"), PARITY // 8).view(np.uint64)
            held = tuple(map(np.concatenate, zip(held, new, strict=True)))
            yield from tiles(False)
        yield from tiles(True)

    return run


def rest_tiles(rest: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """``tile, node, group``: rows of ``rest(node, group)`` such that any two of different groups that are linked share a tile."""
    own = written(sets.join(small_or_shuffled(rest, BROADCAST_IDS), "node"))
    # the order decides on the work only, so some sets do
    total = own.count()
    thin = own.where(F.pmod(F.xxhash64("node"), F.lit(max(1, total // ORDER_SETS))) == 0)
    often = thin.select("shingles").mapInArrow(_shingles, "key long").groupBy("key").agg(F.count("*").alias("n")).where("n > 2")
    often = often.orderBy(F.desc("n"), "key").limit(FREQUENT).toPandas().sort_values("key")
    firsts = own.mapInArrow(_prefixes(percent, often["key"].to_numpy(np.int64), often["n"].to_numpy(np.int64)), "key long, node long, n long, group long")
    bits = own.select("node", "n", "shingles").mapInArrow(_parities, "node long, n long, bits binary")
    rows = in_lists(written(firsts), LIST).join(F.broadcast(bits) if total <= BROADCAST_BITS else bits, ["node", "n"])
    met = rows.repartition("tile").sortWithinPartitions("tile").select("tile", "node", "n", "group", "bits").mapInArrow(_meet(percent), "tile long, node long, group long")
    return written(met.distinct())


def links(regions: DataFrame, full: DataFrame, classes: DataFrame, docs: DataFrame, repeated: DataFrame, size: int, percent: int) -> DataFrame:
    """``a, b``: links on full sets inside ``regions(node, region)`` and ``full(bin, node)`` that hold together what their links join; ``repeated`` ids have several rows."""
    some_full = not full.isEmpty()
    wanted = regions.select("node").unionByName(full.select("node"))
    wanted = F.broadcast(wanted) if wanted.count() <= BROADCAST_IDS else small_or_shuffled(written(wanted.distinct()), BROADCAST_IDS)
    some = docs.select(F.col("doc_id").alias("node"), "text").join(wanted, "node", "left_semi")
    several = not repeated.isEmpty()
    if several:  # only their texts are shuffled
        twice = small_or_shuffled(repeated.select(F.col("doc_id").alias("node")))
        some = some.join(twice, "node", "left_anti").unionByName(some.join(twice, "node", "left_semi").dropDuplicates(["node", "text"]))
    sets = written(some.select("node", "text").mapInArrow(_sets(size), "node long, n long, shingles binary"))
    lengths = written(sets.select("node", "n").distinct()) if several else sets.select("node", "n")

    def found_in(tiles: DataFrame, exact: bool = False) -> DataFrame:
        rows = small_or_shuffled(in_blocks(tiles, lengths, percent), BROADCAST_TILES)
        return written(sets.join(rows, ["node", "n"]).groupBy("tile", "left", "right").applyInPandas(_tile(percent, exact), "a long, b long"))

    # large regions are at most as many as nodes / TILE
    large = small_or_shuffled(written(regions.groupBy("region").agg(F.count("*").alias("n")).where(F.col("n") > TILE).select("region")))
    few = regions.join(large, "region", "left_anti")
    found = found_in(written(few.select(F.col("region").alias("tile"), "node", F.col("node").alias("group"))))
    large = written(regions.join(large, "region").select("region", "node", F.col("node").alias("group")))
    total, more = large.count(), None
    # few classes: the orders of the first passes at once, as a pass costs more than its work
    for trees in PASSES if total > FEW_OPEN else (range(PASSES[:2][-1].stop),):
        if not total:
            break
        rows = large.join(classes, "node").select("region", "node", "group", "signature").mapInArrow(_ordered(trees), "region long, node long, group long, path binary")
        tiles = rows.repartitionByRange("region", "path", "node").sortWithinPartitions("region", "path", "node").mapInArrow(_cut(TILE), "tile long, node long, group long")
        new = found_in(written(tiles))
        if new.isEmpty():
            continue
        more = new if more is None else more.unionByName(new)
        groups = small_or_shuffled(connected(more).select("node", F.col("component").alias("now")), BROADCAST_IDS)  # links of a region lie inside it
        large = written(large.drop("group").join(groups, "node", "left").select("region", "node", F.coalesce("now", "node").alias("group")))
        large = written(large.join(open_parts(large, "region"), "region"))
        total = large.count()
    found = found if more is None else found.unionByName(more)
    rest = large.select("node", "group")
    if some_full:
        groups = small_or_shuffled(connected(found).select("node", F.col("component").alias("now")), BROADCAST_IDS)
        bins = written(full.join(groups, "node", "left").select("bin", "node", F.coalesce("now", "node").alias("group")))
        rest = written(rest.unionByName(bins.join(open_parts(bins, "bin"), "bin").select("node", "group")).distinct())
    return found if rest.isEmpty() else found.unionByName(found_in(rest_tiles(rest, sets, percent), True))


def open_parts(rows: DataFrame, key: str) -> DataFrame:
    """The values of ``key`` in whose ``rows`` there is more than one ``group``."""
    return small_or_shuffled(written(rows.groupBy(key).agg(F.min("group").alias("low"), F.max("group").alias("high")).where("low < high").select(key)))


def near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = 80) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` for each row of ``docs(doc_id, text)``."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows = written(docs.mapInArrow(_features(shingle), "doc_id long, n_shingles long, set_key binary, signature binary"))
    real = rows.where("set_key is not null and doc_id is not null")
    nodes = written(rows.where("set_key is not null").groupBy("set_key").agg(F.min("doc_id").alias("node"), F.min_by("signature", "doc_id").alias("signature"), F.count("*").alias("n")))
    repeated = written(real.groupBy("doc_id").count().where("count > 1").select("doc_id"))
    classes = nodes.where("node is not null").select("node", "signature")
    if not repeated.isEmpty():  # else each set has a node of its own
        classes = written(classes.dropDuplicates(["node", "signature"]))
    near, full = forest(classes)
    regions = connected(near).select("node", F.col("component").alias("region"))
    found = links(regions, full, classes, docs, repeated, shingle, percent)
    # an id with several texts stands for all of them
    twice = real.select("doc_id", "set_key").join(small_or_shuffled(repeated), "doc_id").distinct().join(nodes.select("set_key", "node"), "set_key")
    groups = connected(found.unionByName(twice.select(F.col("doc_id").alias("a"), F.col("node").alias("b"))))
    answer = written(nodes.join(groups, "node", "left").select("set_key", F.coalesce("component", "node").alias("component_id"), "n"))
    alone = rows.where("set_key is null").select("doc_id", "n_shingles", F.lit(None).cast("long").alias("component_id"))
    total = rows.count()
    out = joined_by(rows.select("doc_id", "n_shingles", "set_key"), answer, "set_key", "n", total).select("doc_id", "n_shingles", "component_id").unionByName(alone)
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"))


def deduplicate(docs: DataFrame, shingle: int = 5, percent: int = 80) -> DataFrame:
    """One row of ``docs`` for each group of near duplicates, with its columns.

    A row with a null doc_id takes an id from its text, so it joins the texts it
    equals or resembles; without words it is linked with nothing and stays.  Of
    several rows with the kept id, that of the least digest stays.
    """
    own, row = fresh(docs, "own_id"), fresh(docs, "least_row")
    has_words = F.coalesce("text", F.lit("")).rlike(r"[^\x20\x09-\x0D]")
    hashed = F.xxhash64("text").bitwiseAND(F.lit((1 << 61) - 1)) + F.lit(1 << 62)  # beyond usual ids, which so are kept rather
    rows = docs.withColumn(own, F.coalesce(F.col("doc_id").cast("long"), F.when(has_words, hashed)))
    found = near_duplicates(rows.select(F.col(own).alias("doc_id"), "text"), shingle, percent)
    kept = written(found.where("kept and doc_id is not null").groupBy(F.col("doc_id").alias(own)).agg(F.count("*").alias("n")))
    # ids are broadcast up to a counted number; beyond, the kept texts are shuffled once
    one = rows.join(small_or_shuffled(kept.where("n = 1").select(own), BROADCAST_IDS), own, "left_semi")
    # repeated rows are reduced inside their tasks, so that many copies aren't gathered
    again = rows.join(small_or_shuffled(kept.where("n > 1").select(own)), own, "left_semi")
    digest = F.xxhash64(*(f.name for f in docs.schema if "map<" not in f.dataType.simpleString()))
    least = again.groupBy(own).agg(F.min_by(F.struct(*docs.columns), digest).alias(row)).select(f"{row}.*")
    return one.select(*docs.columns).unionByName(least).unionByName(rows.where(F.col(own).isNull()).select(*docs.columns))


@finished
def op2_minhash_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), shingle=2)


def oracle() -> str:
    """DuckDB SQL for the query: every pair of rows that share a shingle, on full sets."""
    return f"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') AS words FROM documents),
s AS (SELECT r, doc_id, CASE WHEN len(words) > 1 THEN list_distinct(list_transform(range(1, len(words)), lambda i: words[i] || ' ' || words[i + 1])) ELSE words END AS held FROM d),
e AS (SELECT r, unnest(held) AS w FROM s), n AS (SELECT r, doc_id, len(held) AS n FROM s),
p AS (SELECT a.r AS x, b.r AS y, count(*) AS both_ FROM e a JOIN e b ON a.w = b.w AND a.r < b.r GROUP BY ALL),
k AS (SELECT i.doc_id AS a, j.doc_id AS b FROM p JOIN n i ON i.r = x JOIN n j ON j.r = y WHERE 100 * both_ >= 80 * (i.n + j.n - both_) AND i.doc_id <> j.doc_id),
l AS (SELECT a, b FROM k UNION SELECT b, a FROM k),
t(a, b) AS (SELECT doc_id, doc_id FROM documents WHERE doc_id IS NOT NULL UNION SELECT t.a, l.b FROM t JOIN l ON t.b = l.a),
c AS (SELECT a, min(b) AS component_id FROM t GROUP BY a)
SELECT doc_id, n::BIGINT AS n_shingles, component_id, coalesce(doc_id = component_id, true) AS kept FROM n LEFT JOIN c ON a = doc_id
"""
