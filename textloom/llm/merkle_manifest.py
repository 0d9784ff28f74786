"""Merkle manifest of a dataset: every row a leaf, a tree for each language, and a tree of their subroots.

Rows are placed in the order of language and id; a leaf's index in its tree is
its row number there.  The tree is built level by level: a node's index divided
by the fanout is its parent's, each parent gathers its children as a sorted
array, and the hash of their digests is its own.  On the way back, each level
joins its nodes with their parents and puts a node's siblings before those
that its parent has: so the rows that a level joins halve with each level, and
a row's proof ends at the root.

Trees have as many levels as their size asks for; a level's nodes stay in one
task only where they were counted to be ``SMALL`` at most.

Cases: null values are hashed as ``-``, also a null id, which comes first in
its language; a null language is a tree of its own, before all others; rows
that share an id are ordered by their leaves, and equal rows have equal leaves
but proofs of their own places; empty and very long texts are texts as any;
further columns, whatever their names, are not read; an empty table gives no
rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm.common import discard, finished, job, placed, table, written

#: Children of a node.
FANOUT = 2
#: Nodes of a level up to which it stays in one task.
SMALL = 10_000
#: Parents whose proofs are sent to all tasks (some 2 kB each at most): so few that it takes as many shuffles a row at every size.
BROADCAST_PARENTS = 2_000
#: Trees whose places are sent to all tasks.
BROADCAST_TREES = 100_000
#: The fields of a leaf, in order.
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")

PATH = "array<struct<left:binary,right:binary>>"


def hexed(x: Column) -> Column:
    return F.lower(F.hex(x))


def digest(x: Column) -> Column:
    """Digests are kept as 32 bytes, and hashed as hex text."""
    return F.unhex(F.sha2(x.cast("binary"), 256))


def leaf(fields: list[Column]) -> Column:
    """Digest of the fields, each with its length in bytes, so that no two rows run together alike; null is ``-``."""

    def part(c: Column) -> Column:
        text = c.cast("string")
        return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))

    return digest(F.concat(*map(part, fields)))


@dataclass
class Level:
    """``runs(tree, up, size, kids)``: the children of each node above, and how many nodes the level above has."""

    runs: DataFrame
    parents: int


def levels(nodes: DataFrame, fanout: int = FANOUT) -> tuple[list[Level], DataFrame]:
    """The levels above ``nodes(tree, idx, size, hash, row)`` until each tree has one node, and ``(tree, hash, height)`` of those.

    What a lowest node stands for is its ``row``, which stays beside it.
    """
    found: list[Level] = []
    total = nodes.count()
    roots = nodes.where("size = 1").select("tree", "hash", F.lit(0).alias("height"))
    while True:
        rows = nodes.where("size > 1")
        if total <= SMALL:
            rows = rows.coalesce(1)  # so few that their shuffle costs more
        kids = F.array_sort(F.collect_list(F.struct("idx", "hash", *(["row"] if not found else []))))
        up = F.floor(F.col("idx") / fanout).cast("long") if fanout != 2 else F.shiftright("idx", 1)
        runs = written(rows.groupBy("tree", up.alias("up"), F.ceil(F.col("size") / fanout).cast("long").alias("size")).agg(kids.alias("kids")))
        parents = runs.count()
        if not parents:
            return found, roots
        found.append(Level(runs, parents))
        nodes = runs.select("tree", F.col("up").alias("idx"), "size", digest(F.array_join(F.transform("kids", lambda k: hexed(k["hash"])), "")).alias("hash"))
        roots = roots.unionByName(nodes.where("size = 1").select("tree", "hash", F.lit(len(found)).alias("height")))
        total = parents


def _siblings(kids: Column, place: Column) -> Column:
    """The digests before and after the child at ``place`` (from 0)."""
    joined = lambda x: F.aggregate(x, F.unhex(F.lit("")), lambda a, k: F.concat(a, k["hash"]))
    return F.struct(joined(F.slice(kids, 1, place)).alias("left"), joined(F.slice(kids, place + 2, F.size(kids))).alias("right"))


def paths(nodes: DataFrame, found: list[Level], tops: DataFrame) -> DataFrame:
    """``(tree, row, hash, path)`` of the lowest ``nodes``: the siblings of each level from below, and then ``tops(tree, height, path)``."""
    spark = nodes.sparkSession
    first = F.lit(0).cast("long").alias("idx")
    top = lambda height: tops.where(F.col("height") == height)
    above = top(len(found)).select("tree", first, "path")
    with job() as own:
        for height in range(len(found) - 1, -1, -1):
            level = found[height]
            kids = level.runs.select("tree", "up", "kids", F.posexplode("kids").alias("place", "kid"))
            kids = kids.select("tree", "up", "kid", _siblings(F.col("kids"), F.col("place")).alias("own"))
            parents = above.select("tree", F.col("idx").alias("up"), "path")
            if level.parents <= BROADCAST_PARENTS:
                kids, parents = kids.coalesce(1), F.broadcast(parents)
            rows = kids.join(parents, ["tree", "up"])
            path = F.concat(F.array("own"), "path").cast(PATH).alias("path")
            if height:
                above = written(rows.select("tree", "kid.idx", path).unionByName(top(height).select("tree", first, "path")))
                discard(spark, own, (own[-1],))
    alone = nodes.where("size = 1").join(top(0).select("tree", "path"), "tree").select("tree", "row", "hash", "path")
    return rows.select("tree", "kid.row", "kid.hash", path).unionByName(alone) if found else alone


def proof(path: Column) -> Column:
    """Digest of all siblings of a path, from the leaf to the root."""
    return digest(F.array_join(F.transform(path, lambda s: F.concat(hexed(s["left"]), hexed(s["right"]))), ""))


def folded(start: Column, path: Column) -> Column:
    """The root that a leaf and its siblings give."""
    return F.aggregate(path, start, lambda below, s: digest(F.concat(hexed(s["left"]), hexed(below), hexed(s["right"]))))


def manifest(rows: DataFrame, tree: str, order: str, fanout: int = FANOUT) -> tuple[DataFrame, DataFrame]:
    """``row, hash, subroot, root, path`` of ``rows`` (with ``hash``), and ``(tree's name, subroot)`` in order.

    Each value of the column ``tree`` is a tree, its leaves in the order of the
    column ``order``.  A tree is known by the place of its first row.
    """
    at = placed(rows, tree, order, "hash", name="__place")
    starts = written(at.groupBy(F.col(tree).alias("__name")).agg(F.min("__place").alias("tree"), F.count("*").alias("size")))
    n_trees = starts.count()
    side = F.broadcast(starts) if n_trees <= BROADCAST_TREES else starts
    nodes = at.join(side, F.col(tree).eqNullSafe(F.col("__name"))).select("tree", (F.col("__place") - F.col("tree")).alias("idx"), "size", "hash", F.struct(*rows.columns).alias("row"))
    found, roots = levels(nodes, fanout)
    roots = written(roots)
    # the subroots are a tree too, of one name
    tops = placed(roots, "tree", name="idx")
    above, last = levels(one := tops.select(F.lit(0).cast("long").alias("tree"), "idx", F.lit(n_trees).cast("long").alias("size"), "hash", F.struct("tree", "height").alias("row")), fanout)
    root = last.first()["hash"] if n_trees else b""
    up = paths(one, above, last.select("tree", "height", F.array().cast(PATH).alias("path")))
    tops = written(up.select("row.tree", "row.height", "path", F.col("hash").alias("subroot")))
    few = tops.select("tree", "subroot")
    low = paths(nodes, found, tops.select("tree", "height", "path"))
    out = low.join(F.broadcast(few) if n_trees <= BROADCAST_TREES else few, "tree").drop("tree").withColumn("root", F.lit(bytes(root)))
    return out, starts.join(few, "tree").orderBy("tree").select(F.col("__name").alias(tree), hexed(F.col("subroot")).alias("subroot"))


@finished
def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's leaf, subroot, root and proof, and the root that its proof gives for a row that may have been tampered with."""
    docs = table(spark, sf_dir, "documents").select(*FIELDS)
    fields = {c: F.col(c) for c in FIELDS}
    touched = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    changed = F.when(touched, leaf([*(fields | {"n_chars": F.col("n_chars") + 1}).values()]))
    rows = docs.select("doc_id", "lang", leaf([*fields.values()]).alias("hash"), changed.alias("changed"))
    out, _ = manifest(rows, "lang", "doc_id")
    again = folded(F.coalesce("row.changed", "hash"), F.col("path"))
    found = {"leaf": F.col("hash"), "subroot": F.col("subroot"), "root": F.col("root"), "proof_sha256": proof(F.col("path")), "folded_root": again}
    out = out.select("row.doc_id", *(hexed(x).alias(name) for name, x in found.items()))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


def oracle() -> str:
    """DuckDB SQL for the query: the levels of a tree are lists, and a row's siblings are taken from them."""
    part = lambda c: f"coalesce(strlen({c}::VARCHAR)::VARCHAR || ':' || {c}::VARCHAR, '-')"
    leaf_of = lambda n: f"sha256({' || '.join(part(n if c == 'n_chars' else c) for c in FIELDS)})"
    up = "list_transform(range(0, (len(nodes) + 1) // 2), lambda i: sha256(nodes[2 * i + 1] || coalesce(nodes[2 * i + 2], '')))"
    # DuckDB has no crc32: bit by bit over the id's decimal digits
    return f"""
WITH RECURSIVE d AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx
  FROM (SELECT doc_id, lang, {leaf_of('n_chars')} AS leaf, {leaf_of('(n_chars + 1)')} AS changed, row_number() OVER () AS r FROM documents)),
digits AS (SELECT r, doc_id::VARCHAR AS digits, 1 AS k, 4294967295 AS c FROM d WHERE doc_id IS NOT NULL),
crc AS (SELECT r, digits, k, c FROM digits UNION ALL
  SELECT r, digits, k + 1, list_reduce(list_prepend(xor(c, ascii(digits[k])::BIGINT), range(8)::BIGINT[]), lambda c, _: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)
  FROM crc WHERE k <= len(digits)),
touched AS (SELECT r FROM crc WHERE k = len(digits) + 1 AND xor(c, 4294967295) % 7 = 0),
t AS (SELECT lang, 0 AS h, list(leaf ORDER BY idx) AS nodes FROM d GROUP BY lang
  UNION ALL SELECT lang, h + 1, {up} FROM t WHERE len(nodes) > 1),
subroots AS (SELECT lang, nodes[1] AS subroot, h AS height, row_number() OVER (ORDER BY encode(lang) NULLS FIRST) - 1 AS idx FROM t WHERE len(nodes) = 1),
u AS (SELECT 0 AS h, list(subroot ORDER BY idx) AS nodes FROM subroots UNION ALL SELECT h + 1, {up} FROM u WHERE len(nodes) > 1),
steps AS (
  SELECT r, t.h, (d.idx >> t.h) & 1 AS side, coalesce(nodes[xor(d.idx >> t.h, 1) + 1], '') AS sibling FROM d JOIN t ON t.lang IS NOT DISTINCT FROM d.lang AND len(nodes) > 1
  UNION ALL
  SELECT r, s.height + u.h, (s.idx >> u.h) & 1, coalesce(nodes[xor(s.idx >> u.h, 1) + 1], '') FROM d JOIN subroots s ON s.lang IS NOT DISTINCT FROM d.lang JOIN u ON len(nodes) > 1),
p AS (SELECT r, sha256(string_agg(sibling, '' ORDER BY h)) AS proof_sha256 FROM steps GROUP BY r),
f AS (SELECT r, 0 AS h, CASE WHEN r IN (SELECT r FROM touched) THEN changed ELSE leaf END AS x FROM d
  UNION ALL SELECT f.r, f.h + 1, sha256(CASE WHEN side = 0 THEN x || sibling ELSE sibling || x END) FROM f JOIN steps s ON s.r = f.r AND s.h = f.h),
e AS (SELECT r, arg_max(x, h) AS folded_root FROM f GROUP BY r)
SELECT doc_id, leaf, subroot, (SELECT nodes[1] FROM u WHERE len(nodes) = 1) AS root, coalesce(proof_sha256, sha256('')) AS proof_sha256, folded_root,
  folded_root = (SELECT nodes[1] FROM u WHERE len(nodes) = 1) AS verified
FROM d JOIN subroots s ON s.lang IS NOT DISTINCT FROM d.lang LEFT JOIN p USING (r) JOIN e USING (r)
"""
