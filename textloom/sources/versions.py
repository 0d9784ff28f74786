"""Tables kept in parts, with versions: a save rewrites the parts it touches, and counts once its manifest is there.

A store is a folder.  Each save writes its parts' rows below ``data/<version>``
and then ``manifests/<version>``, which names the folder that holds each part;
that write is committed as a whole by Spark, with a success file at its end.
Readers take the newest committed manifest, so a save that fails at any point
leaves the store as it was, and a part that has become empty is simply not
named any more.  Two saves of one version can't both succeed.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

MANIFEST = "part int, folder string, parts int"


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the folder that driver and executors share, named by ``spark.checkpoint.dir``; a session on one machine may do without."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = "/tmp/checkpoints/textloom"
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def part_of(key: str, parts: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(parts)).cast("int")


def _names(spark: SparkSession, path: str) -> list[str]:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    return [s.getPath().getName() for s in fs.listStatus(at)] if fs.exists(at) else []


def _committed(spark: SparkSession, path: str) -> list[int]:
    return sorted(int(v) for v in _names(spark, f"{path}/manifests") if v.isdigit() and "_SUCCESS" in _names(spark, f"{path}/manifests/{v}"))


def current(spark: SparkSession, path: str) -> tuple[int, dict[int, str], int | None]:
    """The version, the folder of each of its parts, and the number of parts (none before the first save)."""
    versions = _committed(spark, path)
    if not versions:
        return 0, {}, None
    rows = spark.read.schema(MANIFEST).parquet(f"{path}/manifests/{versions[-1]}").collect()  # a row a part
    return versions[-1], {r.part: r.folder for r in rows if r.part >= 0}, rows[0].parts


def load(spark: SparkSession, path: str, table: str, schema: str, parts: Iterable[int] | None = None) -> DataFrame:
    """``table`` of the current version, or of some of its parts; no rows where there is none yet."""
    folders = current(spark, path)[1]
    wanted = [f"{folder}/{table}/part={p}" for p, folder in sorted(folders.items()) if parts is None or p in parts]
    return spark.read.schema(schema).parquet(*wanted) if wanted else spark.createDataFrame([], schema)


def save(spark: SparkSession, path: str, tables: dict[str, DataFrame | Callable[[DataFrame], DataFrame]], touched: Iterable[int], parts: int, options: dict[str, str] | None = None) -> None:
    """A new version in which ``tables`` (with a column ``part``) are all that the ``touched`` parts hold.

    The first table's rows tell which parts are still there; each table's rows
    of a part go to one folder.  A function makes its table of the first one, as
    that has been stored, part by part: each of its scan's tasks reads one part.
    """
    version, folders, _ = current(spark, path)
    touched = set(touched)
    folder = f"{path}/data/{version + 1}-{uuid.uuid4().hex}"
    stored = made = None
    for name, rows in tables.items():
        rows = rows if isinstance(rows, DataFrame) else rows(stored)
        rows.write.options(**options or {}).partitionBy("part").parquet(f"{folder}/{name}")
        if made is None:
            made = {int(n.removeprefix("part=")) for n in _names(spark, f"{folder}/{name}") if n.startswith("part=")}
            schema = T.StructType([f for f in rows.schema if f.name != "part"])
            each = [spark.read.schema(schema).parquet(f"{folder}/{name}/part={p}").withColumn("part", F.lit(p)) for p in sorted(made)]
            stored = reduce(DataFrame.unionByName, each or [spark.createDataFrame([], rows.schema)])
    kept = {p: f for p, f in folders.items() if p not in touched} | {p: folder for p in made}
    rows = [(p, f, parts) for p, f in sorted(kept.items())] or [(-1, "", parts)]
    spark.createDataFrame(rows, MANIFEST).coalesce(1).write.parquet(f"{path}/manifests/{version + 1}")


def vacuum(spark: SparkSession, path: str, keep: int = 1) -> None:
    """Deletes manifests but the newest ``keep``, and the data that none of these names; no save may be running."""
    versions = _committed(spark, path)
    held = {r.folder for v in versions[-keep:] for r in spark.read.schema(MANIFEST).parquet(f"{path}/manifests/{v}").collect()}
    fs = spark._jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark._jsc.hadoopConfiguration())
    old = [f"{path}/manifests/{v}" for v in versions[:-keep]] + [f"{path}/data/{d}" for d in _names(spark, f"{path}/data") if f"{path}/data/{d}" not in held]
    for p in old:
        fs.delete(spark._jvm.org.apache.hadoop.fs.Path(p), True)
