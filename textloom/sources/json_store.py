"""A folder of JSON files as a data source: a file an entry, read by file, written by two phases.

``spark.read.format("json_store").schema(...).load(path)`` gives a row for each
file's object, and ``name``, the file's own.  A filter on ``name`` is answered
by names: files that it excludes are not opened.  A file that can't be read as
an object is skipped; with the option ``badColumn`` it is a row whose column of
that name holds what was wrong, so that bad files can be counted.

A write puts each row's object in the file of its ``name``.  Tasks write beside
the store; the commit moves all files in, after all tasks have ended; a failed
write leaves none.  Files of the same name are replaced.

The path is one that the executors share and open as a folder.
"""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from datetime import date, datetime
from decimal import Decimal
from urllib.parse import quote, unquote

from pyspark.sql import Row
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualTo, Filter, In, InputPartition, StringStartsWith, WriterCommitMessage

ENDING = ".json"
#: Files of a partition.
FILES = 256


def local(path: str) -> str:
    return path.removeprefix("file://").rstrip("/")


def names(path: str) -> list[str]:
    """Names of the store's entries, sorted; hidden files and other endings are none."""
    if not os.path.isdir(local(path)):
        return []
    return sorted(unquote(e.name.removesuffix(ENDING)) for e in os.scandir(local(path)) if e.name.endswith(ENDING) and not e.name.startswith(".") and e.is_file())


def _file(path: str, name: str) -> str:
    return f"{local(path)}/{quote(name, safe=' ')}{ENDING}"


def as_type(value, kind: T.DataType):
    """A JSON value as a column's type; what doesn't fit is null."""
    if value is None:
        return None
    if isinstance(kind, T.StringType):
        return value if isinstance(value, str) else json.dumps(value, ensure_ascii=False)
    if isinstance(kind, T.BooleanType):
        return value if isinstance(value, bool) else None
    if isinstance(kind, T.IntegralType):
        return value if isinstance(value, int) and not isinstance(value, bool) and -(1 << 63) <= value < 1 << 63 else None
    if isinstance(kind, T.FractionalType):
        return float(value) if isinstance(value, int | float) and not isinstance(value, bool) else None
    if isinstance(kind, T.ArrayType):
        return [as_type(v, kind.elementType) for v in value] if isinstance(value, list) else None
    if isinstance(kind, T.MapType):
        return {k: as_type(v, kind.valueType) for k, v in value.items()} if isinstance(value, dict) else None
    if isinstance(kind, T.StructType):
        return tuple(as_type(value.get(f.name), f.dataType) for f in kind) if isinstance(value, dict) else None
    return None


def plain(value):
    """A row's value as JSON knows it."""
    if isinstance(value, Row):
        return {k: plain(v) for k, v in value.asDict().items()}
    if isinstance(value, dict):
        return {str(k): plain(v) for k, v in value.items()}
    if isinstance(value, list | tuple):
        return [plain(v) for v in value]
    if isinstance(value, datetime | date):
        return value.isoformat()
    if isinstance(value, Decimal):
        return float(value)
    if isinstance(value, bytes | bytearray):
        return value.hex()
    return value


@dataclass
class Files(InputPartition):
    names: list[str]


class Reader(DataSourceReader):
    def __init__(self, path: str, schema: T.StructType, bad: str | None):
        self.path, self.schema, self.bad = path, schema, bad
        self.names: set[str] | None = None
        self.prefixes: list[str] = []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            if isinstance(f, EqualTo | In | StringStartsWith) and f.attribute == ("name",):
                if isinstance(f, StringStartsWith):
                    self.prefixes.append(f.value)
                    continue
                wanted = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.names = wanted if self.names is None else self.names & wanted
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        # named ones are not looked for in the whole folder
        found = names(self.path) if self.names is None else sorted(n for n in self.names if n is not None and os.path.isfile(_file(self.path, n)))
        found = [n for n in found if all(map(n.startswith, self.prefixes))]
        return [Files(found[k : k + FILES]) for k in range(0, len(found), FILES)] or [Files([])]

    def read(self, partition: Files) -> Iterator[tuple]:
        for name in partition.names:
            wrong = None
            try:
                with open(_file(self.path, name), encoding="utf-8") as f:
                    value = json.load(f)
                if not isinstance(value, dict):
                    wrong = f"a {type(value).__name__}, no object"
            except (OSError, ValueError, RecursionError) as e:
                wrong = f"{type(e).__name__}: {e}"
            if wrong is None:
                value = value | {"name": name} | ({self.bad: None} if self.bad else {})
            elif self.bad:
                value = {"name": name, self.bad: wrong}
            else:
                continue
            yield tuple(as_type(value.get(f.name), f.dataType) for f in self.schema)


@dataclass
class Written(WriterCommitMessage):
    files: list[tuple[str, str]]


class Writer(DataSourceWriter):
    def __init__(self, path: str, schema: T.StructType, overwrite: bool):
        if "name" not in schema.names:
            raise ValueError("rows need a column `name`, their file's")
        self.path, self.overwrite, self.job = path, overwrite, f".writing-{uuid.uuid4().hex}"

    def write(self, rows: Iterator[Row]) -> Written:
        folder, done = f"{local(self.path)}/{self.job}", []
        os.makedirs(folder, exist_ok=True)
        for row in rows:
            value = plain(row)
            name = value.pop("name")
            if not name:
                raise ValueError("a row has no name")
            part = f"{folder}/{uuid.uuid4().hex}"
            with open(part, "w", encoding="utf-8") as f:
                json.dump(value, f, ensure_ascii=False)
            done.append((name, part))
        return Written(done)

    def commit(self, messages: list[Written | None]) -> None:
        kept = set()
        for name, part in (x for m in messages if m for x in m.files):
            os.replace(part, _file(self.path, name))
            kept.add(name)
        if self.overwrite:
            for name in set(names(self.path)) - kept:
                os.remove(_file(self.path, name))
        self._clean()

    def abort(self, messages: list[Written | None]) -> None:
        self._clean()

    def _clean(self) -> None:
        """Only this write's own folder goes."""
        folder = f"{local(self.path)}/{self.job}"
        if os.path.isdir(folder):
            for e in os.scandir(folder):
                os.remove(e.path)
            os.rmdir(folder)


class JsonStore(DataSource):
    @classmethod
    def name(cls) -> str:
        return "json_store"

    def schema(self) -> str:
        return "name string, value string"

    def reader(self, schema: T.StructType) -> Reader:
        return Reader(self.options["path"], schema, self.options.get("badcolumn") or self.options.get("badColumn"))

    def writer(self, schema: T.StructType, overwrite: bool) -> Writer:
        return Writer(self.options["path"], schema, overwrite)


def register(spark) -> None:
    """Makes ``json_store`` a format of the session, with filters given to its reader."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(JsonStore)
