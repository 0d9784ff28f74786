"""Readers and writers of the file formats that the operators meet."""

from __future__ import annotations

import io
import re
import zipfile
from xml.parsers import expat

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textloom.functions.names import fresh
from textloom.functions.text import java, strip


def json_objects(spark: SparkSession, path: str, schema: str, lines: bool = False) -> DataFrame:
    """Rows of JSON files in any folder below ``path``; what can't be read is left out."""
    reader = spark.read.schema(f"{schema}, _corrupt_record string").option("mode", "PERMISSIVE").option("recursiveFileLookup", "true").option("multiLine", str(not lines).lower())
    rows = reader.json(path)
    names = [c for c in rows.columns if c != "_corrupt_record"]
    bad = fresh("__bad", rows)
    return rows.withColumn(bad, F.col("_corrupt_record").isNotNull()).where(~F.col(bad)).select(*names)


def text_lines(spark: SparkSession, path: str) -> DataFrame:
    """``file, line_no, line``: whole files are read as lines, numbered from 1."""
    whole = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), "value")
    return whole.select("file", F.posexplode(F.split("value", "\n")).alias("p", "line")).select("file", (F.col("p") + 1).cast("long").alias("line_no"), "line").where("line <> ''")


def corpus_lines(spark: SparkSession, path: str, least: int = 40) -> DataFrame:
    """Stripped lines of more than ``least`` characters of the ``.txt`` and ``.md`` files below ``path``."""
    lines = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{txt,md}").text(path).select(strip(F.col("value")).alias("text"))
    return lines.where(F.length("text") > least)


def write_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def adopt(old: DataFrame, path: str) -> None:
    """A table from an older place, unless the new one is there."""
    old.write.mode("ignore").parquet(path)


def docx_text(data: bytes) -> str:
    """Text of a word-processor file, a line for each paragraph and break, white space and blank runs closed up; empty if it can't be read."""
    out: list[str] = []
    parser = expat.ParserCreate()
    parser.CharacterDataHandler = out.append
    parser.StartElementHandler = lambda name, _: out.append({"w:tab": "\t", "w:br": "\n"}.get(name, ""))
    parser.EndElementHandler = lambda name: out.append("\n" if name == "w:p" else "")
    try:
        with zipfile.ZipFile(io.BytesIO(data)) as z, z.open("word/document.xml") as f:
            parser.ParseFile(f)
    except (zipfile.BadZipFile, KeyError, OSError, expat.ExpatError):
        return ""
    text = re.sub(r"[ \t]+", " ", "".join(out))
    return re.sub(r"\n{3,}", "\n\n", text).strip()


@F.arrow_udf(T.StringType())
def docx_column(data: pa.Array) -> pa.Array:
    return pa.array([None if d is None else docx_text(d) for d in data.to_pylist()], pa.string())


def save_rows(df: DataFrame, path: str, day: str | None = None) -> None:
    """Appends to a table below ``path``; with ``day``, in a folder a day of that time column, so that later reads prune."""
    writer = df.withColumn("day", F.to_date(day)) if day else df
    w = writer.write.mode("append")
    (w.partitionBy("day") if day else w).parquet(path)


def load_rows(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A table that ``save_rows`` made; where there is none yet, no rows of ``schema``."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException:
        return spark.createDataFrame([], schema)


def clear(spark: SparkSession, path: str, schema: str) -> None:
    """No rows, and the schema kept."""
    spark.createDataFrame([], schema).write.mode("overwrite").parquet(path)


def file_text(spark: SparkSession, path: str, most: int = 20_000) -> DataFrame:
    """``path, text, truncated`` of text files, cut at ``most`` characters."""
    rows = spark.read.option("recursiveFileLookup", "true").text(path, wholetext=True)
    return rows.select(F.input_file_name().alias("path"), F.substring("value", 1, most).alias("text"), (F.length("value") > most).alias("truncated"))


def file_list(spark: SparkSession, path: str, most: int = 200) -> DataFrame:
    """``path, length`` of the first ``most`` files below ``path`` by name; hidden and build folders are skipped."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length")
    return rows.where(~F.col("path").rlike(java(r"/(\.git|node_modules|__pycache__|\.venv|dist|build)/"))).orderBy("path").limit(most)
