"""The library's functions under SQL names, and its table functions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from textloom.functions import kernels

#: SQL name, column function of one text, and its result.
FUNCTIONS: dict[str, Callable] = {"text_type": kernels.types, "compress_json": kernels.json_compressed, "compress_logs": kernels.logs_compressed, "compress_code": kernels.code_compressed, "compress_prose": kernels.prose_compressed, "page_text": kernels.page_text, "json_found": kernels.json_found}


@udtf(returnType="table_no int, headers array<string>, row map<string, string>")
class PageTables:
    """Rows of all tables of a page; a page that is null has none."""

    def eval(self, page: str):
        for t in kernels.tables(page or ""):
            for row in t["rows"]:
                yield t["table_no"], t["headers"], row


def register(spark: SparkSession, **more: Callable) -> list[str]:
    """Makes all functions, and ``more`` of one's own, known to SQL; gives their names.

    One's own are plain functions of one text.  What one raises becomes the
    text ``error: ...``, so that a bad row doesn't end a job.
    """
    for name, fn in FUNCTIONS.items():
        spark.udf.register(name, fn)
    for name, fn in more.items():
        spark.udf.register(name, _guarded(fn), "string")
    spark.udtf.register("page_tables", PageTables)
    return [*FUNCTIONS, *more, "page_tables"]


def _guarded(fn: Callable) -> Callable:
    def run(text):
        try:
            got = fn(text)
        except Exception as e:  # the caller's own code: any failure is the row's value
            return f"error: {e}"
        return None if got is None else str(got)

    return run
