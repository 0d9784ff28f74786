"""Streams run to their end over the tables, and files made of them; with their DuckDB SQL."""

from __future__ import annotations

import io
import re
import zipfile
from contextlib import contextmanager
from xml.sax.saxutils import escape

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textloom.functions import fixed, kernels
from textloom.operators import ingest
from textloom.plans.oracles import SQL as BATCH_SQL
from textloom.plans.queries import table
from textloom.sources import files, pdf
from textloom.sources.versions import scratch
from textloom.streaming import streams

#: A row this far ahead lets all windows before it end.
END = "2030-01-01"


def _replayed(rows: DataFrame) -> DataFrame:
    """The rows as a stream of files."""
    path = scratch(rows.sparkSession, "replayed")
    rows.write.parquet(path)
    return rows.sparkSession.readStream.schema(rows.schema).parquet(path)


def _drained(stream: DataFrame) -> DataFrame:
    """All that the stream tells, as a table."""
    spark, path = stream.sparkSession, scratch(stream.sparkSession, "drained")
    q = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", scratch(spark, "progress")).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)


@contextmanager
def _state_provider(spark: SparkSession):
    key = "spark.sql.streaming.stateStore.providerClass"
    old = spark.conf.get(key)
    spark.conf.set(key, streams.STATE_PROVIDER)
    try:
        yield
    finally:
        spark.conf.set(key, old)


def _events(spark: SparkSession, sf: str, *columns) -> DataFrame:
    return table(spark, sf, "events").select(F.col("ts").cast("timestamp").alias("ts"), *columns)


def stream_daily(spark, sf):
    value = F.floor(F.col("value") * 10).cast("long")
    rows = _events(spark, sf, value.alias("before"), (value - value % 7).alias("after"), (value % 7).alias("saved"))
    end = spark.sql(f"SELECT TIMESTAMP '{END}' AS ts, 0L AS before, 0L AS after, 0L AS saved")
    got = _drained(streams.daily_savings(_replayed(rows.unionByName(end)), "60 days"))
    return got.where(F.col("day") < END).withColumn("day", F.col("day").cast("string"))


def stream_rate_limit(spark, sf):
    rows = _events(spark, sf, F.col("user_id").alias("client"), "event_id")
    got = _drained(streams.rate_limited(_replayed(rows), 3, 86_400, "60 days"))
    return got.select("client", "event_id", "allowed", "retry_after")


def stream_sessions(spark, sf):
    rows = _events(spark, sf, "user_id", "event_id")
    end = spark.sql(f"SELECT TIMESTAMP '{END}' AS ts, -1L AS user_id, -1L AS event_id")
    got = _drained(streams.sessions(_replayed(rows.unionByName(end)), 24 * 60, "60 days"))
    return got.select("user_id", F.unix_micros("started").alias("started"), F.unix_micros("last_active").alias("last_active"), "n_events")


def stream_late_outputs(spark, sf):
    """Each event asks; every third is answered after some minutes, of these some too late; some answers come twice."""
    asked = _events(spark, sf, F.col("event_id").alias("request_id"), F.lit(1).cast("long").alias("output_tokens"))
    after = F.make_interval(mins=(F.col("request_id") % 90).cast("int"))
    told = asked.where("request_id % 3 = 0").select("request_id", (F.col("ts") + after).alias("answered_at"), (F.col("request_id") + 10).alias("output_tokens"))
    told = told.unionByName(told.where("request_id % 2 = 0"))
    end = spark.sql(f"SELECT TIMESTAMP '{END}' AS ts, -1L AS request_id, 0L AS output_tokens")
    last = end.select("request_id", F.col("ts").alias("answered_at"), "output_tokens")
    got = _drained(streams.late_outputs(_replayed(asked.unionByName(end)), _replayed(told.unionByName(last)), "1 hour", "60 days"))
    return got.where("request_id >= 0").select("request_id", "output_tokens")


def stream_originals(spark, sf):
    """Each event's text is stored by its first of its user's events, and asked for by all of them, for ten days."""
    rows = _events(spark, sf, F.col("user_id").cast("string").alias("id"), "event_id")
    first = rows.groupBy("id").agg(F.min("ts").alias("ts"))
    stores = first.select("id", F.lit("store").alias("op"), "ts", F.concat(F.lit("text of "), "id").alias("original"))
    asks = rows.select("id", F.lit("get").alias("op"), "ts", F.lit(None).cast("string").alias("original"))
    with _state_provider(spark):
        got = _drained(streams.originals(_replayed(stores.unionByName(asks)), 10 * 86_400, "60 days"))
    return got.where("op = 'get'").groupBy("id").agg(F.count("*").alias("n_asked"), F.count("original").alias("n_found"), F.max("original").alias("original"))


# --- files --------------------------------------------------------------------------


def _as_pdf(text: str) -> bytes:
    """A file with a page of the text, a line for each of its lines, packed, its characters in two bytes each."""
    import zlib

    lines = b"\n".join(b"<%s> Tj T*" % x.encode("utf-16-be", "ignore").hex().encode() for x in text.split("\n"))
    body = zlib.compress(b"BT /F1 9 Tf 12 TL 72 700 Td\n" + lines + b"\nET", 1)
    return (
        b"%%PDF-1.4\n1 0 obj\n<< /Type /Catalog /Pages 2 0 R >>\nendobj\n2 0 obj\n<< /Type /Pages /Kids [3 0 R] /Count 1 >>\nendobj\n"
        b"3 0 obj\n<< /Type /Page /Parent 2 0 R /Contents 5 0 R /Resources << /Font << /F1 4 0 R >> >> >>\nendobj\n4 0 obj\n<< /Type /Font /Subtype /Type0 /Encoding /Identity-H >>\nendobj\n"
        b"5 0 obj\n<< /Filter /FlateDecode /Length %d >>\nstream\n%s\nendstream\nendobj\ntrailer\n<< /Root 1 0 R >>\n%%%%EOF" % (len(body), body)
    )


@F.arrow_udf(T.BinaryType())
def _pdf_of(texts: pa.Array) -> pa.Array:
    return pa.array([None if t is None else _as_pdf(t) for t in texts.to_pylist()], pa.binary())


def pdf_texts(spark, sf):
    """Each document as a file, and what is read from it."""
    d = table(spark, sf, "documents").select("doc_id", pdf.pdf_column(_pdf_of("text")).alias("text"))
    return d.select("doc_id", F.length("text").cast("long").alias("n_chars"), F.md5("text").alias("digest"))


def _as_docx(text: str) -> bytes:
    """A word-processor file with a paragraph for each line; each word is a run of its own."""
    paragraphs = "".join("<w:p>" + "".join(f'<w:r><w:t xml:space="preserve">{escape(x)}</w:t></w:r>' for x in re.split("( )", line)) + "</w:p>" for line in text.split("\n"))
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED, compresslevel=1) as z:
        z.writestr(zipfile.ZipInfo("word/document.xml"), f'<?xml version="1.0" encoding="UTF-8"?><w:document xmlns:w="w"><w:body>{paragraphs}</w:body></w:document>')
    return out.getvalue()


@F.arrow_udf(T.BinaryType())
def _docx_of(texts: pa.Array) -> pa.Array:
    return pa.array([None if t is None else _as_docx(t) for t in texts.to_pylist()], pa.binary())


def docx_texts(spark, sf):
    """Each document as a word-processor file, and what is read from it; characters that XML can't hold are left out before."""
    text = F.regexp_replace("text", r"[\x00-\x08\x0B-\x1F]", "")
    d = table(spark, sf, "documents").select("doc_id", files.docx_column(_docx_of(text)).alias("text"))
    return d.select("doc_id", F.length("text").cast("long").alias("n_chars"), F.md5("text").alias("digest"))


def truncate_paragraphs(spark, sf):
    """Long lines of all documents cut to their first and last sentence, or to their start."""
    d = table(spark, sf, "documents").select("doc_id", kernels.paragraphs_truncated("text").alias("text"))
    return d.select("doc_id", F.length("text").cast("long").alias("n_chars"), F.md5("text").alias("digest"))


def watches_due(spark, sf):
    """A watch for each page, some never checked, some just then: those whose interval has passed."""
    p = table(spark, sf, "pages").select("page_id", ((F.col("page_id") % 4) * 30).cast("int").alias("interval_minutes"))
    checked = F.when(F.col("page_id") % 5 > 0, F.timestamp_seconds(F.lit(1_700_000_000) - (F.col("page_id") % 100) * 60))
    return ingest.watches_due(p.withColumn("last_checked", checked), F.timestamp_seconds(F.lit(1_700_000_000))).select("page_id")


QUERY_FUNCTIONS = {f.__name__: f for f in (stream_daily, stream_rate_limit, stream_sessions, stream_late_outputs, stream_originals, pdf_texts, docx_texts, truncate_paragraphs, watches_due)}
_LINES = "regexp_replace(regexp_replace(array_to_string(list_transform(string_split(text, chr(10)), lambda s: regexp_replace(regexp_replace(regexp_replace(s, '[ \\t\\xa0]+', ' ', 'g'), '^\\s+', ''), '\\s+$', '')), chr(10)), '\\n{3,}', chr(10) || chr(10), 'g'), '^\\s+|\\s+$', '', 'g')"
_SENTENCES = "string_split(regexp_replace(s, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1))"
_CUT = f"list_transform(string_split(text, chr(10)), lambda s: CASE WHEN length(s) <= {fixed.LONG_PARAGRAPH} THEN s WHEN len({_SENTENCES}) > 3 THEN ({_SENTENCES})[1] || ' [... ' || (len({_SENTENCES}) - 2) || ' sentences removed ...] ' || ({_SENTENCES})[-1] ELSE s[1:{fixed.LONG_PARAGRAPH}] || '[... ' || (length(s) - {fixed.LONG_PARAGRAPH}) || ' characters removed ...]' END)"
_KEPT = "regexp_replace(text, '[\\x00-\\x08\\x0B-\\x1F]', '', 'g')"
SQL = {
    "docx_texts": f"SELECT doc_id, length(t)::BIGINT AS n_chars, md5(t) AS digest FROM (SELECT doc_id, regexp_replace(regexp_replace(regexp_replace({_KEPT}, '[ \\t]+', ' ', 'g'), '\\n{{3,}}', chr(10) || chr(10), 'g'), '^\\s+|\\s+$', '', 'g') AS t FROM documents)",
    "truncate_paragraphs": f"SELECT doc_id, length(t)::BIGINT AS n_chars, md5(t) AS digest FROM (SELECT doc_id, array_to_string({_CUT}, chr(10)) AS t FROM documents)",
    "watches_due": "SELECT page_id FROM pages WHERE page_id % 5 = 0 OR (page_id % 100) * 60 >= greatest(1, (page_id % 4) * 30) * 60",
    "stream_daily": "SELECT strftime(ts, '%Y-%m-%d') AS day, sum(b)::BIGINT AS tokens_before, sum(b - b % 7)::BIGINT AS tokens_after, sum(b % 7)::BIGINT AS tokens_saved, count(*) AS requests FROM (SELECT ts, floor(value * 10)::BIGINT AS b FROM events) GROUP BY 1",
    "stream_rate_limit": BATCH_SQL["rate_limit_log"],
    "stream_sessions": f"SELECT user_id, started, last_active, n_events FROM ({BATCH_SQL['session_islands']})",
    "stream_late_outputs": "SELECT event_id AS request_id, CASE WHEN event_id % 3 = 0 AND event_id % 90 <= 60 THEN event_id + 10 ELSE 1 END::BIGINT AS output_tokens FROM events",
    "stream_originals": "WITH f AS (SELECT user_id, min(ts) AS first FROM events GROUP BY user_id) SELECT user_id::VARCHAR AS id, count(*) AS n_asked, count(*) FILTER (epoch_ms(ts) - epoch_ms(first) <= 864000000) AS n_found, 'text of ' || user_id AS original FROM events JOIN f USING (user_id) GROUP BY user_id",
    "pdf_texts": f"SELECT doc_id, length(t)::BIGINT AS n_chars, md5(t) AS digest FROM (SELECT doc_id, {_LINES} AS t FROM documents)",
}
