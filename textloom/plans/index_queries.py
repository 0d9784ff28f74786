"""Queries of stored indexes and stores, and their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.functions import kernels
from textloom.functions.json_paths import json_set, json_unset
from textloom.operators import dropping, ingest, postings, retrieval, text_index, training, vector_index
from textloom.plans.oracles import BM25, CHUNKS, MAIN_TEXT, ONE
from textloom.plans.queries import QUERY, _first_vector, table
from textloom.sources.versions import scratch, vacuum

#: Parts of the indexes that the queries build.
PARTS = 8
_built: dict[tuple[str, str, str], object] = {}


def built(spark: SparkSession, sf: str, name: str, make):
    """What ``make`` builds for a folder of tables, built once in a session."""
    key = spark.sparkContext.applicationId, sf, name
    if key not in _built:
        _built[key] = make()
    return _built[key]


def _words_index(spark: SparkSession, sf: str) -> str:
    def make() -> str:
        path = scratch(spark, "words")
        postings.put(table(spark, sf, "documents").select("doc_id", "text"), path, PARTS)
        return path

    return built(spark, sf, "words", make)


def _hits(rows: DataFrame) -> DataFrame:
    return rows.select("doc_id", F.col("chunk_no").cast("long").alias("chunk_no"), F.round("score", 4).alias("score"))


def bm25_indexed(spark, sf):
    return _hits(postings.Index(spark, _words_index(spark, sf)).topk(QUERY, 10))


def hybrid_indexed(spark, sf):
    vectors = table(spark, sf, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")
    return _hits(postings.Index(spark, _words_index(spark, sf)).hybrid(QUERY, vectors, _first_vector(spark, sf), 10))


def _altered(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """All documents, those put in place of some of them, and ids taken out."""
    d = table(spark, sf, "documents").select("doc_id", "text")
    new = d.where("doc_id % 10 = 0").select("doc_id", F.concat(F.lit("the erthat of "), "text").alias("text"))
    return d, new, d.where("doc_id % 10 = 1").select("doc_id")


def index_updated(spark, sf):
    """The index after a tenth of the documents was replaced, and another taken out; no older version is kept."""
    every, new, gone = _altered(spark, sf)
    path = scratch(spark, "updated")
    postings.put(every, path, PARTS)
    postings.put(new, path)
    vacuum(spark, path)
    postings.drop(gone, path)
    vacuum(spark, path)
    return _hits(postings.Index(spark, path).topk(QUERY, 10))


def stored_chunks(spark, sf):
    """The chunk store after the same changes."""
    every, new, gone = _altered(spark, sf)
    path = scratch(spark, "chunks")
    retrieval.save_chunks(every, path, PARTS)
    retrieval.save_chunks(new, path)
    retrieval.drop_chunks(gone, path)
    rows = retrieval.load_chunks(spark, path)
    return rows.select("doc_id", F.col("chunk_no").cast("long").alias("chunk_no"), F.md5("text").alias("digest"))


def _vectors_index(spark: SparkSession, sf: str) -> str:
    def make() -> str:
        path = scratch(spark, "vectors")
        vector_index.build(table(spark, sf, "embeddings"), path)
        return path

    return built(spark, sf, "vectors", make)


def cosine_indexed(spark, sf):
    """All lists: the answer of a scan."""
    rows = vector_index.search(table(spark, sf, "embeddings"), _vectors_index(spark, sf), _first_vector(spark, sf), 10)
    return rows.select("vec_id", F.round("score", 6).alias("score"))


def cosine_probed(spark, sf):
    """48 of 64 lists: the table's vectors lie in no clusters, so fewer find less than 0.95 of the best ten."""
    rows = vector_index.search(table(spark, sf, "embeddings"), _vectors_index(spark, sf), _first_vector(spark, sf), 10, probes=48)
    return rows.select("vec_id", F.round("score", 6).alias("score"))


def word_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """``doc_id, original, compressed, held_out``: messages with phrases and fillers around them, and what the rules for prose make of them."""
    c = table(spark, sf, "conversations").select(F.concat_ws("/", "conv_id", "turn").alias("doc_id"), "text")
    wordy = F.concat(F.lit("Basically, in order to read this, it is able to wait. "), "text", F.lit(" As you know, due to the fact that it is very long, it is really important to note that we stop."))
    return c.select("doc_id", wordy.alias("original"), (F.crc32("doc_id") % 5 == 0).alias("held_out")).withColumn("compressed", kernels.prose_compressed("original"))


def word_dropping_learned(spark, sf):
    """Labels of all messages by weights that four fifths of them have taught."""
    pairs = word_pairs(spark, sf)
    path = scratch(spark, "labelled")
    training.label_words(pairs).join(pairs.select("doc_id", "held_out"), "doc_id").write.parquet(path)
    rows = spark.read.parquet(path)
    out = dropping.predicted(rows, dropping.fit(rows.where("NOT held_out")))
    ones = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda a, x: a + x)
    right = F.size(F.filter(F.arrays_zip("labels", "predicted"), lambda x: x["labels"] == x["predicted"])).cast("long")
    return out.select("doc_id", "held_out", F.size("words").cast("long").alias("n_words"), ones("labels").alias("n_kept"), ones("predicted").alias("n_predicted"), right.alias("n_right"))


def grep_indexed(spark, sf):
    def make() -> str:
        path = scratch(spark, "substrings")
        text_index.build(table(spark, sf, "documents"), path)
        return path

    return text_index.search(spark, built(spark, sf, "substrings", make), "license", 50)


def json_documents(spark: SparkSession, sf: str) -> DataFrame:
    """``event_id, body``: an event's settings: nested, flat, without any, with another value on the way, and no JSON object."""
    e = table(spark, sf, "events").select("event_id", "props")
    kind = F.col("event_id") % 5
    nested = F.concat(F.lit('{"env":{"url":"old","props":'), "props", F.lit('},"n":'), F.col("event_id").cast("string"), F.lit("}"))
    same = F.lit('{"env":{"url":"new"},"keep":[1,{"x":null}]}')
    body = F.when(kind == 0, nested).when(kind == 1, same).when(kind == 2, F.col("props")).when(kind == 3, '{"env":"text","z":1}').otherwise("[1, 2]")
    return e.select("event_id", body.alias("body"))


def json_paths(spark, sf):
    """A value set at a path, and another taken out."""
    rows = json_documents(spark, sf).select("event_id", json_set(F.col("body"), ("env", "url"), F.lit('"new"')).alias("s"), json_unset(F.col("body"), ("env", "url")).alias("u"))
    at = lambda c, p: F.get_json_object(c, p)
    return rows.select(
        "event_id", F.col("s.changed").alias("set_changed"), at("s.body", "$.env.url").alias("url"), at("s.body", "$.env.props.k").alias("k"), at("s.body", "$.n").alias("n"), at("s.body", "$.z").alias("z"),
        F.col("u.changed").alias("unset_changed"), at("u.body", "$.env.url").alias("url_left"), at("u.body", "$.env.props.k").alias("k_left"),
    )


#: Places that a page of the made web links to: a number times its own, plus one.
STEPS = (2, 3, 5)


def crawl_pages(spark, sf):
    """The pages as a web of one host: each links to three others, besides what it links to itself."""
    p = table(spark, sf, "pages").select("page_id", "html")
    n = p.agg(F.count("*").alias("n"))
    own = [F.concat(F.lit('<a href="/p'), ((F.col("page_id") * k + 1) % F.col("n")).cast("string"), F.lit('">x</a>')) for k in STEPS]
    web = p.crossJoin(F.broadcast(n)).select("page_id", F.concat(F.lit("https://web.example/p"), F.col("page_id").cast("string")).alias("url"), F.concat("html", F.lit("<nav>"), *own, F.lit("</nav>")).alias("html"))
    got = ingest.crawl(web, "https://web.example/p1#top", 25, 4, ("/p7",))
    return got.select("url", F.col("depth").cast("long").alias("depth"), F.length("text").cast("long").alias("n_chars"))


def watch_round(spark, sf):
    """A watch for each page, checked twice: every third page has changed by then, every seventh can't be fetched."""
    p = table(spark, sf, "pages").select(F.col("page_id"), F.concat(F.lit("https://web.example/p"), F.col("page_id").cast("string")).alias("url"), "html")
    none = spark.createDataFrame([], ingest.WATCH)
    first = p.select("url", F.timestamp_seconds(F.lit(1000)).alias("fetched_at"), F.col("html").alias("content"))
    content = F.when(F.col("page_id") % 7 == 0, None).when(F.col("page_id") % 3 == 0, F.concat("html", F.lit("!"))).otherwise(F.col("html"))
    second = p.select("url", F.timestamp_seconds(F.lit(5000)).alias("fetched_at"), content.alias("content"))
    watches = ingest.watches_added(none, p.select("url", (F.col("page_id") % 3).alias("interval_minutes"), F.lit(None).cast("string").alias("notify_url")))
    watches, _ = ingest.watches_checked(watches, first)
    watches, told = ingest.watches_checked(watches, second)
    rows = watches.join(told.select("id", "status"), "id")
    return rows.select("url", F.col("interval_minutes").cast("long").alias("interval_minutes"), "status", "last_hash", F.unix_seconds("last_changed").alias("last_changed"))


_ALTERED = "altered AS (SELECT doc_id, CASE WHEN doc_id % 10 = 0 THEN 'the erthat of ' || text ELSE text END AS text FROM documents WHERE doc_id % 10 <> 1),"
_TOP = "SELECT doc_id, chunk_no, round(score, 4) AS score FROM (SELECT * FROM scored WHERE score > 0 ORDER BY score DESC, doc_id, chunk_no LIMIT 10)"


def _in(text: str) -> str:
    return text.replace("FROM documents", "FROM altered")


QUERY_FUNCTIONS = {f.__name__: f for f in (bm25_indexed, hybrid_indexed, index_updated, stored_chunks, cosine_indexed, cosine_probed, word_dropping_learned, grep_indexed, json_paths, crawl_pages, watch_round)}
_BODY = """CASE event_id % 5 WHEN 0 THEN '{"env":{"url":"old","props":' || props || '},"n":' || event_id || '}' WHEN 1 THEN '{"env":{"url":"new"},"keep":[1,{"x":null}]}' WHEN 2 THEN props WHEN 3 THEN '{"env":"text","z":1}' ELSE '[1, 2]' END"""
_NEXT = ", ".join(f"{{'position': {i}, 'dst': (page_id * {k} + 1) % n}}" for i, k in enumerate(STEPS))
SQL = {
    # a merge with {"env": {"url": ...}} sets what isn't an object on the way, and null takes out
    "json_paths": f"""WITH b AS (SELECT event_id, {_BODY} AS body FROM events), s AS (SELECT event_id, body, CASE WHEN json_type(body) = 'OBJECT' THEN json_merge_patch(body::JSON, '{{"env":{{"url":"new"}}}}'::JSON)::VARCHAR ELSE body END AS put,
  CASE WHEN json_extract(body, '$.env.url') IS NOT NULL THEN json_merge_patch(body::JSON, '{{"env":{{"url":null}}}}'::JSON)::VARCHAR ELSE body END AS out FROM b)
SELECT event_id, json_type(body) = 'OBJECT' AND coalesce(json_extract_string(body, '$.env.url'), '') <> 'new' AS set_changed, json_extract_string(put, '$.env.url') AS url, json_extract_string(put, '$.env.props.k') AS k, json_extract_string(put, '$.n') AS n, json_extract_string(put, '$.z') AS z,
  json_extract(body, '$.env.url') IS NOT NULL AS unset_changed, json_extract_string(out, '$.env.url') AS url_left, json_extract_string(out, '$.env.props.k') AS k_left FROM s""",
    "crawl_pages": f"""WITH RECURSIVE n AS (SELECT count(*) AS n FROM pages), t AS (SELECT page_id, {MAIN_TEXT} AS text FROM (SELECT page_id, html || '<nav></nav>' AS html FROM pages)),
e AS (SELECT page_id AS src, x.position AS position, x.dst AS dst FROM (SELECT page_id, unnest([{_NEXT}]) AS x FROM pages, n)),
w AS (SELECT page_id AS node, 0 AS depth, [0] AS place FROM pages WHERE page_id = 1 UNION ALL SELECT dst, depth + 1, list_append(place, position) FROM w JOIN e ON src = node JOIN pages ON page_id = dst WHERE depth < 4 AND NOT starts_with(dst::VARCHAR, '7')),
f AS (SELECT node, min({{'depth': depth, 'place': place}}) AS x FROM w GROUP BY node)
SELECT 'https://web.example/p' || node AS url, x.depth::BIGINT AS depth, length(text)::BIGINT AS n_chars FROM f JOIN t ON page_id = node WHERE length(text) > 50 ORDER BY x.depth, x.place LIMIT 25""",
    "watch_round": """SELECT 'https://web.example/p' || page_id AS url, greatest(1, page_id % 3)::BIGINT AS interval_minutes, CASE WHEN page_id % 7 = 0 THEN 'failed' WHEN page_id % 3 = 0 THEN 'changed' ELSE 'same' END AS status,
sha256(CASE WHEN page_id % 7 <> 0 AND page_id % 3 = 0 THEN html || '!' ELSE html END) AS last_hash, CASE WHEN page_id % 7 <> 0 AND page_id % 3 = 0 THEN 5000 END::BIGINT AS last_changed FROM pages""",
    "bm25_indexed": f"{ONE} {BM25} {_TOP}",
    "index_updated": f"{ONE} {_ALTERED} {_in(BM25)} {_TOP}",
    "stored_chunks": f"WITH {_ALTERED} {_in(CHUNKS)} SELECT doc_id, chunk_no, md5(text) AS digest FROM chunks",
}
