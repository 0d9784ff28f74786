"""Chunks, BM25, cosine and hybrid search."""

from __future__ import annotations

from collections import Counter

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textloom.functions import fixed
from textloom.functions.text import chunks, cosine, strip, words
from textloom.sources import versions

#: Chunk frequencies of query terms are joined by broadcast up to this number of rows.
BROADCAST_TERMS = 100_000


def chunk_table(docs: DataFrame, target: int = fixed.CHUNK) -> DataFrame:
    """``doc_id, chunk_no, text`` for each chunk of ``docs(doc_id, text)``."""
    return docs.select("doc_id", F.posexplode(chunks(F.col("text"), target)).alias("chunk_no", "text"))


def query_terms(query: str) -> Counter[str]:
    """Terms of a query with their number: a repeated term counts as often."""
    import re

    return Counter(re.findall("[a-z0-9]{2,}", query.lower()))


def _idf(n: Column, df: Column) -> Column:
    return F.log((n - df + 0.5) / (df + 0.5) + 1)


def _equals(term: str):
    return lambda w: w == term


def bm25_scores(chunked: DataFrame, query: str) -> DataFrame:
    """``chunked`` with ``score``.

    Term counts are taken inside each row, so chunks are not shuffled: one
    aggregate gives a single row of counts, which is joined back by broadcast.
    """
    terms = query_terms(query)
    if not terms:
        return chunked.withColumn("score", F.lit(0.0))
    tf = {t: F.size(F.filter("words", _equals(t))) for t in terms}
    counted = chunked.withColumn("words", words(F.col("text"))).select(*chunked.columns, F.size("words").alias("n_words"), F.array(*tf.values()).alias("tf"))
    stats = counted.agg(F.count("*").alias("n_chunks"), F.avg("n_words").alias("avg_words"), F.array(*(F.count_if(F.get("tf", F.lit(i)) > 0) for i in range(len(terms)))).alias("df"))
    both = counted.crossJoin(F.broadcast(stats))  # one row
    score = F.lit(0.0)
    for i, times in enumerate(terms.values()):
        f = F.get("tf", F.lit(i))
        part = _idf(F.col("n_chunks"), F.get("df", F.lit(i))) * f * (fixed.K1 + 1) / (f + fixed.K1 * (1 - fixed.B + fixed.B * F.col("n_words") / F.col("avg_words")))
        score = score + F.when(f > 0, times * part).otherwise(0.0)
    return both.select(*chunked.columns, score.alias("score"))


def bm25_topk(chunked: DataFrame, query: str, k: int = 4) -> DataFrame:
    """The ``k`` best chunks with a score over 0; ties by document and chunk."""
    return bm25_scores(chunked, query).where("score > 0").orderBy(F.desc("score"), "doc_id", "chunk_no").limit(k)


def bm25_batch(chunked: DataFrame, queries: DataFrame, k: int = 4) -> DataFrame:
    """``query_id, doc_id, chunk_no, score, place``: the ``k`` best chunks for each row of ``queries(query_id, query)``.

    Only words that some query holds leave their rows.
    """
    asked = queries.select("query_id", F.explode(words(F.col("query"))).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("times"))
    counted = chunked.select("doc_id", "chunk_no", words(F.col("text")).alias("words"))
    stats = counted.agg(F.count("*").alias("n_chunks"), F.avg(F.size("words")).alias("avg_words"))
    terms = asked.select("term").distinct()
    small = terms.count() <= BROADCAST_TERMS
    hint = F.broadcast if small else (lambda df: df)
    held = counted.select("doc_id", "chunk_no", F.size("words").alias("n_words"), F.explode("words").alias("term")).join(hint(terms), "term", "left_semi")
    tf = held.groupBy("doc_id", "chunk_no", "n_words", "term").agg(F.count("*").alias("f"))
    df = tf.groupBy("term").agg(F.count("*").alias("df"))
    part = _idf(F.col("n_chunks"), F.col("df")) * F.col("f") * (fixed.K1 + 1) / (F.col("f") + fixed.K1 * (1 - fixed.B + fixed.B * F.col("n_words") / F.col("avg_words")))
    scored = tf.join(hint(df), "term").join(hint(asked), "term").crossJoin(F.broadcast(stats)).groupBy("query_id", "doc_id", "chunk_no").agg(F.sum(F.col("times") * part).alias("score"))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id", "chunk_no"))
    return scored.withColumn("place", place).where(F.col("place") <= k)


def cosine_topk(vectors: DataFrame, query: list[float], k: int = 4) -> DataFrame:
    to = F.array(*map(F.lit, map(float, query)))
    return vectors.withColumn("score", cosine(F.col("embedding"), to)).where("score > 0").orderBy(F.desc("score"), "vec_id").limit(k)


def hybrid_topk(chunked: DataFrame, query: str, vector: list[float], k: int = 4) -> DataFrame:
    """Half cosine, half BM25, each by its largest value; ``chunked`` has ``embedding`` and is known by document and chunk.

    Both scores are stored once, in a table without texts, for the largest
    values and the ranking; texts are read for the ``k`` best only.
    """
    cos = F.coalesce(cosine(F.col("embedding"), F.array(*map(F.lit, map(float, vector)))), F.lit(0.0))
    kinds = "doc_id bigint, chunk_no int, cos double, bm double"
    spark, path = chunked.sparkSession, versions.scratch(chunked.sparkSession, "scores")
    bm25_scores(chunked, query).select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("chunk_no").cast("int").alias("chunk_no"), cos.alias("cos"), F.col("score").alias("bm")).write.parquet(path)
    rows = spark.read.schema(kinds).parquet(path)
    top = rows.agg(F.max("cos").alias("cos"), F.max("bm").alias("bm")).first()
    by = lambda x, most: F.col(x) / F.lit(most) if most is not None and most > 0 else F.lit(0.0)
    best = rows.select("doc_id", "chunk_no", (0.5 * by("cos", top.cos) + 0.5 * by("bm", top.bm)).alias("score"))
    best = best.where("score > 0").orderBy(F.desc("score"), "doc_id", "chunk_no").limit(k)
    return chunked.join(F.broadcast(best), ["doc_id", "chunk_no"]).select(*chunked.columns, "score").orderBy(F.desc("score"), "doc_id", "chunk_no")


def search(chunked: DataFrame, query: str, vector: list[float] | None = None, k: int = 4) -> DataFrame:
    """Hybrid search where the query has a vector and some chunk an ``embedding`` of its length; BM25 alone otherwise."""
    if vector is None or "embedding" not in chunked.columns or chunked.where(F.size("embedding") == len(vector)).isEmpty():
        return bm25_topk(chunked, query, k)
    return hybrid_topk(chunked.withColumn("embedding", F.when(F.size("embedding") == len(vector), F.col("embedding"))), query, vector, k)


CHUNKS = "doc_id bigint, chunk_no int, text string"


def save_chunks(docs: DataFrame, path: str, parts: int = 64) -> None:
    """Chunks of ``docs(doc_id, text)`` put into the store below ``path`` in place of what it had under their ids.

    The store is cut by id; only parts that hold one of the ids are written
    again.  A null text leaves nothing under its id.  The store changes at once,
    when all is written (``versions``).
    """
    spark = docs.sparkSession
    parts = versions.current(spark, path)[2] or parts
    part = versions.part_of("doc_id", parts)
    touched = [r.part for r in docs.select(part.alias("part")).distinct().collect()]  # parts at most
    kept = delete_documents(versions.load(spark, path, "chunks", CHUNKS, touched), docs)
    rows = kept.unionByName(chunk_table(docs).select(kept.columns)).withColumn("part", part)
    versions.save(spark, path, {"chunks": rows}, touched, parts)


def drop_chunks(ids: DataFrame, path: str) -> None:
    """Takes the documents ``ids(doc_id)`` out of the store."""
    save_chunks(ids.select("doc_id", F.lit(None).cast("string").alias("text")), path)


def clear_chunks(spark: SparkSession, path: str) -> None:
    """A new version without any document."""
    _, folders, parts = versions.current(spark, path)
    if parts is not None:
        versions.save(spark, path, {"chunks": spark.createDataFrame([], f"{CHUNKS}, part int")}, folders, parts)


def load_chunks(spark: SparkSession, path: str) -> DataFrame:
    return versions.load(spark, path, "chunks", CHUNKS)


def list_documents(chunked: DataFrame) -> DataFrame:
    return chunked.groupBy("doc_id").agg(F.count("*").alias("n_chunks"))


def delete_documents(chunked: DataFrame, ids: DataFrame) -> DataFrame:
    return chunked.join(ids.select("doc_id"), "doc_id", "left_anti")


def replace_documents(chunked: DataFrame, docs: DataFrame) -> DataFrame:
    """All chunks of ``docs`` in place of what was stored under their ids."""
    return delete_documents(chunked, docs).unionByName(chunk_table(docs))


def context(hits: DataFrame) -> DataFrame:
    """One text of ranked hits: ``[document] chunk``, with a blank line between; ``hits`` is a top-k."""
    each = F.struct((-F.col("score")).alias("s"), "doc_id", "chunk_no", F.concat(F.lit("["), F.col("doc_id").cast("string"), F.lit("] "), F.col("text")).alias("line"))
    return hits.agg(F.array_join(F.transform(F.array_sort(F.collect_list(each)), lambda x: x["line"]), "\n\n").alias("context"))


def grep(docs: DataFrame, query: str, k: int = 50) -> DataFrame:
    """``doc_id, line_no, line`` (160 characters) of lines that hold ``query`` in any case, the first ``k``."""
    lines = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("p", "line"))
    hits = lines.where(F.lower("line").contains(query.lower()))
    return hits.select("doc_id", (F.col("p") + 1).cast("long").alias("line_no"), F.substring(strip(F.col("line")), 1, 160).alias("line")).orderBy("doc_id", "line_no").limit(k)
