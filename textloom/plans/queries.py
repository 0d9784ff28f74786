"""A query for each operator, over whole tables; inputs that the tables lack are derived from them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textloom.functions import fixed
from textloom.functions import kernels
from textloom.functions.text import client_name, invisible, is_code, is_logs, language, scan, strip, tokens
from textloom.operators import compress, conversations, govern, ingest, ledger, requests, retrieval, training

QUERY = "the erthat of the reanonsh"
QUERIES = ((1, "the erthat of the"), (2, "ciónosas la de"), (3, "einer der ungsch"), (4, "le que treaux"))
NOW = "2024-01-31 00:00:00"


#: Tables of texts, on which most of the work is done where their rows lie.
TEXTS = ("documents", "pages", "conversations")


def spread(rows: DataFrame) -> DataFrame:
    """``rows`` dealt to all cores where their files give fewer tasks than that: a file of one row group is one task."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(cores) if rows.rdd.getNumPartitions() < cores else rows


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(rows) if name in TEXTS else rows


# --- derived inputs ---------------------------------------------------------


def ledger_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Events as ledger rows."""
    e = table(spark, sf, "events")
    before = F.floor(F.col("value") * 10).cast("long")
    provider = F.when(F.col("user_id") % 3 == 0, "").otherwise(F.concat(F.lit("p"), (F.col("user_id") % 5).cast("string")))
    model = F.when(F.col("user_id") % 4 == 0, "").otherwise(F.concat(F.lit("m"), (F.col("user_id") % 7).cast("string")))
    return ledger.rows(e.select("ts", F.col("event_type").alias("tool"), provider.alias("provider"), model.alias("model"), before.alias("before"), (before - before % 7).alias("after"), (before % 7).alias("saved"), F.lit(1).alias("blocks"), F.floor("value").alias("output_tokens"), (F.col("user_id") % 3 - 1).alias("shaped")))


def log_blocks(spark: SparkSession, sf: str) -> DataFrame:
    """``block, text``: a user's events as log lines, a frame line after each purchase."""
    e = table(spark, sf, "events")
    level = F.when(F.col("event_type") == "error", "ERROR").otherwise("INFO")
    line = F.concat_ws(" ", F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), level, "event_type")
    line = F.when(F.col("event_type") == "purchase", F.concat(line, F.lit("\n    at step "), F.col("event_id").cast("string"))).otherwise(line)
    ordered = F.array_sort(F.collect_list(F.struct("ts", "event_id", line.alias("line"))))
    return e.groupBy(F.col("user_id").alias("block")).agg(F.array_join(F.transform(ordered, lambda x: x["line"]), "\n").alias("text"))


def json_blocks(spark: SparkSession, sf: str) -> DataFrame:
    """``block, items, text``: a customer's orders as a JSON array."""
    o = table(spark, sf, "orders")
    items = F.array_sort(F.collect_list(F.struct(F.col("o_orderkey"), F.col("o_orderstatus"), F.col("o_orderpriority"))))
    return o.groupBy(F.col("o_custkey").alias("block")).agg(items.alias("items")).withColumn("text", F.to_json("items"))


def code_blocks(spark: SparkSession, sf: str) -> DataFrame:
    """``block, text``: a Python source for each brand of parts."""
    p = table(spark, sf, "part")
    head = "\n".join(["import os", "import sys", "import json", "import re", "", "# parts of a brand"])
    line = F.concat(F.lit("def part_"), F.col("p_partkey").cast("string"), F.lit("():  # "), F.col("p_type"), F.lit("\n    return "), F.col("p_size").cast("string"), F.lit("\n"))
    ordered = F.array_sort(F.collect_list(F.struct("p_partkey", line.alias("line"))))
    return p.groupBy(F.col("p_brand").alias("block")).agg(F.concat(F.lit(head + "\n"), F.array_join(F.transform(ordered, lambda x: x["line"]), "\n")).alias("text"))


def verbose_docs(spark: SparkSession, sf: str) -> DataFrame:
    """``doc_id, text``: documents with phrases and fillers around them."""
    d = table(spark, sf, "documents")
    return d.select("doc_id", F.concat(F.lit("Basically, in order to read this, it is able to wait. "), F.col("text"), F.lit("\nas you know, due to the fact that it is very long , stop.")).alias("text"))


def secret_docs(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents")
    key = F.concat(F.lit("sk" + "-"), F.md5(F.col("doc_id").cast("string")))
    return d.select("doc_id", F.concat("text", F.lit(" key "), key, F.lit(" mail a.b@example.org host 10.0.0.1")).alias("text"))


def hidden_docs(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents")
    head = "a" + chr(0x200B) + "b" + chr(0x202E) + "c" + chr(0xA0) + "d" + chr(0xFE01) + "e"
    return d.select("doc_id", F.concat(F.lit(head), "text", F.lit(chr(0x2060))).alias("text"))


def page_versions(spark: SparkSession, sf: str) -> DataFrame:
    """Three fetches of each page; every third page changes at the second or third."""
    p = table(spark, sf, "pages")
    v = F.explode(F.sequence(F.lit(1), F.lit(3))).alias("version")
    rows = p.select("page_id", F.concat("url", F.lit("#"), F.col("page_id").cast("string")).alias("url"), "html", v)
    changed = (F.col("version") > F.col("page_id") % 3 + 1) & (F.col("page_id") % 3 > 0)
    return rows.select("page_id", "url", F.timestamp_seconds(F.col("version") * 1000).alias("fetched_at"), F.concat("html", F.when(changed, "!").otherwise("")).alias("content"))


def table_pages(spark: SparkSession, sf: str) -> DataFrame:
    """A page for each region with a table of its nations."""
    n = table(spark, sf, "nation")
    row = F.concat(F.lit("<tr><td>"), F.col("n_nationkey").cast("string"), F.lit("</td><td> "), F.col("n_name"), F.lit("</td></tr>"))
    ordered = F.array_sort(F.collect_list(F.struct("n_nationkey", row.alias("row"))))
    return n.groupBy(F.col("n_regionkey").cast("long").alias("page_id")).agg(F.concat(F.lit("<table><tr><th>key</th><th>name</th></tr>"), F.array_join(F.transform(ordered, lambda x: x["row"]), ""), F.lit("</table>")).alias("html"))


def request_rows(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    agent = F.element_at(F.array(*map(F.lit, ("curl/8.1", "Cursor/1.2 (x)", "python-httpx/0.28", "MyTool/2.0 linux", ""))), (F.col("event_id") % 5 + 1).cast("int"))
    return e.select("event_id", agent.alias("agent"), F.concat(F.lit("Model-"), F.col("event_type")).alias("model"), F.col("props").alias("text"), F.col("user_id"), "ts")


def originals(spark: SparkSession, sf: str) -> DataFrame:
    """``id, original, compressed, stored_at`` from conversations."""
    c = table(spark, sf, "conversations")
    return c.select(F.concat_ws("/", F.col("conv_id"), F.col("turn")).alias("id"), F.coalesce("text", F.lit("")).alias("original"), F.substring(F.coalesce("text", F.lit("")), 1, 40).alias("compressed"), F.timestamp_seconds(F.lit(1_700_000_000) + F.col("turn") * 20_000).alias("stored_at"))


CCR_NOW = "2023-11-16 02:00:00"

# --- queries ----------------------------------------------------------------


def bm25_topk(spark, sf):
    hits = retrieval.bm25_topk(retrieval.chunk_table(table(spark, sf, "documents")), QUERY, 10)
    return hits.select("doc_id", F.col("chunk_no").cast("long").alias("chunk_no"), F.round("score", 4).alias("score"))


def bm25_batch(spark, sf):
    asked = spark.createDataFrame(list(QUERIES), "query_id int, query string")
    hits = retrieval.bm25_batch(retrieval.chunk_table(table(spark, sf, "documents")), asked, 5)
    return hits.select("query_id", F.col("place").cast("long").alias("place"), F.round("score", 4).alias("score"))


def rag_chunks(spark, sf):
    c = retrieval.chunk_table(table(spark, sf, "documents"))
    return c.select("doc_id", F.col("chunk_no").cast("long").alias("chunk_no"), F.md5("text").alias("digest"), F.length("text").cast("long").alias("n_chars"))


def list_documents(spark, sf):
    return retrieval.list_documents(retrieval.chunk_table(table(spark, sf, "documents")))


def replace_document(spark, sf):
    d = table(spark, sf, "documents")
    new = d.where("doc_id % 10 = 0").select("doc_id", F.lit("replaced text").alias("text")).dropDuplicates()
    return retrieval.list_documents(retrieval.replace_documents(retrieval.chunk_table(d), new))


def rag_context(spark, sf):
    return retrieval.context(retrieval.bm25_topk(retrieval.chunk_table(table(spark, sf, "documents")), QUERY, 3)).select(F.md5("context").alias("digest"), F.length("context").cast("long").alias("n_chars"))


def _first_vector(spark, sf) -> list[float]:
    row = table(spark, sf, "embeddings").where("vec_id = 0").select("embedding").first()  # one row
    return [float(x) for x in row[0]]


def cosine_topk(spark, sf):
    hits = retrieval.cosine_topk(table(spark, sf, "embeddings"), _first_vector(spark, sf), 10)
    return hits.select("vec_id", F.round("score", 6).alias("score"))


def hybrid_topk(spark, sf):
    vectors = table(spark, sf, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")
    both = retrieval.chunk_table(table(spark, sf, "documents")).join(vectors, "doc_id", "left")
    hits = retrieval.search(both, QUERY, _first_vector(spark, sf), 10)
    return hits.select("doc_id", F.col("chunk_no").cast("long").alias("chunk_no"), F.round("score", 4).alias("score"))


def search_fallback(spark, sf):
    """No chunk has a vector: words alone."""
    rows = retrieval.chunk_table(table(spark, sf, "documents")).withColumn("embedding", F.lit(None).cast("array<float>"))
    hits = retrieval.search(rows, QUERY, [1.0, 0.0], 10)
    return hits.select("doc_id", F.col("chunk_no").cast("long").alias("chunk_no"), F.round("score", 4).alias("score"))


def grep_lines(spark, sf):
    return retrieval.grep(table(spark, sf, "documents"), "license", 50)


def ledger_totals(spark, sf):
    return ledger.totals(ledger_rows(spark, sf), F.lit("2024-01-10 00:00:00").cast("timestamp")).drop("first_ts")


def ledger_daily(spark, sf):
    return ledger.daily(ledger_rows(spark, sf), "2024-02-02", 40).withColumn("day", F.col("day").cast("string"))


def _by(dimension):
    return lambda spark, sf: ledger.breakdown(ledger_rows(spark, sf), dimension)


def ledger_breakdowns(spark, sf):
    return ledger.breakdowns(ledger_rows(spark, sf))


def ledger_prune(spark, sf):
    return ledger.prune(ledger_rows(spark, sf), NOW, 15).agg(F.count("*").alias("n"), F.sum("saved").alias("tokens_saved"))


def output_effect(spark, sf):
    e = ledger.effect(ledger_rows(spark, sf))
    return e.select("n_s", "n_c", *(F.round(c, 4).alias(c) for c in ("mean_s", "mean_c", "difference", "margin")), "verdict")


def late_output_tokens(spark, sf):
    e = table(spark, sf, "events")
    rows = e.select(F.col("event_id").alias("request_id"), F.lit(0).cast("long").alias("output_tokens"))
    late = e.where("event_type = 'purchase'").select(F.col("event_id").alias("request_id"), F.floor("value").cast("long").alias("output_tokens"))
    return ledger.fill_output(rows, late)


def token_estimate(spark, sf):
    d = table(spark, sf, "documents")
    return d.groupBy("lang").agg(F.sum(tokens(F.col("text"))).alias("n_tokens"), F.count("*").alias("n"))


def _all_blocks(spark, sf):
    sets = (("json", json_blocks), ("logs", log_blocks), ("code", code_blocks))
    out = table(spark, sf, "documents").select(F.lit("text").alias("made_as"), F.concat(F.lit("text/"), F.col("doc_id").cast("string")).alias("id"), "text")
    for name, make in sets:
        out = out.unionByName(make(spark, sf).select(F.lit(name).alias("made_as"), F.concat(F.lit(f"{name}/"), F.col("block").cast("string")).alias("id"), "text"))
    return out


def type_counts(spark, sf):
    return compress.with_type(_all_blocks(spark, sf)).groupBy("made_as", "type").agg(F.count("*").alias("n"))


def log_code_rules(spark, sf):
    rows = _all_blocks(spark, sf)
    return rows.select("id", is_logs(F.col("text")).alias("is_logs"), is_code(F.col("text")).alias("is_code"))


def code_language(spark, sf):
    return code_blocks(spark, sf).select("block", language(F.col("text")).alias("language"))


def compress_corpus(spark, sf):
    rows = compress.compress_blocks(_all_blocks(spark, sf))
    return compress.savings(rows, "type")


def log_triage(spark, sf):
    rows = compress.compress_blocks(log_blocks(spark, sf), F.lit("logs"))
    return rows.select("block", F.md5("compressed").alias("digest"), F.length("compressed").cast("long").alias("n_chars"))


def json_csv_schema(spark, sf):
    rows = json_blocks(spark, sf)
    return compress.compress_blocks(rows, F.lit("json")).select("block", F.col("compressed").alias("text"))


def json_shrink(spark, sf):
    e = table(spark, sf, "events").select(F.col("event_id").alias("block"), F.to_json(F.struct("event_id", "event_type", F.struct(F.col("props").alias("props"), F.lit("x").alias("type"), F.lit("").alias("none")).alias("inner"), F.array().cast("array<string>").alias("empty"))).alias("text"))
    return compress.compress_blocks(e, F.lit("json")).select("block", F.col("compressed").alias("text"))


def code_compress(spark, sf):
    return compress.compress_blocks(code_blocks(spark, sf), F.lit("code")).select("block", F.col("compressed").alias("text"))


def prose_compress(spark, sf):
    rows = compress.compress_blocks(verbose_docs(spark, sf), F.lit("text"))
    return rows.select("doc_id", F.length("text").cast("long").alias("chars_before"), F.length("compressed").cast("long").alias("chars_after"), F.md5("compressed").alias("digest"))


def dedupe_lines(spark, sf):
    return compress.dedupe_lines(table(spark, sf, "documents")).select("doc_id", F.md5("text").alias("digest"), F.length("text").cast("long").alias("n_chars"))


def invisible_clean(spark, sf):
    rows = hidden_docs(spark, sf).select("doc_id", kernels.cleaning(strip_nbsp=True)("text").alias("x"))
    return rows.select("doc_id", F.md5("x.text").alias("digest"), "x.invisible", "x.bidi", "x.smuggled", "x.nbsp")


def mixed_script(spark, sf):
    from textloom.functions.kernels import mixed_scripts

    d = table(spark, sf, "documents").select("doc_id", F.concat(F.lit("p" + chr(0x430) + "ypal and " + chr(0xAA) + "1 "), "text").alias("text"))
    return d.select("doc_id", F.array_join(F.slice(mixed_scripts("text"), 1, 10), " ").alias("words"))


def align_messages(spark, sf):
    rows = compress.align_messages(table(spark, sf, "conversations"))
    return rows.select("conv_id", "turn", "role", "position", F.md5("text").alias("digest"))


def shape_last_user(spark, sf):
    rows = compress.shape_messages(table(spark, sf, "conversations"))
    return rows.select("conv_id", "turn", "shaped", tokens(F.col("text")).alias("n_tokens"))


def compress_messages(spark, sf):
    rows = compress.compress_messages(compress.align_messages(table(spark, sf, "conversations")))
    return compress.savings(rows, "role")


def ccr_stats(spark, sf):
    return compress.store_stats(originals(spark, sf), CCR_NOW)


def ccr_cleanup(spark, sf):
    return compress.cleanup(originals(spark, sf), CCR_NOW).select("id")


def ccr_retrieve(spark, sf):
    wanted = originals(spark, sf).where("id like '%/0' or id like '%/3'").select("id")
    return compress.retrieve(originals(spark, sf), wanted, CCR_NOW).select("id", F.length("original").cast("long").alias("n_chars"))


def redact_counts(spark, sf):
    return govern.redaction_counts(secret_docs(spark, sf), pii=True)


def redact_text(spark, sf):
    return govern.redacted(secret_docs(spark, sf), pii=True).select("doc_id", F.md5("text").alias("digest"))


def policy_check(spark, sf):
    rows = govern.check_policy(request_rows(spark, sf), "error, signup", ["\"k\": 9", "(", "\"k\": 1[0-4]"])
    return rows.groupBy("reason").agg(F.count("*").alias("n"))


def client_names(spark, sf):
    rows = request_rows(spark, sf)
    return rows.groupBy(client_name(F.col("agent")).alias("client")).agg(F.count("*").alias("n"))


def rate_limit_log(spark, sf):
    rows = govern.rate_limited(request_rows(spark, sf).select(F.col("user_id").alias("client"), "event_id", "ts"), 3, 86_400)
    return rows.select("client", "event_id", "allowed", "retry_after")


def session_islands(spark, sf):
    rows = govern.sessions(table(spark, sf, "events"), 24 * 60)
    return rows.select("user_id", "session_no", F.unix_micros("started").alias("started"), F.unix_micros("last_active").alias("last_active"), "n_events")


def audit_trim(spark, sf):
    return govern.audit_trim(table(spark, sf, "events"), NOW, 10).select("event_id")


def audit_tail(spark, sf):
    lines = table(spark, sf, "events").select(F.col("event_id").alias("line_no"), F.when(F.col("event_id") % 10 == 0, "not json").otherwise(F.col("props")).alias("line"))
    return govern.audit_tail(lines, 100).select("line_no", F.element_at("entry", "k").alias("k"))


def html_main_text(spark, sf):
    p = table(spark, sf, "pages").select("page_id", ingest.main_text(F.col("html")).alias("text"))
    return p.select("page_id", F.length("text").cast("long").alias("n_chars"), F.md5("text").alias("digest"))


def page_links(spark, sf):
    return ingest.links(table(spark, sf, "pages")).select("page_id", F.col("position").cast("long").alias("position"), "link")


def html_tables(spark, sf):
    rows = ingest.tables(table_pages(spark, sf))
    return rows.select("page_id", F.col("row_no").cast("long").alias("row_no"), F.element_at("row", "key").alias("key"), F.element_at("row", "name").alias("name"))


def robots(spark, sf):
    """Rules of each page's host: for another agent, then for all, for this one or for a third."""
    p = table(spark, sf, "pages").select("page_id")
    who = F.element_at(F.array(*map(F.lit, ("User-agent: *", "user-agent: LoomBot/2", "User-Agent: third"))), (F.col("page_id") % 3 + 1).cast("int"))
    lines = (F.lit("User-agent: other"), F.lit("Disallow: /no"), who, F.lit("Disallow:"), F.concat(F.lit("Disallow: /d"), (F.col("page_id") % 11).cast("string"), F.lit(" ")), F.concat(F.lit("disallow:/p/"), F.col("page_id").cast("string")))
    rows = p.select(F.col("page_id").alias("host"), F.posexplode(F.array(*lines)).alias("line_no", "line"))
    return ingest.robots_disallow(rows, "loombot")


def watch_changes(spark, sf):
    rows = ingest.watch_changes(page_versions(spark, sf))
    return rows.select("page_id", F.unix_seconds("fetched_at").alias("at"), "status")


def bfs_depth(spark, sf):
    """Suppliers as a web: each links to three others."""
    s = table(spark, sf, "supplier")
    n = s.agg(F.count("*").alias("n"))
    edges = s.crossJoin(F.broadcast(n)).select(F.col("s_suppkey").alias("src"), F.explode(F.array(*((F.col("s_suppkey") * k + 1) % F.col("n") for k in (2, 3, 5)))).alias("dst"))
    return ingest.reach(edges, s.where("s_suppkey = 1").select(F.col("s_suppkey").alias("node")), 3)


def training_pairs(spark, sf):
    rows = training.training_pairs(table(spark, sf, "conversations"))
    return rows.select("conv_id", "turn", F.size("history").cast("long").alias("n_before"), F.length("response").cast("long").alias("n_chars"))


def training_augmented(spark, sf):
    pairs = training.training_pairs(table(spark, sf, "conversations"))
    last = F.try_element_at("history", F.lit(-1))
    # prompts with blank lines, so that compression changes them
    spaced = training._last_replaced(F.concat(F.lit("\n\n"), last["content"]))
    rows = training.augmented(pairs.withColumn("history", spaced))
    return rows.select("conv_id", "turn", "kind", F.md5(last["content"]).alias("digest"))


def training_formatted(spark, sf):
    rows = training.formatted(training.training_pairs(table(spark, sf, "conversations")))
    return rows.select("conv_id", "turn", F.md5("text").alias("digest"))


def training_split(spark, sf):
    rows = training.training_pairs(table(spark, sf, "conversations"))
    return training.split(rows, F.concat_ws("/", "conv_id", "turn")).select("conv_id", "turn", "part")


def synth_sentences(spark, sf):
    rows = training.synth_sentences(spark, 500)
    return rows.select("id", "text")


def token_accuracy(spark, sf):
    l = table(spark, sf, "labels")
    rows = l.select(F.array(F.coalesce("quality", F.lit(0)), F.coalesce("toxic", F.lit(0))).alias("predicted"), F.array(F.coalesce("toxic", F.lit(-100)), F.coalesce("quality", F.lit(-100))).alias("labels"))
    return training.token_accuracy(rows).select(F.round("token_accuracy", 9).alias("token_accuracy"))


def label_drop_rate(spark, sf):
    b = table(spark, sf, "benchmark").select(F.col("item_id").alias("doc_id"), F.col("text").alias("original"), F.when(F.col("item_id") % 2 == 0, F.col("text")).otherwise(F.regexp_replace("text", "(^|\n)[^ \n]+ ", "$1")).alias("compressed"))
    return training.dropped_share(training.label_words(b)).select("doc_id", F.round("dropped", 6).alias("dropped"))


def prompt_text(spark, sf):
    c = table(spark, sf, "conversations")
    return c.select("conv_id", "turn", F.md5(training.compressed_prompt(F.concat(F.lit("\n [1] x \n\n"), "text"))).alias("digest"))


def label_words(spark, sf):
    d = table(spark, sf, "benchmark").select(F.col("item_id").alias("doc_id"), F.col("text").alias("original"), F.regexp_replace("text", "(^|\n)[^ \n]+ ", "$1").alias("compressed"))
    rows = training.label_words(d)
    return rows.select("doc_id", F.size("words").cast("long").alias("n_words"), F.aggregate("labels", F.lit(0), lambda a, x: a + x).cast("long").alias("n_kept"), F.md5(F.array_join(F.transform("labels", lambda x: x.cast("string")), "")).alias("labels"))


def fact_retention(spark, sf):
    """Each line without its first word, and 30 characters at every 50 of the text as facts: those that hold a lost word are gone."""
    b = table(spark, sf, "benchmark")
    facts = F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length("text")), F.lit(50)), lambda i: F.substring(F.col("text"), i, F.lit(30)))
    cases = b.select(F.col("item_id").alias("case_id"), F.regexp_replace("text", "(^|\n)[^ \n]+ ", "$1").alias("compressed"), facts.alias("facts"))
    return training.fact_retention(cases)


def model_fit_rank(spark, sf):
    p = table(spark, sf, "part").select(F.concat_ws("-", F.col("p_name"), F.col("p_partkey").cast("string")).alias("name"), (F.col("p_size") * 500).cast("long").alias("size_mb"))
    return training.model_fit(p, F.lit(16000))


# --- requests, stores, measures ----------------------------------------------


def chat_requests(spark: SparkSession, sf: str) -> DataFrame:
    """A request for each conversation: messages with texts as they are, and one that is no text."""
    c = table(spark, sf, "conversations")
    one = F.struct("turn", F.struct("role", F.col("text").alias("content")).alias("m"))
    rows = c.groupBy("conv_id").agg(F.array_sort(F.collect_list(one)).alias("x"))
    return rows.select("conv_id", F.to_json(F.struct(F.lit("m").alias("model"), F.transform("x", lambda v: v["m"]).alias("messages"))).alias("body"))


def block_requests(spark: SparkSession, sf: str) -> DataFrame:
    """A request for each customer with three orders or more: a system prompt, a text block, an image, and a tool result that holds the orders as JSON."""
    j = json_blocks(spark, sf).where(F.size("items") >= 3)
    text = F.struct(F.lit("text").alias("type"), F.lit("short").alias("text"))
    tool = lambda content: F.struct(F.lit("tool_result").alias("type"), F.lit("t").alias("tool_use_id"), F.array(F.struct(F.lit("text").alias("type"), content.alias("text"))).alias("content"))
    image = F.struct(F.lit("image").alias("type"), F.lit("x" * 200).alias("data"))
    as_json = lambda x: F.to_json(x)
    content = F.concat(F.lit("["), as_json(text), F.lit(","), as_json(image), F.lit(","), as_json(tool(F.col("text"))), F.lit("]"))
    body = F.concat(F.lit('{"system":"be brief","messages":[{"role":"user","content":"hi"},{"role":"user","content":'), content, F.lit("}]}"))
    return j.select("block", body.alias("body"), F.col("text").alias("inner"))


def compress_chat_requests(spark, sf):
    rows = requests.compress_requests(chat_requests(spark, sf))
    return rows.select("conv_id", *requests.SUMS, "ratio", "compressed", F.md5("body").alias("digest"))


def compress_block_requests(spark, sf):
    """Each tool result inside is the table that the customer's array becomes; the rest is as it was."""
    rows = requests.compress_requests(block_requests(spark, sf), "blocks")
    inner = F.get_json_object("body", "$.messages[1].content[2].content[0].text")
    return rows.select("block", *requests.SUMS, "ratio", "compressed", inner.alias("inner"), F.get_json_object("body", "$.messages[1].content[1].data").alias("image"), F.get_json_object("body", "$.messages[0].content").alias("short"))


def instruction_cost(spark, sf):
    e = table(spark, sf, "events")
    before = F.floor("value").cast("long")
    rows = e.select("event_id", before.alias("tokens_before"), F.floor(before / 2).alias("tokens_after"), (before - F.floor(before / 2)).alias("tokens_saved"), F.lit(1.0).alias("ratio"))
    return requests.with_instruction(rows)


def completion_tokens(spark, sf):
    e = table(spark, sf, "events")
    name = F.when(F.col("event_id") % 3 == 0, "completion_tokens").when(F.col("event_id") % 3 == 1, "output_tokens").otherwise("other")
    rows = e.select("event_id", F.concat(F.lit('{"usage": {"'), name, F.lit('": '), F.floor("value").cast("string"), F.lit(', "x": "y"}}')).alias("answer"))
    return requests.completion_tokens(rows).select("event_id", "output_tokens")


def redact_payload(spark, sf):
    d = secret_docs(spark, sf)
    body = F.to_json(F.struct(F.concat(F.lit("model-"), F.col("doc_id").cast("string")).alias("model"), F.array(F.struct(F.lit("user").alias("role"), F.col("text").alias("content"))).alias("messages")))
    rows = requests.redact_payloads(d.select("doc_id", body.alias("body")), pii=True)
    count = lambda name: F.coalesce(F.element_at("counts", name), F.lit(0)).cast("long")
    return rows.select("doc_id", F.get_json_object("body", "$.model").alias("model"), F.md5(F.get_json_object("body", "$.messages[0].content")).alias("digest"), count("openai_key").alias("keys"), count("email").alias("mails"))


def savings_measure(spark, sf):
    """Six kinds made of the tables, by the estimate of tokens; kind null is all together."""
    kinds = [("json:records", json_blocks(spark, sf).where(F.size("items") >= 3).select("text"))]
    e = table(spark, sf, "events")
    hits = e.groupBy("user_id").agg(F.to_json(F.array_sort(F.collect_list(F.struct("event_id", F.lit("https://example.org/").alias("link"), "event_type", F.lit(None).cast("string").alias("note"))))).alias("text"))
    kinds.append(("json:hits", hits.select("text")))
    kinds.append(("logs:build", log_blocks(spark, sf).select("text")))
    frame = F.concat(F.lit('  File "app.py", line '), F.col("event_id").cast("string"), F.lit(", in step\n    run(step)"))
    trace = e.groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("event_id", frame.alias("f")))).alias("x"))
    kinds.append(("logs:trace", trace.select(F.concat(F.lit("Traceback (most recent call last):\n"), F.array_join(F.transform("x", lambda v: v["f"]), "\n"), F.lit("\nValueError: bad value")).alias("text"))))
    kinds.append(("code:python", code_blocks(spark, sf).select("text")))
    kinds.append(("prose:verbose", training.synth_sentences(spark, 200).groupBy(F.floor(F.col("id") / 20)).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("id", "text"))), lambda v: v["text"]), " ").alias("text")).select("text")))
    rows = None
    for kind, df in kinds:
        own = df.select(F.lit(kind).alias("kind"), "text")
        rows = own if rows is None else rows.unionByName(own)
    return compress.savings_measure(compress.compress_blocks(rows))


def invisible_overhead(spark, sf):
    rows = hidden_docs(spark, sf).select("text", invisible(F.col("text"), True)["text"].alias("clean"))
    return compress.invisible_overhead(rows)


def invisible_scan(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "lang")
    word = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit(" "), "lang", F.lit(chr(0x430)))).otherwise("")
    rows = hidden_docs(spark, sf).join(d, "doc_id").select("doc_id", scan(F.concat(F.col("text"), word)).alias("x"))
    return rows.select("doc_id", "x.invisible", "x.bidi", "x.nbsp", F.array_join("x.mixed", " ").alias("mixed"))


def conversation_titles(spark, sf):
    c = table(spark, sf, "conversations").withColumn("ts", F.timestamp_seconds(F.lit(1_700_000_000) + F.col("turn") * 60 + F.col("conv_id")))
    kept = conversations.without(c, c.where("conv_id % 7 = 0").select("conv_id"))
    rows = conversations.conversations(kept)
    return rows.select("conv_id", "title", F.unix_seconds("created_at").alias("created_at"), F.unix_seconds("updated_at").alias("updated_at"), "n_messages")


def recent_conversations(spark, sf):
    c = table(spark, sf, "conversations").withColumn("ts", F.timestamp_seconds(F.lit(1_700_000_000) + F.col("turn") * 60 + F.col("conv_id")))
    return conversations.recent(c, 10).select("conv_id", "title")


def dashboard(spark, sf):
    rows = ledger.dashboard(ledger_rows(spark, sf), "2024-02-02", 5, F.lit("2024-01-10 00:00:00").cast("timestamp"))
    field = lambda name: F.get_json_object("body", f"$.{name}").cast("long")
    items = F.when(F.col("body").startswith("["), F.json_array_length("body")).cast("long")
    return rows.select("section", field("requests").alias("requests"), field("tokens_saved").alias("tokens_saved"), field("n_s").alias("n_s"), items.alias("items"))


def purge_expired(spark, sf):
    active = govern.sessions(table(spark, sf, "events"), 24 * 60)
    return govern.purge(originals(spark, sf).withColumn("stored_at", F.timestamp_seconds(F.unix_seconds("stored_at") + 6_572_000)), active, table(spark, sf, "events"), NOW, 24, 60 * 24, 10)


def limiter_stats(spark, sf):
    e = table(spark, sf, "events").select(F.col("user_id").alias("client"), "ts")
    return govern.limiter_stats(e, "2024-01-20 00:00:00", 60, 3600.0)


def limiter_reset(spark, sf):
    e = table(spark, sf, "events").select(F.col("user_id").alias("client"), F.col("ts").cast("timestamp").alias("ts"))
    resets = e.groupBy("client").agg(F.min("ts").alias("first")).where("client % 2 = 0").select("client", (F.col("first") + F.expr("INTERVAL 5 DAY")).alias("at"))
    return govern.limiter_reset(e, resets).groupBy("client").agg(F.count("*").alias("n"))


def encryption_round_trip(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "text")
    key = F.lit("0123456789abcdef").cast("binary")
    rows = govern.decrypted(govern.encrypted(d, "text", key), "text", key)
    return rows.select("doc_id", F.md5("text").alias("digest"))


def page_plain_text(spark, sf):
    p = table(spark, sf, "pages").select("page_id", kernels.page_text("html").alias("text"))
    return p.select("page_id", F.length("text").cast("long").alias("n_chars"), F.md5("text").alias("digest"))


def json_in_text(spark, sf):
    e = table(spark, sf, "events")
    text = F.concat(F.lit("The answer is "), F.when(F.col("event_id") % 4 == 0, F.lit("{broken")).otherwise(F.col("props")), F.lit(" as asked."))
    return e.select("event_id", F.get_json_object(kernels.json_found(text), "$.k").alias("k"))


def holdout_arms(spark, sf):
    e = table(spark, sf, "events").select("event_id", compress.in_treatment(F.col("event_id").cast("string")).alias("shaped"))
    return e.groupBy("shaped").agg(F.count("*").alias("n"))


def store_info(spark, sf):
    return compress.store_info(originals(spark, sf)).select("id", F.unix_seconds("stored_at").alias("stored_at"), F.col("original_chars").cast("long").alias("original_chars"), F.col("compressed_chars").cast("long").alias("compressed_chars"))


def word_dropping(spark, sf):
    """Words scored by their length, a third of them kept."""
    b = table(spark, sf, "benchmark").select("item_id", "text")
    keep = kernels.column(lambda t: kernels.drop_words(t, lambda words: [float(len(w)) for w in words], target_ratio=1 / 3), T.StringType())
    return b.select("item_id", F.md5(keep("text")).alias("digest"))


QUERY_FUNCTIONS = {
    f.__name__: f
    for f in (
        bm25_topk, bm25_batch, rag_chunks, list_documents, replace_document, rag_context, cosine_topk, hybrid_topk, search_fallback, grep_lines, ledger_totals, ledger_daily, ledger_breakdowns, ledger_prune, output_effect, late_output_tokens, dashboard,
        token_estimate, type_counts, log_code_rules, code_language, compress_corpus, savings_measure, log_triage, json_csv_schema, json_shrink, code_compress, prose_compress, word_dropping, dedupe_lines, invisible_clean, invisible_scan, invisible_overhead, mixed_script,
        align_messages, shape_last_user, compress_messages, compress_chat_requests, compress_block_requests, instruction_cost, completion_tokens, holdout_arms, ccr_stats, ccr_cleanup, ccr_retrieve, store_info, conversation_titles, recent_conversations,
        redact_counts, redact_text, redact_payload, policy_check, client_names, rate_limit_log, limiter_stats, limiter_reset, session_islands, audit_trim, audit_tail, purge_expired, encryption_round_trip, html_main_text, page_plain_text, page_links, html_tables, robots,
        watch_changes, bfs_depth, json_in_text, training_pairs, training_augmented, training_formatted, training_split, synth_sentences, token_accuracy, prompt_text, label_words, label_drop_rate, fact_retention, model_fit_rank,
    )
} | {f"ledger_by_{d}": _by(d) for d in ("tool", "provider", "model")}
