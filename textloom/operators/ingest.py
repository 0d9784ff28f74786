"""Pages: main text, links, tables, robots rules, changes, breadth-first crawl."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.functions import fixed, kernels
from textloom.functions.names import fresh
from textloom.functions.text import java, strip
from textloom.sources.versions import scratch


def _rewritten(x: Column, rules: tuple[tuple[str, str], ...]) -> Column:
    return reduce(lambda c, rule: F.regexp_replace(c, *rule), rules, x)


def main_text(page: Column) -> Column:
    """Without the elements that hold no text, with a line for each block; blank runs closed up."""
    return strip(_rewritten(kernels.unescaped(_rewritten(page, fixed.MAIN_TEXT_RULES)), fixed.SPACE_RULES))


def page_kind(content_type: Column, path: Column, body: Column) -> Column:
    """pdf, docx, html or raw, by content type, ending of the path, or the first kilobyte."""
    kind, name = F.lower(F.coalesce(content_type, F.lit(""))), F.lower(F.coalesce(path, F.lit("")))
    return (
        F.when(kind.contains("pdf") | name.endswith(".pdf"), "pdf")
        .when(kind.contains("wordprocessingml") | name.endswith(".docx"), "docx")
        .when(kind.contains("html") | F.lower(F.substring(body, 1, 1024)).contains("<html"), "html")
        .otherwise("raw")
    )


def links(pages: DataFrame) -> DataFrame:
    """``page_id, position, link``: targets on the page's own host, in order, with repeats."""
    found = pages.select("page_id", kernels.page_links("html", "url").alias("links"))
    return found.select("page_id", F.posexplode("links").alias("position", "link"))


def tables(pages: DataFrame) -> DataFrame:
    """``page_id, table_no, row_no, headers, row``: a row for each row of each table."""
    found = pages.select("page_id", F.inline(kernels.page_tables("html")))
    return found.select("page_id", "table_no", "headers", F.posexplode_outer("rows").alias("row_no", "row"))


def robots_disallow(lines: DataFrame, agent: str) -> DataFrame:
    """``host, path`` from ``lines(host, line_no, line)``: what holds for all agents or for ``agent``; the last agent line decides."""
    line = strip(F.col("line"))
    value = strip(F.regexp_extract(line, r"(?s)^[^:]*:(.*)$", 1))
    who = F.when(F.lower(line).startswith("user-agent:"), F.lower(value))
    upto = Window.partitionBy("host").orderBy("line_no").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = lines.withColumns({"who": F.last(who, ignorenulls=True).over(upto), "path": F.when(F.lower(line).startswith("disallow:"), value)})
    return rows.where((F.col("path") != "") & ((F.col("who") == "*") | F.col("who").contains(agent.lower()))).select("host", "path")


def watch_changes(versions: DataFrame) -> DataFrame:
    """``versions(url, fetched_at, content)`` with ``digest`` and ``status``: baseline, same or changed."""
    digest = F.sha2(F.coalesce(F.col("content"), F.lit("")), 256)
    before = F.lag("digest").over(Window.partitionBy("url").orderBy("fetched_at"))
    last = fresh("__before", versions)
    rows = versions.withColumn("digest", digest).withColumn(last, before)
    status = F.when(F.col(last).isNull(), "baseline").when(F.col(last) == F.col("digest"), "same").otherwise("changed")
    return rows.withColumn("status", status).drop(last, "content")


def watches_due(watches: DataFrame, now) -> DataFrame:
    """``watches(last_checked, interval_minutes)`` whose interval, a minute at least, has passed."""
    every = F.greatest(F.lit(1), F.col("interval_minutes")) * 60
    return watches.where(F.col("last_checked").isNull() | (F.lit(now).cast("timestamp").cast("double") - F.col("last_checked").cast("timestamp").cast("double") >= every))


def reach(edges: DataFrame, seeds: DataFrame, max_depth: int = 2) -> DataFrame:
    """``node, depth``: the least number of steps from ``seeds(node)`` along ``edges(src, dst)``, up to ``max_depth``.

    Each step's nodes are stored, so a step costs its own nodes and their edges.
    """
    spark = seeds.sparkSession

    def stored(rows: DataFrame) -> DataFrame:
        path = scratch(spark, "reached")
        rows.write.parquet(path)
        return spark.read.schema(rows.schema).parquet(path)

    found = front = stored(seeds.select("node").distinct().withColumn("depth", F.lit(0)))
    for step in range(1, max_depth + 1):
        front = edges.join(front.select(F.col("node").alias("src")), "src", "left_semi").select(F.col("dst").alias("node")).distinct()
        front = stored(front.join(found.select("node"), "node", "left_anti").withColumn("depth", F.lit(step)))
        found = found.unionByName(front)
        if front.isEmpty():
            break
    return found


def crawl(pages: DataFrame, start: str, max_pages: int = 10, max_depth: int = 2, disallow: tuple[str, ...] = ()) -> DataFrame:
    """``url, depth, text`` of the first ``max_pages`` pages with over 50 characters of text that a crawl from ``start`` meets; ``pages(page_id, url, html)`` is the web.

    Pages are met breadth first, in the order of their links: a page's place is
    the places of the links that lead to it.  Each step stores the pages it has
    met and reads the links of these only; disallowed pages are met, but neither
    read nor followed.  The crawl ends with the step that has met enough.
    """
    spark = pages.sparkSession
    web = pages.withColumn("url", F.split_part(F.col("url"), F.lit("#"), F.lit(1))).groupBy("url").agg(F.min_by("html", "page_id").alias("html"))
    path = F.coalesce(F.parse_url("url", F.lit("PATH")), F.lit(""))
    for p in disallow:
        web = web.where(~path.startswith(p))
    kinds = "url string, place array<int>, depth int, html string, text string"

    def fetched(front: DataFrame) -> DataFrame:
        at = scratch(spark, "crawled")
        front.join(web, "url").select("url", "place", "depth", "html", main_text(F.col("html")).alias("text")).write.parquet(at)
        return spark.read.schema(kinds).parquet(at)

    front = spark.createDataFrame([(start.split("#")[0], [0], 0)], "url string, place array<int>, depth int")
    found = met = fetched(front)
    n = 0
    for depth in range(1, max_depth + 1):
        n += met.where(F.length("text") > 50).count()
        if n >= max_pages:
            break
        links_of = met.select("place", F.posexplode(kernels.page_links("html", "url")).alias("position", "url"))
        front = links_of.groupBy("url").agg(F.min(F.concat("place", F.array("position"))).alias("place")).join(found.select("url"), "url", "left_anti")
        met = fetched(front.withColumn("depth", F.lit(depth)))
        found = found.unionByName(met)
    return found.where(F.length("text") > 50).orderBy("depth", "place").limit(max_pages).select("url", "depth", "text")


# --- watches -----------------------------------------------------------------------

WATCH = "id string, url string, interval_minutes int, notify_url string, last_hash string, last_checked timestamp, last_changed timestamp"


def watches_added(watches: DataFrame, new: DataFrame) -> DataFrame:
    """``watches`` and those of ``new(url, interval_minutes, notify_url)``, under new ids, not checked yet; an interval is a minute at least, an hour where none is told."""
    rows = new.select(
        F.replace(F.uuid(), F.lit("-"), F.lit("")).alias("id"), "url", F.greatest(F.lit(1), F.coalesce("interval_minutes", F.lit(60))).cast("int").alias("interval_minutes"), F.coalesce("notify_url", F.lit("")).alias("notify_url"),
        F.lit("").alias("last_hash"), F.lit(None).cast("timestamp").alias("last_checked"), F.lit(None).cast("timestamp").alias("last_changed"),
    )
    return watches.unionByName(rows)


def watches_removed(watches: DataFrame, ids: DataFrame) -> DataFrame:
    return watches.join(ids.select("id").distinct(), "id", "left_anti")


def watches_checked(watches: DataFrame, fetched: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``watches`` after a round, and ``id, url, status`` of its pages, by ``fetched(url, fetched_at, content)``, one row a page.

    A first page is a baseline; a page that couldn't be fetched (null) only
    moves the time of the check.
    """
    page = fetched.select("url", "fetched_at", F.when(F.col("content").isNotNull(), F.sha2("content", 256)).alias("digest"))
    both = watches.join(page, "url", "left")
    status = F.when(F.col("fetched_at").isNull(), None).when(F.col("digest").isNull(), "failed").when(F.col("last_hash") == "", "baseline").when(F.col("last_hash") == F.col("digest"), "same").otherwise("changed")
    both = both.withColumn("status", status)
    after = both.select(
        "id", "url", "interval_minutes", "notify_url", F.coalesce("digest", "last_hash").alias("last_hash"), F.coalesce("fetched_at", "last_checked").alias("last_checked"),
        F.when(F.col("status") == "changed", F.col("fetched_at")).otherwise(F.col("last_changed")).alias("last_changed"),
    )
    return after, both.where("status IS NOT NULL").select("id", "url", "status")
