"""Detection, compression by type, messages, and the store of originals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.functions import fixed, kernels
from textloom.functions.names import fresh
from textloom.functions.text import strip, tokens, without_volatile
from textloom.operators.training import draw
from textloom.sources.files import load_rows, save_rows


def with_type(blocks: DataFrame) -> DataFrame:
    """``blocks(text)`` with ``type``: json before logs before code before text; a null text counts as empty.

    One pass of a function on batches: the rules as expressions (``is_logs``,
    ``is_code``) look at each line once for each pattern.
    """
    return blocks.withColumn("type", kernels.types(F.coalesce(F.col("text"), F.lit(""))))


def compress_blocks(blocks: DataFrame, force: Column | None = None, strip_nbsp: bool = False) -> DataFrame:
    """``blocks(text)`` with ``type, compressed, tokens_before, tokens_after, tokens_saved`` and the counts ``found``.

    One pass: each text is sent once to the function that detects its type,
    cleans it and compresses it.
    """
    force = F.lit(None).cast("string") if force is None else force
    r = fresh("__r", blocks)
    rows = blocks.withColumn(r, kernels.route(strip_nbsp)(F.coalesce(F.col("text"), F.lit("")), force))
    before, after = tokens(F.col("text")), tokens(F.col(f"{r}.compressed"))
    saved = F.greatest(F.lit(0).cast("long"), before - after)
    return rows.withColumns({"type": F.col(f"{r}.type"), "compressed": F.col(f"{r}.compressed"), "tokens_before": before, "tokens_after": after, "tokens_saved": saved, "found": F.col(r).dropFields("type", "compressed")}).drop(r)


def align_messages(messages: DataFrame) -> DataFrame:
    """``messages(conv_id, turn, role, text)`` with ``position``: system messages first, by digest, without what changes from call to call."""
    system = F.coalesce(F.col("role") == "system", F.lit(False))
    text = F.coalesce(F.col("text"), F.lit(""))
    digest = fresh("__digest", messages)
    rows = messages.withColumn(digest, F.when(system, F.md5(text)).otherwise("")).withColumn("text", strip(F.when(system, without_volatile(text)).otherwise(text)))
    rows = rows.where(~system | (F.col("text") != ""))
    order = Window.partitionBy("conv_id").orderBy(~system, digest, "turn")
    return rows.withColumn("position", (F.row_number().over(order) - 1).cast("long")).drop(digest)


def compress_messages(messages: DataFrame, keep_cache: bool = False, system_too: bool = False) -> DataFrame:
    """Messages of ``MIN_BLOCK`` characters or more compressed; with ``keep_cache`` only each conversation's last."""
    able = F.length("text") >= fixed.MIN_BLOCK
    if not system_too:
        able = able & (F.coalesce(F.col("role"), F.lit("")) != "system")
    rows, r, last = messages, fresh("__r", messages), fresh("__last", messages)
    if keep_cache:
        rows = rows.withColumn(last, F.max("turn").over(Window.partitionBy("conv_id")))
        able = able & (F.col("turn") == F.col(last))
    rows = rows.withColumn("touched", F.coalesce(able, F.lit(False)))
    rows = rows.withColumn(r, kernels.route()(F.when(F.col("touched"), F.col("text")), F.lit(None).cast("string")))
    before, after = tokens(F.col("text")), tokens(F.col(f"{r}.compressed"))
    zero = F.lit(0).cast("long")
    numbers = {"tokens_before": before, "tokens_after": after, "tokens_saved": F.greatest(zero, before - after)}
    columns = {c: F.when(F.col("touched"), v).otherwise(zero) for c, v in numbers.items()}
    return rows.withColumns({"type": F.col(f"{r}.type"), "compressed": F.coalesce(f"{r}.compressed", "text"), **columns}).drop(r, last)


def savings_measure(compressed: DataFrame, name: str = "kind") -> DataFrame:
    """Per kind and for all together (kind null): tokens before and after, and the percentage saved."""
    total = lambda c: F.sum(c).cast("long").alias(c)
    rows = compressed.rollup(name).agg(total("tokens_before"), total("tokens_after"))
    return rows.withColumn("saved_percent", F.round((1 - F.col("tokens_after") / F.col("tokens_before")) * 100, 2))


def invisible_overhead(cleaned: DataFrame) -> DataFrame:
    """Tokens of ``cleaned(text, clean)`` as pasted and after cleaning, and the overhead in percent of the latter."""
    sums = cleaned.agg(F.sum(tokens(F.col("text"))).alias("tokens_pasted"), F.sum(tokens(F.col("clean"))).alias("tokens_clean"))
    over = (F.col("tokens_pasted") - F.col("tokens_clean")) / F.col("tokens_clean") * 100
    return sums.withColumn("overhead_percent", F.when(F.col("tokens_clean") > 0, F.round(over, 1)).otherwise(0.0))


def savings(compressed: DataFrame, *keys: str) -> DataFrame:
    """Per key: blocks, tokens before, after and saved; saved adds up what each block saved."""
    some = compressed.where("touched") if "touched" in compressed.columns else compressed
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c)
    return some.groupBy(*keys).agg(F.count("*").alias("blocks"), total("tokens_before"), total("tokens_after"), total("tokens_saved"))


def shape_messages(messages: DataFrame, instruction: str = fixed.INSTRUCTION) -> DataFrame:
    """The instruction appended to each conversation's last user message."""
    last = F.max(F.when(F.col("role") == "user", F.col("turn"))).over(Window.partitionBy("conv_id"))
    at = (F.col("role") == "user") & (F.col("turn") == last)
    return messages.withColumn("shaped", F.coalesce(at, F.lit(False))).withColumn("text", F.when(F.col("shaped"), F.concat("text", F.lit("\n\n" + instruction))).otherwise(F.col("text")))


def in_treatment(key: Column, holdout: float = 0.1, seed: int = 0) -> Column:
    """Whether a request is shaped: by a hash of its key, so that a retried task decides alike."""
    return F.lit(True) if holdout <= 0 else draw(key, seed) % 10_000 >= int(10_000 * min(1.0, holdout))


# --- originals --------------------------------------------------------------


def store_originals(compressed: DataFrame, now) -> DataFrame:
    """``id, original, compressed, stored_at`` of what became smaller; the id is the content's digest."""
    some = compressed.where("tokens_saved > 0")
    return some.select(F.sha2("text", 256).alias("id"), F.col("text").alias("original"), "compressed", F.lit(now).cast("timestamp").alias("stored_at")).dropDuplicates(["id"])


STORE = "id string, original string, compressed string, stored_at timestamp"


def save_originals(compressed: DataFrame, path: str, now) -> None:
    """What became smaller, appended to the store below ``path``; an id that it has already is not written again."""
    spark = compressed.sparkSession
    new = store_originals(compressed, now)
    save_rows(new.join(load_rows(spark, path, STORE).select("id"), "id", "left_anti"), path)


def _live(now, hours: float) -> Column:
    return F.lit(now).cast("timestamp").cast("double") - F.col("stored_at").cast("double") <= hours * 3600


def retrieve(store: DataFrame, ids: DataFrame, now, hours: float = 24) -> DataFrame:
    return store.where(_live(now, hours)).join(ids.select("id"), "id", "left_semi")


def store_info(store: DataFrame) -> DataFrame:
    return store.select("id", "stored_at", F.length("original").alias("original_chars"), F.length("compressed").alias("compressed_chars"))


def store_stats(store: DataFrame, now, hours: float = 24) -> DataFrame:
    total = lambda c: F.coalesce(F.sum(F.length(c)), F.lit(0)).cast("long")
    return store.agg(F.count("*").alias("total"), F.count_if(_live(now, hours)).alias("active"), total("original").alias("original_chars"), total("compressed").alias("compressed_chars"), (total("original") - total("compressed")).alias("saved_chars"))


def cleanup(store: DataFrame, now, hours: float = 24) -> DataFrame:
    """What has not expired."""
    return store.where(_live(now, hours))


# --- relational forms -------------------------------------------------------


def dedupe_lines(docs: DataFrame) -> DataFrame:
    """``doc_id, text`` of each row of ``docs`` without later copies of long lines; a null text counts as empty.

    A long line is kept where it stands first; lines stay in their rows.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.transform(F.split(text, "\n"), lambda line, p: F.struct(strip(line).alias("key"), p.alias("p"), line.alias("line")))
    # sorted by line and place, the first of equal ones comes first
    rows = docs.select("doc_id", F.array_sort(lines).alias("x"))
    first = lambda x, i: F.when((F.length(x["key"]) <= fixed.MIN_DUPLICATE_LINE) | (i == 0) | (F.get("x", i - 1)["key"] != x["key"]), F.struct(x["p"].alias("p"), x["line"].alias("line")))
    kept = F.array_sort(F.filter(F.transform("x", first), lambda x: x.isNotNull()))
    return rows.select("doc_id", F.array_join(F.transform(kept, lambda x: x["line"]), "\n").alias("text"))
