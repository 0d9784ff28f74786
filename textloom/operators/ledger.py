"""Savings ledger: ``ts, tool, provider, model, before, after, saved, blocks, output_tokens, shaped``."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.functions import fixed
from textloom.functions.names import fresh
from textloom.sources import files
from textloom.sources.files import load_rows

NUMBERS = ("before", "after", "saved", "blocks", "output_tokens")
LABELS = {"tool": 64, "provider": 64, "model": 128}


def rows(events: DataFrame) -> DataFrame:
    """Ledger rows as stored: labels cut and never null, numbers 0 where they can't be read, absent columns added."""
    have = set(events.columns)
    labels = [(F.substring(F.coalesce(F.col(c), F.lit("")), 1, n) if c in have else F.lit("")).alias(c) for c, n in LABELS.items()]
    numbers = [(F.coalesce(F.expr(f"try_cast({c} AS bigint)"), F.lit(0)) if c in have else F.lit(0)).cast("long").alias(c) for c in NUMBERS]
    shaped = F.coalesce(F.expr("try_cast(shaped AS int)"), F.lit(-1)) if "shaped" in have else F.lit(-1)
    return events.select(F.col("ts").cast("timestamp").alias("ts"), *labels, *numbers, shaped.alias("shaped"))


def append(events: DataFrame, path: str) -> None:
    """One folder a day, so that later reads prune by day."""
    rows(events).withColumn("day", F.to_date("ts")).write.mode("append").partitionBy("day").parquet(path)


def fill_output(ledger: DataFrame, responses: DataFrame, key: str = "request_id") -> DataFrame:
    """Output tokens that arrive later, from ``responses(key, output_tokens)``."""
    told = fresh("__late", ledger)
    late = responses.groupBy(key).agg(F.max("output_tokens").alias(told))
    return ledger.join(late, key, "left").withColumn("output_tokens", F.coalesce(told, "output_tokens")).drop(told)


def _sums(*names: str) -> list[Column]:
    return [F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(f"tokens_{c}") for c in names]


def totals(ledger: DataFrame, since=None) -> DataFrame:
    some = ledger if since is None else ledger.where(F.col("ts") >= F.lit(since))
    return some.agg(F.count("*").alias("requests"), *_sums("before", "after", "saved"), F.coalesce(F.sum("blocks"), F.lit(0)).cast("long").alias("blocks"), F.min("ts").alias("first_ts"))


def daily(ledger: DataFrame, today, days: int = 30) -> DataFrame:
    """A row for each of ``days`` UTC days up to ``today``, with zeroes where nothing happened."""
    days = max(1, min(days, 366))
    last = F.to_date(F.lit(today))
    first = F.date_sub(last, days - 1)
    each = ledger.withColumn("day", F.to_date("ts")).where((F.col("day") >= first) & (F.col("day") <= last))
    each = each.groupBy("day").agg(*_sums("before", "after", "saved"), F.count("*").alias("requests"))
    calendar = ledger.sparkSession.range(1).select(F.explode(F.sequence(first, last)).alias("day"))
    zero = {c: F.coalesce(F.col(c), F.lit(0)).cast("long") for c in ("tokens_before", "tokens_after", "tokens_saved", "requests")}
    return calendar.join(each, "day", "left").withColumns(zero)


def _label(dimension: str) -> Column:
    own = F.col(dimension)
    if dimension == "tool":
        return F.when(own == "", "unknown").otherwise(own)
    return F.when((own == "") & (F.col("tool") != ""), F.concat(F.lit("n/a ("), F.col("tool"), F.lit(")"))).when(own == "", "unknown").otherwise(own)


def breakdown(ledger: DataFrame, dimension: str, limit: int = 12) -> DataFrame:
    """The ``limit`` labels that saved most."""
    if dimension not in LABELS:
        raise ValueError(f"no dimension: {dimension}")
    out = ledger.groupBy(_label(dimension).alias("key")).agg(*_sums("before", "after", "saved"), F.count("*").alias("requests"))
    return out.where("tokens_saved > 0").orderBy(F.desc("tokens_saved"), "key").limit(limit)


def breakdowns(ledger: DataFrame) -> DataFrame:
    """All three dimensions in one pass over the ledger."""
    each = ledger.select(F.explode(F.array(*(F.struct(F.lit(d).alias("dimension"), _label(d).alias("key")) for d in LABELS))).alias("by"), "before", "after", "saved")
    return each.groupBy("by.dimension", "by.key").agg(*_sums("before", "after", "saved"), F.count("*").alias("requests")).where("tokens_saved > 0")


def effect(ledger: DataFrame) -> DataFrame:
    """Whether shaped answers are shorter: means, Welch's interval and a verdict, in one row."""
    some = ledger.where("output_tokens > 0")
    of = lambda fn, arm: fn(F.when(F.col("shaped") == arm, F.col("output_tokens")))
    one = some.agg(*(x for name, arm in (("s", 1), ("c", 0)) for x in (of(F.count, arm).alias(f"n_{name}"), F.coalesce(of(F.avg, arm), F.lit(0.0)).alias(f"mean_{name}"), of(F.var_samp, arm).alias(f"var_{name}"))))
    var = lambda x: F.when(F.col(f"n_{x}") > 1, F.col(f"var_{x}")).otherwise(0.0)
    one = one.withColumn("enough", (F.col("n_s") >= fixed.MIN_ARM) & (F.col("n_c") >= fixed.MIN_ARM))
    one = one.withColumn("difference", F.when(F.col("enough"), F.col("mean_c") - F.col("mean_s")))
    one = one.withColumn("margin", F.when(F.col("enough"), fixed.Z95 * F.sqrt(var("s") / F.col("n_s") + var("c") / F.col("n_c"))))
    verdict = F.when(~F.col("enough"), "not enough data yet").when(F.col("difference") - F.col("margin") > 0, "shorter answers").when(F.col("difference") + F.col("margin") < 0, "longer answers").otherwise("no measurable difference")
    needed = F.when(~F.col("enough"), F.greatest(fixed.MIN_ARM - F.col("n_s"), fixed.MIN_ARM - F.col("n_c")))
    return one.select("n_s", "n_c", "mean_s", "mean_c", "difference", "margin", needed.alias("needed"), verdict.alias("verdict"))


def prune(ledger: DataFrame, now, retention_days: int = 400) -> DataFrame:
    return ledger.where(F.col("ts") >= F.lit(now).cast("timestamp") - F.make_dt_interval(F.lit(max(1, retention_days))))


def usd(saved: Column) -> Column:
    return F.round(saved / 1e6 * fixed.USD_PER_MILLION, 4)


def percent_saved(before: Column, after: Column) -> Column:
    return F.when(before > 0, F.round((1 - after / before) * 100, 1)).otherwise(0.0)


LEDGER = "ts timestamp, tool string, provider string, model string, before bigint, after bigint, saved bigint, blocks bigint, output_tokens bigint, shaped int, day date"


def load(spark: SparkSession, path: str) -> DataFrame:
    return load_rows(spark, path, LEDGER)


def clear(spark: SparkSession, path: str) -> None:
    files.clear(spark, path, LEDGER)


def dashboard(ledger: DataFrame, today, days: int = 30, started=None) -> DataFrame:
    """``section, body``: what a dashboard shows, each section as JSON.

    ``session`` (since ``started``) and ``lifetime`` totals with percent and
    money, ``daily``, the three breakdowns, and ``output_effect``.  Every
    section is an aggregate or a top-k of the ledger.
    """

    def one(name: str, df: DataFrame) -> DataFrame:
        return df.select(F.lit(name).alias("section"), F.to_json(F.struct(*df.columns)).alias("body"))

    def many(name: str, df: DataFrame, *order: Column) -> DataFrame:
        rows = F.transform(F.array_sort(F.collect_list(F.struct(*order, F.struct(*df.columns).alias("row")))), lambda x: x["row"])
        return df.agg(F.to_json(rows).alias("body")).select(F.lit(name).alias("section"), "body")

    def shaped(df: DataFrame) -> DataFrame:
        return df.withColumns({"percent_saved": percent_saved(F.col("tokens_before"), F.col("tokens_after")), "usd_saved": usd(F.col("tokens_saved"))})

    parts = [one("session", shaped(totals(ledger, started))), one("lifetime", shaped(totals(ledger))), many("daily", daily(ledger, today, days), F.col("day").alias("o"))]
    parts += [many(f"by_{d}", breakdown(ledger, d), (-F.col("tokens_saved")).alias("o"), F.col("key").alias("k")) for d in LABELS]
    parts.append(one("output_effect", effect(ledger)))
    return reduce(DataFrame.unionByName, parts)


def signature(stats: DataFrame) -> DataFrame:
    """A digest of ``stats`` without its start; a stream tells only when it changes."""
    names = sorted(c for c in stats.columns if c not in ("since", "first_ts"))
    return stats.select(F.sha2(F.to_json(F.struct(*names)), 256).alias("signature"))
