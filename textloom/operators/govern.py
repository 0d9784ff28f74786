"""Redaction, policy, rate limits, sessions, audit, retention."""

from __future__ import annotations

import re
from collections.abc import Iterable

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textloom.functions import kernels
from textloom.functions.names import fresh
from textloom.functions.text import java
from textloom.sources.files import save_rows


def redacted(docs: DataFrame, pii: bool = False) -> DataFrame:
    """``docs(text)`` with secrets replaced and ``counts`` by kind; a null text counts as empty."""
    secret = kernels.redaction(kernels.redacted, pii)(F.coalesce(F.col("text"), F.lit("")))
    r = fresh("__r", docs)
    return docs.withColumn(r, secret).withColumns({"text": F.col(f"{r}.text"), "counts": F.col(f"{r}.counts")}).drop(r)


def redaction_counts(docs: DataFrame, pii: bool = False) -> DataFrame:
    return redacted(docs, pii).select(F.explode("counts").alias("category", "n")).groupBy("category").agg(F.sum("n").cast("long").alias("n"))


def blocked_model(model, rules: str):
    """The first rule of a comma-separated list that the lower-cased name holds, else null."""
    found = F.lit(None).cast("string")
    for rule in reversed([r.strip().lower() for r in rules.split(",") if r.strip()]):
        found = F.when(F.lower(model).contains(rule), rule).otherwise(found)
    return found


def blocked_pattern(text, patterns: Iterable[str]):
    """The first pattern that the text holds; patterns that aren't valid are skipped."""
    found = F.lit(None).cast("string")
    for p in reversed(list(patterns)):
        try:
            re.compile(p)
        except re.error:
            continue
        found = F.when(text.rlike(java(p, "iU")), p).otherwise(found)
    return found


def check_policy(requests: DataFrame, models: str = "", patterns: Iterable[str] = ()) -> DataFrame:
    """``requests(model, text)`` with ``reason``, null where allowed; the model's rule comes first."""
    m, p = blocked_model(F.coalesce(F.col("model"), F.lit("")), models), blocked_pattern(F.coalesce(F.col("text"), F.lit("")), patterns)
    return requests.withColumn("reason", F.when(m.isNotNull(), F.concat(F.lit("model: "), m)).when(p.isNotNull(), F.concat(F.lit("pattern: "), p)))


VERDICT = "client string, event_id long, ts double, allowed boolean, retry_after int"


class SlidingLog:
    """Times of accepted requests within the window; a rejected one uses up nothing."""

    def __init__(self, limit: int, window: float, taken: Iterable[float] = ()):
        self.limit, self.window, self.taken = limit, window, list(taken)

    def check(self, now: float) -> tuple[bool, int]:
        self.taken = [t for t in self.taken if now - t < self.window]
        if len(self.taken) >= self.limit:
            return False, max(1, int(self.window - (now - self.taken[0])) + 1)
        self.taken.append(now)
        return True, 0


def rate_limited(events: DataFrame, limit: int = 60, window: float = 60.0) -> DataFrame:
    """Verdict on each row of ``events(client, event_id, ts)``, in order of time, then id, within a client.

    A client's rows reach its task sorted and are read in pieces, with the
    accepted times of one window as state.
    """

    rows = events.select(F.coalesce(F.col("client").cast("string"), F.lit("")).alias("client"), F.col("event_id").cast("long").alias("event_id"), F.col("ts").cast("timestamp").cast("double").alias("ts"))

    def partition(frames):
        """Rows come sorted by client and time; state starts anew with each client."""
        last, log = None, None
        for pdf in frames:
            allowed, wait = [], []
            for client, t in zip(pdf["client"], pdf["ts"], strict=True):
                if client != last:
                    last, log = client, SlidingLog(limit, window)
                ok, after = log.check(t)
                allowed.append(ok)
                wait.append(after)
            yield pdf.assign(allowed=allowed, retry_after=wait)

    return rows.repartition("client").sortWithinPartitions("client", "ts", "event_id").mapInPandas(partition, VERDICT)


def limiter_stats(events: DataFrame, now, limit: int = 60, window: float = 60.0) -> DataFrame:
    """``tracked_clients, max_requests, window_seconds``: clients with a request within the window before ``now``."""
    age = F.lit(now).cast("timestamp").cast("double") - F.col("ts").cast("timestamp").cast("double")
    live = events.where((age >= 0) & (age < window))
    return live.agg(F.count_distinct(F.coalesce(F.col("client").cast("string"), F.lit(""))).alias("tracked_clients"), F.lit(limit).alias("max_requests"), F.lit(window).alias("window_seconds"))


def limiter_reset(events: DataFrame, resets: DataFrame) -> DataFrame:
    """``events(client, ts)`` without what came before the last of ``resets(client, at)`` of their client; a reset of client null holds for all."""
    every, at = fresh("__all", events), fresh("__at", events)
    everyone = resets.where("client is null").agg(F.max("at").alias(every))
    own = resets.where("client is not null").groupBy("client").agg(F.max("at").alias(at))
    rows = events.join(own, "client", "left").crossJoin(F.broadcast(everyone))  # one row
    last = F.greatest(F.coalesce(at, every), F.coalesce(every, at))
    return rows.where(last.isNull() | (F.col("ts").cast("timestamp") >= last)).drop(at, every)


def encrypted(rows: DataFrame, column: str, key) -> DataFrame:
    """A text column at rest: AES in GCM mode with a random nonce, as base64; ``key`` is a column of 16, 24 or 32 bytes."""
    return rows.withColumn(column, F.base64(F.aes_encrypt(F.col(column).cast("binary"), key, F.lit("GCM"))))


def decrypted(rows: DataFrame, column: str, key) -> DataFrame:
    """What ``encrypted`` made, as text again; null where the key or the data is not right."""
    return rows.withColumn(column, F.try_aes_decrypt(F.unbase64(column), key, F.lit("GCM")).cast("string"))


def sessions(events: DataFrame, timeout_minutes: int = 60) -> DataFrame:
    """``user_id, session_no, started, last_active, n_events``; a pause longer than the timeout starts another."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    gap = F.unix_micros("ts") - F.lag(F.unix_micros("ts")).over(w) > timeout_minutes * 60_000_000
    marked = events.select("user_id", F.col("ts").cast("timestamp").alias("ts"), "event_id").withColumn("new", F.coalesce(gap, F.lit(True)).cast("int"))
    numbered = marked.withColumn("session_no", F.sum("new").over(w).cast("long"))
    return numbered.groupBy("user_id", "session_no").agg(F.min("ts").alias("started"), F.max("ts").alias("last_active"), F.count("*").alias("n_events"))


def expired(rows: DataFrame, now, minutes: int = 60) -> DataFrame:
    """``rows(last_active)`` with ``expired``."""
    return rows.withColumn("expired", F.lit(now).cast("timestamp").cast("double") - F.col("last_active").cast("double") > minutes * 60)


def audit_tail(lines: DataFrame, n: int = 100) -> DataFrame:
    """The last ``n`` of ``lines(line_no, line)``, without those that aren't JSON objects."""
    last = lines.orderBy(F.desc("line_no")).limit(n)
    return last.withColumn("entry", F.from_json("line", "map<string,string>")).where("entry is not null")


def append_audit(entries: DataFrame, path: str) -> None:
    """``entries(ts, ...)`` appended to the log, a folder a day."""
    save_rows(entries.withColumn("ts", F.col("ts").cast("timestamp")), path, "ts")


def purge(originals: DataFrame, active: DataFrame, audit: DataFrame, now, hours: float = 24, minutes: int = 60, max_days: int = 30) -> DataFrame:
    """``kind, removed, kept`` of what has run out among ``originals(stored_at)``, ``active(last_active)`` sessions and ``audit(ts)`` entries."""
    age = lambda c: F.lit(now).cast("timestamp").cast("double") - F.col(c).cast("timestamp").cast("double")
    rules = (("originals", originals, age("stored_at") > hours * 3600), ("sessions", active, age("last_active") > minutes * 60), ("audit", audit, (age("ts") > max_days * 86400) if max_days > 0 else F.lit(False)))
    parts = [df.agg(F.lit(kind).alias("kind"), F.count_if(gone).alias("removed"), F.count_if(~gone).alias("kept")) for kind, df, gone in rules]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def audit_trim(entries: DataFrame, now, max_days: int = 30) -> DataFrame:
    """``entries(ts)`` of the last ``max_days``; 0 or less keeps all."""
    if max_days <= 0:
        return entries
    return entries.where(F.col("ts").cast("timestamp").cast("double") >= F.lit(now).cast("timestamp").cast("double") - max_days * 86400)
