"""Streams: ledger by day, rate limits, sessions, page changes, and totals that tell only of changes."""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from textloom.operators import ledger
from textloom.operators.govern import VERDICT, SlidingLog


def daily_savings(events: DataFrame, late: str = "1 day") -> DataFrame:
    """Sums by UTC day of a stream of ledger rows; rows later than ``late`` are left out."""
    w = F.window("ts", "1 day")
    out = events.withWatermark("ts", late).groupBy(w).agg(F.sum("before").alias("tokens_before"), F.sum("after").alias("tokens_after"), F.sum("saved").alias("tokens_saved"), F.count("*").alias("requests"))
    return out.select(F.to_date("window.start").alias("day"), "tokens_before", "tokens_after", "tokens_saved", "requests")


def rate_limited(events: DataFrame, limit: int = 60, window: float = 60.0, late: str = "1 hour") -> DataFrame:
    """Verdicts on a stream of ``client, event_id, ts``; a client's state is its accepted times of one window.

    Rows later than ``late`` are left out.  Once the watermark is a window past
    a client's last row, its state is dropped: it could reject nothing any more.
    """

    def run(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        pdf = pd.concat(list(parts)).sort_values(["ts", "event_id"])
        log = SlidingLog(limit, window, state.get[0] if state.exists else ())
        verdicts = [log.check(t) for t in pdf["ts"]]
        state.update((log.taken,))
        state.setTimeoutTimestamp(max(int(1000 * (pdf["ts"].max() + window)), state.getCurrentWatermarkMs()) + 1)
        yield pd.DataFrame({"client": pdf["client"].to_numpy(), "event_id": pdf["event_id"].to_numpy(), "ts": pdf["ts"].to_numpy(), "allowed": [v[0] for v in verdicts], "retry_after": [v[1] for v in verdicts]})

    rows = events.select(F.coalesce(F.col("client").cast("string"), F.lit("")).alias("client"), F.col("event_id").cast("long").alias("event_id"), F.col("ts").cast("timestamp").alias("at"))
    rows = rows.withWatermark("at", late).withColumn("ts", F.col("at").cast("double"))
    return rows.groupBy("client").applyInPandasWithState(run, VERDICT, "taken array<double>", "append", GroupStateTimeout.EventTimeTimeout)


def sessions(events: DataFrame, timeout_minutes: int = 60, late: str = "1 hour") -> DataFrame:
    """Sessions by user of a stream; each is told once its end has passed."""
    w = F.session_window("ts", f"{timeout_minutes} minutes")
    out = events.withWatermark("ts", late).groupBy("user_id", w).agg(F.count("*").alias("n_events"), F.min("ts").alias("started"), F.max("ts").alias("last_active"))
    return out.select("user_id", "started", "last_active", "n_events")


CHANGE = "url string, digest string, status string"


def page_changes(fetched: DataFrame, forget_days: float = 400, late: str = "30 days") -> DataFrame:
    """``url, digest, status`` of a stream of ``url, fetched_at, content``; a url's state is its last digest.

    Fetches later than ``late`` are left out.  A url that isn't fetched for
    ``forget_days`` is forgotten, and its next page is a baseline.
    """

    def run(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        pdf = pd.concat(list(parts)).sort_values("fetched_at")
        last, status = state.get[0] if state.exists else None, []
        for digest in pdf["digest"]:
            status.append("baseline" if last is None else "same" if digest == last else "changed")
            last = digest
        state.update((last,))
        last_ms = pdf["fetched_at"].max().timestamp() * 1000
        state.setTimeoutTimestamp(max(int(last_ms + forget_days * 86_400_000), state.getCurrentWatermarkMs()) + 1)
        yield pd.DataFrame({"url": key[0], "digest": pdf["digest"].to_numpy(), "status": status})

    rows = fetched.select("url", F.col("fetched_at").cast("timestamp").alias("fetched_at"), F.sha2(F.coalesce("content", F.lit("")), 256).alias("digest")).withWatermark("fetched_at", late)
    return rows.groupBy("url").applyInPandasWithState(run, CHANGE, "digest string", "append", GroupStateTimeout.EventTimeTimeout)


def live_totals(events: DataFrame) -> DataFrame:
    """Running totals of a stream of ledger rows (complete mode)."""
    return ledger.totals(events)


def on_change(tell: Callable[[DataFrame, int], None]) -> Callable[[DataFrame, int], None]:
    """For ``foreachBatch``: calls ``tell`` only when the totals differ from those told last."""
    last: list[str | None] = [None]

    def batch(stats: DataFrame, number: int) -> None:
        row = ledger.signature(stats).first()
        if row is not None and row["signature"] != last[0]:
            last[0] = row["signature"]
            tell(stats, number)

    return batch


# --- joined and kept state --------------------------------------------------------


def once(rows: DataFrame, key: str, at: str, late: str = "10 minutes") -> DataFrame:
    """A stream without the repeats of a key that come within ``late``; a key is forgotten once the watermark has passed it."""
    return rows.withWatermark(at, late).dropDuplicatesWithinWatermark([key])


def late_outputs(requests: DataFrame, answers: DataFrame, within: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """A stream of ledger rows ``requests(request_id, ts, output_tokens, ...)`` with the tokens that ``answers(request_id, answered_at, output_tokens)`` tell later.

    An answer counts from its request's time until ``within`` later; a request
    without one keeps its own number, and is told once none can come any more.
    Repeats of a request or an answer are left out.  Both sides are kept no
    longer than the watermarks ask for.
    """
    own = [c for c in requests.columns if c != "output_tokens"]
    asked = once(requests, "request_id", "ts", late)
    told = once(answers.select(F.col("request_id").alias("answers"), F.col("answered_at"), F.col("output_tokens").alias("told")), "answers", "answered_at", late)
    near = F.expr(f"request_id = answers AND answered_at >= ts AND answered_at <= ts + INTERVAL {within}")
    return asked.join(told, near, "left_outer").select(*own, F.coalesce("told", "output_tokens").alias("output_tokens"))


#: What ``originals`` keeps needs this provider (``spark.sql.streaming.stateStore.providerClass``).
STATE_PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
KEPT = "id string, op string, ts timestamp, original string"


class _Originals(StatefulProcessor):
    """An id's original with the time it was stored last; the id is its content's, so a later store only renews it."""

    def __init__(self, ttl_ms: int, by_event: bool):
        self.ttl_ms, self.by_event = ttl_ms, by_event

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        ttl = {} if self.by_event else {"ttlDurationMs": self.ttl_ms}
        self.kept = handle.getValueState("original", "original string, stored_at bigint", **ttl)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        text, times = self.kept.get() if self.kept.exists() else (None, None)
        stores, asks = [times] if times is not None else [], []
        for part in rows:  # of a part only times stay, and one text
            ms = (part["ts"].astype("datetime64[us]").astype("int64") // 1000).tolist()
            for op, at, original in zip(part["op"], ms, part["original"], strict=True):
                if op == "store":
                    stores.append(at)
                    text = original
                else:
                    asks.append(at)
        stores.sort()
        if stores:
            self.kept.update((text, stores[-1]))
            if self.by_event:
                for old in self.handle.listTimers():
                    self.handle.deleteTimer(old)
                self.handle.registerTimer(max(stores[-1] + self.ttl_ms + 1, timerValues.getCurrentWatermarkInMs() + 1))
        last = [bisect_right(stores, at) for at in asks]
        found = [n > 0 and at - stores[n - 1] <= self.ttl_ms for at, n in zip(asks, last, strict=True)]
        yield self._told(key, "get", asks, [text if f else None for f in found])

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        at = expiredTimerInfo.getExpiryTimeInMs()
        self.kept.clear()
        yield self._told(key, "expired", [at], [None])

    @staticmethod
    def _told(key: tuple, op: str, at: list[int], original: list) -> pd.DataFrame:
        as_objects = lambda x: pd.Series(x, dtype=object)
        return pd.DataFrame({"id": as_objects([key[0]] * len(at)), "op": as_objects([op] * len(at)), "ts": pd.to_datetime(pd.Series(at, dtype="int64"), unit="ms"), "original": as_objects(original)})

    def close(self) -> None:
        pass


def originals(events: DataFrame, ttl: float = 86_400, late: str = "10 minutes", by_event: bool = True) -> DataFrame:
    """Answers of a stream ``id, op, ts, original``: what ``store`` has kept under an id is told to each ``get`` until ``ttl`` seconds have passed.

    By event time an id is dropped by a timer, which also tells so
    (``expired``), once the watermark is past its time; by the clock of the
    machines its state has a time to live.  Answers come in a row of ``KEPT``,
    with a null original where nothing is kept; rows later than ``late`` are
    left out.
    """
    rows = events.select("id", "op", F.col("ts").cast("timestamp").alias("ts"), "original")
    if by_event:
        rows = rows.withWatermark("ts", late)
    mode = "EventTime" if by_event else "ProcessingTime"
    return rows.groupBy("id").transformWithStateInPandas(_Originals(int(ttl * 1000), by_event), KEPT, "Append", mode)


def kept_originals(spark, checkpoint: str) -> DataFrame:
    """``id, original, stored_at`` as a query's checkpoint holds them."""
    rows = spark.read.format("statestore").option("stateVarName", "original").load(checkpoint)
    return rows.select("key.id", "value.original", F.timestamp_millis("value.stored_at").alias("stored_at"))
