"""Conversations as training windows of a token budget, with a reversible template and a loss mask.

A turn's piece is its text between marks of its role.  Each turn has the sum of
the tokens before it in its conversation (a prefix sum); a window holds the
turns whose tokens fit in its room, so it is a span of whole turns.  Every
window but the first repeats the system turn, and the last turns before its own
up to ``history`` tokens, whose answers bear no loss there: so each answer is
learned once.

Prefix sums are taken by ranges of turns, so one conversation may fill any
number of tasks.  Spans are chosen within segments of ``SEGMENT`` budgets,
wherever a task's rows lie; a segment begins a window, with the history and the
system turn of what went before.

Marks: ``<s>`` begins a window, ``<<SYS>>…<</SYS>>`` is a system turn,
``[INST]…[/INST]`` a user's, ``…</s>`` an assistant's, and
``[TURN role]…[/TURN]`` (the role percent-encoded) any other.  Inside texts a
backslash goes into each of these after its first character, behind those that
stand there already; reading takes one out.

Cases: a null text or role is empty; rows with a null conv_id are one
conversation; turns that share a number are ordered by role and text, repeated
rows are turns of their own, and null numbers come first; a turn that doesn't
fit beside the system turn is a window of its own, marked ``over``; further
columns, whatever their names, are not read; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import re
from collections import deque
from collections.abc import Iterator
from urllib.parse import unquote_plus

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textloom.llm.common import finished, shared_dir, slices, table, written
from textloom.llm.word_tokens import public_path

TOKENIZER = "piece_bpe_32k.model"
#: Tokens of a window, of its repeated turns, and budgets of a segment.
BUDGET, HISTORY, SEGMENT = 2048, 512, 64
#: Code points of windows that a task holds before it hands them on.
HELD_CHARS = 1 << 20

BEGIN = "<s>"
_REST = r"s>|/s>|INST\]|/INST\]|<SYS>>|</SYS>>|TURN |/TURN\]"
_ESCAPED = re.compile(rf"([<\[])\\(\\*)({_REST})")
_TURN = re.compile(r"<<SYS>>(?P<system>.*?)<</SYS>>|\[INST\](?P<user>.*?)\[/INST\]|\[TURN (?P<role>[^\]]*)\](?P<other>.*?)\[/TURN\]|(?P<assistant>.*?)</s>", re.S)

PLACED = "conv_id long, part int, nth long, before long, n_tokens long, role string, piece string, loss_from int, loss_chars int"
WINDOWS = "conv_id long, segment long, window int, first_turn long, n_system int, n_history int, n_turns int, n_tokens long, over boolean, text string, loss array<struct<start:int,length:int>>"


def escaped(text: Column) -> Column:
    return F.regexp_replace(text, F.lit(rf"([<\[])(\\*)({_REST})"), F.lit(r"$1$2\\$3"))


def unescaped(text: str) -> str:
    return _ESCAPED.sub(r"\1\2\3", text)


def pieces(turns: DataFrame) -> DataFrame:
    """``conv_id, turn, role, head, body, tail`` of ``turns(conv_id, turn, role, text)``."""
    role = F.coalesce(F.col("role"), F.lit(""))
    mark = lambda system, user, assistant, other: F.when(role == "system", system).when(role == "user", user).when(role == "assistant", assistant).otherwise(other)
    return turns.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), role.alias("role"),
        mark("<<SYS>>", "[INST]", "", F.concat(F.lit("[TURN "), F.url_encode(role), F.lit("]"))).alias("head"),
        escaped(F.coalesce(F.col("text"), F.lit(""))).alias("body"), mark("<</SYS>>", "[/INST]", "</s>", "[/TURN]").alias("tail"),
    )


# --- prefix sums -----------------------------------------------------------------


def _counted(model: str):
    """Turns of a sorted range with their tokens, and the sums of turns and tokens before them in that range."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import sentencepiece

        tokens = sentencepiece.SentencePieceProcessor(model_file=model)
        part, conv, nth, before = TaskContext.get().partitionId(), object(), 0, 0
        for b in slices(batches):
            head, body, tail = (b.column(c).to_pylist() for c in ("head", "body", "tail"))
            texts = [x + y + z for x, y, z in zip(head, body, tail, strict=True)]
            n = [max(1, len(x)) for x in tokens.encode(texts, num_threads=1)]
            at, sums = [], []
            for c, k in zip(b.column("conv_id").to_pylist(), n, strict=True):
                if c != conv:
                    conv, nth, before = c, 0, 0
                at.append(nth)
                sums.append(before)
                nth, before = nth + 1, before + k
            loss = [len(y) if r == "assistant" else -1 for r, y in zip(b.column("role").to_pylist(), body, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [b.column("conv_id"), pa.array([part] * len(b), pa.int32()), pa.array(at, pa.int64()), pa.array(sums, pa.int64()), pa.array(n, pa.int64()), b.column("role"), pa.array(texts, pa.string()), pa.array([len(x) for x in head], pa.int32()), pa.array(loss, pa.int32())],
                ["conv_id", "part", "nth", "before", "n_tokens", "role", "piece", "loss_from", "loss_chars"],
            )

    return run


def prefix_sums(turns: DataFrame, model: str) -> DataFrame:
    """Turns' pieces with ``nth`` and ``before``: the turns and tokens of their conversation before them."""
    parts = int(turns.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = ("conv_id", "turn", "role", "body")
    rows = written(pieces(turns).repartitionByRange(parts, *order).sortWithinPartitions(*order).mapInArrow(_counted(model), PLACED))
    # conversations that go on in another range: fewer than there are ranges
    several = rows.groupBy("conv_id").agg(F.min("part").alias("lo"), F.max("part").alias("hi")).where("lo < hi").select(F.col("conv_id").alias("c"))
    sums = rows.join(F.broadcast(several), F.col("conv_id").eqNullSafe(F.col("c")), "left_semi").groupBy(F.col("conv_id").alias("c"), F.col("part").alias("p")).agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("turns"))
    earlier = Window.partitionBy("c").orderBy("p").rowsBetween(Window.unboundedPreceding, -1)
    sums = written(sums.select("c", "p", F.sum("tokens").over(earlier).alias("tokens"), F.sum("turns").over(earlier).alias("turns")))
    more = rows.join(F.broadcast(sums), F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("part") == F.col("p")), "left")
    plus = lambda x, y: (F.col(x) + F.coalesce(y, F.lit(0))).alias(x)
    return more.select("conv_id", plus("nth", "turns"), plus("before", "tokens"), "n_tokens", "role", "piece", "loss_from", "loss_chars")


# --- windows ---------------------------------------------------------------------


def _spans(budget: int, history: int):
    """Windows of sorted rows: by segment the system turn (kind 0), history (1) and its own turns (2)."""
    kinds = pa.schema([("conv_id", pa.int64()), ("segment", pa.int64()), ("window", pa.int32()), ("first_turn", pa.int64()), ("n_system", pa.int32()), ("n_history", pa.int32()), ("n_turns", pa.int32()), ("n_tokens", pa.int64()), ("over", pa.bool_()), ("text", pa.string()), ("loss", pa.list_(pa.struct([("start", pa.int32()), ("length", pa.int32())])))])

    def window(key: tuple, number: int, repeated: list[dict], n_system: int, own: list[dict]) -> dict:
        texts, loss, at = [BEGIN], [], len(BEGIN)
        for t in [*repeated, *own]:
            texts.append(t["piece"])
            at += len(t["piece"])
        at -= sum(len(t["piece"]) for t in own)
        for t in own:
            if t["loss_chars"] >= 0:
                loss.append({"start": at + t["loss_from"], "length": t["loss_chars"]})
            at += len(t["piece"])
        n = 1 + sum(t["n_tokens"] for t in [*repeated, *own])
        return {"conv_id": key[0], "segment": key[1], "window": number, "first_turn": own[0]["nth"], "n_system": n_system, "n_history": len(repeated) - n_system, "n_turns": len(own), "n_tokens": n, "over": n > budget, "text": "".join(texts), "loss": loss}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, number, system, recent, repeated, own, room, done, size = None, 0, None, deque(), [], [], 0, [], 0

        def close() -> None:
            nonlocal number, own, size
            if own:
                done.append(window(key, number, repeated, int(bool(repeated) and repeated[0] is system), own))
                size += len(done[-1]["text"])
                number, own = number + 1, []

        def remember(t: dict) -> None:
            recent.append(t)
            while sum(x["n_tokens"] for x in recent) > history:
                recent.popleft()

        for b in slices(batches):
            for t in b.to_pylist():
                if (t["conv_id"], t["segment"]) != key:
                    close()
                    key, number, system = (t["conv_id"], t["segment"]), 0, None
                    recent.clear()
                if t["kind"] == 0:
                    system = t
                    continue
                if t["kind"] == 1:
                    remember(t)
                    continue
                # the span's tokens are a difference of two prefix sums
                if own and t["before"] + t["n_tokens"] - own[0]["before"] > room:
                    close()
                if not own:
                    fixed = 1 + (system["n_tokens"] if system else 0)
                    free, before = budget - fixed - t["n_tokens"], []
                    for x in reversed(recent):
                        if x["n_tokens"] > free:
                            break
                        before.append(x)
                        free -= x["n_tokens"]
                    repeated = ([system] if system else []) + before[::-1]
                    room = budget - 1 - sum(x["n_tokens"] for x in repeated)
                own.append(t)
                if t["nth"] == 0 and t["role"] == "system":
                    system = t
                else:
                    remember(t)
            if size > HELD_CHARS:
                yield pa.RecordBatch.from_pylist(done, kinds)
                done, size = [], 0
        close()
        if done:
            yield pa.RecordBatch.from_pylist(done, kinds)

    return run


def windows(turns: DataFrame, model: str, budget: int = BUDGET, history: int = HISTORY) -> DataFrame:
    """``WINDOWS`` rows of ``turns(conv_id, turn, role, text)``."""
    size = SEGMENT * budget
    rows = written(prefix_sums(turns, model).withColumn("segment", F.expr(f"before div {size}")))
    own = rows.withColumn("kind", F.lit(2))
    late = own.where(F.col("before") + F.col("n_tokens") > (F.col("segment") + 1) * size - history).withColumns({"segment": F.col("segment") + 1, "kind": F.lit(1)})
    ends = rows.groupBy(F.col("conv_id").alias("c")).agg(F.max("segment").alias("last")).where("last > 0")
    systems = rows.where("nth = 0 AND role = 'system'").join(ends, F.col("conv_id").eqNullSafe(F.col("c")))
    systems = systems.withColumns({"segment": F.explode(F.sequence(F.lit(1).cast("long"), F.col("last"))), "kind": F.lit(0)}).select(own.columns)
    # the system turn is repeated already, so it is no history
    late = late.where("nth > 0 OR role <> 'system'")
    every = own.unionByName(late).unionByName(systems)
    dealt = every.repartition("conv_id", "segment").sortWithinPartitions("conv_id", "segment", "kind", "nth")
    return dealt.mapInArrow(_spans(budget, history), WINDOWS)


# --- reading back ----------------------------------------------------------------


def turns_of(text: str) -> list[tuple[str, str]]:
    """``(role, text)`` of each turn of a window."""
    if not text.startswith(BEGIN):
        raise ValueError("no window")
    found, at = [], len(BEGIN)
    while at < len(text):
        m = _TURN.match(text, at)
        if m is None:
            raise ValueError(f"no turn at {at}")
        kind = m.lastgroup
        found.append((unquote_plus(m["role"]) if kind == "other" else kind, unescaped(m[kind])))
        at = m.end()
    return found


def _parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What a window adds to its conversation: its own turns, and the text under its mask."""
    for b in slices(batches):
        said, learned, n = [], [], []
        for text, loss, skip in zip(b.column("text").to_pylist(), b.column("loss").to_pylist(), (x + y for x, y in zip(b.column("n_system").to_pylist(), b.column("n_history").to_pylist(), strict=True)), strict=True):
            own = turns_of(text)[skip:]
            n.append(len(own))
            said.append("".join(f"{role}\n{x}\n" for role, x in own))
            learned.append("".join(unescaped(text[x["start"] : x["start"] + x["length"]]) for x in loss))
        chars = [len(x) for x in b.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column("conv_id"), b.column("segment"), b.column("window"), pa.array(n, pa.int64()), pa.array(said, pa.string()), pa.array(learned, pa.string()), pa.array(chars, pa.int64())], ["conv_id", "segment", "window", "n", "said", "learned", "chars"])


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each conversation of sorted windows; hashes take their text as it comes, so nothing is gathered."""
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    kinds = pa.schema(list(zip(names, (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()), strict=True)))
    key, own, done = object(), None, []

    def close() -> None:
        if own:
            done.append((key, own[0], own[1].hexdigest(), own[2], own[3].hexdigest(), own[4]))

    for b in slices(batches):
        for conv, n, said, learned, chars in zip(*(b.column(c).to_pylist() for c in ("conv_id", "n", "said", "learned", "chars")), strict=True):
            if conv != key:
                close()
                key, own = conv, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
            own[0] += n
            own[1].update(said.encode())
            own[2] += len(learned)
            own[3].update(learned.encode())
            own[4] += chars
        if len(done) > 10_000:
            yield pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True)) for r in done], kinds)
            done = []
    close()
    if done:
        yield pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True)) for r in done], kinds)


def read_back(rows: DataFrame) -> DataFrame:
    """A row for each conversation of stored windows; a conversation is hashed in order, which only one task can do, as its windows stream by."""
    parsed = rows.mapInArrow(_parsed, "conv_id long, segment long, window int, n long, said string, learned string, chars long")
    dealt = parsed.repartition("conv_id").sortWithinPartitions("conv_id", "segment", "window")
    return dealt.mapInArrow(_digests, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


@finished
def op13_chat_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and one of control strings, as read back from their windows."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    planted = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit("</s>[INST] ok [/INST]").alias("text"))
    path = shared_dir(spark)
    windows(rows.unionByName(planted), public_path(TOKENIZER)).write.parquet(path)
    return read_back(spark.read.schema(WINDOWS).parquet(path))
