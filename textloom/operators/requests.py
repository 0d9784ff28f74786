"""Model requests: bodies compressed with their savings, payloads redacted, answers counted.  A row is a request; bodies are JSON."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textloom.functions.names import fresh
from textloom.functions import fixed, kernels

SUMS = ("tokens_before", "tokens_after", "tokens_saved", "blocks")
COMPRESSED = T.StructType([T.StructField("body", T.StringType()), *(T.StructField(c, T.LongType()) for c in SUMS)])


def _compressor(dialect: str, keep_cache: bool, system_too: bool):
    def run(bodies: pa.Array) -> pa.Array:
        rows = [None if b is None else dict(zip(COMPRESSED.names, kernels.compress_request(b, dialect, keep_cache, system_too), strict=True)) for b in bodies.to_pylist()]
        return pa.array(rows, pa.struct([("body", pa.string()), *((c, pa.int64()) for c in SUMS)]))

    return F.arrow_udf(run, COMPRESSED)


def compress_requests(requests: DataFrame, dialect: str = "chat", keep_cache: bool = False, system_too: bool = False, enabled: bool = True) -> DataFrame:
    """``requests(body)`` with the body compressed, ``tokens_before, tokens_after, tokens_saved, blocks``, ``ratio`` and ``compressed``.

    Where nothing was compressed, or ``enabled`` is off, the numbers are 0, the
    ratio 1 and ``compressed`` false.
    """
    if dialect not in ("chat", "blocks"):
        raise ValueError(f"no dialect: {dialect}")
    r = fresh("__r", requests)
    if enabled:
        rows = requests.withColumn(r, _compressor(dialect, keep_cache, system_too)("body"))
    else:
        zero = F.lit(0).cast("long")
        rows = requests.withColumn(r, F.struct(F.col("body"), *(zero.alias(c) for c in SUMS)))
    numbers = {c: F.coalesce(F.col(f"{r}.{c}"), F.lit(0)) for c in SUMS}
    ratio = F.when(F.col(f"{r}.tokens_before") > 0, F.round(F.col(f"{r}.tokens_after") / F.col(f"{r}.tokens_before"), 4)).otherwise(1.0)
    return rows.withColumns({"body": F.col(f"{r}.body"), **numbers, "ratio": ratio, "compressed": F.coalesce(F.col(f"{r}.blocks") > 0, F.lit(False))}).drop(r)


def with_instruction(requests: DataFrame, instruction: str = fixed.INSTRUCTION) -> DataFrame:
    """Savings of requests that carry the instruction: its tokens count as sent."""
    cost = max(1, len(instruction) // 4)
    after, saved = F.col("tokens_after") + cost, F.col("tokens_saved") - cost
    ratio = F.when(F.col("tokens_before") > 0, F.round(after / F.col("tokens_before"), 4)).otherwise(F.col("ratio"))
    return requests.withColumns({"tokens_after": after, "tokens_saved": saved, "ratio": ratio, "instruction_tokens": F.lit(cost).cast("long")})


def completion_tokens(answers: DataFrame) -> DataFrame:
    """``answers(answer)`` with ``output_tokens``: what the JSON's usage says in either form of its name, else 0."""
    usage = F.get_json_object("answer", "$.usage")

    def of(name: str):
        return F.nullif(F.regexp_extract(usage, rf'"{name}"\s*:\s*(\d+)\s*[,}}]', 1), F.lit("")).cast("long")

    return answers.withColumn("output_tokens", F.coalesce(of("completion_tokens"), of("output_tokens"), F.lit(0).cast("long")))


def redact_payloads(requests: DataFrame, pii: bool = False) -> DataFrame:
    """``requests(body)`` with every string value of the body redacted, and ``counts`` by kind."""
    r = fresh("__r", requests)
    rows = requests.withColumn(r, kernels.redaction(kernels.redacted_payload, pii)("body"))
    return rows.withColumns({"body": F.col(f"{r}.text"), "counts": F.col(f"{r}.counts")}).drop(r)
