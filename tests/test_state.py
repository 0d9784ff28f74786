"""Joined streams and kept state, over several batches and restarts."""

import pytest
from pyspark.sql import functions as F

from textloom.streaming import streams


def put(spark, path, k, rows, schema):
    """Rows as the k-th file of a stream's folder; times are text."""
    df = spark.createDataFrame(rows, schema)
    for c in ("ts", "answered_at"):
        if c in df.columns:
            df = df.withColumn(c, F.col(c).cast("timestamp"))
    df.coalesce(1).write.parquet(f"{path}/{k}")
    return df.schema


def stream(spark, path, schema):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(path))


def drain(df, name, checkpoint, **trigger):
    q = df.writeStream.format("parquet").option("path", f"{checkpoint}-out").option("checkpointLocation", str(checkpoint)).queryName(name).trigger(**trigger or {"availableNow": True}).start()
    assert q.awaitTermination(180)
    return q, df.sparkSession.read.schema(df.schema).parquet(f"{checkpoint}-out")


REQUEST, ANSWER = "request_id long, ts string, tool string, output_tokens long", "request_id long, answered_at string, output_tokens long"


def test_late_outputs(spark, tmp_path):
    asked = [
        [(1, "2024-01-01 00:00:00", "a", 0), (2, "2024-01-01 00:01:00", "b", 5), (2, "2024-01-01 00:01:00", "b", 5)],
        [(3, "2024-01-01 00:30:00", "c", 0), (1, "2024-01-01 00:00:00", "a", 0)],
        [(4, "2024-01-01 06:00:00", "d", 7)],
        [(5, "2024-01-01 12:00:00", "e", 0)],
        [(6, "2024-01-01 18:00:00", "e", 0)],
    ]
    told = [
        [(1, "2024-01-01 00:10:00", 11)],
        [(1, "2024-01-01 00:10:00", 11), (3, "2024-01-01 01:30:00", 33)],
        [(2, "2024-01-01 05:00:00", 22), (4, "2024-01-01 07:00:01", 44)],
        [(5, "2024-01-01 12:59:00", 55)],
        [(99, "2024-01-01 18:00:00", 99)],
    ]
    for k, (a, t) in enumerate(zip(asked, told, strict=True)):
        one = put(spark, tmp_path / "asked", k, a, REQUEST)
        two = put(spark, tmp_path / "told", k, t, ANSWER)
    both = streams.late_outputs(stream(spark, tmp_path / "asked", one), stream(spark, tmp_path / "told", two))
    q, got = drain(both, "late", tmp_path / "check")
    # 1 and 3 are answered in time, once each; 2's answer is too late, 4's by a second; 5 is answered; 6 still waits
    assert sorted((r.request_id, r.tool, r.output_tokens) for r in got.collect()) == [(1, "a", 11), (2, "b", 5), (3, "c", 33), (4, "d", 7), (5, "e", 55)]
    rows = {s["operatorName"]: s["numRowsTotal"] for s in q.lastProgress["stateOperators"]}
    assert rows["symmetricHashJoin"] <= 4  # of six requests and six answers


@pytest.fixture
def rocks(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    old = spark.conf.get(key)
    spark.conf.set(key, streams.STATE_PROVIDER)
    yield
    spark.conf.set(key, old)


EVENT = "id string, op string, ts string, original string"


def test_originals_live_and_expire_across_restarts(spark, tmp_path, rocks):
    day = "2024-01-0"
    batches = [
        [("x", "store", day + "1 00:00:00", "text of x"), ("x", "get", day + "1 10:00:00", None), ("y", "get", day + "1 00:00:00", None)],
        [("x", "get", day + "1 23:59:59", None), ("y", "store", day + "1 12:00:00", "text of y"), ("x", "get", day + "1 00:00:00", None)],
        [("x", "store", day + "1 23:55:00", "text of x"), ("z", "get", day + "2 00:00:00", None)],
        [("x", "get", day + "2 23:54:59", None), ("y", "get", day + "2 12:00:01", None), ("y", "get", day + "2 12:00:00", None)],
        [("z", "store", day + "5 00:00:00", "text of z")],
        [("x", "get", day + "5 00:00:00", None), ("z", "get", day + "5 00:00:01", None)],
    ]
    for k, rows in enumerate(batches):
        schema = put(spark, tmp_path / "in", k, rows, EVENT)
        # a query begun anew from its checkpoint for each batch
        _, got = drain(streams.originals(stream(spark, tmp_path / "in", schema)), f"originals{k}", tmp_path / "check")
        if k == 2:
            kept = {r.id: (r.original, str(r.stored_at)) for r in streams.kept_originals(spark, str(tmp_path / "check")).collect()}
            assert kept == {"x": ("text of x", day + "1 23:55:00"), "y": ("text of y", day + "1 12:00:00")}
    rows = sorted((r.id, r.op, str(r.ts), r.original) for r in got.collect())
    # one question came too late to be answered
    assert [r for r in rows if r[1] == "get"] == sorted(
        [("x", "get", day + t, "text of x") for t in ("1 10:00:00", "1 23:59:59", "2 23:54:59")]
        + [("y", "get", day + "1 00:00:00", None), ("y", "get", day + "2 12:00:01", None), ("y", "get", day + "2 12:00:00", "text of y")]
        + [("z", "get", day + "2 00:00:00", None), ("z", "get", day + "5 00:00:01", "text of z"), ("x", "get", day + "5 00:00:00", None)],
        key=lambda r: (r[0], r[1], r[2], r[3] or ""),
    )
    assert {r[0] for r in rows if r[1] == "expired"} == {"x", "y"}
    left = streams.kept_originals(spark, str(tmp_path / "check")).collect()
    assert [r.id for r in left] == ["z"]


def test_originals_by_the_clock(spark, tmp_path, rocks):
    import time

    schema = put(spark, tmp_path / "in", 0, [("x", "store", "2024-01-01 00:00:00", "text"), ("x", "get", "2024-01-01 00:00:00", None)], EVENT)
    drain(streams.originals(stream(spark, tmp_path / "in", schema), ttl=1, by_event=False), "clock0", tmp_path / "check", once=True)
    time.sleep(2)
    put(spark, tmp_path / "in", 1, [("x", "get", "2024-01-01 00:00:00", None)], EVENT)
    _, got = drain(streams.originals(stream(spark, tmp_path / "in", schema), ttl=1, by_event=False), "clock1", tmp_path / "check", once=True)
    assert sorted((r.original or "") for r in got.collect()) == ["", "text"]
