"""Streams against the batch operators on the same rows."""

from pyspark.sql import functions as F

from textloom.operators import govern, ingest
from textloom.streaming import streams

SF = "/root/testdata/sf0.001"


def drained(df, name, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    assert q.awaitTermination(120)
    return df.sparkSession.table(name)


def replayed(spark, df, tmp_path, files=1):
    df.repartition(files).write.parquet(f"{tmp_path}/in")
    return spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in")


def events(spark):
    return spark.read.parquet(f"{SF}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))


def test_rate_limit(spark, tmp_path):
    rows = events(spark).select(F.col("user_id").alias("client"), "event_id", "ts")
    got = drained(streams.rate_limited(replayed(spark, rows, tmp_path), 3, 86_400), "limited")
    want = govern.rate_limited(rows, 3, 86_400)
    assert got.exceptAll(want).count() == 0 == want.exceptAll(got).count()


def in_batches(spark, frames, schema, tmp_path, make, name):
    """What a stream gives that meets each frame in a batch of its own."""
    for k, rows in enumerate(frames):
        frame = spark.createDataFrame(rows, schema)
        frame.withColumn("ts", F.col("ts").cast("timestamp")).coalesce(1).write.mode("append").parquet(f"{tmp_path}/src/{k}")
    kinds = spark.read.parquet(f"{tmp_path}/src/0").schema
    stream = spark.readStream.schema(kinds).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/src")
    return drained(make(stream), name)


def test_state_is_carried_between_batches_and_dropped(spark, tmp_path):
    frames = [[("a", 1, "2024-01-01 00:00:00")], [("a", 2, "2024-01-01 00:00:30")], [("a", 3, "2024-01-01 00:00:40"), ("b", 4, "2024-01-03 00:00:00")], [("b", 5, "2024-01-03 00:00:01")], [("b", 6, "2024-01-03 00:00:02")]]
    got = in_batches(spark, frames, "client string, event_id long, ts string", tmp_path, lambda s: streams.rate_limited(s, 2, 60), "carried")
    # the third of a client within a minute is rejected, though it comes in another batch
    assert {r.event_id: r.allowed for r in got.collect()} == {1: True, 2: True, 3: False, 4: True, 5: True, 6: False}


def test_page_changes_between_batches(spark, tmp_path):
    frames = [[("u", "2024-01-01 00:00:00", "x")], [("u", "2024-01-02 00:00:00", "x"), ("v", "2024-01-02 00:00:00", "y")], [("u", "2024-01-03 00:00:00", "z")]]
    make = lambda s: streams.page_changes(s.select("url", F.col("ts").alias("fetched_at"), "content"))
    got = in_batches(spark, frames, "url string, ts string, content string", tmp_path, make, "pages_carried")
    assert sorted((r.url, r.status) for r in got.collect()) == [("u", "baseline"), ("u", "changed"), ("u", "same"), ("v", "baseline")]


def test_daily(spark, tmp_path):
    value = F.floor("value").cast("long")
    rows = events(spark).select("ts", value.alias("before"), value.alias("after"), F.lit(1).cast("long").alias("saved"))
    got = drained(streams.daily_savings(replayed(spark, rows, tmp_path)), "daily", "complete")
    want = rows.groupBy(F.to_date("ts").alias("day")).agg(F.sum("before").alias("tokens_before"), F.count("*").alias("requests"))
    assert got.select(want.columns).exceptAll(want).count() == 0 and got.count() == want.count()


def test_sessions(spark, tmp_path):
    rows = events(spark).select("user_id", "event_id", "ts")
    # a last row far ahead lets all other sessions end
    end = spark.sql("SELECT -1L AS user_id, -1L AS event_id, TIMESTAMP '2030-01-01' AS ts")
    got = drained(streams.sessions(replayed(spark, rows.unionByName(end), tmp_path), 24 * 60), "sessions_")
    want = govern.sessions(rows, 24 * 60).select("user_id", "started", "last_active", "n_events")
    assert got.exceptAll(want).count() == 0


def test_page_changes(spark, tmp_path):
    rows = spark.createDataFrame([("u", 1, "a"), ("u", 2, "a"), ("u", 3, "b"), ("v", 1, None)], "url string, at int, content string")
    rows = rows.select("url", F.timestamp_seconds("at").alias("fetched_at"), "content")
    got = drained(streams.page_changes(replayed(spark, rows, tmp_path)), "changes").groupBy("url", "status").count()
    want = ingest.watch_changes(rows).groupBy("url", "status").count()
    assert got.exceptAll(want).count() == 0 and got.count() == want.count() == 4


def test_tells_changes_only(spark):
    told = []
    batch = streams.on_change(lambda df, n: told.append(n))
    for n, requests in enumerate((1, 1, 2)):
        batch(spark.createDataFrame([(requests, n)], "requests int, since int"), n)
    assert told == [0, 2]
