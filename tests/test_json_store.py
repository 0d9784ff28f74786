import json
import os

import pytest
from pyspark.sql import functions as F

from textloom.sources import json_store

KIND = "name string, title string, n long, tags array<string>, inner struct<a:long,b:string>, score double, ok boolean"


@pytest.fixture(scope="module", autouse=True)
def registered(spark):
    json_store.register(spark)


def load(spark, path, kind=KIND, **options):
    return spark.read.format("json_store").schema(kind).options(**options).load(str(path))


def put(path, **files):
    path.mkdir(exist_ok=True)
    for name, text in files.items():
        (path / f"{name}.json").write_text(text, encoding="utf-8")


def test_read(spark, tmp_path):
    put(tmp_path / "s", a=json.dumps({"title": "é", "n": 3, "tags": ["x", 5], "inner": {"a": 1, "c": 2}, "score": 2, "ok": True, "name": "other"}), b='{"n": "3", "title": {"k": 1}}', bad="{no", list="[1]", empty="")
    (tmp_path / "s" / "note.txt").write_text("{}")
    (tmp_path / "s" / ".hidden.json").write_text("{}")
    rows = {r.name: r for r in load(spark, tmp_path / "s").collect()}
    assert set(rows) == {"a", "b"}
    a = rows["a"]
    assert (a.title, a.n, a.tags, a.inner.a, a.inner.b, a.score, a.ok) == ("é", 3, ["x", "5"], 1, None, 2.0, True)
    assert rows["b"].n is None and rows["b"].title == '{"k": 1}' and rows["b"].tags is None
    bad = load(spark, tmp_path / "s", f"{KIND}, wrong string", badColumn="wrong")
    assert {r.name for r in bad.where("wrong IS NOT NULL").collect()} == {"bad", "list", "empty"} and bad.count() == 5
    assert load(spark, tmp_path / "none").count() == 0


def test_filters_keep_files_closed(spark, tmp_path):
    put(tmp_path / "s", **{f"f{k}": json.dumps({"n": k}) for k in range(30)})
    os.chmod(tmp_path / "s" / "f7.json", 0)
    only = load(spark, tmp_path / "s", f"{KIND}, wrong string", badColumn="wrong")
    opened = lambda **f: json_store.Reader(str(tmp_path / "s"), None, None)
    from pyspark.sql.datasource import EqualTo, GreaterThan, In, StringStartsWith

    for filters, left, files in (([EqualTo(("name",), "f3"), GreaterThan(("n",), 1)], 1, ["f3"]), ([In(("name",), ("f1", "f2", "zz"))], 0, ["f1", "f2"]), ([StringStartsWith(("name",), "f2")], 0, ["f2", *(f"f2{k}" for k in range(10))]), ([EqualTo(("name",), "f1"), EqualTo(("name",), "f2")], 0, []), ([StringStartsWith(("name",), "f2"), StringStartsWith(("name",), "f1")], 0, [])):
        r = opened()
        assert len(list(r.pushFilters(filters))) == left
        assert [n for p in r.partitions() for n in p.names] == files
    assert [r.n for r in only.where("name = 'f3' AND n > 1").collect()] == [3]
    assert only.where("name IN ('f1', 'f2', 'zz')").count() == 2 and only.where("name LIKE 'f1%' AND name LIKE 'f2%'").count() == 0
    assert only.where(F.col("name").startswith("f2") & (F.col("n") > 24)).count() == 5


def test_write_replaces_and_overwrites(spark, tmp_path):
    path = str(tmp_path / "w")
    df = spark.createDataFrame([(f"n/{k} é", k, ["a"], {"x": k}) for k in range(20)], "name string, n long, tags array<string>, m map<string,long>")
    df.repartition(4).write.format("json_store").mode("append").save(path)
    kind = "name string, n long, tags array<string>, m map<string,long>"
    key = lambda r: r.name
    assert sorted(load(spark, path, kind).collect(), key=key) == sorted(df.collect(), key=key)
    df.limit(3).withColumn("n", F.lit(99)).write.format("json_store").mode("append").save(path)
    assert load(spark, path, kind).where("n = 99").count() == 3 and load(spark, path, kind).count() == 20
    df.where("n < 5").write.format("json_store").mode("overwrite").save(path)
    assert sorted(r.n for r in load(spark, path, kind).collect()) == [0, 1, 2, 3, 4]
    assert not [f for f in os.listdir(path) if f.startswith(".writing")]


def test_a_failed_write_leaves_nothing(spark, tmp_path):
    path = str(tmp_path / "w")
    spark.createDataFrame([("a", 1)], "name string, n long").write.format("json_store").mode("append").save(path)
    bad = spark.createDataFrame([("b", 1), ("a", 2), ("c", None)], "name string, n long").repartition(3)
    bad = bad.withColumn("n", F.when(F.col("n").isNull(), F.raise_error(F.lit("x"))).otherwise(F.col("n")))
    with pytest.raises(Exception):
        bad.write.format("json_store").mode("append").save(path)
    assert [tuple(r) for r in load(spark, path, "name string, n long").collect()] == [("a", 1)]
    assert not [f for f in os.listdir(path) if f.startswith(".writing")]
    with pytest.raises(Exception):
        spark.createDataFrame([(1,)], "n long").write.format("json_store").mode("append").save(path)
