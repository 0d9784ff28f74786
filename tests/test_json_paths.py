"""Values set and taken out at paths, against plain Python."""

import json

import pytest
from pyspark.sql import functions as F

from textloom.functions.json_paths import json_set, json_unset

TEXTS = ['{"a": {"b": {"c": 1, "d": [1, {"x": null}]}, "k.dot": 2}, "z": "é"}', '{"a": 5}', '{"a": {"b": null}}', "{}", '{"a": {"b": {"c": "new"}}}', "[1]", '"text"', "no json", "", None, '{"a": {"b": [1, 2]}}', '{"a": {"b": {"c": null}}}']
PATHS = [("a",), ("a", "b"), ("a", "b", "c"), ("q", "r"), ("a", "k.dot")]


def put(doc, keys, value):
    at = doc
    for k in keys[:-1]:
        if not isinstance(at.get(k), dict):
            at[k] = {}
        at = at[k]
    if at.get(keys[-1]) == value:
        return False
    at[keys[-1]] = value
    return True


def take(doc, keys):
    for k in keys[:-1]:
        doc = doc.get(k) if isinstance(doc, dict) else None
    if not isinstance(doc, dict) or keys[-1] not in doc:
        return False
    del doc[keys[-1]]
    return True


def read(text):
    try:
        x = json.loads(text or "")
    except ValueError:
        return None
    return x if isinstance(x, dict) else None


@pytest.mark.parametrize("keys", PATHS)
@pytest.mark.parametrize("value", ['"new"', '{"c": [1, 2]}', "null", "7"])
def test_set(spark, keys, value):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "i int, t string")
    for r in rows.select("i", "t", json_set(F.col("t"), keys, F.lit(value)).alias("x")).collect():
        doc = read(r.t)
        changed = doc is not None and put(doc, keys, json.loads(value))
        assert r.x.changed == changed, r
        assert r.x.body == r.t if not changed else json.loads(r.x.body) == doc


@pytest.mark.parametrize("keys", PATHS)
def test_unset(spark, keys):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "i int, t string")
    for r in rows.select("i", "t", json_unset(F.col("t"), keys).alias("x")).collect():
        doc = read(r.t)
        changed = doc is not None and take(doc, keys)
        assert r.x.changed == changed, r
        assert r.x.body == r.t if not changed else json.loads(r.x.body) == doc
