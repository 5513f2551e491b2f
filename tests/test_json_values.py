"""Free JSON against Python's own json module, over random documents and single cases."""

from __future__ import annotations

import copy
import json
import random

import pytest
from pyspark.sql import functions as F

from granary.functions import json_values as jv


def one(spark, column, *texts):
    return spark.createDataFrame([texts], ", ".join(f"c{i} string" for i in range(len(texts)))).select(column(*(F.col(f"c{i}") for i in range(len(texts))))).first()[0]


@pytest.mark.parametrize(
    ("a", "b", "want"),
    [
        ("[1,2]", "[2,1]", False), ('{"a":1}', '{"a":"1"}', False), ('{"a":{"x":1,"y":2}}', '{"a":{"y":2,"x":1}}', True), ("1", "1.0", True), ("null", None, False), (None, None, True), ("{", "{", True), ("{", "null", False), ('{"a":null}', "{}", False),
        ('"é"', '"\\u00e9"', True), ("[]", "{}", False), ("1.10", "1.1", True), ("true", '"true"', False), ("", "", True),
    ],
)
def test_same_json(spark, a, b, want):
    assert one(spark, jv.same_json, a, b) is want


@pytest.mark.parametrize(
    ("text", "path", "new", "want"),
    [
        ('{"k":1,"x":2,"deep":{"a":[1,2]}}', "$.deep.a[1]", '"new"', {"k": 1, "x": 2, "deep": {"a": [1, "new"]}}), ('{"k":1}', "$.meta.seen", "true", {"k": 1, "meta": {"seen": True}}), ("{}", "$.a[2].b", "1", {"a": [None, None, {"b": 1}]}), ('{"a":5}', "$.a.b", "1", {"a": {"b": 1}}),
        ("[1,2]", "$[0]", "null", [None, 2]), ('{"a":1}', "$", "[3]", [3]), ("nonsense", "$.a", "1", None), (None, "$.a", "1", None), ('{"a.b":1}', "$['a.b']", "2", {"a.b": 2}),
    ],
)
def test_with_value(spark, text, path, new, want):
    found = one(spark, lambda t: jv.with_value(t, path, F.lit(new)), text)
    assert (json.loads(found) if found is not None else None) == want


def test_merge(spark):
    assert json.loads(one(spark, jv.merged, '{"a":1,"b":{"c":2}}', '{"b":3,"d":null}')) == {"a": 1, "b": 3, "d": None}
    assert one(spark, jv.merged, "[1]", '["x"]') == '[1,"x"]' and one(spark, jv.merged, "{}", "[1]") is None and one(spark, jv.merged, None, "{}") is None


def test_paths(spark):
    doc = '{"a":[{"b":1},{"b":"x"},{"c":2},{"b":null}],"m":{"p":{"q":5},"r":{"q":[6,7]}}}'
    values = lambda path: one(spark, lambda t: F.to_json(jv.values_at(F.try_parse_json(t), path)), doc)
    assert values("$.a[*].b") == '[1,"x",null]' and values("$.m.*.q") == "[5,[6,7]]" and values("$.m.r.q[*]") == "[6,7]" and values("$.none[*].b") == "[]" and values("$.a[9]") == "[]"
    for bad in ("a.b", "$.a[", "$a", ""):
        with pytest.raises(ValueError):
            jv.steps_of(bad)
    read = lambda path: one(spark, lambda t: F.to_json(jv.read_path(F.try_parse_json(t), path)), doc)
    assert read("a.1.b") == '"x"' and read("a.3.b") == "null" and read("a.x") is None and read("m.r.q.1") == "7"


def random_value(draw: random.Random, depth: int):
    if depth == 0 or draw.random() < 0.3:
        return draw.choice([None, True, False, 0, -7, 12, 3.25, "", "q", "é", "1"])
    if draw.random() < 0.5:
        return [random_value(draw, depth - 1) for _ in range(draw.randint(0, 3))]
    return {k: random_value(draw, depth - 1) for k in draw.sample("abcd", draw.randint(0, 4))}


def kind(v):  # tells true from 1, as JSON does
    return (type(v).__name__, [kind(x) for x in v] if isinstance(v, list) else {k: kind(x) for k, x in v.items()} if isinstance(v, dict) else v)


def test_random_documents(spark):
    draw, rows = random.Random(3), []
    for i in range(400):
        a = random_value(draw, 3)
        b = copy.deepcopy(a) if draw.random() < 0.5 else random_value(draw, 3)
        if isinstance(b, dict):
            b = dict(draw.sample(list(b.items()), len(b)))
        rows.append((i, json.dumps(a), json.dumps(b)))
    got = spark.createDataFrame(rows, "i long, a string, b string").select("i", jv.same_json(F.col("a"), F.col("b")).alias("same"), jv.canonical(F.col("a")).alias("c"), jv.with_value(F.col("a"), "$.a[1]", F.lit("[0]")).alias("s")).collect()
    for r in got:
        a, b = json.loads(rows[r["i"]][1]), json.loads(rows[r["i"]][2])
        assert r["same"] == (kind(a) == kind(b)), rows[r["i"]]
        assert json.loads(r["c"]) == a
        a = a if isinstance(a, dict) else {}
        old = a["a"] if isinstance(a.get("a"), list) else []
        assert json.loads(r["s"]) == a | {"a": [old[0] if old else None, [0], *old[2:]]}


def test_values_of_a_kind(spark):
    doc = F.try_parse_json(F.lit('{"a": [{"b": 1, "c": [1, "x", null]}, {"b": null}, 7, {"b": {"d": 2}, "c": {"k": 3.50}}]}'))
    found = spark.range(1).select(jv.values_at(doc, "$.a[*].b", "string").alias("b"), jv.values_at(doc, "$.a[*].c[*]", "long").alias("c"), jv.values_at(doc, "$.a[*]", "struct<b:int>").alias("s"), jv.values_at(doc, "$.a[1].b", "int").alias("n")).first()
    assert found["b"] == ["1", None, '{"d":2}'] and found["c"] == [1, None, None, 3] and found["n"] == [None]
    assert [s and s["b"] for s in found["s"]] == [1, None, None, None]
