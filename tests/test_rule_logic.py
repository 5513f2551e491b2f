"""Rules over documents: operators one by one, trees, evidence, broken rules and documents."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from granary.operators import rule_logic as rl

DOC = {"a": 5, "s": "text", "l": [1, 2, "x"], "n": None, "o": {"p": 2.50}, "zero": 0}


def run(spark, logic, doc=DOC, **more):
    docs = spark.createDataFrame([(1, doc if doc is None or isinstance(doc, str) else json.dumps(doc))], "k long, d string")
    r = rl.evaluated(docs, "k", "d", [{"rule_id": "r", "logic": logic}], **more).first()
    return r["status"], json.loads(r["evidence"])


def test_operators(spark):
    tests = [
        ("$.a", "EQUALS", 5, True), ("$.a", "EQUALS", 5.0, True), ("$.a", "EQUALS", "5", False), ("$.none", "NOT_EQUALS", 5, True), ("$.none", "EQUALS", None, False), ("$.n", "EQUALS", None, True), ("$.a", "GREATER_THAN", 4, True), ("$.s", "GREATER_THAN", 4, False), ("$.none", "LESS_THAN", 4, False),
        ("$.o.p", "LESS_THAN_OR_EQUAL", 2.5, True), ("$.a", "GREATER_THAN_OR_EQUAL", 6, False), ("$.a", "BETWEEN", [1, 5], True), ("$.a", "BETWEEN", [1], False), ("$.a", "NOT_BETWEEN", [6, 9], True), ("$.s", "IN", ["text", 1], True), ("$.a", "IN", ["5"], False), ("$.none", "NOT_IN", [1], True), ("$.a", "NOT_IN", 5, False),
        ("$.n", "EXISTS", None, False), ("$.none", "NOT_EXISTS", None, True), ("$.l", "CONTAINS", "x", True), ("$.l", "CONTAINS", "1", False), ("$.s", "CONTAINS", "ex", True), ("$.a", "CONTAINS", "5", False), ("$.l", "NOT_CONTAINS", 7, True), ("$.a", "NOT_CONTAINS", 5, False), ("$.s", "MATCHES_PATTERN", "^t.*t$", True), ("$.none", "MATCHES_PATTERN", "^$", True), ("$.s", "MATCHES_PATTERN", "(", False), ("$.a", "LIKE", 5, False), ("$.l[*]", "CONTAINS", 2, True),
    ]
    rules = [{"rule_id": str(i), "logic": {"logic_type": "SIMPLE_COMPARISON", "json_path": p, "operator": o, "expected_value": w}} for i, (p, o, w, _) in enumerate(tests)]
    docs = spark.createDataFrame([(1, json.dumps(DOC))], "k long, d string")
    got = {int(r["rule_id"]): r["status"] for r in rl.evaluated(docs, "k", "d", rules).collect()}
    assert [(tests[i], got[i]) for i in got if (got[i] == "PASS") != tests[i][3]] == []


def test_kinds(spark):
    assert run(spark, {"logic_type": "EXISTENCE_CHECK", "json_path": "$.l[*]"}) == ("PASS", {"matches": 3})
    assert run(spark, {"logic_type": "EXISTENCE_CHECK", "json_path": "$.l[9]", "operator": "NOT_EXISTS"}) == ("PASS", {"matches": 0})
    calculation = {"logic_type": "CALCULATION", "calculation_formula": "(a + 1) * -p / 2", "fields": {"a": "$.a", "p": "$.o.p"}, "operator": "EQUALS", "expected_value": -7.5}
    assert run(spark, calculation) == ("PASS", {"value": -7.5})
    assert run(spark, calculation | {"calculation_formula": "a / z", "fields": {"a": "$.a", "z": "$.zero"}})[0] == "ERROR"
    for bad in ("a; drop", "__import__('os')", "a ** 2", "b", "", "a < 2"):
        assert run(spark, calculation | {"calculation_formula": bad})[0] == "ERROR"
    assert run(spark, {"logic_type": "SIMPLE_COMPARISON", "json_path": "broken"})[0] == "ERROR" and run(spark, {})[0] == "ERROR"
    table = spark.createDataFrame([("text",), ("text",), (None,), ("5",)], "code string")
    look = {"logic_type": "LOOKUP_TABLE", "lookup_table_ref": "t", "json_path": "$.s"}
    assert run(spark, look, tables={"t": table}) == ("PASS", {"actual": '"text"'})
    assert run(spark, look | {"json_path": "$.none"}, tables={"t": table})[0] == "FAIL" and run(spark, look)[0] == "ERROR"


@pytest.mark.parametrize(("kind", "parts", "want"), [("ALL", "PP", "PASS"), ("ALL", "PFE", "FAIL"), ("ALL", "PE", "ERROR"), ("ALL", "PS", "PASS"), ("ALL", "SS", "SKIP"), ("ANY", "FPE", "PASS"), ("ANY", "FE", "ERROR"), ("ANY", "FS", "FAIL"), ("ANY", "S", "SKIP"), ("NOT", "P", "FAIL"), ("NOT", "S", "SKIP"), ("NOT", "PP", "ERROR"), ("ALL", "", "ERROR")])
def test_trees(spark, kind, parts, want):
    states = {"P": "PASS", "F": "FAIL", "S": "SKIP", "E": "ERROR"}
    functions = {k: (lambda doc, v=v: F.lit(v)) for k, v in states.items()}
    logic = {"logic_type": "ALL", "rules": [{"logic_type": kind, "rules": [{"logic_type": "CUSTOM", "custom_function": p} for p in parts]}]}
    assert run(spark, logic, functions=functions)[0] == want


def test_documents_without_values(spark):
    for doc in (None, "", "{"):
        assert run(spark, {"logic_type": "EXISTENCE_CHECK", "json_path": "$.a"}, doc) == ("FAIL", {"matches": 0})
    assert rl.evaluated(spark.createDataFrame([], "k long, d string"), "k", "d", [{"rule_id": "r", "logic": {}}]).count() == 0


def test_episode_functions(spark):
    doc = lambda v: spark.createDataFrame([(json.dumps(v),)], "d string").select(F.try_parse_json("d").alias("d"))
    told = lambda f, v: doc(v).select(f(F.col("d"))).first()[0]
    sick = {"diagnosis": {"primary_diagnosis": {"icd_code": "i22.1"}}}
    tests = lambda *t: sick | {"clinical_timeline": [{"diagnostics_performed": list(t)}, {}]}
    enzyme = {"diagnostic_meta": {"test_name_normalized": "CK-MB mass"}}
    assert told(rl.cardiac_enzymes, {}) == "SKIP" and told(rl.cardiac_enzymes, sick) == told(rl.cardiac_enzymes, tests(enzyme)) == "FAIL"
    assert told(rl.cardiac_enzymes, tests(enzyme | {"interpretation": "abnormal_high"})) == "PASS" and told(rl.cardiac_enzymes, tests(enzyme | {"value": "7", "reference_range_high": 6})) == "PASS"
    stay = lambda *p: {"meta": {"episode_type": "Medical_Management"}, "clinical_timeline": list(p)}
    icu = {"phase_code": "icu", "duration": {"value": 96, "unit": "HOURS"}}
    assert told(rl.icu_stay, stay()) == "SKIP" and told(rl.icu_stay, stay(icu)) == "FAIL" and told(rl.icu_stay, stay(icu | {"daily_progress": ["a", "b", {}]})) == "PASS" and told(rl.icu_stay, stay({"room_category": "ICU", "days": 3})) == "PASS"
    charged = {"financial_summary": {"line_items": [{"description": "physio visit"}]}}
    assert told(rl.physiotherapy, {}) == "SKIP" and told(rl.physiotherapy, charged) == "FAIL"
    assert told(rl.physiotherapy, charged | {"treatment_plan": {"x": "Physio daily"}, "clinical_timeline": [{"daily_progress": [{"note": "PHYSIO"}]}]}) == "PASS"


def test_parts_of_deep_trees_are_evaluated_once(spark):
    leaf = {"logic_type": "SIMPLE_COMPARISON", "json_path": "$.a", "operator": "EQUALS", "expected_value": 5}
    tree = leaf
    for _ in range(4):
        tree = {"logic_type": "ALL", "rules": [tree, leaf]}
    docs = spark.createDataFrame([(1, json.dumps(DOC))], "k long, d string")
    found = rl.evaluated(docs, "k", "d", [{"rule_id": "r", "logic": tree}])
    plan = found._jdf.queryExecution().analyzed().toString()
    assert plan.count("variant_get") <= 5 * 2 and plan.count("try_parse_json") == 1
    assert found.first()["status"] == "PASS"


def test_episode_functions_read_each_part_once(spark):
    """One pass over a list makes typed rows of it; a variant taken out at every step of a path would be a copy each time."""
    docs = spark.createDataFrame([("{}",)], "d string").select(F.try_parse_json("d").alias("d"))
    reads = [docs.select(f(F.col("d")))._jdf.queryExecution().analyzed().toString().count("variant_get") for f in (rl.cardiac_enzymes, rl.icu_stay, rl.physiotherapy)]
    assert all(n <= most for n, most in zip(reads, (12, 10, 20), strict=True)), reads


def test_phases_with_parts_of_other_types(spark):
    doc = lambda v: spark.createDataFrame([(json.dumps(v),)], "d string").select(F.try_parse_json("d").alias("d"))
    stay = {"meta": {"episode_type": "medical_management"}, "clinical_timeline": {"a": 3, "b": {"phase_code": ["icu"], "duration": "long", "days": "4", "daily_progress": {"x": None, "y": 1, "z": "n"}}}}
    assert doc(stay).select(rl.icu_stay(F.col("d"))).first()[0] == "PASS"
    stay["clinical_timeline"]["b"]["daily_progress"].pop("z")
    assert doc(stay).select(rl.icu_stay(F.col("d"))).first()[0] == "FAIL"
