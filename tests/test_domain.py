"""Conditions, rule functions, calculations and change shapes on hand-made values."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from granary.functions import json_values as jv
from granary.operators import domain as d
from granary.operators import similarity as sim


def test_calculation_allows_only_named_fields(spark):
    row = spark.range(1).select(F.lit(7.0).alias("claimed"), F.lit(2.0).alias("cap"))
    assert row.select(d.calculation("claimed * 2 >= (cap + 5) * 2", {"claimed", "cap"})).first()[0] is True
    for bad in ("claimed; drop", "java_method(1)", "claimed > other", "'x'"):
        with pytest.raises(ValueError, match="not allowed"):
            d.calculation(bad, {"claimed", "cap"})


def test_sequences_and_unknown_conditions(spark):
    row = spark.range(1).select(F.array(*map(F.lit, "abcab")).alias("outcomes"), F.array(F.lit("x")).alias("docs"), F.lit(5).alias("amount"), F.create_map(F.lit("s"), F.lit(2.0)).alias("stages"))
    specs = [{"kind": "past_outcome_seq", "sequence": list(x)} for x in ("acb", "cc", "abcab", "ba")] + [{"kind": "doc_missing", "doc": "x"}, {"kind": "stage_dwell", "stage": "t", "hours": 1}, {"kind": "?"}]
    assert list(row.select(*map(d.condition, specs)).first()) == [True, False, True, True, False, False, None]


def test_shapes_and_json_equality(spark):
    values = [('"abc"', '"abc"', "no_change"), ('"abc"', "1", "type_change"), ('"abcd"', '"bc"', "truncation"), ('"abc"', '"xyz"', "replacement"), ("1", "2.5", "numeric"), ('{"a":1}', '{"a":2}', "structural"), (None, '"a"', "type_change"), (None, None, "no_change")]
    df = spark.createDataFrame(values, "a string, b string, want string")
    assert df.where(d.shape_of_change(F.col("a"), F.col("b")) != F.col("want")).count() == 0
    pair = spark.createDataFrame([('{"a":1,"b":2}', '{"b":2,"a":1}', True), ('{"a":1}', '{"a":2}', False), (None, None, True)], "a string, b string, want boolean")
    assert pair.where(jv.same_json(F.col("a"), F.col("b")) != F.col("want")).count() == 0


def test_rule_functions_skip_what_they_do_not_know(spark):
    row = spark.range(1).select(F.lit(9).alias("days"), F.lit(4).alias("benchmark_days"), F.lit(None).cast("int").alias("icu_days"))
    assert list(row.select(d.rule_function("validate_los_against_benchmark"), d.rule_function("validate_los_against_benchmark", {"tolerance": 5}), d.rule_function("validate_icu_stay"), d.rule_function("nothing")).first()) == ["FAIL", "PASS", "SKIP", "SKIP"]


def test_names_join_the_first_cluster_near_enough(spark):
    rows = [("c", "sharma", 5.0), ("c", "sharna", 1.0), ("c", "kumar", 4.0), ("c", "kumor", 2.0), ("c", "sharma", 1.0), ("e", "a", 1.0), ("e", "b", 1.0)]
    got = {(r["claim"], r["name"]): r["cluster"] for r in sim.clustered_names(spark.createDataFrame(rows, "claim string, name string, weight double"), "claim").collect()}
    assert got == {("c", "sharma"): "sharma", ("c", "sharna"): "sharma", ("c", "kumar"): "kumar", ("c", "kumor"): "kumar", ("e", "a"): "a", ("e", "b"): "b"}


def test_margin_decides(spark):
    rows = [("m", 1, 1.0), ("m", 2, 0.5), ("n", 1, 1.0), ("n", 2, 0.75), ("o", 1, 0.4), ("p", 3, 0.5)]
    got = {(r["k"], r["c"]) for r in d.disambiguated(spark.createDataFrame(rows, "k string, c long, share double"), "k", "c").collect()}
    assert got == {("m", 1), ("p", 3)}


def test_d14_identity_mismatch_normalises_a_name_before_pairs_are_made(spark, small):
    from granary.plans import domain

    plan = domain.d14_identity_mismatch(spark, small)._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_replace" in plan and "regexp_replace" not in plan[: plan.index("Join")]


def test_r3_fuzzy_names_normalises_a_name_before_pairs_are_made(spark, small):
    from granary.plans import domain

    plan = domain.r3_fuzzy_names(spark, small)._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_replace" in plan and "regexp_replace" not in plan[: plan.index("Join")]
