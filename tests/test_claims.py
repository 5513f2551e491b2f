"""Dossiers against a plain fold in order, and edge cases of entities, bills, fusion, slots and sections."""

from __future__ import annotations

import json
import random

from pyspark.sql import functions as F

from granary.functions import entities as en
from granary.operators import dossier as ds
from granary.operators import fusion as fu
from granary.operators import similarity as sim

LOG = "claim long, event_id long, us long, kind string, payload string"


def plain_fold(events):
    """Events of one claim, one after the other."""
    state = {"version": 0, "stage": None, "closed": None, "outcome": None, "open": {}, "sections": set()}
    for _, us, kind, payload in sorted({e[0]: e for e in events}.values(), key=lambda e: (e[1], e[0])):
        p = {k: v for k, v in json.loads(payload or "{}").items() if v}
        state["version"] += 1
        if kind == "claim_created":
            state["stage"] = p.get("initial_stage", state["stage"])
        elif kind in ("stage_transitioned", "stage_changed"):
            state["stage"] = p.get("after_stage", p.get("to", state["stage"]))
        elif kind == "claim_closed":
            state["closed"], state["outcome"] = us, p.get("outcome")
        elif kind == "section_classified" and "category" in p and "section_id" in p:
            state["sections"].add((p["category"], p["section_id"]))
        for name, (key, adds, removes) in ds.LISTS.items():
            if kind in adds and key in p:
                state["open"].setdefault((name, p[key]), us)
            elif kind in removes and key in p:
                state["open"].pop((name, p[key]), None)
    return state


def test_dossier_equals_plain_fold(spark):
    rng = random.Random(3)
    kinds = [*ds.KNOWN, *ds.UNFOLDED, "other"]
    log = []
    for i in range(1500):
        item = rng.choice(["a", "b", "", None])
        payload = {"query_id": item, "draft_id": item, "action_id": item, rng.choice(["after_stage", "to", "initial_stage"]): rng.choice(["s1", "s2", ""]), "outcome": rng.choice(["paid", None]), "category": rng.choice(["x", "y", None]), "section_id": rng.choice(["1", "2"])}
        log.append((rng.randrange(12), i, rng.randrange(200), rng.choice(kinds), rng.choice([json.dumps(payload)] * 9 + [None])))
    log += log[:50]  # repeated rows
    df = spark.createDataFrame(log, LOG)
    want = {c: plain_fold([e[1:] for e in log if e[0] == c]) for c in {e[0] for e in log}}
    found = {r.claim: r for r in ds.dossier(df).collect()}
    assert {c: (r.version, r.stage, r.closed_us, r.outcome, r.n_sections) for c, r in found.items()} == {c: (s["version"], s["stage"], s["closed"], s["outcome"], len(s["sections"])) for c, s in want.items()}
    items = {(r.claim, r.list, r.item, r.opened_us) for r in ds.open_items(df).collect()}
    assert items == {(c, *k, us) for c, s in want.items() for k, us in s["open"].items()} and items


def test_ingest(spark):
    log = [(1, 1, 0, "a", '{"x":"1"}', "k"), (1, 2, 0, "a", '{"x":""}', "k"), (1, 3, 0, "a", '{"x":2}', "k"), (1, 4, 0, "b", "{}", None), (1, 5, 0, "b", "{}", None), (2, 6, 0, "a", '{"x":"1"}', "k"), (2, 7, 0, None, "{}", "k"), (2, 8, 0, "b", "{", "q"), (2, 9, 0, "c", "{}", "q"), (2, 10, 0, "b", "{}", "q")]
    found = ds.ingested(spark.createDataFrame(log, LOG + ", idem string"), {"a": ("x",), "b": ()}, "idem")
    assert [r.verdict for r in found.orderBy("event_id").collect()] == ["accepted", "invalid_payload", "duplicate", "accepted", "accepted", "accepted", "unknown_kind", "invalid_payload", "unknown_kind", "accepted"]


def test_empty_log(spark):
    empty = spark.createDataFrame([], LOG)
    assert ds.dossier(empty).count() == ds.open_items(empty).count() == 0


def one(spark, column, text):
    return spark.createDataFrame([(text,)], "t string").select(column(F.col("t"))).first()[0]


def test_rupees_and_templates(spark):
    got = spark.createDataFrame([(v,) for v in (0.0, 999.4, 1000.0, 123456.0, 12345678.0, -1000.0)], "v double").select(en.rupees(F.col("v"))).collect()
    assert [r[0] for r in got] == ["₹0", "₹999", "₹1,000", "₹1,23,456", "₹1,23,45,678", "-₹1,000"]
    assert one(spark, lambda t: en.rendered("a {{x.y}} {{z}} {{gone}}", t, keep_missing=True), '{"x":{"y":[1,2]},"z":"q"}') == "a 1, 2 q {{gone}}"
    assert one(spark, lambda t: en.rendered("a {{x}}", t), None) == "a "


def test_bills(spark):
    rows = [(1, "final", 100.0, 100.5), (1, "final", 50.0, None), (2, "interim", None, 10.0), (2, "pharmacy", 5.0, None), (3, "fallback", None, 7.0), (4, "implant", 3.0, None), (4, "subbill", 4.0, None), (5, None, 9.0, None), (6, "final", 100.0, 200.0)]
    got = {r.claim: (r.hospital, r.total, r.n_sources, r.status) for r in fu.reconciled_bills(spark.createDataFrame(rows, "claim int, role string, stated double, line_sum double"), "claim").collect()}
    assert got == {1: (100.0, 100.0, 2, "discrepancy"), 2: (10.0, 10.0, 2, "reconciled"), 3: (None, None, 0, "no_financial_data"), 4: (None, 7.0, 2, "reconciled"), 5: (None, None, 0, "no_financial_data"), 6: (100.0, 100.0, 1, "discrepancy")}


def test_fusion(spark):
    rows = [(1, "A", 1, 0.9, "p2", "2001-01-01"), (1, " a ", 1, 0.5, "p1", "2020-01-01"), (1, "b", 2, 1.0, "p0", "2020-01-01"), (2, "x", 0, 0.99, "p", None)]
    facts = spark.createDataFrame(rows, "g int, value string, rank int, score double, page string, day string").withColumn("day", F.to_date("day")).withColumn("ref", F.lit("2020-02-01").cast("date"))
    got = {r.g: (r.value, r.confidence, r.contested) for r in fu.fused(facts, ["g"], "ref").collect()}
    assert got == {1: (" a ", 0.54, True), 2: ("x", 0.99, False)}


def test_slots(spark):
    facts = spark.createDataFrame([(1, 1, "c", "f", " "), (1, 2, "c", "f", "v2"), (1, 3, "c", "f", "v3"), (1, 4, "d", "f", "w"), (2, 5, "c", "f", "v"), (3, 6, "d", "f", "w")], "claim int, section int, category string, field string, value string")
    existing = spark.createDataFrame([(2, "s", "old"), (3, "s", "")], "claim int, slot string, value string")
    excluded = spark.createDataFrame([(1, 2), (1, 2)], "claim int, section int")
    got = {(r.claim, r.slot, r.value, r.section) for r in fu.filled_slots(existing, facts, excluded, {"s": [("c", "f"), ("d", "f")], "t": [("d", "f")]}).collect()}
    assert got == {(1, "s", "v3", 3), (1, "t", "w", 4), (2, "s", "old", None), (3, "s", "w", 6), (3, "t", "w", 6)}


def test_near_sections(spark):
    a, far = "0" * 64, "f" * 64
    near = "0" * 60 + "ffff"
    rows = [(1, "c", [(a, a)]), (2, "c", [(near, near)]), (3, "c", [(a, far)]), (4, "c", [(a, a), (a, a)]), (5, "d", [(a, a)]), (6, "c", []), (7, "c", [(a, a)]), (8, "c", []), (9, "c", [("0" * 59 + "1ffff", a)])]
    got = {r.section: r.first_section for r in sim.near_sections(spark.createDataFrame(rows, "section int, claim string, pages array<struct<p:string,d:string>>"), "claim").collect()}
    assert got == {1: 1, 2: 1, 3: 3, 4: 4, 5: 5, 6: 6, 7: 1, 8: 6, 9: 1}


def test_sections_meet_as_keys_without_their_pages(spark, monkeypatch):
    from granary.operators import components as co

    met = []
    monkeypatch.setattr(co, "components", lambda pairs: met.append(pairs) or pairs.selectExpr("b as node", "a as component"))
    rows = [(i, "c", [(f"{i:064x}", f"{i:064x}")]) for i in range(3)]
    sim.near_sections(spark.createDataFrame(rows, "section int, claim string, pages array<struct<p:string,d:string>>"), "claim")
    plan = met[0].select("a", "b")._jdf.queryExecution().analyzed().toString()
    joined = [line for line in plan.splitlines() if "Join Inner" in line and "place" in line]
    assert joined, "sections meet by a key of their part"


def test_letters_of_one_small_file_are_read_by_many_tasks(spark, small):
    from granary.plans import claims

    assert claims.f6_letter_facts(spark, small).rdd.getNumPartitions() >= 2 * spark.sparkContext.defaultParallelism
