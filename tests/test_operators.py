"""Relational compositions, rules and similarity on edge cases."""

from __future__ import annotations

from pyspark.sql import functions as F

from granary.operators import mining, rules
from granary.operators import relational as rel
from granary.operators import similarity as sim


def test_comparisons_are_two_valued(spark):
    row = spark.createDataFrame([(None, 5)], "a int, b int")
    ops = "EQUALS NOT_EQUALS GREATER_THAN LESS_THAN IN NOT_IN EXISTS NOT_EXISTS CONTAINS NOT_CONTAINS MATCHES_PATTERN NOPE".split()
    missing = row.select(*(rel.compared(op, F.col("a"), F.lit(5)).alias(op) for op in ops)).first().asDict()
    assert [op for op in ops if missing[op]] == ["NOT_EQUALS", "NOT_IN", "NOT_EXISTS", "NOT_CONTAINS"]


def test_upsert_is_idempotent_for_greatest(spark):
    old, new = spark.createDataFrame([(1, 5), (2, 1)], "k int, v int"), spark.createDataFrame([(2, 7), (3, 2)], "k int, v int")
    once = rel.upserted(old, new, ["k"], {"v": "greatest"})
    assert sorted((r["k"], r["v"], r["action"]) for r in once.collect()) == [(1, 5, "kept"), (2, 7, "updated"), (3, 2, "inserted")]
    twice = rel.upserted(once.drop("action"), new, ["k"], {"v": "greatest"})
    assert sorted((r["k"], r["v"]) for r in twice.collect()) == [(1, 5), (2, 7), (3, 2)]


def test_insert_if_absent_takes_one_per_key(spark):
    target, rows = spark.createDataFrame([(1, "x")], "k int, v string"), spark.createDataFrame([(1, "a"), (2, "b"), (2, "c")], "k int, v string")
    assert [tuple(r) for r in rel.inserted_if_absent(target, rows, ["k"], [F.asc("v")]).collect()] == [(2, "b")]


def test_page_ranges_and_cover(spark):
    pages = spark.createDataFrame([(1, p) for p in (4, 5, 6, 7, 11, 5)] + [(2, 3)], "d int, page int")
    assert {r["d"]: r["pages"] for r in rel.page_ranges(pages, ["d"], "page").collect()} == {1: "4-7, 11", 2: "3"}
    sections = spark.createDataFrame([(1, 1, 3), (1, 4, 5), (2, 1, 2), (2, 4, 5), (3, 1, 4), (4, 3, 1)], "d int, first_page int, last_page int")
    assert {r["d"]: r["fault"] for r in rel.cover_faults(sections, "d", F.lit(5)).collect()} == {1: None, 2: "coverage_gap_or_overlap", 3: "last_page_mismatch", 4: "inverted_range"}


def test_subsequence(spark):
    rows = spark.createDataFrame([(["a", "x", "b", "c"],), (["b", "a", "c"],), ([],)], "l array<string>")
    assert [r[0] for r in rows.select(rel.in_order(F.col("l"), ("a", "b", "c"))).collect()] == [True, False, False]


def test_rules_abstain_fail_and_err(spark):
    rows = spark.createDataFrame([(1, 5, 0.9), (2, None, 0.1)], "k int, v int, sure double")
    own = [rules.Rule("a", "v", "GREATER_THAN", (3,), "CRITICAL", 0.5), rules.Rule("b", "nowhere", "EXISTS", (), "HIGH"), rules.Rule("c", "v", "EXISTS", (), "LOW")]
    got = {r["k"]: r for r in rules.readiness(rows, "k", own, "sure").collect()}
    assert (got[1]["score"], got[1]["errored"]) == (100, "b")
    assert (got[2]["score"], got[2]["abstained"], got[2]["warnings"]) == (98, "a", "c")
    assert {(r["k"], r["rule_id"]): r["status"] for r in rules.evaluated(rows, "k", own, "sure").collect()}[2, "a"] == "SKIP"


def test_score_floor(spark):
    own = [rules.Rule(f"r{i}", "v", "EQUALS", (1,), "CRITICAL") for i in range(6)]
    assert rules.readiness(spark.createDataFrame([(1, 0)], "k int, v int"), "k", own).first()["score"] == 0


def test_digests_and_vectors(spark):
    rows = spark.createDataFrame([(1, "A b"), (2, "a  B!"), (3, None), (4, ""), (5, "日本")], "id long, t string")
    assert {r[0]: r[1] for r in sim.first_of_equal(rows, sim.text_digest(F.col("t")), "id").collect()} == {1: 1, 2: 1, 3: 3, 4: 4, 5: 5}
    v = spark.createDataFrame([(0, [1.0, 0.0], "f"), (1, [1.0, 0.1], "f"), (2, [0.0, 0.0], "f"), (3, [1.0, 0.0], "g")], "id long, v array<double>, facet string")
    assert [r["neighbour_id"] for r in sim.nearest(v.where("id = 0"), v, "id", "v", ["facet"], 3).collect()] == [1]


def test_nearest_rank_percentile(spark):
    dwell = spark.createDataFrame([("a", float(i)) for i in range(1, 21)] + [("b", 1.0)], "k string, dwell_s double")
    got = mining.dwell_stats(dwell, ["k"]).collect()
    assert [(r["k"], r["n"], r["p95_s"]) for r in got] == [("a", 20, 20.0)]


def test_most_alike_searches_all_earlier_cases(spark):
    from datetime import date

    from granary.operators import similarity

    rows = [(1, date(2024, 1, 1), "a", "x", "p", 100.0), (2, date(2024, 1, 2), "b", "x", "p", 100.0), (3, date(2024, 1, 3), "a", "y", "q", 900.0), (4, date(2024, 1, 4), "a", "x", "p", 100.0), (5, date(2024, 1, 4), "a", None, "p", 0.0)]
    got = similarity.most_alike(spark.createDataFrame(rows, "case_id long, opened date, panel string, kind string, priority string, claimed double"), 2).collect()
    want = {(2, 1): 7 / 11, (3, 1): (4 + 2 / 9) / 11, (3, 2): (2 / 9) / 11, (4, 1): 1.0, (4, 2): 7 / 11, (5, 4): 6 / 8, (5, 1): 6 / 8}
    assert {(r["case_id"], r["other"]): r["score"] for r in got} == {k: round(v, 6) for k, v in want.items()}


def test_most_alike_equals_all_pairs_in_blocks_of_any_size(spark):
    import datetime
    import random

    import duckdb
    import pandas as pd

    from granary.operators import similarity

    rng = random.Random(3)
    start = datetime.date(2024, 1, 1)
    amounts = [0.0, 0.3, 5.0, 100.0, 100.0, 100.0002, 100.0004, 250_000.0, 250_000.4, 250_000.8, 3e9]
    rows = [(i, start + datetime.timedelta(rng.randrange(40)), rng.choice("ab"), rng.choice("xxxy"), rng.choice("ppq"), rng.choice(amounts) if rng.random() < 0.5 else round(rng.uniform(0, 400_000), 2)) for i in rng.sample(range(5000), 700)]
    cases = pd.DataFrame(rows, columns=["case_id", "opened", "panel", "kind", "priority", "claimed"])
    sql = """with s as (select q.case_id, c.case_id as other, c.opened, round((4 * (q.panel = c.panel)::int + 3 * (q.kind = c.kind)::int + 2 * (q.priority = c.priority)::int + 2 * (1 - least(1, abs(q.claimed - c.claimed) / greatest(q.claimed, c.claimed, 1)))) / 11, 6) as score
from cases q join cases c on c.opened < q.opened or (c.opened = q.opened and c.case_id < q.case_id)) select case_id, other, score from (select *, row_number() over (partition by case_id order by score desc, opened desc, other desc) as k from s) where k <= 5"""
    want = sorted(duckdb.sql(sql).fetchall())
    table = spark.createDataFrame(rows, "case_id long, opened date, panel string, kind string, priority string, claimed double")
    for block_rows, most_rows in ((1 << 16, 1 << 20), (50, 100)):
        assert sorted(map(tuple, similarity.most_alike(table, 5, block_rows, most_rows).collect())) == want
