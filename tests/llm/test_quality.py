"""Quality rules against DuckDB and plain counts."""

from __future__ import annotations

import duckdb
from fixtures import documents, prose, rows_of, with_clashing_columns
from pyspark.sql import functions as F

from granary.llm import quality, registry


def test_query_equals_sql(spark, medium):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{medium}/documents.parquet'")
    want = con.execute(quality.SQL).fetchall()
    assert rows_of(registry.op7_quality_rules(spark, medium)) == sorted(want, key=repr)


def test_counts():
    assert quality.text_counts(None) == (0, 0, 0, 0, 0, 0)
    assert quality.text_counts("") == (0, 0, 0, 0, 0, 0)
    assert quality.text_counts("a b c a b c") == (6, 6, 0, 0, 6, 1)
    assert quality.text_counts("a a a a") == (4, 4, 0, 0, 4, 1)
    assert quality.text_counts("x\nx\n\n \ny\nx") == (4, 4, 0, 2, 0, 4)
    assert quality.text_counts("#a *$%&|<> b") == (2, 11, 8, 0, 0, 1)


def test_hosts(spark):
    good, bad = " ".join(f"word{i}" for i in range(80)), "too short"
    rows = [(i, good if i % 10 else bad) for i in range(200)]
    docs = documents(spark, rows, source="fine").unionByName(documents(spark, [(1000 + i, bad) for i in range(200)] + [(2000, good)], source="poor")).unionByName(documents(spark, [(3000, bad), (3001, good), (3002, good)], source="new"))
    docs = docs.unionByName(docs.where("doc_id = 2000").selectExpr("4000L as doc_id", "text", "lang", "cast(null as string) as source", "n_chars"))
    kept = {r["doc_id"]: r["kept"] for r in quality.judged(with_clashing_columns(docs)).collect()}
    assert kept[1] and not kept[0] and not kept[2000] and kept[3001] and kept[4000]


def brute_kept(rows: list[tuple[int, str, str | None]]) -> dict[int, tuple[bool, bool]]:
    """(base_failed, kept) by plain sums; host rates by the formulas of the docstring."""
    counts = {i: quality.text_counts(t) for i, t, _ in rows}
    rules = {
        "short": lambda c: c[0] < 50, "repeats": lambda c: 100 * c[4] > 50 * c[0], "symbols": lambda c: 5 * c[2] > c[0], "dup_lines": lambda c: 2 * c[3] > c[5],
    }
    by_host: dict[str, list] = {}
    for i, _, host in rows:
        if host is not None:
            by_host.setdefault(host, []).append(counts[i])
    bad = set()
    for rule in rules.values():
        n, f = {h: len(c) for h, c in by_host.items()}, {h: sum(map(rule, c)) for h, c in by_host.items()}
        total = sum(n.values())
        mean = sum(f.values()) / total
        variance = max((sum(f[h] ** 2 / n[h] for h in n) - total * mean**2 - (len(n) - 1) * mean * (1 - mean)) / total, 1e-6)
        strength = max(mean * (1 - mean) / variance - 1, 0)
        bad |= {h for h in n if (f[h] + mean * strength) / (n[h] + strength) > min(0.5, mean + 0.2)}
    failed = {i: rules["short"](c) or rules["repeats"](c) for i, c in counts.items()}
    return {i: (failed[i], not failed[i] and host not in bad) for i, _, host in rows}


def test_rejected_and_spared_hosts_of_the_real_table(spark, medium):
    """The table's own hosts are dealt at random, so none stands out; failing documents moved to hosts of their own do."""
    docs = spark.read.parquet(f"{medium}/documents.parquet")
    failing = [r["doc_id"] for r in quality.judged(docs).where("base_failed").collect()]
    assert quality.judged(docs).where("not host_ok").count() == 0
    moved = F.when(F.col("doc_id").isin(failing) | (F.col("doc_id") % 97 == 0), "junk").when(F.col("doc_id") == failing[0] + 1, "tiny").otherwise(F.col("source"))
    table = docs.withColumn("source", moved).union(docs.limit(1).select(F.lit(-1), F.lit("too short"), "lang", F.lit("tiny"), "n_chars"))
    want = brute_kept([(r["doc_id"], r["text"], r["source"]) for r in table.collect()])
    got = quality.judged(table)
    assert {r["doc_id"]: (r["base_failed"], r["kept"]) for r in got.collect()} == want
    rejected = {r["source"] for r in got.where("not host_ok").select("source").distinct().collect()}
    assert "junk" in rejected and not {f"src{i}" for i in range(20)} & rejected and any(not failed and not kept for failed, kept in want.values())


def test_salted_join_of_many_hosts(spark):
    measured = spark.createDataFrame([(i, f"h{i % 7}" if i % 5 else None) for i in range(200)], "doc_id long, source string")
    hosts = spark.createDataFrame([(f"h{i}", i % 2 == 0) for i in range(7)], "source string, host_ok boolean")
    assert rows_of(quality.with_hosts(measured, hosts, most=0).select("doc_id", "source", "host_ok")) == rows_of(quality.with_hosts(measured, hosts).select("doc_id", "source", "host_ok"))


def test_long_text_and_repeated_rows(spark):
    text = prose(200_000, 3)
    rows = quality.judged(documents(spark, [(1, text), (1, text), (2, "a b c " * 60_000)])).orderBy("doc_id").collect()
    assert [(r["n_words"], r["n_repeat_words"], r["base_failed"]) for r in rows] == [(200_000, 0, False)] * 2 + [(180_000, 180_000, True)]


def test_empty_table(spark):
    assert quality.judged(documents(spark, [])).count() == 0
