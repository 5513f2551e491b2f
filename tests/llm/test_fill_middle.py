"""Fill-in-the-middle: a plain version of the rules, exact round trip, edges."""

from __future__ import annotations

import hashlib
import re

import duckdb
import pytest
from fixtures import documents, prose, rows_of, with_clashing_columns
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from granary.llm import fill_middle, registry


def plain_version(doc_id: int, text: str | None) -> tuple:
    text = text or ""
    lines = re.findall(r"[^\n]*\n|[^\n]+", text)
    digest = hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[i : i + 8], 16) for i in (0, 8, 16, 24))
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 100:
        return doc_id, len(lines), "plain", None, None, sha(text), sha(text)
    a, b = sorted((h1 % (len(lines) + 1), h2 % (len(lines) + 1)))
    prefix, middle, suffix = "".join(lines[:a]), "".join(lines[a:b]), "".join(lines[b:])
    form = "spm" if h4 % 100 < 50 else "psm"
    out = f"<S>{suffix}<P>{prefix}<M>{middle}" if form == "spm" else f"<P>{prefix}<S>{suffix}<M>{middle}"
    return doc_id, len(lines), form, len(prefix), len(middle), sha(out), sha(text)


ORDER = ("doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256")


def test_query(spark, medium):
    texts = spark.read.parquet(f"{medium}/documents.parquet").select("doc_id", "text").collect()
    found = registry.op11_fill_middle(spark, medium).select(*ORDER)
    assert rows_of(found) == sorted((plain_version(r["doc_id"], r["text"]) for r in texts), key=repr)
    assert {r["form"] for r in found.select("form").distinct().collect()} >= {"psm", "spm"}


def test_query_equals_sql(spark, medium):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{medium}/documents.parquet'")
    want = sorted((tuple(r) for r in con.execute(f"select {', '.join(ORDER)} from ({fill_middle.SQL})").fetchall()), key=repr)
    assert rows_of(registry.op11_fill_middle(spark, medium).select(*ORDER)) == want


def test_edges(spark, tmp_path):
    rows = [(1, None), (2, ""), (3, "\n"), (4, "a\n\n\nb"), (5, "x <P> y\nz"), (6, "<M>"), (7, "no feed"), (None, "a\nb\nc"), (8, "é\n日本\n😀 <\nS>\n<S"), (9, prose(300_000, 1)), (10, "l\n" * 200_000), (11, "same\ntext\n"), (11, "same\ntext\n"), (-3, "<\n<S\n>\r\n\x0b")]
    docs = with_clashing_columns(documents(spark, rows))
    wanted = tuple(fill_middle.KINDS)
    found = docs.select("doc_id", "text", fill_middle.fill_middle(docs, wanted=wanted).alias("f")).select("doc_id", "text", "f.*")
    assert rows_of(found.select("doc_id", F.col("n_units").alias("n"), *ORDER[2:])) == sorted((plain_version(i, t) for i, t in rows), key=repr)
    for r in found.select("text", fill_middle.restored(F.col("output"), F.col("form")).alias("back")).collect():
        assert r["back"] == (r["text"] or "")
    none = documents(spark, [])
    assert none.select(fill_middle.fill_middle(none).alias("f")).count() == 0


@settings(max_examples=500, deadline=None)
@given(st.text(alphabet="<>PSM\na", max_size=30), st.tuples(*[st.integers(0, 2**32 - 1)] * 4))
def test_round_trip_with_pieces_of_marks(text, draw):
    n, form, prefix, middle, output = fill_middle.rearranged(text, draw, fill_middle.LINES, fill_middle.MARKS, 100, 50)
    assert fill_middle.rebuilt(output, form, fill_middle.MARKS) == text
    assert (form == "plain") == (not text or any(m in text for m in fill_middle.MARKS))


def test_rates_units_and_marks(spark):
    docs = documents(spark, [(i, f"{i} words of a text that go on") for i in range(400)])
    f = fill_middle.fill_middle(docs, seed=3, units=r"\w+\s*", marks=("[p]", "[s]", "[m]"), change_percent=30, spm_percent=0)
    forms = {r["form"]: r["count"] for r in docs.select(f.alias("f")).groupBy("f.form").count().collect()}
    assert set(forms) == {"plain", "psm"} and 80 < forms["psm"] < 160
    for bad in (("<P>", "<P>", "<M>"), ("", "a", "b"), ("a", "ab", "c"), ("<P<", "<S>", "<M>")):
        with pytest.raises(ValueError):
            fill_middle.fill_middle(docs, marks=bad)
