"""Anchor dedup: a dictionary of all windows, SQL, covers, edges."""

from __future__ import annotations

import hashlib
import random

import duckdb
import numpy as np
import pytest
from fixtures import CLASHING, documents, prose, rows_of, with_clashing_columns, words
from pyspark.sql import functions as F

from granary.llm import anchor_dedup, registry

ORDER = ("doc_id", "n_words", "n_removed", "kept_sha256")


def plain_version(rows: list[tuple[int | None, str | None]], length: int) -> list[tuple]:
    first: dict[tuple, int] = {}
    split = [(i, (t or "").encode().split()) for i, t in rows]
    for i, w in split:
        if i is not None:
            for k in range(len(w) - length + 1):
                key = tuple(w[k : k + length])
                first[key] = min(first.get(key, i), i)
    out = []
    for i, w in split:
        gone = set()
        for k in range(len(w) - length + 1):
            if i is not None and first[tuple(w[k : k + length])] < i:
                gone |= set(range(k, k + length))
        out.append((i, len(w), len(gone), b" ".join(x for k, x in enumerate(w) if k not in gone).decode()))
    return sorted(out, key=repr)


def found(docs, length=anchor_dedup.LENGTH):
    return rows_of(anchor_dedup.without_repeats(docs, length).select("doc_id", "n_words", "n_removed", "kept_text"))


@pytest.mark.parametrize("period", anchor_dedup.COVERS)
def test_covers(period):
    differences = {(a - b) % period for a in anchor_dedup.COVERS[period] for b in anchor_dedup.COVERS[period]}
    assert differences == set(range(period))


def test_query_equals_sql(spark, medium):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{medium}/documents.parquet'")
    want = sorted((tuple(r) for r in con.execute(f"select {', '.join(ORDER)} from ({anchor_dedup.SQL})").fetchall()), key=repr)
    got = rows_of(registry.op13_anchor_dedup(spark, medium).select(*ORDER))
    assert got == want and sum(r[2] for r in got) > 1000


def test_query_equals_plain_version(spark, small):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{small}/documents.parquet").collect()]
    want = [(i, n, k, hashlib.sha256(t.encode()).hexdigest()) for i, n, k, t in plain_version(rows, 13)]
    assert rows_of(registry.op13_anchor_dedup(spark, small).select(*ORDER)) == sorted(want, key=repr)


@pytest.mark.parametrize("length", [1, 5, 13, 30])
def test_random_texts_in_small_blocks(spark, length, monkeypatch):
    """Few different words, so that windows repeat at all shifts, and blocks of a few documents."""
    monkeypatch.setattr(anchor_dedup, "block_bytes", lambda total: 600)
    draw = random.Random(length)
    passages = [words(draw.randint(length, 3 * length), s) for s in range(6)]
    rows: list[tuple[int | None, str | None]] = []
    for i in range(150):
        text: list[str] = []
        for _ in range(draw.randint(0, 4)):
            text += draw.choice(passages) if draw.random() < 0.5 else [draw.choice("ab") for _ in range(draw.randint(1, 2 * length))]
        rows.append((draw.randrange(120), draw.choice([" ", "\n", " \t\r\n", "\x0b\x0c"]).join(text)))
    assert found(documents(spark, rows).repartition(3), length) == plain_version(rows, length)


def test_edges(spark, monkeypatch):
    monkeypatch.setattr(anchor_dedup, "block_bytes", lambda total: 200_000)
    shared, long_one = prose(13, 1), prose(60_000, 2)
    rows = [(1, None), (2, ""), (3, " \n\t "), (4, shared), (5, f"x {shared} y"), (6, shared.rsplit(" ", 1)[0]), (7, long_one), (8, f"{prose(5, 3)} {long_one}"), (8, long_one), (None, long_one), (None, shared), (9, "a" * 500_000), (10, "z " * 40), (11, "z " * 13), (12, "é " + shared.replace(" ", " ")), (4, shared), (13, f"{shared[:-1]}é {shared}"), (-5, "q " * 14), (0, "q " * 20)]
    docs = with_clashing_columns(documents(spark, rows))
    assert found(docs) == plain_version(rows, 13)
    out = anchor_dedup.without_repeats(docs.withColumn("N_Words", F.lit("old")).withColumn("kept_text", F.lit("old")))
    assert set(CLASHING) <= set(out.columns) and dict(out.dtypes)["n_words"] == "bigint" and out.count() == len(rows)
    assert found(documents(spark, [])) == []


def test_hot_passage(spark, monkeypatch):
    """A third of all documents hold one passage; each block sends it once."""
    monkeypatch.setattr(anchor_dedup, "block_bytes", lambda total: 5_000)
    passage = prose(40, 9)
    rows = [(i, f"{prose(30, 100 + i)} {passage} {prose(20, 900 + i)}" if i % 3 == 0 else prose(60, 5000 + i)) for i in range(600)]
    got = found(documents(spark, rows))
    assert got == plain_version(rows, 13) and sum(r[2] == 40 for r in got) == 199


def test_word_hashes_tell_words_apart():
    texts = [b"a", b"b", b"ab", b"a\x00", b"12345678", b"123456780", b"12345678\x00", b"x" * 64, b"x" * 65, b"x" * 66, b"87654321" * 3]
    data = np.frombuffer(b" ".join(texts), np.uint8)
    starts, ends = anchor_dedup.word_bounds(data)
    assert [data[a:b].tobytes() for a, b in zip(starts, ends, strict=True)] == texts
    assert len(set(anchor_dedup.word_hashes(data, starts, ends).tolist())) == len(texts)
