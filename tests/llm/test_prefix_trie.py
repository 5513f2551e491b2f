"""Prefix trie: a plain version, SQL, forced collisions, hot conversations, edges."""

from __future__ import annotations

import hashlib
import random
import zlib
from collections import defaultdict

import duckdb
import numpy as np
import pytest
from fixtures import rows_of, with_clashing_columns
from pyspark.sql import functions as F

from granary.llm import prefix_trie, registry

TURNS = "conv_id long, turn long, role string, text string"
ORDER = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def ordered(rows: list[tuple]) -> dict[int, list[tuple[str, str]]]:
    convs = defaultdict(list)
    for c, turn, role, text in sorted((r for r in rows if r[0] is not None), key=lambda r: (r[0], r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")):
        convs[c].append((role or "", text or ""))
    return dict(convs)


def plain_splice(convs: dict[int, list]) -> dict[int, list]:
    height = {c: zlib.crc32(str(c).encode()) % 4 for c in convs}
    return {c: convs.get(c - c % 20, [])[: height[c]] + convs[c][height[c] :] for c in convs}


def plain_trie(convs: dict[int, list]) -> list[tuple]:
    members = defaultdict(list)
    for c in sorted(convs):
        for d in range(len(convs[c]) + 1):
            members[tuple(convs[c][:d])].append(c)
    children = defaultdict(list)
    for p in members:
        if p:
            children[p[:-1]].append(p)
    leaves, saved = {}, {}
    for p in sorted(members, key=len, reverse=True):
        leaves[p] = sum(leaves[x] for x in children[p]) or 1
        saved[p] = sum(saved[x] for x in children[p]) + ((len(members[p]) - 1) * len(p[-1][1].encode().split()) if p else 0)
    ends = lambda p: hashlib.sha256(",".join(str(c) for c in members[p] if len(convs[c]) == len(p)).encode()).hexdigest()
    return sorted(((members[p][0], len(p), members[p[:-1]][0] if p else None, len(members[p]), len(children[p]), leaves[p], saved[p], ends(p)) for p in members), key=repr)


def found(turns, ids=None, primes=prefix_trie.PRIMES):
    return rows_of(prefix_trie.prefix_trie(turns, ids, primes).select(*ORDER))


def random_rows(n_convs: int, seed: int) -> list[tuple]:
    draw, rows = random.Random(seed), []
    for _ in range(n_convs):
        c = draw.randrange(3 * n_convs)
        rows += [(c, t if draw.random() < 0.9 else None, draw.choice(["user", "bot", None]), draw.choice(["a b", "a  b", "c", "", None, "d\ne"])) for t in range(draw.randint(1, 6))]
    return rows


def test_query_equals_plain_version(spark, medium):
    rows = [tuple(r) for r in spark.read.parquet(f"{medium}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert rows_of(registry.op12_prefix_trie(spark, medium).select(*ORDER)) == plain_trie(plain_splice(ordered(rows)))


def test_query_equals_sql(spark, medium):
    con = duckdb.connect()
    con.execute(f"create view conversations as select * from '{medium}/conversations.parquet'")
    want = sorted((tuple(r) for r in con.execute(f"select {', '.join(ORDER)} from ({prefix_trie.SQL})").fetchall()), key=repr)
    assert rows_of(registry.op12_prefix_trie(spark, medium).select(*ORDER)) == want


def test_random_conversations_with_splice(spark, tmp_path):
    rows = random_rows(120, 1)
    spark.createDataFrame(rows, TURNS).write.parquet(f"{tmp_path}/conversations.parquet")
    assert rows_of(registry.op12_prefix_trie(spark, str(tmp_path)).select(*ORDER)) == plain_trie(plain_splice(ordered(rows)))


@pytest.mark.parametrize("primes", [(2, 3), (5, 7)])
def test_collisions_are_split(spark, primes):
    """So few fingerprints that different prefixes share them at every depth."""
    rows = random_rows(60, 2)
    assert found(spark.createDataFrame(rows, TURNS), primes=primes) == plain_trie(ordered(rows))


def test_long_conversation_over_many_partitions(spark):
    """One conversation with a third of all turns, and a copy of its beginning."""
    rows = [(7, t, "user", f"turn {t % 50} of it") for t in range(2000)] + [(9, t, "user", f"turn {t % 50} of it") for t in range(1500)]
    rows += [(20 + i, t, "bot", f"{i % 5} {t}") for i in range(500) for t in range(4)]
    got = found(spark.createDataFrame(rows, TURNS).repartition(5))
    want = ordered(rows)
    assert {(r[0], r[1], r[3]) for r in got if r[0] in (7, 9)} == {(7, d, 506 - 4 if d == 0 else 2 if d <= 1500 else 1) for d in range(2001)}
    assert got == plain_trie(want)


def test_edges(spark):
    rows = [(1, None, None, None), (1, None, None, None), (2, 0, "u", ""), (3, 0, "u", "x " * 50_000), (4, 0, "u", "x " * 50_000), (None, 0, "u", "lost"), (5, 1, "u", "b"), (5, 1, "u", "a"), (5, 1, "u", "a"), (-7, 0, "", "")]
    turns = with_clashing_columns(spark.createDataFrame(rows, TURNS)).withColumns({c: F.lit("x") for c in ("place", "part", "depth", "print", "path", "words", "rep")})
    assert found(turns) == plain_trie(ordered(rows))
    ids = spark.createDataFrame([(1,), (2,), (3,), (4,), (5,), (-7,), (-9,), (100,), (None,)], "conv_id long")
    assert found(turns, ids) == plain_trie(ordered(rows) | {-9: [], 100: []})
    none = spark.createDataFrame([], TURNS)
    assert found(none) == []
    assert found(none, spark.createDataFrame([(3,), (4,)], "conv_id long")) == plain_trie({3: [], 4: []})


def test_powers():
    e = np.array([0, 1, 2, 63, 64, 10**9, 10**12])
    assert prefix_trie.powers(1_000_003, e, 2_147_483_647).tolist() == [pow(1_000_003, int(x), 2_147_483_647) for x in e]
