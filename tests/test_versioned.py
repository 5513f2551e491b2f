"""The versioned table: merges against a dictionary, touched ranges, replays, crashes and rival writers."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from granary.sources import versioned as v

KIND = "k long, n long, s string, extra string"
POLICY = {"n": "sum", "s": "old", "extra": "new"}


def rows(spark, values):
    return spark.createDataFrame([(k, n, s, f"e{n}") for k, n, s in values], KIND)


def held(spark, root, version=None):
    return {r["k"]: (r["n"], r["s"], r["extra"]) for r in v.read(spark, root, version).collect()}


def folders(spark, root):
    return v._folders(spark, root, v.version_of(spark, root))


def test_merges_equal_a_dictionary(spark, tmp_path):
    root, draw = f"{tmp_path}/t", random.Random(1)
    want = {k: (1, None if k % 4 == 0 else "a", "e1") for k in range(100)}
    v.created(rows(spark, [(k, 1, want[k][1]) for k in want]), root, ["k"], 8)
    for batch in range(3):
        new = {k: (draw.randrange(9), draw.choice([None, "b"])) for k in draw.sample(range(150), 40)}
        told = v.merged(rows(spark, [(k, *x) for k, x in new.items()]), root, POLICY, f"b{batch}")
        assert told["updated"] == len(new.keys() & want.keys()) and told["inserted"] == len(new.keys() - want.keys())
        for k, (n, s) in new.items():
            old = want.get(k)
            want[k] = (n, s, f"e{n}") if old is None else (old[0] + n, old[1] or s, f"e{n}")
        assert held(spark, root) == want
    assert v.version_of(spark, root) == 3 and held(spark, root, 0)[4] == (1, None, "e1")


def test_only_touched_ranges_are_written(spark, tmp_path):
    root = f"{tmp_path}/t"
    v.created(rows(spark, [(k, 1, "a") for k in range(160)]), root, ["k"], 16)
    before = folders(spark, root)
    assert len(before) == 16
    assert v.merged(rows(spark, [(3, 1, "x"), (5, 1, "x")]), root, POLICY, "b")["ranges"] == 1
    after = folders(spark, root)
    assert sum(before[p] != after[p] for p in before) == 1 and held(spark, root)[3][0] == 2
    assert v.merged(rows(spark, [(10_000, 1, "x")]), root, POLICY, "c") == {"inserted": 1, "updated": 0, "kept": 9, "skipped": 0, "ranges": 1} or held(spark, root)[10_000][0] == 1


def test_replay_crash_and_rival(spark, tmp_path, monkeypatch):
    root = f"{tmp_path}/t"
    v.created(rows(spark, [(1, 1, "a")]), root, ["k"], 4)
    batch = rows(spark, [(1, 5, "b"), (2, 7, "c")])
    publish = v._published

    def broken(*args):
        raise OSError("lost")

    monkeypatch.setattr(v, "_published", broken)
    with pytest.raises(OSError, match="lost"):
        v.merged(batch, root, POLICY, "b")
    monkeypatch.setattr(v, "_published", publish)
    assert held(spark, root) == {1: (1, "a", "e1")}
    assert v.cleaned(spark, root) == 1  # what the crash left
    assert v.merged(batch, root, POLICY, "b")["inserted"] == 1 and v.merged(batch, root, POLICY, "b")["inserted"] == 0
    assert held(spark, root) == {1: (6, "a", "e5"), 2: (7, "c", "e7")}
    monkeypatch.setattr(v, "version_of", lambda spark, root: 0)  # a rival that has not seen version 1
    with pytest.raises(Exception, match="(?i)exists"):
        v.merged(batch, root, POLICY, "other")


def test_insert_only_update_only_and_edges(spark, tmp_path):
    root = f"{tmp_path}/t"
    v.created(rows(spark, []), root, ["k"])
    assert held(spark, root) == {}
    assert v.merged(rows(spark, [(1, 1, "a")]), root, POLICY, "a", matched=False)["inserted"] == 1
    told = v.merged(rows(spark, [(1, 9, "z"), (2, 2, "b")]), root, POLICY, "b", matched=False)
    assert (told["inserted"], told["skipped"]) == (1, 1) and held(spark, root) == {1: (1, "a", "e1"), 2: (2, "b", "e2")}
    told = v.merged(rows(spark, [(1, 9, "z"), (3, 2, "b")]), root, POLICY, "c", unmatched=False)
    assert (told["updated"], told["skipped"]) == (1, 1) and held(spark, root) == {1: (10, "a", "e9"), 2: (2, "b", "e2")}
    v.merged(rows(spark, []), root, POLICY, "d")
    assert v.version_of(spark, root) == 4 and len(held(spark, root)) == 2
    for bad in ([(None, 1, "a")], [(5, 1, "a"), (5, 2, "a")]):
        with pytest.raises(ValueError):
            v.merged(rows(spark, bad), root, POLICY, "e")
    with pytest.raises(ValueError):
        v.created(rows(spark, []), root, ["k"])


def test_text_keys(spark, tmp_path):
    root = f"{tmp_path}/t"
    v.created(spark.createDataFrame([(f"k{i:03d}", i) for i in range(200)], "k string, n long"), root, ["k"], 8)
    assert len(folders(spark, root)) == 8
    v.merged(spark.createDataFrame([("k000", 5), ("zzz", 1)], "k string, n long"), root, {"n": "sum"}, "b")
    assert v.read(spark, root).agg(F.sum("n")).first()[0] == sum(range(200)) + 6


def test_interval_join(spark):
    from datetime import datetime, timedelta

    from granary.operators.ordered import near_in_time

    draw, t0 = random.Random(2), datetime(2024, 1, 1)
    at = lambda: t0 + timedelta(seconds=draw.randrange(200_000))
    left = [(draw.choice([1, 1, 2, None]), at() if draw.random() < 0.95 else None, i) for i in range(80)]
    right = [(draw.choice([1, 1, 2, None]), at() if draw.random() < 0.95 else None, i) for i in range(120)]
    df = lambda rows, name: spark.createDataFrame(rows, f"k long, t_{name} timestamp, {name} long")
    got = sorted((r["l"], r["r"]) for r in near_in_time(df(left, "l"), df(right, "r"), ["k"], "t_l", "t_r", 3600, 18000).collect())
    want = sorted((a[2], b[2]) for a in left for b in right if a[0] == b[0] is not None and a[1] and b[1] and timedelta(seconds=-3600) <= b[1] - a[1] < timedelta(seconds=18000))
    assert got == want and want
