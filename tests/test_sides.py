"""Sides of claims on hand-made sections."""

from __future__ import annotations

from granary.operators import domain as d


def test_votes_verdicts_and_standings(spark):
    claims = spark.createDataFrame([(1, "fracture of the left knee"), (2, None), (3, "Rt hip, R-side"), (4, "left and right"), (5, "left ear"), (6, "left"), (None, "left")], "c long, dx string")
    sections = [(1, 1, "RIGHT knee"), (1, 2, "right; left; rt."), (1, 3, "Left"), (2, 1, "lt. side"), (2, 2, "L side"), (2, 3, "right"), (3, 1, "left"), (4, 1, "left"), (5, 1, "right left"), (5, 2, None), (5, 3, "bright, leftover"), (6, 1, "right"), (6, 2, "right"), (6, 3, "left"), (6, 4, "left"), (None, 1, "right"), (None, 2, "right")]
    votes = d.side_votes(spark.createDataFrame([(*s, "x") for s in sections], "c long, s long, t string, majority2 string"), "t").select("c", "s", "side")
    assert {(r["c"], r["s"]): r["side"] for r in votes.collect() if r["c"] in (1, 2, 5)} == {(1, 1): "right", (1, 2): "right", (1, 3): "left", (2, 1): "left", (2, 2): "left", (2, 3): "right", (5, 1): "right"}  # a tie counts for the second side
    verdicts = d.side_verdicts(claims, votes, "c", "dx")
    assert {r["c"]: tuple(r)[1:] for r in verdicts.collect()} == {
        1: ("left", 1, 2, "right", True, False),
        2: (None, 2, 1, "left", False, True),
        3: ("right", 1, 0, "left", False, False),
        4: (None, 1, 0, "left", False, False),
        5: ("left", 0, 1, "right", False, False),
        6: ("left", 2, 2, None, False, False),
        None: ("left", 0, 0, None, False, False),
    }
    found = d.side_standings(votes, verdicts, "c")
    assert sorted((r["c"], r["s"], r["standing"]) for r in found.collect()) == [(1, 1, "dissents"), (1, 2, "dissents"), (2, 1, "agrees"), (2, 2, "agrees"), (3, 1, "dissents"), (5, 1, "dissents"), (6, 1, "dissents"), (6, 2, "dissents")]
    assert d.side_verdicts(claims.limit(0), votes.limit(0), "c", "dx").count() == 0
