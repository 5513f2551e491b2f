"""Running values, percentiles and automata: pieces against plain Python, with a key of a third of all rows."""

from __future__ import annotations

import random
import statistics

import pytest
from pyspark.sql import functions as F

from granary.operators import ordered as o

FORMS = [{}, {"most_rows": 10, "piece_rows": 8}, {"most_rows": 10, "piece_rows": 1}]


def rows_of(n: int, seed: int) -> list[tuple]:
    draw = random.Random(seed)
    return [(None if i % 17 == 0 else 0 if i % 3 == 0 else draw.randrange(1, 12), draw.randrange(40), i, draw.choice([None, 1.0, 2.5, 7.0, float(draw.randrange(100))]), draw.choice("abcd")) for i in range(n)]


def table(spark, rows):
    return spark.createDataFrame(rows, "key long, time long, id long, value double, kind string").repartition(7)


def groups(rows):
    found: dict = {}
    for r in sorted(rows, key=lambda r: (r[1], r[2])):
        found.setdefault(r[0], []).append(r)
    return found


@pytest.mark.parametrize("form", FORMS)
def test_running(spark, form):
    rows = rows_of(500, 1)
    df = table(spark, rows)
    latest = F.when(F.col("value").isNotNull(), F.struct("time", "id", "value"))
    ahead, p = o.running(df, ["key"], ["time", "id"], {"place": ("sum", F.lit(1)), "total": ("sum", F.col("value")), "last": ("max", latest)}, inclusive=False, **form)
    back, _ = o.running(df, ["key"], ["time", "id"], {"next": ("min", F.struct("time", "id")), "left": ("sum", F.lit(1))}, inclusive=False, backwards=True, **form)
    assert (p is None) == (not form)
    got = {r["id"]: r for r in ahead.collect()}
    got_back = {r["id"]: r for r in back.collect()}
    assert len(got) == len(got_back) == len(rows)
    for group in groups(rows).values():
        for i, r in enumerate(group):
            known = [x[3] for x in group[:i] if x[3] is not None]
            g, b = got[r[2]], got_back[r[2]]
            assert g["place"] == (i or None) and (g["total"] == pytest.approx(sum(known)) if known else g["total"] is None) and (g["last"]["value"] if g["last"] else None) == (known[-1] if known else None)
            assert (tuple(b["next"]) if b["next"] else None) == (group[i + 1][1:3] if i + 1 < len(group) else None) and b["left"] == (len(group) - 1 - i or None)


@pytest.mark.parametrize("form", FORMS)
def test_percentiles(spark, form):
    rows = rows_of(600, 2)
    got = {r["key"]: r for r in o.percentiles(table(spark, rows), ["key"], "value", {"p50": (0.5, "between"), "p95": (0.95, "between"), "rank": (0.95, "rank")}, **form)[0].collect()}
    for key, group in groups(rows).items():
        values = sorted(r[3] for r in group if r[3] is not None)
        place = 0.95 * (len(values) - 1)
        low = int(place)
        want = values[low] + (values[min(low + 1, len(values) - 1)] - values[low]) * (place - low)
        assert got[key]["p50"] == pytest.approx(statistics.median(values)) and got[key]["p95"] == pytest.approx(want) and got[key]["rank"] == values[min(int(0.95 * len(values)), len(values) - 1)]
    assert len(got) == len(groups(rows))


@pytest.mark.parametrize("form", [*FORMS, {"most_rows": 10, "piece_rows": 2, "fan": 3}])
def test_ordered_subsequence(spark, form):
    rows, wanted = rows_of(300, 3), ("a", "c", "a", "d", "b", "b")
    got = {r["key"]: r["state"] for r in o.reached(table(spark, rows), ["key"], ["time", "id"], F.col("kind"), len(wanted) + 1, o.sequence_step(wanted), **form)[0].collect()}
    for key, group in groups(rows).items():
        state = 0
        for r in group:
            state += state < len(wanted) and r[4] == wanted[state]
        assert got[key] == state
    assert len(set(got.values())) > 1


def test_pieces_are_bounded_and_spread(spark):
    """The hot key lies in many pieces, none larger than asked."""
    sizes = o.in_pieces(table(spark, rows_of(3000, 4)), ["key"], ["time", "id"], 16).groupBy(f"`{o.PIECE}`", "key").count().collect()
    assert max(r["count"] for r in sizes) <= 16 and sum(r["key"] == 0 for r in sizes) >= 50


@pytest.mark.parametrize("form", FORMS)
def test_empty(spark, form):
    none = table(spark, [])
    assert o.running(none, ["key"], ["id"], {"n": ("sum", F.lit(1))}, **form)[0].count() == 0
    assert o.percentiles(none, ["key"], "value", {"p": (0.5, "rank")}, **form)[0].count() == o.reached(none, ["key"], ["id"], F.col("kind"), 2, o.sequence_step("a"), **form)[0].count() == 0
