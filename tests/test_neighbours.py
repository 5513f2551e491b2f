"""Nearest neighbours against all pairs in numpy."""

from __future__ import annotations

import numpy as np

from granary.operators import neighbours


def plain(queries, rows, k):
    found = {}
    for i, f, q in queries:
        usable = lambda x: x and all(c is not None and np.isfinite(c) for c in x) and any(x)
        if i is None or f is None or not usable(q):
            continue
        q = np.array(q)
        near = found.setdefault(i, [])
        for j, g, v in rows:
            if j is not None and g == f and j != i and usable(v) and len(v) == len(q):
                v = np.array(v)
                near.append((1 - (v * q).sum() / (np.sqrt((q * q).sum()) * np.sqrt((v * v).sum())), j))
    return sorted((i, j, round(float(d), 9) + 0.0) for i, near in found.items() for d, j in sorted(near)[:k])


def cases(n=240, dims=6):
    draw = np.random.default_rng(3)
    centres = draw.normal(size=(5, dims))
    rows = [(i, "hot" if i % 3 else "b", (centres[i % 5] + draw.normal(scale=0.05, size=dims)).tolist()) for i in range(n)]
    rows += [(n + i, "hot", rows[1][2]) for i in range(12)]  # ties: one vector many times
    rows += [rows[4], (500, "hot", None), (501, "hot", [0.0] * dims), (502, "hot", [float("nan")] * dims), (503, "hot", [None] + [1.0] * (dims - 1)), (504, "hot", []), (505, None, rows[1][2]), (None, "hot", rows[1][2]), (506, "hot", [1.0, 2.0]), (507, "hot", [1.0, 3.0]), (508, "alone", rows[2][2])]
    return rows


def test_equals_all_pairs_with_small_cells_and_blocks(spark):
    schema = "id long, f string, vector array<double>, cell string"
    rows = cases()
    given = spark.createDataFrame([(*r, "x") for r in rows], schema)
    queries = given.where("id is null or id % 4 = 0 or id >= 500")
    got = neighbours.nearest_pruned(queries, given, "id", "vector", ["f"], 5, cell=16, block=32)
    asked = [r for r in rows if r[0] is None or r[0] % 4 == 0 or r[0] >= 500]
    assert sorted((r[0], r[1], round(r[2], 9) + 0.0) for r in got.collect()) == plain(asked, rows, 5)
    assert neighbours.nearest_pruned(queries.limit(0), given.limit(0), "id", "vector", ["f"], 5).count() == 0


def test_structure_prunes_blocks():
    """Of vectors in narrow clusters a query's bound leaves few cells."""
    draw = np.random.default_rng(1)
    units = lambda x: x / np.sqrt((x * x).sum(axis=1))[:, None]
    pivots = units(draw.normal(size=(40, 32)))
    points = units(np.repeat(pivots, 50, axis=0) + draw.normal(scale=0.02, size=(2000, 32)))
    away = neighbours._chords(points, pivots)
    own, r = away.argmin(axis=1), away.min(axis=1)
    cells = np.unique(own)
    least = neighbours.bounds(away[::20], pivots, cells, np.array([r[own == c].min() for c in cells]), np.array([r[own == c].max() for c in cells]))
    apart = np.sqrt(np.maximum(0, 2 - 2 * points[::20] @ points.T))
    true = np.array([[a[own == c].min() for c in cells] for a in apart])
    assert (least <= true + 1e-6).all()  # never above what is there
    fifth = np.sort(apart, axis=1)[:, 5]
    assert (least <= fifth[:, None]).mean() < 0.05


def test_nearest_vectors_are_found_by_blocks(spark, small):
    from granary.plans import similarity

    assert "zip_with" not in similarity.d7_nearest_vectors(spark, small)._jdf.queryExecution().optimizedPlan().toString()
