"""Embedding links against all pairs in numpy."""

from __future__ import annotations

import numpy as np
from fixtures import rows_of

from granary.llm import embeddings, registry


def brute(rows: list[tuple[int, list | None]], limit: float = 0.95) -> list[tuple]:
    is_sound = lambda i, v: i is not None and bool(v) and all(x is not None and np.isfinite(x) for x in v) and any(v)
    sound = [(i, np.array(v, np.float64)) for i, v in rows if is_sound(i, v)]
    parent = list(range(len(sound)))

    def top(k: int) -> int:
        while parent[k] != k:
            k = parent[k]
        return k

    n_links = [0] * len(sound)
    for a in range(len(sound)):
        for b in range(a + 1, len(sound)):
            x, y = sound[a][1], sound[b][1]
            if len(x) == len(y) and x @ y / np.sqrt(x @ x) / np.sqrt(y @ y) >= limit:
                n_links[a] += 1
                n_links[b] += 1
                parent[max(top(a), top(b))] = min(top(a), top(b))
    least: dict[int, int] = {}
    for k, (i, _) in enumerate(sound):
        least[top(k)] = min(i, least.get(top(k), i))
    out = [(i, n_links[k], least[top(k)], i == least[top(k)]) for k, (i, _) in enumerate(sound)]
    out += [(i, 0, i, i is not None) for i, v in rows if not is_sound(i, v)]
    return sorted(out, key=repr)


def test_query_equals_brute_force(spark, small):
    rows = [(r["vec_id"], list(r["embedding"])) for r in spark.read.parquet(f"{small}/embeddings.parquet").collect()]
    assert rows_of(registry.op3_embedding_near_dedup(spark, small)) == brute(rows)


def test_edges_and_many_cells(spark):
    draw = np.random.default_rng(3)
    centres = draw.normal(size=(12, 16))
    vectors = (centres[draw.integers(0, 12, 300)] + 0.22 * draw.normal(size=(300, 16))).astype(np.float32).tolist()
    rows = list(enumerate(vectors))
    rows += [(1000, None), (1001, []), (1002, [0.0] * 16), (1003, [float("nan")] + [1.0] * 15), (1004, [None] + [1.0] * 15), (1005, [float("inf")] + [1.0] * 15), (1006, [1.0, 2.0]), (1007, [2.0, 4.0]), (1008, vectors[5]), (1009, vectors[5])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = embeddings.near_duplicates(df.selectExpr("*", "'x' as rep", "'y' as cell", "1 as label"), per_pivot=30, block=16)
    assert rows_of(got) == brute(rows)


def test_ids_that_are_null_or_repeat(spark):
    draw = np.random.default_rng(5)
    base = draw.normal(size=(6, 8))
    near = lambda k: (base[k] + 0.03 * draw.normal(size=8)).tolist()
    rows = [(1, near(0)), (1, near(0)), (1, near(1)), (2, near(1)), (None, near(0)), (None, None), (3, near(2)), (4, near(2)), (4, near(3)), (5, near(3)), (5, near(4))]
    assert rows_of(embeddings.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), per_pivot=3, block=2)) == brute(rows)


def test_bounds_prune_where_the_data_have_structure():
    draw = np.random.default_rng(6)
    tight = np.repeat(draw.normal(size=(40, 32)), 50, 0) + 0.02 * draw.normal(size=(2000, 32))
    x = embeddings.unit(tight)
    pivots = embeddings.farthest_first(x, 40)
    d = embeddings.distances(x, pivots)
    own = d.min(1)
    assert (d <= own[:, None] + 2 * np.sqrt(0.1)).sum() < 0.1 * d.size


def test_tiny_and_large_components(spark):
    rows = [(1, [1e-300, 1e-300]), (2, [1e300, 1e300]), (3, [1.0, -1.0])]
    got = rows_of(embeddings.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")))
    assert [(r[0], r[2]) for r in got] == [(1, 1), (2, 1), (3, 3)]


def test_empty_table(spark):
    assert embeddings.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0
