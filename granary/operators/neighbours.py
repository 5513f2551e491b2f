"""Exact nearest neighbours: cells around pivots, visited in the order of their bounds."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from granary.operators.relational import first_per
from granary.sources.tables import stored

#: Rows that one pivot stands for; there are at most MOST_PIVOTS (more rows make larger cells, with the same result).
CELL, MOST_PIVOTS = 2048, 512
#: Vectors of either side that meet in one task.
BLOCK = 8192
#: Room for rounding in cosine distances and in bounds on chords.
NEAR, WIDE = 1e-9, 1e-6
#: Pivots nearer than this give no hyperplane: rounding would grow beyond WIDE.
APART = 1e-3
#: Queries whose products with a cell are held at a time.
TOGETHER = 1024


def _fit(pivots: np.ndarray, length: int) -> np.ndarray:
    """The pivots as points of a space of ``length`` dimensions (any points serve)."""
    return pivots[:, :length] if length <= pivots.shape[1] else np.pad(pivots, ((0, 0), (0, length - pivots.shape[1])))


def _chords(units: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Distances of unit vectors (rows) from pivots (columns)."""
    return np.sqrt(np.maximum(0.0, 1.0 + (pivots * pivots).sum(axis=1) - 2.0 * units @ pivots.T))


def bounds(to_pivots: np.ndarray, pivots: np.ndarray, cells: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Least possible distance of each vector from the rows of each cell, by the triangle inequality and the hyperplane between two pivots."""
    own = to_pivots.argmin(axis=1)
    here = to_pivots[:, cells]
    squares = (pivots * pivots).sum(axis=1)
    between = np.sqrt(np.maximum(0.0, squares[:, None] + squares[None, :] - 2.0 * pivots @ pivots.T))[own][:, cells]
    plane = np.where(between > APART, (here**2 - to_pivots.min(axis=1)[:, None] ** 2) / np.maximum(2 * between, APART), 0.0)
    return np.maximum.reduce([here - high, low - here, plane, np.zeros_like(here)])


def _place(pivots: np.ndarray) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """Adds the nearest pivot and the distance from it; rows without a direction go."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for length, part in frame.groupby(frame["vector"].map(len)):
                values = np.array(part["vector"].tolist(), dtype="float64").reshape(len(part), length)
                with np.errstate(all="ignore"):
                    norms = np.sqrt((values * values).sum(axis=1))
                    good = np.isfinite(values).all(axis=1) & np.isfinite(norms) & (norms > 0)
                if good.any():
                    away = _chords(values[good] / norms[good, None], _fit(pivots, length))
                    yield part[good].assign(cell=away.argmin(axis=1), r=away.min(axis=1))

    return run


def _route(pivots: np.ndarray, block: int, first: bool) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """The block of a query's nearest cell, or all other blocks with a cell within its bound."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for q in frame.itertuples(index=False):
                vector = np.asarray(q.vector, dtype="float64")
                points = _fit(pivots, len(vector))
                cells, n, low, high, before = (np.array([c[f] for c in q.cells]) for f in ("cell", "n", "low", "high", "before"))
                away = _chords((vector / np.sqrt((vector * vector).sum()))[None, :], points)
                home = int(before[away[0, cells].argmin()]) // block
                if first:
                    out.append((q.facet, q.id, q.vector, math.inf, home))
                    continue
                most = math.inf if pd.isna(q.most) else float(q.most)
                reached = bounds(away, points, cells, low, high)[0] <= math.sqrt(max(0.0, 2 * most)) + WIDE
                blocks = {b for a, m in zip(before[reached], n[reached], strict=True) for b in range(int(a) // block, (int(a + m) - 1) // block + 1)}
                out.extend((q.facet, q.id, q.vector, most, b) for b in sorted(blocks - {home}))
            yield pd.DataFrame(out, columns=["facet", "id", "vector", "most", "block"])

    return run


def _search(pivots: np.ndarray, k: int) -> Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame]:
    """The k nearest rows of a block for each query; cells come in order and a query's bound falls as it finds rows."""

    def run(queries: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        found: list[tuple] = []
        if len(queries) and len(rows):
            q, v = (np.array(f["vector"].tolist(), dtype="float64") for f in (queries, rows))
            q_norm, v_norm = np.sqrt((q * q).sum(axis=1)), np.sqrt((v * v).sum(axis=1))
            points, units = _fit(pivots, q.shape[1]), v / v_norm[:, None]
            q_units = q / q_norm[:, None]
            ids, asked, cell, r = rows["id"].to_numpy(), queries["id"].to_numpy(), rows["cell"].to_numpy(), rows["r"].to_numpy()
            cells = np.unique(cell)
            members = [np.flatnonzero(cell == c) for c in cells]
            least = bounds(_chords(q_units, points), points, cells, np.array([r[m].min() for m in members]), np.array([r[m].max() for m in members]))
            most = queries["most"].to_numpy(dtype="float64").copy()
            best: list[tuple[np.ndarray, np.ndarray]] = [(np.empty(0), ids[:0]) for _ in asked]
            for c in np.argsort(least.mean(axis=0), kind="stable"):
                active = np.flatnonzero(least[:, c] <= np.sqrt(np.maximum(0.0, 2 * most)) + WIDE)
                here = members[c]
                for start in range(0, len(active), TOGETHER):
                    some = active[start : start + TOGETHER]
                    for i, apart in zip(some, 1.0 - q_units[some] @ units[here].T, strict=True):
                        take = np.flatnonzero((apart <= most[i] + NEAR) & (ids[here] != asked[i]))
                        if len(take) > k:
                            take = take[apart[take] <= np.partition(apart[take], k - 1)[k - 1] + NEAR]
                        if not len(take):
                            continue
                        chosen = here[take]  # summed row by row, so that equal vectors have equal distances wherever they lie
                        exact = 1.0 - (v[chosen] * q[i]).sum(axis=1) / (q_norm[i] * v_norm[chosen])
                        far, near_ids = np.concatenate([best[i][0], exact]), np.concatenate([best[i][1], ids[chosen]])
                        order = np.lexsort((near_ids, far))[:k]
                        best[i] = far[order], near_ids[order]
                        if len(order) == k:
                            most[i] = min(most[i], float(far[order[-1]]))
            for name, (far, near_ids) in zip(asked, best, strict=True):
                kth = float(far[-1]) if len(far) == k else None
                found.extend((name, n, float(d), kth) for d, n in zip(far, near_ids, strict=True))
        return pd.DataFrame(found, columns=["query_id", "neighbour_id", "distance", "kth"])

    return run


def nearest_pruned(queries: DataFrame, rows: DataFrame, id_column: str, vector: str, facet: Sequence[str], k: int, cell: int = CELL, block: int = BLOCK) -> DataFrame:
    """(query_id, neighbour_id, distance): the k nearest rows of each query by cosine distance among those of equal facet columns, exact, smaller ids first on ties.

    A row of the query's own id isn't its neighbour; query rows of one id share k
    pairs, and a repeated row gives a pair each time.  Rows with a null id or
    facet, and vectors that are null, empty, zero or hold null or non-finite
    components, have no neighbours and are none; so have vectors of different
    lengths.  A query with fewer than k candidates returns them all.

    Pivots (one for ``cell`` rows, a sample by hash of the id) split the unit
    vectors into cells; cells of a facet, in a row, are cut into blocks of about
    ``block`` vectors, so a facet or cell of any size is many tasks.  First each
    query meets the block of its nearest cell, which bounds its k-th distance;
    then it meets only blocks with a cell that the triangle inequality lets
    within that bound.  Inside a block cells are visited in order and the bound
    falls.  Queries of a block are cut into slices of ``block`` in the same way.
    Python holds one block and one slice; to the driver come four sampled vectors per pivot.
    """
    key = F.to_json(F.struct(F.array(*(F.col(c).cast("string") for c in facet)).alias("f"), F.size(vector).alias("s")))

    def usable(df: DataFrame) -> DataFrame:
        known = [F.col(c).isNotNull() for c in (id_column, vector, *facet)]
        kept = df.where(F.size(vector) > 0)
        for condition in known:
            kept = kept.where(condition)
        return kept.select(key.alias("facet"), F.col(id_column).alias("id"), F.col(vector).cast("array<double>").alias("vector"))

    given, asked = usable(rows), usable(queries)
    id_type = given.schema["id"].dataType.simpleString()
    pivots = _pivots(given, cell)
    base = f"facet string, id {id_type}, vector array<double>"
    placed = stored(given.mapInPandas(_place(pivots), f"{base}, cell long, r double"), "placed")
    wanted = stored(asked.mapInPandas(_place(pivots), f"{base}, cell long, r double").select("facet", "id", "vector"), "asked")
    cells = placed.groupBy("facet", "cell").agg(F.count("*").alias("n"), F.min("r").alias("low"), F.max("r").alias("high"))
    cells = cells.withColumn("before", F.sum("n").over(Window.partitionBy("facet").orderBy("cell")) - F.col("n"))  # a row per pivot at most
    cells = stored(cells, "cells")
    listed = cells.groupBy("facet").agg(F.collect_list(F.struct("cell", "n", "low", "high", "before")).alias("cells"))
    at = F.floor((F.col("before") + F.pmod(F.xxhash64("id", "vector"), F.col("n"))) / block)
    blocks = placed.join(cells.select("facet", "cell", "n", "before"), ["facet", "cell"]).select("facet", at.alias("block"), "id", "vector", "cell", "r")
    routed = f"{base}, most double, block long"

    def met(routes: DataFrame) -> DataFrame:
        sizes = routes.groupBy("facet", "block").agg(F.ceil(F.count("*") / block).alias("slices"))
        left = routes.join(sizes, ["facet", "block"]).withColumn("slice", F.pmod(F.xxhash64("id"), F.col("slices"))).drop("slices")
        right = blocks.join(sizes, ["facet", "block"]).withColumn("slice", F.explode(F.sequence(F.lit(0).cast("long"), F.col("slices") - 1))).drop("slices")
        by = ["facet", "block", "slice"]
        return left.groupBy(*by).cogroup(right.groupBy(*by)).applyInPandas(_search(pivots, k), f"query_id {id_type}, neighbour_id {id_type}, distance double, kth double")

    home = wanted.join(listed, "facet").select("facet", "id", "vector", "cells")
    first = stored(met(stored(home.mapInPandas(_route(pivots, block, True), routed), "home")), "nearest_of_home")
    most = first.groupBy(F.col("query_id").alias("id")).agg(F.min("kth").alias("most"))
    further = home.join(most, "id", "left").select("facet", "id", "vector", "cells", "most")
    second = met(stored(further.mapInPandas(_route(pivots, block, False), routed), "further"))
    both = first.unionByName(second).select("query_id", "neighbour_id", "distance")
    return first_per(both, ["query_id"], [F.asc("distance"), F.asc("neighbour_id")], k)


def _pivots(given: DataFrame, cell: int) -> np.ndarray:
    """Unit vectors far from each other, among the four per pivot with the smallest hashes of their ids; a zero point where there are none."""
    wanted = max(1, min(MOST_PIVOTS, math.ceil(given.count() / cell)))
    sample = [np.array(r["vector"], dtype="float64") for r in given.select("id", "vector").orderBy(F.xxhash64("id"), "id").limit(4 * wanted).select("vector").collect()]
    with np.errstate(all="ignore"):
        good = [v / n for v in sample if np.isfinite(v).all() and np.isfinite(n := np.sqrt((v * v).sum())) and n > 0]
    if not good:
        return np.zeros((1, 1))
    width = max(map(len, good))
    spread = np.stack([np.pad(v, (0, width - len(v))) for v in good])
    chosen, away = [0], 1.0 - spread @ spread[0]
    while len(chosen) < min(wanted, len(spread)):  # farthest first: one product a round
        chosen.append(int(away.argmax()))
        away = np.minimum(away, 1.0 - spread @ spread[chosen[-1]])
    return spread[chosen]
