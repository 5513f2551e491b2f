"""Near-duplicate vectors by an exact metric range join.

On unit vectors cosine >= c is a Euclidean distance of at most
r = sqrt(2 - 2c), so the join is a range join in a metric space:

1. Equal vectors become one (a number, the smallest id, the number of copies).
2. Pivots, chosen far apart from a bounded sample, partition the vectors: each
   is at home in its nearest pivot's cell.
3. Of two cells one is the host of the other (``hosts``).  A vector x is copied
   to a host cell j if a vector at home there can be within r.  By the triangle
   inequality that needs d(x, p_j) <= d(x, p_i) + 2r and d(x, p_j) <= radius_j +
   r; in Euclidean space also that x lies within r of the plane between p_i and p_j.
4. Each cell is joined on its own: its home vectors with one another, and with
   its visitors, so each pair is met once and counts for both.  Cells of more
   than BLOCK vectors are cut into blocks of both kinds.  In a block, vectors are
   sorted by their distance to one point; a slice meets only those whose
   distance differs by at most r (the triangle inequality again).
5. A task emits a row per vector with links (their number, a local root), not per
   pair; components of the roots are the result.

A fast single-precision product only pre-selects pairs; every pair near or above
the limit is decided by the cosine in double precision.

Pivots are one per PER_PIVOT vectors up to MOST_PIVOTS, and the sample that they
are chosen from (and that the driver sees) has SAMPLE rows a pivot.  Beyond
MOST_PIVOTS x PER_PIVOT (16 million) vectors cells grow, in more blocks of the
same size.  The bounds prune as far as the data have structure: in many
dimensions without any, most vectors lie near most planes, and the join costs
about n squared / 2 products in blocks.  The result is exact either way.

Defined results: vectors that are null, empty, zero or hold null or non-finite
components link with nothing; nor do vectors of different lengths.  Rows that
repeat a vec_id, with equal or other vectors, count as vectors of their own.
Rows without a vec_id link with nothing, have a null component and aren't kept.
Extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.operators.components import components
from granary.sources.tables import dropped, stored

#: Rows per pivot that pivots are chosen from, pivots at most, vectors per pivot, and vectors in a block.
SAMPLE, MOST_PIVOTS, PER_PIVOT, BLOCK = 16, 4096, 4096, 4096
#: Rows whose distances to all pivots are held at a time.
DEALT_ROWS = 512
#: More than the rounding errors of distances.
SLACK = 1e-7
#: Side of vectors that are compared with one another; 0 and 1 are home and visiting vectors that meet.
WITHIN = 2


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    """Rows of an Arrow list column as doubles."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def unit(x: np.ndarray) -> np.ndarray:
    """Rows scaled to length one; first by the largest component, so that squares neither vanish nor overflow."""
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def farthest_first(x: np.ndarray, k: int) -> np.ndarray:
    """k of some unit vectors, each the farthest from those before it.

    A round is one product of the sample with a vector, in the sample's own precision,
    so nothing of the sample's size is made.
    """
    chosen = [0]
    gap = 2 - 2 * (x @ x[0])
    while len(chosen) < min(k, len(x)) and gap.max() > 1e-6:
        chosen.append(int(gap.argmax()))
        np.minimum(gap, 2 - 2 * (x @ x[chosen[-1]]), out=gap)
    return x[chosen]


def sampled(column: pa.Array, dim: int) -> np.ndarray:
    """Rows of an Arrow list column as unit vectors in single precision, made a slice at a time."""
    out = np.empty((len(column), dim), np.float32)
    for at in range(0, len(column), DEALT_ROWS):
        part = column.slice(at, DEALT_ROWS)
        out[at : at + len(part)] = unit(matrix(part, dim))
    return out


def distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0.0, 2.0 - 2.0 * (x @ pivots.T)))


def hosts(cell: np.ndarray, home: np.ndarray) -> np.ndarray:
    """Whether a cell is the host of vectors at home in another: of each two cells exactly one is, and each hosts about half of the others."""
    return ((cell + home) % 2 == 1) == (cell < home)


def homes(vectors: DataFrame, dim: int, pivots: np.ndarray) -> DataFrame:
    """(cell, distance) of each vector's nearest pivot."""
    shared = vectors.sparkSession.sparkContext.broadcast(pivots)

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, DEALT_ROWS):
                d = distances(unit(matrix(batch.column(0).slice(at, DEALT_ROWS), dim)), shared.value)
                home = d.argmin(1)
                yield pa.RecordBatch.from_arrays([pa.array(home.astype(np.int32)), pa.array(d[np.arange(len(d)), home])], names=["cell", "distance"])

    return vectors.select("embedding").mapInArrow(nearest, "cell int, distance double")


def with_cells(vectors: DataFrame, dim: int, pivots: np.ndarray, r: float, radii: np.ndarray, blocks: np.ndarray) -> DataFrame:
    """Every cell that a vector takes part in, whether it is at home there, and the cell's number of home and visiting blocks."""
    shared = vectors.sparkSession.sparkContext.broadcast((pivots, radii, blocks))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pivots, radii, blocks = shared.value
        between = np.sqrt(np.maximum(1e-24, 2 - 2 * pivots @ pivots.T))
        cells = np.arange(len(pivots))
        for whole in batches:
            for at in range(0, whole.num_rows, DEALT_ROWS):
                batch = whole.slice(at, DEALT_ROWS)
                d = distances(unit(matrix(batch.column(2), dim)), pivots)
                home = d.argmin(1)
                own = d[np.arange(len(d)), home]
                plane = (d * d - (own * own)[:, None]) / (2 * between[home])
                joins = (d <= own[:, None] + 2 * r + SLACK) & (d <= radii + r + SLACK) & (plane <= r + SLACK) & hosts(cells[None, :], home[:, None])
                joins[np.arange(len(d)), home] = True
                row, cell = np.nonzero(joins)
                taken = batch.take(pa.array(row))
                yield pa.RecordBatch.from_arrays([pa.array(cell.astype(np.int32)), pa.array(home[row] == cell), *(pa.array(blocks[k][cell]) for k in (0, 1)), *taken.columns], names=["cell", "at_home", "home_blocks", "visiting_blocks", "node", "copies", "embedding"])

    kind = vectors.schema["embedding"].dataType.simpleString()
    return vectors.select("node", "copies", "embedding").mapInArrow(deal, f"cell int, at_home boolean, home_blocks int, visiting_blocks int, node long, copies long, embedding {kind}")


def block_links(one: np.ndarray, two: np.ndarray | None, limit: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Indexes of pairs with cosine >= limit, between two sets of vectors or (two None) within one, each pair once; a slice at a time."""
    a = unit(one)
    b, other = (a, one) if two is None else (unit(two), two)
    point = a[:1]
    from_a, from_b = distances(a, point)[:, 0], distances(b, point)[:, 0]
    order_a, order_b = np.argsort(from_a), np.argsort(from_b)
    a, b, from_a, from_b = a[order_a], b[order_b], from_a[order_a], from_b[order_b]
    small_a, small_b = a.astype(np.float32), b.astype(np.float32)
    reach = math.sqrt(2 - 2 * limit) + SLACK
    for start in range(0, len(a), 512):
        end = min(len(a), start + 512)
        lo, hi = np.searchsorted(from_b, [from_a[start] - reach, from_a[end - 1] + reach])
        lo = start if two is None else lo
        i, j = np.nonzero(small_a[start:end] @ small_b[lo:hi].T >= np.float32(limit - 1e-4))
        i, j = i + start, j + lo
        if two is None:
            i, j = i[i < j], j[i < j]
        cosine = np.empty(len(i))
        for at in range(0, len(i), 65536):
            s = slice(at, at + 65536)
            cosine[s] = (a[i[s]] * b[j[s]]).sum(1)
        i, j = order_a[i], order_b[j]
        for k in np.flatnonzero(np.abs(cosine - limit) < 1e-12):
            x, y = one[i[k]], other[j[k]]
            cosine[k] = (x @ y) / (math.sqrt(x @ x) * math.sqrt(y @ y))
        keep = cosine >= limit
        yield i[keep], j[keep]


def joined(cells: DataFrame, dim: int, limit: float) -> DataFrame:
    """(node, links, root) of the vectors with links in each block; whole blocks in one task, sorted by key."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def close(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
            block = pa.Table.from_batches(parts).combine_chunks()
            side = block["side"].to_numpy()
            nodes, copies = block["node"].to_numpy(), block["copies"].to_numpy()
            vectors = matrix(block["embedding"].combine_chunks(), dim)
            one, two = np.flatnonzero(side != 1), np.flatnonzero(side == 1)
            within = side[0] == WITHIN
            links, root = np.zeros(len(nodes), np.int64), np.arange(len(nodes))
            if len(one) and (within or len(two)):
                for i, j in block_links(vectors[one], None if within else vectors[two], limit):
                    x, y = one[i], (one if within else two)[j]
                    links += np.bincount(x, copies[y], len(nodes)).astype(np.int64) + np.bincount(y, copies[x], len(nodes)).astype(np.int64)
                    while len(x):
                        low = np.minimum(root[x], root[y])
                        # hang the roots, not the nodes, so that earlier links stay joined
                        before = root.copy()
                        np.minimum.at(root, before[x], low)
                        np.minimum.at(root, before[y], low)
                        root = root[root]
                        if (root[x] == root[y]).all():
                            break
                while (root[root] != root).any():
                    root = root[root]
            used = np.flatnonzero(links)
            return pa.RecordBatch.from_arrays([pa.array(nodes[used]), pa.array(links[used]), pa.array(nodes[root[used]])], names=["node", "links", "root"])

        held: list[pa.RecordBatch] = []
        key = None
        for batch in batches:
            keys = batch.column("block").to_numpy(zero_copy_only=False)
            cuts = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist(), len(keys)] if len(keys) else []
            for lo, hi in zip(cuts, cuts[1:], strict=False):
                if held and keys[lo] != key:
                    yield close(held)
                    held = []
                key = keys[lo]
                held.append(batch.slice(lo, hi - lo))
        if held:
            yield close(held)

    return cells.mapInArrow(compare, "node long, links long, root long")


def in_blocks(dealt: DataFrame) -> DataFrame:
    """Vectors once for each pair of blocks that they are compared in: (block, side, node, copies, embedding)."""
    numbered = lambda part, blocks: part.withColumn("own", F.pmod(F.xxhash64("node"), F.col(blocks)).cast("int"))
    others = lambda blocks: F.explode(F.sequence(F.lit(0), F.col(blocks) - 1)).alias("other")
    rest = ("node", "copies", "embedding")
    home = numbered(dealt.where("at_home"), "home_blocks")
    home_pairs = home.select("cell", "own", *rest, others("home_blocks")).select(
        F.concat_ws("/", "cell", F.least("own", "other").cast("string"), F.greatest("own", "other").cast("string")).alias("block"),
        F.when(F.col("own") == F.col("other"), WITHIN).otherwise((F.col("own") > F.col("other")).cast("int")).alias("side"), *rest,
    )
    meets = home.where("visiting_blocks > 0").select("cell", "own", *rest, others("visiting_blocks")).select(F.concat_ws("/", "cell", "own", F.lit("v"), "other").alias("block"), F.lit(0).alias("side"), *rest)
    visits = numbered(dealt.where("not at_home and home_blocks > 0"), "visiting_blocks").select("cell", "own", *rest, others("home_blocks")).select(F.concat_ws("/", "cell", "other", F.lit("v"), "own").alias("block"), F.lit(1).alias("side"), *rest)
    return home_pairs.unionByName(meets).unionByName(visits)


def near_duplicates(vectors: DataFrame, limit: float = 0.95, per_pivot: int = PER_PIVOT, block: int = BLOCK) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row of (vec_id, embedding)."""
    sound = F.expr("vec_id is not null and embedding is not null and size(embedding) > 0 and forall(embedding, x -> x is not null and not isnan(x) and abs(x) < double('infinity')) and exists(embedding, x -> x <> 0)")
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")
    same = rows.where(sound).groupBy("embedding").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies"))
    distinct = stored(same.withColumn("node", F.monotonically_increasing_id()), "vectors")
    r = math.sqrt(2 - 2 * limit)
    found = None
    for dim, n in sorted((x["dim"], x["n"]) for x in distinct.groupBy(F.size("embedding").alias("dim")).agg(F.count("*").alias("n")).collect()):
        own = distinct.where(F.size("embedding") == dim)
        n_pivots = max(1, min(MOST_PIVOTS, math.ceil(n / per_pivot)))
        share = min(1.0, max(2048, SAMPLE * n_pivots) / n)
        sample = own.where(F.pmod(F.xxhash64("node"), F.lit(1 << 30)) < int(share * (1 << 30))).select("embedding").toArrow()["embedding"].combine_chunks()
        if not len(sample):
            sample = own.select("embedding").limit(1).toArrow()["embedding"].combine_chunks()
        # any unit vectors will do as pivots: they steer the cost, not the result
        pivots = unit(farthest_first(sampled(sample, dim), n_pivots).astype(np.float64))
        del sample
        radii, at_home = np.full(len(pivots), -9.0), np.zeros(len(pivots), np.int64)
        for x in homes(own, dim, pivots).groupBy("cell").agg(F.max("distance").alias("radius"), F.count("*").alias("n")).collect():
            radii[x["cell"]], at_home[x["cell"]] = x["radius"], x["n"]
        visiting = np.zeros(len(pivots), np.int64)
        blocks = lambda: np.array([-(-at_home // block), -(-visiting // block)], np.int32)
        for x in with_cells(own, dim, pivots, r, radii, blocks()).where("not at_home").groupBy("cell").agg(F.count("*").alias("n")).collect():
            visiting[x["cell"]] = x["n"]
        dealt = in_blocks(with_cells(own, dim, pivots, r, radii, blocks()))
        part = joined(dealt.repartition(F.col("block")).sortWithinPartitions("block"), dim, limit)
        found = part if found is None else found.unionByName(part)
    if found is None:
        dropped(distinct)
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.col("vec_id").isNotNull().alias("kept"))
    checked = stored(found, "linked")
    links = checked.groupBy("node").agg(F.sum("links").alias("links"))
    tied = stored(components(checked.select(F.col("node").alias("a"), F.col("root").alias("b"))), "tied")
    heads = distinct.select("node", "rep").join(tied, "node").groupBy("component").agg(F.min("rep").alias("head"))
    judged = distinct.join(links, "node", "left").join(tied.join(heads, "component"), "node", "left").select("embedding", F.coalesce("head", "rep").alias("component_id"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    ids = rows.withColumn("key", F.when(sound, F.col("embedding")))
    out = ids.join(judged, ids["key"] == judged["embedding"], "left").select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    result = stored(out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False))), "near_vectors")
    dropped(distinct, checked, tied)
    return result


#: DuckDB SQL for ``near_duplicates`` over ``embeddings``.
SQL = """
with recursive v as (select vec_id, embedding::double[] as e from embeddings where embedding is not null and len(embedding) > 0),
ok as (select vec_id, e, sqrt(list_dot_product(e, e)) as norm from v where list_dot_product(e, e) > 0 and isfinite(list_dot_product(e, e))),
links as (select a.vec_id as x, b.vec_id as y from ok a join ok b on a.vec_id <> b.vec_id and len(a.e) = len(b.e) where list_dot_product(a.e, b.e) / (a.norm * b.norm) >= 0.95),
reach as (select x as node, y as other from links union select r.node, l.y from reach r join links l on l.x = r.other),
c as (select vec_id, least(vec_id, coalesce((select min(other) from reach where node = vec_id), vec_id)) as component_id, (select count(*) from links where x = vec_id) as n_links from embeddings)
select vec_id, n_links, component_id, vec_id = component_id as kept from c
"""
