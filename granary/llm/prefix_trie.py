"""The prefix trie of conversations: which openings they share, and what sharing would save.

Every distinct sequence of first turns (role, text) is a node; the empty sequence
is the root.  A node's conversations are those that begin with it.

1. Fingerprints.  Turns are range-partitioned and sorted by (conversation, turn).  A
   numpy scan over each partition gives every turn its place and the polynomial
   fingerprint of all turns up to it, modulo two primes; as a polynomial continues
   where another ended, one carry row per partition joins what a border cuts.  So a
   conversation may spread over any number of partitions.
2. Verification.  (depth, fingerprint) groups candidates.  In each group the turns
   themselves are compared with those of the representative, the smallest
   conversation.  Where one differs, a collision, the group is split: conversations
   carry the places at which they left their group's representative, which makes
   (depth, fingerprint, places) exact.  (By induction: same group and same turn
   means same fingerprint one turn earlier.)
3. Roll-up.  A node is known by its depth and its smallest conversation.  So a
   conversation's own nodes are one run of depths, and sums over a subtree are sums
   over the conversations that pass: of each, the whole run, but of the smallest
   only what lies deeper.  One more scan and one aggregation do this for all depths
   at once; nothing iterates over levels.

Aggregations are partial before each shuffle and joins have one row per key on one
side, so a first turn or a conversation of a third of all rows is split.  The driver
gets one row per partition.  Lists of conversation ids are hashed piece by piece.

Defined results: null role or text is empty; rows without conv_id belong to no
conversation; turns are ordered by turn (null first), ties by role, then by the
first TIE_CHARS characters of the text, then by a hash of it; repeated rows are turns of their
own.  An empty table has no nodes, not even a root.  Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from granary.sources.tables import dropped, stored, text_batches

#: The two largest primes below 2**31, so that products fit 64 bits; bases of the polynomials.
PRIMES, BASES = (2_147_483_647, 2_147_483_629), (1_000_003, 998_244_353)
TIE_CHARS = 40
#: Ids of a piece of a list that is hashed.
PIECE_IDS = 50_000
KEY = ("depth", "print", "path")


# ---- running values within keys, over all partitions


def powers(base: int, exponents: np.ndarray, modulus: int) -> np.ndarray:
    """base ** exponents modulo a number below 2**31, by squaring."""
    out, square, left = np.ones(len(exponents), np.uint64), base % modulus, exponents.astype(np.uint64)
    while left.any():
        out = np.where(left & np.uint64(1), out * np.uint64(square) % np.uint64(modulus), out)
        left >>= np.uint64(1)
        square = square * square % modulus
    return out


def running(values: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Running sums that begin anew at each start."""
    sums = np.cumsum(values)
    return sums - np.repeat(sums[starts] - values[starts], lengths)


def scanned(df: DataFrame, key: str, order: list[Column], series: dict[str, tuple[str, int, int | None]]) -> tuple[DataFrame, DataFrame]:
    """(rows, table): df with ``place`` (from 0 within key) and, for each of ``series``, a running value ``name`` and ``name_before`` without the own row; and the stored table behind it.

    A series (column, base, modulus) sums column * base**place modulo modulus (None:
    plain sums, base 1).  ``key`` is a long without nulls; ``order`` orders rows of a
    key, rows equal in it in any order.
    """
    names = [x for name in series for x in (name, f"{name}_before")]
    schema = StructType([*df.schema.fields, *(StructField(c, LongType()) for c in ("part", "place", *names))])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, last, count, carry = TaskContext.get().partitionId(), None, 0, dict.fromkeys(series, 0)
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            keys = np.asarray(batch.column(key))
            starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
            lengths = np.diff(np.append(starts, n))
            goes_on = int(keys[0]) == last
            head = int(lengths[0]) if goes_on else 0
            place = np.arange(n) - np.repeat(starts, lengths)
            place[:head] += count
            columns = [pa.array(np.full(n, part)), pa.array(place)]
            for name, (column, base, modulus) in series.items():
                values = np.asarray(batch.column(column)).astype(np.int64)
                if modulus:
                    values = (values.astype(np.uint64) * powers(base, place, modulus) % np.uint64(modulus)).astype(np.int64)
                sums = running(values, starts, lengths)
                sums[:head] += carry[name]
                before = sums - values
                if modulus:
                    sums, before = sums % modulus, before % modulus
                carry[name] = int(sums[-1])
                columns += [pa.array(sums), pa.array(before)]
            last, count = int(keys[-1]), int(place[-1]) + 1
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], names=schema.names)

    by = [F.col(key), *order, F.monotonically_increasing_id()]
    numbered = df.repartitionByRange(*by).sortWithinPartitions(*by)
    table = stored(numbered.mapInArrow(scan, schema), "scan")
    tails = table.groupBy("part").agg(F.max(F.struct(key, "place", *series)).alias("tail"), F.min(key).alias("first")).sort("part").collect()
    carries, held = [], None
    for row in tails:
        tail = row["tail"].asDict()
        factor = {}
        if held and held[key] == row["first"]:
            factor = {name: pow(base, held["place"] + 1, modulus) if modulus else 1 for name, (_, base, modulus) in series.items()}
            carries.append((row["part"], row["first"], held["place"] + 1, *(x for name in series for x in (held[name], factor[name]))))
        if factor and tail[key] == row["first"]:
            tail = {key: tail[key], "place": tail["place"] + held["place"] + 1} | {name: (held[name] + factor[name] * tail[name]) % modulus if modulus else held[name] + tail[name] for name, (_, _, modulus) in series.items()}
        held = tail
    if not carries:
        return table.drop("part"), table
    carry = df.sparkSession.createDataFrame(carries, ", ".join(["part long", f"{key} long", "carry_place long", *(f"carry_{name} long, factor_{name} long" for name in series)]))
    met = table.join(F.broadcast(carry), ["part", key], "left")  # a row a partition at most
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    new: dict[str, Column] = {"place": F.col("place") + zero("carry_place")}
    for name, (_, _, modulus) in series.items():
        for c in (name, f"{name}_before"):
            total = zero(f"carry_{name}") + F.coalesce(F.col(f"factor_{name}"), F.lit(1)) * F.col(c)
            new[c] = total % modulus if modulus else total
    return met.withColumns(new).select(*df.columns, "place", *names), table


# ---- conversations


def turn_order(turn: str = "turn") -> list[Column]:
    return [F.col(turn), F.col("role"), F.substring("text", 1, TIE_CHARS), F.xxhash64("text")]


def clean_turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) without nulls in conv_id, role and text."""
    texts = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("role", "text")]
    return conversations.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", *texts)


def spliced(conversations: DataFrame, every: int = 20, most: int = 4) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Conversations with borrowed openings: (turns, ids of all of them, stored table to drop at the end).

    The first h = crc32(conv_id) % most turns of a conversation are replaced by the
    first h turns of the conversation whose id is the next multiple of ``every`` below,
    if there is one.
    """
    placed, table = scanned(clean_turns(conversations), "conv_id", turn_order(), {})
    height = F.crc32(F.col("conv_id").cast("string").cast("binary")) % most
    ids = placed.groupBy("conv_id").agg(F.lit(1).alias("one")).select("conv_id")
    openings = placed.where((F.pmod("conv_id", F.lit(every)) == 0) & (F.col("place") < most - 1)).select(F.col("conv_id").alias("opening"), "place", "role", "text")
    wants = ids.select("conv_id", height.alias("height"), (F.col("conv_id") - F.pmod("conv_id", F.lit(every))).alias("opening"))
    borrowed = wants.join(openings, "opening").where("place < height").select("conv_id", F.col("place").alias("turn"), "role", "text")
    own = placed.where(F.col("place") >= height).select("conv_id", F.col("place").alias("turn"), "role", "text")
    return borrowed.unionByName(own), ids, table


# ---- trie


def with_paths(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """rows with ``path`` and ``path_before``: where their conversations left the representatives of their groups; and the stored collisions."""
    contents = rows.groupBy("depth", "print", "role", "text").agg(F.min("conv_id").alias("first_conv"))
    several = contents.groupBy("depth", "print").agg(F.count("*").alias("n"), F.min("first_conv").alias("representative")).where("n > 1")
    collided = stored(several, "collided")
    if collided.isEmpty():
        return rows.withColumns({"path": F.lit(""), "path_before": F.lit("")}), collided
    strays = contents.join(collided, ["depth", "print"]).where("first_conv <> representative").drop("representative", "n")
    left = rows.join(strays, ["depth", "print", "role", "text"]).groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("depth", "first_conv"))).alias("left"))
    until = lambda depth: F.coalesce(F.to_json(F.filter("left", lambda x: x["depth"] <= depth)), F.lit("[]"))
    return rows.join(left, "conv_id", "left").withColumns({"path": until(F.col("depth")), "path_before": until(F.col("depth") - 1)}), collided


def list_digests(members: DataFrame) -> DataFrame:
    """(depth, print, path, ends_sha256): SHA-256 of each node's conv_ids, ascending and joined by commas."""

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for key, run in groupby(zip(*(c.to_pylist() for c in batch.columns), strict=True), lambda r: r[:3]):
                ids = [r[3] for r in run]
                rows += [(*key, ids[i], ",".join(map(str, ids[i : i + PIECE_IDS]))) for i in range(0, len(ids), PIECE_IDS)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string()))], names=[*KEY, "first", "piece"])

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, state = None, hashlib.sha256()
        made = lambda rows: pa.RecordBatch.from_arrays([pa.array([r[0][i] for r in rows], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.string()))] + [pa.array([r[1] for r in rows], pa.string())], names=[*KEY, "ends_sha256"])
        for batch in batches:
            rows = []
            for *key, piece in zip(*(batch.column(c).to_pylist() for c in (*KEY, "piece")), strict=True):
                if key != last:
                    if last is not None:
                        rows.append((last, state.hexdigest()))
                    last, state = key, hashlib.sha256(piece.encode())
                else:
                    state.update(f",{piece}".encode())
            yield made(rows)
        if last is not None:
            yield made([(last, state.hexdigest())])

    by = (*KEY, "conv_id")
    cut = members.select(*by).repartitionByRange(*by).sortWithinPartitions(*by).mapInArrow(pieces, "depth long, print long, path string, first long, piece string")
    return cut.repartition(*KEY).sortWithinPartitions(*KEY, "first").mapInArrow(digests, "depth long, print long, path string, ends_sha256 string")


def prefix_trie(turns: DataFrame, conversations: DataFrame | None = None, primes: tuple[int, int] = PRIMES) -> DataFrame:
    """One row per node of the trie of ``turns`` (conv_id, turn, role, text).

    ``conversations`` (conv_id), if given, also names those without turns; they are
    members of the root.  Columns: conv_id (smallest member), depth, parent_conv_id
    (null for the root), n_convs, n_children, n_leaves (childless nodes of the
    subtree, itself included), saved_tokens (over the subtree: (members - 1) times the
    words of a node's last text) and ends_sha256 (of the ids of members that end here).
    """
    rows = clean_turns(turns)
    values = {"value_1": F.pmod(F.xxhash64("role", "text"), F.lit(primes[0])), "value_2": F.pmod(F.xxhash64("text", "role", F.lit(1)), F.lit(primes[1]))}
    series: dict[str, tuple[str, int, int | None]] = {f"print_{i}": (f"value_{i}", BASES[i - 1], primes[i - 1]) for i in (1, 2)}
    with text_batches(turns.sparkSession):
        rows, scan = scanned(rows.withColumns(values | {"words": F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")).cast("long")}), "conv_id", turn_order(), series)
    both = lambda a, b: F.shiftleft(a, 32).bitwiseOR(F.col(b))
    rows = rows.select("conv_id", (F.col("place") + 1).alias("depth"), both("print_1", "print_2").alias("print"), both("print_1_before", "print_2_before").alias("print_before"), "role", "text", "words")
    rows, collided = with_paths(rows)

    nodes = stored(rows.groupBy(*KEY).agg(F.min("conv_id").alias("rep"), F.count("*").alias("n_convs"), F.max("print_before").alias("print_before"), F.max("path_before").alias("path_before"), F.max("words").alias("words")), "nodes")
    children = nodes.groupBy((F.col("depth") - 1).alias("depth"), F.col("print_before").alias("print"), F.col("path_before").alias("path")).agg(F.count("*").alias("n_children"))
    grown = nodes.join(children, [*KEY], "left").withColumns({"n_children": F.coalesce("n_children", F.lit(0)), "own": (F.col("n_convs") - 1) * F.col("words")})
    valued, sums_scan = scanned(grown, "rep", [F.col("depth")], {"saved": ("own", 1, None)})
    weights = stored(valued.groupBy("rep").agg(F.sum("own").alias("total"), F.sum((F.col("n_children") == 0).cast("long")).alias("leaf")), "weights")
    passed = rows.select("conv_id", *KEY).join(weights.withColumnRenamed("rep", "conv_id"), "conv_id").groupBy(*KEY).agg(F.sum("total").alias("total"), F.sum("leaf").alias("n_leaves"))
    parents = nodes.select(F.col("depth").alias("parent_depth"), F.col("print").alias("parent_print"), F.col("path").alias("parent_path"), F.col("rep").alias("parent_rep"))
    lasts = rows.groupBy("conv_id").agg(F.max(F.struct(*KEY)).alias("last")).select("conv_id", "last.*")

    everyone = lasts.select("conv_id") if conversations is None else conversations.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id")).distinct()
    silent = everyone.join(lasts.select("conv_id"), "conv_id", "left_anti").select("conv_id", F.lit(0).cast("long").alias("depth"), F.lit(0).cast("long").alias("print"), F.lit("").alias("path"))
    ends = stored(list_digests(lasts.unionByName(silent)), "ends")

    nothing = hashlib.sha256(b"").hexdigest()
    below = (
        valued.join(passed, [*KEY])
        .join(parents, (F.col("parent_depth") == F.col("depth") - 1) & (F.col("parent_print") == F.col("print_before")) & (F.col("parent_path") == F.col("path_before")), "left")
        .join(ends, [*KEY], "left")
        .select(F.col("rep").alias("conv_id"), "depth", "parent_rep", "n_convs", "n_children", "n_leaves", (F.col("total") - F.col("saved_before")).alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(nothing)).alias("ends_sha256"))
    )
    facts = (
        everyone.select("conv_id", F.lit(1).alias("n_convs"), F.lit(0).alias("n_children"), F.lit(0).cast("long").alias("leaf"), F.lit(0).cast("long").alias("total"), F.lit(None).cast("string").alias("ends"))
        .unionByName(nodes.where("depth = 1").select(F.lit(None).cast("long").alias("conv_id"), F.lit(0).alias("n_convs"), F.lit(1).alias("n_children"), F.lit(0).cast("long").alias("leaf"), F.lit(0).cast("long").alias("total"), F.lit(None).cast("string").alias("ends")))
        .unionByName(weights.select(F.lit(None).cast("long").alias("conv_id"), F.lit(0).alias("n_convs"), F.lit(0).alias("n_children"), "leaf", "total", F.lit(None).cast("string").alias("ends")))
        .unionByName(ends.where("depth = 0").select(F.lit(None).cast("long").alias("conv_id"), F.lit(0).alias("n_convs"), F.lit(0).alias("n_children"), F.lit(0).cast("long").alias("leaf"), F.lit(0).cast("long").alias("total"), F.col("ends_sha256").alias("ends")))
    )
    root = facts.agg(*(f(c).alias(c) for c, f in (("conv_id", F.min), ("n_convs", F.sum), ("n_children", F.sum), ("leaf", F.sum), ("total", F.sum), ("ends", F.max)))).where("n_convs > 0")
    smallest = root.select("conv_id", F.lit(0).cast("long").alias("depth"), F.lit(None).cast("long").alias("parent_rep"), "n_convs", "n_children", F.when(F.col("n_children") == 0, 1).otherwise(F.col("leaf")).alias("n_leaves"), F.col("total").alias("saved_tokens"), F.coalesce("ends", F.lit(nothing)).alias("ends_sha256"))
    least = everyone.agg(F.min("conv_id").alias("least")).first()["least"]
    parent = F.when(F.col("depth") == 1, F.lit(least)).otherwise(F.col("parent_rep")).cast("long").alias("parent_conv_id")
    out = stored(below.unionByName(smallest).select("conv_id", "depth", parent, "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"), "trie")
    dropped(scan, collided, nodes, sums_scan, weights, ends)
    return out


#: DuckDB SQL for the rows of op12_prefix_trie: all pairs of a node and one of its ancestors.
SQL = """
with turns as (
  select conv_id, coalesce(role, '') as role, coalesce(text, '') as text, row_number() over (partition by conv_id order by turn nulls first, coalesce(role, ''), coalesce(text, '')) - 1 as place
  from conversations where conv_id is not null),
convs as (
  select conv_id, xor(list_reduce(list_prepend(4294967295::ubigint, list_transform(string_split(conv_id::varchar, ''), lambda x: ascii(x)::ubigint)),
    lambda a, b: list_reduce(list_prepend(xor(a, b), [0, 0, 0, 0, 0, 0, 0, 0]::ubigint[]), lambda x, i: xor(x >> 1, 3988292384::ubigint * (x & 1)))), 4294967295::ubigint) % 4 as height
  from (select distinct conv_id from turns)),
rebuilt as (
  select c.conv_id, t.place, t.role, t.text from convs c join turns t on t.conv_id = c.conv_id - c.conv_id % 20 and t.place < c.height
  union all
  select t.conv_id, t.place, t.role, t.text from turns t join convs c on c.conv_id = t.conv_id where t.place >= c.height),
prefixes as (
  select conv_id, row_number() over w as depth, sha256(string_agg(sha256(role) || sha256(text), '') over w) as hash, len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')) as words
  from rebuilt window w as (partition by conv_id order by place rows between unbounded preceding and current row)
  union all
  select conv_id, 0, '', 0 from convs),
nodes as (select depth, hash, min(conv_id) as rep, count(*) as n_convs, (count(*) - 1) * max(words) as own from prefixes group by depth, hash),
passes as (select p.conv_id, n.* from prefixes p join nodes n using (depth, hash)),
kin as (select distinct a.depth as up_depth, a.rep as up_rep, b.depth, b.rep, b.own from passes a join passes b on b.conv_id = a.conv_id and b.depth >= a.depth),
parents as (select depth, rep, max(up_rep) as parent_rep from kin where up_depth = depth - 1 group by depth, rep),
families as (select up_depth, up_rep, count(*) as n_children from kin where depth = up_depth + 1 group by up_depth, up_rep),
subtrees as (
  select k.up_depth, k.up_rep, sum(k.own) as saved_tokens, count(*) filter (where f.up_rep is null) as n_leaves
  from kin k left join families f on f.up_depth = k.depth and f.up_rep = k.rep group by k.up_depth, k.up_rep),
ends as (select depth, hash, string_agg(conv_id::varchar, ',' order by conv_id) as ids from (select conv_id, max(depth) as depth, max_by(hash, depth) as hash from prefixes group by conv_id) group by depth, hash)
select n.rep as conv_id, n.depth, p.parent_rep as parent_conv_id, n.n_convs, coalesce(f.n_children, 0) as n_children, s.n_leaves, s.saved_tokens::bigint as saved_tokens, sha256(coalesce(e.ids, '')) as ends_sha256
from nodes n
left join parents p on p.depth = n.depth and p.rep = n.rep
left join families f on f.up_depth = n.depth and f.up_rep = n.rep
join subtrees s on s.up_depth = n.depth and s.up_rep = n.rep
left join ends e on e.depth = n.depth and e.hash = n.hash
"""
