"""Running values, percentiles and ordered matches within keys, whatever share of all rows a key holds.

A key's rows are ordered, so a plain window puts them into one task.  Where the
largest key has more than MOST_ROWS rows, rows are range-partitioned and sorted by
(key, order) instead and cut into pieces of PIECE_ROWS consecutive rows; each piece
is worked on by itself, a row per piece and key carries what the pieces before it
hold, and both are combined.  The pieces are a table in the shared folder: a task
that is repeated must see the same pieces.  Both ways give the same values; only the
plan differs.

* ``running``: sums, minima and maxima over the rows before (or after) each row, and
  so ranks (sums of 1), latest values (maxima of structs that begin with the order)
  and next values (minima over the rows that follow)
* ``percentiles``: exact, from counts per value and their running totals
* ``reached``: an automaton over each key's ordered rows.  A piece is a function from
  states to states; functions compose in any grouping, so pieces are composed level
  by level and no list grows with a key

Defined results: null keys form a group of their own; rows that are equal in order
come in any order, so ``order`` should end with a unique column; an empty table gives
no rows.  The caller may drop the pieces (second result) once the first is written.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from granary.sources.tables import stored

MOST_ROWS, PIECE_ROWS, FAN = 1 << 20, 1 << 14, 1 << 10
PIECE = "ordered:piece"
AGGREGATES: Mapping[str, Callable[[Column], Column]] = {"sum": F.sum, "min": F.min, "max": F.max}


def largest_group(df: DataFrame, keys: Sequence[str]) -> int:
    """Rows of the key with the most: one pass with partial counts."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0


def in_pieces(df: DataFrame, keys: Sequence[str], order: Sequence[str], piece_rows: int) -> DataFrame:
    """df as a stored table with its piece, a number that grows with (keys, order)."""
    by = [*keys, *order]
    ordered = df.repartitionByRange(*by).sortWithinPartitions(*by)
    return stored(ordered.withColumn(PIECE, F.floor(F.monotonically_increasing_id() / piece_rows)), "pieces")


def same(a: DataFrame, b: DataFrame, columns: Sequence[str]) -> Column:
    return reduce(lambda x, y: x & y, (a[c].eqNullSafe(b[c]) for c in columns))


def matched(a: DataFrame, b: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Inner join where null keys meet; b's keys are dropped."""
    other = b.select(*(F.col(f"`{c}`").alias(f"ordered:{c}") for c in columns), *(F.col(f"`{c}`") for c in b.columns if c not in columns))
    on = reduce(lambda x, y: x & y, (F.col(f"`{c}`").eqNullSafe(F.col(f"`ordered:{c}`")) for c in columns))
    return a.join(other, on).drop(*(f"ordered:{c}" for c in columns))


def running(df: DataFrame, keys: Sequence[str], order: Sequence[str], values: Mapping[str, tuple[str, Column]], inclusive: bool = True, backwards: bool = False, most_rows: int = MOST_ROWS, piece_rows: int = PIECE_ROWS) -> tuple[DataFrame, DataFrame | None]:
    """(df with a column for each of values, pieces or None): name to (sum, min or max, what is gathered).

    Over the rows of the key up to each row in ``order``, itself included or not; with
    ``backwards`` over those from it on.  Nothing before a row: null, for sums too.
    """
    way = [F.desc(c) if backwards else F.asc(c) for c in order]
    frame = lambda *by: Window.partitionBy(*by).orderBy(*way).rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    if largest_group(df, keys) <= most_rows:
        return df.withColumns({name: AGGREGATES[kind](c).over(frame(*keys)) for name, (kind, c) in values.items()}), None
    pieces = in_pieces(df, keys, order, piece_rows)
    local = pieces.withColumns({f"ordered:own:{n}": AGGREGATES[kind](c).over(frame(*keys, PIECE)) for n, (kind, c) in values.items()})
    totals = pieces.groupBy(*keys, PIECE).agg(*(AGGREGATES[kind](c).alias(f"ordered:all:{n}") for n, (kind, c) in values.items()))
    earlier = Window.partitionBy(*keys).orderBy(F.desc(PIECE) if backwards else F.asc(PIECE)).rowsBetween(Window.unboundedPreceding, -1)
    carry = totals.select(*keys, f"`{PIECE}`", *(AGGREGATES[kind](F.col(f"`ordered:all:{n}`")).over(earlier).alias(f"ordered:carry:{n}") for n, (kind, _) in values.items()))
    both = matched(local, carry, [*keys, PIECE])

    def combined(name: str, kind: str) -> Column:
        own, before = F.col(f"`ordered:own:{name}`"), F.col(f"`ordered:carry:{name}`")
        return F.coalesce(own + before, own, before) if kind == "sum" else {"min": F.least, "max": F.greatest}[kind](own, before)

    return both.select(*(F.col(f"`{c}`") for c in df.columns), *(combined(n, kind).alias(n) for n, (kind, _) in values.items())), pieces


def percentiles(df: DataFrame, keys: Sequence[str], value: str, wanted: Mapping[str, tuple[float, str]], most_rows: int = MOST_ROWS, piece_rows: int = PIECE_ROWS) -> tuple[DataFrame, tuple[DataFrame, ...]]:
    """(keys with a column for each of wanted, the tables behind it): name to (fraction, ``between`` or ``rank``).

    ``between`` interpolates at fraction * (n - 1), as percentile_cont does; ``rank``
    is element floor(fraction * n) of the sorted values, from 0, the last at most.
    Nulls don't count; a key without values is left out.
    """
    held = df.where(F.col(value).isNotNull())
    counts = stored(held.groupBy(*keys, value).agg(F.count("*").alias("ordered:n")), "counts")  # made once, read three times
    upto, pieces = running(counts, keys, [value], {"ordered:upto": ("sum", F.col("`ordered:n`"))}, most_rows=most_rows, piece_rows=piece_rows)
    totals = counts.groupBy(*keys).agg(F.sum("`ordered:n`").alias("ordered:total"))
    rows = matched(upto, totals, keys)
    n = F.col("`ordered:total`")
    at = lambda rank: F.min(F.when(F.col("`ordered:upto`") >= rank, F.col(value)))
    found = []
    for name, (fraction, kind) in wanted.items():
        if kind == "rank":
            found.append(at(F.least(F.floor(n * fraction) + 1, n)).alias(name))
        else:
            place = (n - 1) * F.lit(fraction)
            low, high, part = at(F.floor(place) + 1), at(F.ceil(place) + 1), F.max(place - F.floor(place))
            found.append((low + (high - low) * part).alias(name))
    return rows.groupBy(*keys).agg(*found), (counts,) if pieces is None else (counts, pieces)


def reached(df: DataFrame, keys: Sequence[str], order: Sequence[str], symbol: Column, n_states: int, step: Callable[[Column, Column], Column], most_rows: int = MOST_ROWS, piece_rows: int = PIECE_ROWS, fan: int = FAN) -> tuple[DataFrame, DataFrame | None]:
    """(keys, state) that an automaton reaches from state 0 over each key's rows in order; step(state, symbol) is the next state."""
    start = F.sequence(F.lit(0), F.lit(n_states - 1))
    symbols = F.transform(F.array_sort(F.collect_list(F.struct(*order, symbol.alias("ordered:symbol")))), lambda x: x["ordered:symbol"])
    over = lambda read: F.aggregate(read, start, lambda states, s: F.transform(states, lambda x: step(x, s)))
    pieces, rows = None, df
    if largest_group(df, keys) > most_rows:
        rows = pieces = in_pieces(df, keys, order, piece_rows)
    else:
        rows = df.withColumn(PIECE, F.lit(0).cast("long"))
    made = rows.groupBy(*keys, PIECE).agg(symbols.alias("ordered:read")).select(*keys, f"`{PIECE}`", over(F.col("`ordered:read`")).alias("ordered:f"))
    composed = F.aggregate(F.transform(F.array_sort(F.collect_list(F.struct(f"`{PIECE}`", "`ordered:f`"))), lambda x: x["ordered:f"]), start, lambda states, f: F.transform(states, lambda x: F.get(f, x)))
    if pieces is not None:  # fan pieces at a time; then a row per partition and key is left at least
        for _ in range(2):
            made = made.groupBy(*keys, F.floor(F.col(f"`{PIECE}`") / fan).alias("ordered:up")).agg(composed.alias("ordered:f")).withColumnRenamed("ordered:up", PIECE)
        made = made.groupBy(*keys).agg(composed.alias("ordered:f"))
    return made.select(*keys, F.get("`ordered:f`", F.lit(0)).alias("state")), pieces


def sequence_step(wanted: Sequence[str]) -> Callable[[Column, Column], Column]:
    """The automaton of an ordered subsequence, gaps allowed: state k once the first k values have come."""
    values = F.array(*map(F.lit, wanted))
    return lambda state, symbol: F.when(F.coalesce(symbol == F.get(values, state), F.lit(False)), state + 1).otherwise(state)


def near_in_time(left: DataFrame, right: DataFrame, keys: Sequence[str], at: str, other_at: str, before_s: int, after_s: int) -> DataFrame:
    """Pairs of rows of one key where right's time lies in [at - before_s, at + after_s): left's columns and right's without keys.

    Time is cut into bins as long as the span.  A right row lies in one bin, a left row
    asks the two at most that its span touches; so each pair meets once, and a key's rows
    are spread over as many tasks as it has bins.  Rows with a null key or time meet none.
    """
    width = (before_s + after_s) * 1_000_000
    us = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    low, high = us(at) - before_s * 1_000_000, us(at) + after_s * 1_000_000
    bins = F.array_distinct(F.array(F.floor(low / width), F.floor((high - 1) / width)))
    asked = left.where(F.col(at).isNotNull()).select(F.struct(*(F.col(f"`{c}`") for c in left.columns)).alias("ordered:left"), low.alias("ordered:low"), high.alias("ordered:high"), F.explode(bins).alias("ordered:bin"))
    own = [c for c in right.columns if c not in keys]
    other = right.select(us(other_at).alias("ordered:us"), F.floor(us(other_at) / width).alias("ordered:in"), F.struct(*(F.col(f"`{c}`") for c in right.columns)).alias("ordered:right"))
    on = (F.col("`ordered:bin`") == F.col("`ordered:in`")) & (F.col("`ordered:us`") >= F.col("`ordered:low`")) & (F.col("`ordered:us`") < F.col("`ordered:high`"))
    for k in keys:
        on = on & (F.col("`ordered:left`")[k] == F.col("`ordered:right`")[k])
    met = asked.join(other, on)
    return met.select(*(F.col("`ordered:left`")[c].alias(c) for c in left.columns), *(F.col("`ordered:right`")[c].alias(c) for c in own))
