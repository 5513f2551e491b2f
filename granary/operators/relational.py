"""Named relational compositions: null-safe predicates, top rows per key, merges, intervals."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def holds(condition: Column) -> Column:
    """Two-valued truth: null counts as false."""
    return F.coalesce(condition, F.lit(False))


def first_per(rows: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int = 1) -> DataFrame:
    """The first n rows of each key in a total order.  Spark cuts each task's rows to n per key before the shuffle."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return rows.withColumn("_place", place).where(F.col("_place") <= n).drop("_place")


def inserted_if_absent(target: DataFrame, rows: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """Rows of ``rows`` whose key is not in ``target``, one per key: what an idempotent insert appends."""
    return first_per(rows.join(target.select(*keys), list(keys), "left_anti"), keys, order)


def upserted(old: DataFrame, new: DataFrame, keys: Sequence[str], policy: dict[str, str]) -> DataFrame:
    """Merge of two tables on a key, with how each column is merged and ``action``.

    policy: ``sum`` adds, ``greatest`` keeps the larger, ``old`` keeps what was
    there unless null, ``new`` takes the new value unless null, ``replace`` takes it
    also where it is null.  A full outer join on the key: one shuffle of either side.
    """
    rules = {
        "sum": lambda a, b: F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0)),
        "greatest": lambda a, b: F.greatest(a, b),
        "old": lambda a, b: F.coalesce(a, b),
        "new": lambda a, b: F.coalesce(b, a),
        "replace": lambda a, b: F.when(F.col("_new").isNotNull(), b).otherwise(a),
    }
    a, b = old.withColumn("_old", F.lit(True)).alias("a"), new.withColumn("_new", F.lit(True)).alias("b")
    joined = a.join(b, list(keys), "full_outer")
    action = F.when(F.col("_old").isNull(), "inserted").when(F.col("_new").isNull(), "kept").otherwise("updated")
    return joined.select(*keys, *(rules[how](F.col(f"a.{c}"), F.col(f"b.{c}")).alias(c) for c, how in policy.items()), action.alias("action"))


def page_ranges(pages: DataFrame, keys: Sequence[str], page: str) -> DataFrame:
    """Distinct page numbers of each key as text such as ``4-7, 11`` (gaps and islands)."""
    island = F.col(page) - F.row_number().over(Window.partitionBy(*keys).orderBy(page))
    runs = pages.select(*keys, page).distinct().withColumn("_island", island).groupBy(*keys, "_island").agg(F.min(page).alias("lo"), F.max(page).alias("hi"))
    label = F.when(F.col("lo") == F.col("hi"), F.col("lo").cast("string")).otherwise(F.concat_ws("-", "lo", "hi"))
    listed = runs.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("lo", label.alias("label")))).alias("runs"))
    return listed.select(*keys, F.array_join(F.col("runs.label"), ", ").alias("pages"))


def cover_faults(sections: DataFrame, key: str, total: Column) -> DataFrame:
    """First fault of each key's sections (first_page, last_page), which must tile 1..total; null if they do."""
    w = Window.partitionBy(key).orderBy("first_page", "last_page")
    expected = F.coalesce(F.lag("last_page").over(w), F.lit(0)) + 1
    final = F.lead("last_page").over(w).isNull()
    fault = (
        F.when(F.col("last_page") < F.col("first_page"), "inverted_range")
        .when(F.col("first_page") != expected, "coverage_gap_or_overlap")
        .when(final & (F.col("last_page") != total), "last_page_mismatch")
    )
    checked = sections.select(key, "first_page", fault.alias("fault"))
    return checked.groupBy(key).agg(F.min_by("fault", F.when(F.col("fault").isNotNull(), F.col("first_page"))).alias("fault"))


def absorbed(sections: DataFrame, key: str, readable: str) -> DataFrame:
    """Sections with those that can't be read merged into the one before; leading ones into the next."""
    w = Window.partitionBy(key).orderBy("first_page")
    group = F.greatest(F.sum(F.col(readable).cast("long")).over(w.rowsBetween(Window.unboundedPreceding, 0)), F.lit(1))
    return sections.withColumn("_group", group).groupBy(key, "_group").agg(F.min("first_page").alias("first_page"), F.max("last_page").alias("last_page"), F.bool_or(readable).alias(readable)).drop("_group")


def mode_first_seen(rows: DataFrame, key: str, value: str, position: Sequence[str]) -> DataFrame:
    """Most frequent value per key; of equally frequent ones that seen first."""
    seen = rows.where(F.col(value).isNotNull()).groupBy(key, value).agg(F.count("*").alias("n"), F.min(F.struct(*position)).alias("first"))
    return first_per(seen, [key], [F.desc("n"), F.asc("first"), F.asc(value)]).select(key, value, "n")


def densest_window(rows: DataFrame, key: str, value: str, tolerance: int) -> DataFrame:
    """Start of the window [v, v + tolerance] that holds most values; of equal ones the earliest."""
    reach = F.count("*").over(Window.partitionBy(key).orderBy(value).rangeBetween(0, tolerance))
    return first_per(rows.select(key, value).withColumn("n", reach), [key], [F.desc("n"), F.asc(value)]).select(key, F.col(value).alias("start"), "n")


def cascade(*strategies: tuple[str, Column, float]) -> tuple[Column, Column]:
    """(strategy, confidence) of the first condition that holds; order decides, not confidence."""
    pick = lambda value: reduce(lambda rest, s: F.when(holds(s[1]), F.lit(value(s))).otherwise(rest), reversed(strategies), F.lit(None))
    return pick(lambda s: s[0]), pick(lambda s: s[2])


def compared(op: str, value: Column, *wanted: Column) -> Column:
    """Comparison by name, two-valued.  A missing value equals nothing, so NOT_ forms of membership hold for it; an unknown name is false."""
    first = wanted[0] if wanted else F.lit(None)
    inside = reduce(lambda a, b: a | b, [holds(value == w) for w in wanted], F.lit(False))
    between = (value >= first) & (value <= wanted[1]) if len(wanted) > 1 else F.lit(False)
    forms = {
        "EQUALS": holds(value == first), "NOT_EQUALS": ~holds(value == first), "GREATER_THAN": holds(value > first), "GREATER_THAN_OR_EQUAL": holds(value >= first), "LESS_THAN": holds(value < first), "LESS_THAN_OR_EQUAL": holds(value <= first),
        "BETWEEN": holds(between), "NOT_BETWEEN": holds(~between), "IN": inside, "NOT_IN": ~inside, "EXISTS": value.isNotNull(), "NOT_EXISTS": value.isNull(),
        "CONTAINS": holds(value.cast("string").contains(first.cast("string"))), "NOT_CONTAINS": ~holds(value.cast("string").contains(first.cast("string"))), "MATCHES_PATTERN": holds(F.regexp_like(value.cast("string"), first.cast("string"))),
    }
    return forms.get(op, F.lit(False))


def in_order(actual: Column, wanted: Sequence[str]) -> Column:
    """Whether the wanted values occur in an array in this order, gaps allowed."""
    want = F.array(*map(F.lit, wanted))
    matched = F.aggregate(actual, F.lit(0), lambda i, s: F.when((i < len(wanted)) & (s == F.get(want, i)), i + 1).otherwise(i))
    return matched == len(wanted)
