"""One value out of several sources: ranked facts, bills in tiers, slots that sources fill."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granary.operators.relational import first_per

# Days beyond which a date belongs to another era, what an agreeing source adds, and at most.
ERA_DAYS, AGREEING, AGREEING_MOST = 730, 0.04, 0.1
# Tiers of hospital bills in the order that they are asked, and bills beside them.
TIERS = ("final", "interim", "fallback")
SIDES = ("pharmacy", "implant", "subbill")


def fused(facts: DataFrame, group: Sequence[str], reference: str | None = None) -> DataFrame:
    """The winning fact of each group: rank ascending, plausible dates first, score descending, page ascending.

    Facts have value, rank (0 is most authoritative), score and page, and with
    ``reference`` a day column and the group's reference day; a day further than
    ERA_DAYS from it comes last among facts of equal rank.  A missing day or
    reference is plausible.  Every further fact of the same value (case and
    outer spaces aside) adds to the confidence; another value makes the group
    contested.
    """
    far = F.coalesce(F.abs(F.datediff("day", reference)) > ERA_DAYS, F.lit(False)).cast("int") if reference else F.lit(0)
    known = facts.withColumn("_norm", F.lower(F.trim("value"))).withColumn("era", far)
    order = [F.asc("rank"), F.asc("era"), F.desc("score"), F.asc("page")]
    # the best fact of each value, then of each group: both steps are cut per task or small
    per_value = first_per(known, [*group, "_norm"], order)
    agreeing = known.groupBy(*group, "_norm").agg(F.count("*").alias("agreeing"))
    values = per_value.join(agreeing, [*group, "_norm"])
    counted = values.groupBy(*group).agg(F.count("*").alias("n_values"))
    best = first_per(values, list(group), order).join(counted, list(group))
    boost = F.least(F.lit(AGREEING_MOST), AGREEING * (F.col("agreeing") - 1))
    confidence = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("score") + boost))
    return best.select(*group, "value", "rank", "page", F.round(confidence, 6).alias("confidence"), (F.col("n_values") > 1).alias("contested"))


def agree(a: Column, b: Column) -> Column:
    """Amounts within one unit or one per cent of the larger."""
    return F.abs(a - b) <= F.greatest(F.lit(1.0), 0.01 * F.greatest(a, b))


def reconciled_bills(bills: DataFrame, claim: str) -> DataFrame:
    """(claim, hospital, pharmacy, implant, subbill, total, n_sources, status) of rows (claim, role, stated, line_sum).

    A bill is worth its stated total, else its lines; a fallback needs a stated
    one.  The hospital's amount is the largest of the first tier that has any;
    side bills add up, and make the total only where no hospital bill exists.
    Status: no_financial_data, discrepancy (stated against lines, or within the
    tier used), single_source or reconciled.  Partial aggregates only.
    """
    worth = F.coalesce("stated", "line_sum")
    counts = worth.isNotNull() & F.col("role").isin(*TIERS, *SIDES) & ((F.col("role") != "fallback") | F.col("stated").isNotNull())
    of = lambda role: F.when(counts & (F.col("role") == role), worth)
    split = F.coalesce(counts & ~agree(F.col("stated"), F.col("line_sum")), F.lit(False))
    tiers = [c for t in TIERS for c in (F.min(of(t)).alias(f"low_{t}"), F.max(of(t)).alias(t))]
    found = bills.groupBy(claim).agg(*tiers, *(F.sum(of(s)).alias(s) for s in SIDES), F.count_if(counts).alias("n_sources"), F.bool_or(split).alias("split"))
    hospital = F.coalesce(*TIERS)
    low = F.coalesce(*(f"low_{t}" for t in TIERS))  # of the same tier: both are null or neither
    sides = F.when(F.coalesce(*SIDES).isNotNull(), sum((F.coalesce(s, F.lit(0.0)) for s in SIDES), F.lit(0.0)))
    differs = F.col("split") | F.coalesce(~agree(low, hospital), F.lit(False))
    status = F.when(F.col("n_sources") == 0, "no_financial_data").when(differs, "discrepancy").when(F.col("n_sources") == 1, "single_source").otherwise("reconciled")
    money = lambda c: F.round(c, 2)
    return found.select(claim, money(hospital).alias("hospital"), *(money(F.col(s)).alias(s) for s in SIDES), money(F.coalesce(hospital, sides)).alias("total"), "n_sources", status.alias("status"))


def filled_slots(existing: DataFrame, facts: DataFrame, excluded: DataFrame, candidates: Mapping[str, Sequence[tuple[str, str]]]) -> DataFrame:
    """(claim, slot, value, section): slots that were there, and empty ones filled by the first candidate (category, field) with a value.

    ``existing`` is (claim, slot, value), ``facts`` (claim, section, category,
    field, value), ``excluded`` (claim, section).  A slot that has a value is
    never overwritten (its section is null); excluded sections give none; of one
    candidate the smallest section counts.
    """
    ranked = F.array(*(F.struct(F.lit(slot).alias("slot"), F.lit(i).alias("rank"), F.lit(c).alias("category"), F.lit(f).alias("field")) for slot, pairs in candidates.items() for i, (c, f) in enumerate(pairs)))
    own = F.filter(ranked, lambda x: (x["category"] == F.col("category")) & (x["field"] == F.col("field")))
    usable = facts.where(F.trim("value") != "").join(excluded.distinct(), ["claim", "section"], "left_anti")
    kept = existing.where(F.trim("value") != "").select("claim", "slot", "value", F.lit(None).cast(facts.schema["section"].dataType).alias("section"))
    offered = usable.select("claim", "section", "value", F.inline(F.transform(own, lambda x: F.struct(x["slot"].alias("slot"), x["rank"].alias("rank")))))
    first = first_per(offered, ["claim", "slot"], [F.asc("rank"), F.asc("section"), F.asc("value")])
    return kept.unionByName(first.join(kept, ["claim", "slot"], "left_anti").select("claim", "slot", "value", "section"))
