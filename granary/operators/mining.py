"""Patterns mined over closed cases: grouped rates and spreads that pass thresholds."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granary.operators import ordered
from granary.sources.tables import stored

# Least group sizes and thresholds of the miners.
QUERY_LEAST, QUERY_RATE = 5, 0.6
DEDUCTION_LEAST, DEDUCTION_RATE = 5, 0.4
DOCUMENT_LEAST, DOCUMENT_SIDE, DOCUMENT_DELTA = 10, 3, 0.2
DWELL_LEAST, VARIANCE_LEAST, CLUSTER_LEAST = 10, 10, 3


def rate(flag: Column) -> Column:
    """Share of rows for which flag holds; null flags count as not."""
    return F.avg(F.coalesce(flag, F.lit(False)).cast("double"))


def flag_rates(rows: DataFrame, keys: Sequence[str], flag: Column, least: int, above: float) -> DataFrame:
    """(keys, n, rate) of groups with enough rows and a rate above the threshold."""
    return rows.groupBy(*keys).agg(F.count("*").alias("n"), rate(flag).alias("rate")).where((F.col("n") >= least) & (F.col("rate") > above))


def deductions(cases: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, n, cut_rate, mean_cut): how often and by how much the approved amount falls short of the claimed one."""
    cut = F.when(F.col("claimed") > 0, 1 - F.col("approved") / F.col("claimed"))
    found = cases.where("claimed > 0").groupBy(*keys).agg(F.count("*").alias("n"), rate(F.col("approved") < F.col("claimed")).alias("cut_rate"), F.avg(cut).alias("mean_cut"))
    return found.where((F.col("n") >= DEDUCTION_LEAST) & (F.col("cut_rate") > DEDUCTION_RATE))


def document_correlations(cases: DataFrame, documents: DataFrame, key: str) -> DataFrame:
    """Rate of flagged cases with and without each document category, per key.

    documents: distinct (case_id, category).  The side without a category is the
    key's total minus the side with it, so no case x category product is built.
    """
    held = documents.join(cases.select("case_id", key, "queried"), "case_id").groupBy(key, "category").agg(F.count("*").alias("n_with"), F.sum(F.col("queried").cast("long")).alias("q_with"))
    totals = cases.groupBy(key).agg(F.count("*").alias("n"), F.sum(F.col("queried").cast("long")).alias("q"))
    both = held.join(totals, key).withColumns({"n_without": F.col("n") - F.col("n_with"), "rate_with": F.col("q_with") / F.col("n_with")})
    both = both.where((F.col("n") >= DOCUMENT_LEAST) & (F.col("n_with") >= DOCUMENT_SIDE) & (F.col("n_without") >= DOCUMENT_SIDE))
    both = both.withColumn("rate_without", (F.col("q") - F.col("q_with")) / F.col("n_without")).withColumn("delta", F.abs(F.col("rate_with") - F.col("rate_without")))
    return both.where(F.col("delta") > DOCUMENT_DELTA).select(key, "category", "n_with", "n_without", "rate_with", "rate_without", "delta")


def amount_variance(cases: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, n, mean_ratio, sd_ratio, confidence): spread of the approval ratio; confidence is 1 - min(sd, 1)."""
    ratio = F.col("approved") / F.col("claimed")
    found = cases.where("claimed > 0").groupBy(*keys).agg(F.count("*").alias("n"), F.avg(ratio).alias("mean_ratio"), F.stddev_samp(ratio).alias("sd_ratio"))
    return found.where(F.col("n") >= VARIANCE_LEAST).withColumn("confidence", 1 - F.least(F.col("sd_ratio"), F.lit(1.0)))


def dwell_times(events: DataFrame, key: str, stage: str, time: str, tie: str) -> DataFrame:
    """(key, stage, dwell_s): seconds from each event of a key to its next one; the last has none.  A key of any size."""
    rows = events.select(key, stage, F.unix_micros(F.col(time).cast("timestamp")).alias("us"), tie)
    timed, _ = ordered.running(rows, [key], ["us", tie], {"next_us": ("min", F.col("us"))}, inclusive=False, backwards=True)
    return timed.select(key, stage, ((F.col("next_us") - F.col("us")) / 1e6).alias("dwell_s")).where("dwell_s is not null")


def dwell_stats(dwell: DataFrame, keys: Sequence[str], least: int = DWELL_LEAST) -> DataFrame:
    """Mean, population deviation, nearest-rank 95th percentile and confidence 1 / (1 + cv) per group.

    The nearest-rank value is element floor(0.95 n) of the sorted values, found by
    counts per value, so groups may be as few and as large as they like.
    """
    dwell = stored(dwell.select(*keys, "dwell_s"), "dwell")  # read twice
    found = dwell.groupBy(*keys).agg(F.count("*").alias("n"), F.avg("dwell_s").alias("mean_s"), F.stddev_pop("dwell_s").alias("sd_s"))
    ranks, _ = ordered.percentiles(dwell, keys, "dwell_s", {"p95_s": (0.95, "rank")})
    found = ordered.matched(found, ranks, keys)
    return found.where(F.col("n") >= least).withColumn("confidence", F.when(F.col("mean_s") > 0, 1 / (1 + F.col("sd_s") / F.col("mean_s"))).otherwise(F.lit(0.0)))


def change_clusters(changes: DataFrame, keys: Sequence[str], claim: str, least: int = CLUSTER_LEAST) -> DataFrame:
    """(keys, n, n_claims) of changes that occur on at least ``least`` distinct claims."""
    return changes.groupBy(*keys).agg(F.count("*").alias("n"), F.count_distinct(claim).alias("n_claims")).where(F.col("n_claims") >= least)


def saturating_confidence(n: Column) -> Column:
    """1 - exp(-n / 8), held within 0.5 and 0.99."""
    return F.least(F.lit(0.99), F.greatest(F.lit(0.5), 1 - F.exp(-n / 8.0)))
