"""Merges into a versioned table (A9-A11, A13): customers' orders of three periods, all of them."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.plans.base import Plans
from granary.sources import versioned
from granary.sources.tables import shared_dir, stored, table

plans = Plans()

PERIODS = """p as (select o_custkey, case when o_orderdate < timestamp '1997-01-01' then 0 when o_orderdate < timestamp '1999-01-01' then 1 else 2 end as period, count(*) as n, max(o_totalprice) as top, min(case when o_custkey % 7 <> 0 then o_orderpriority end) as sample from orders where o_custkey is not null group by all)"""


def periods(spark: SparkSession, sf_dir: str) -> list[DataFrame]:
    """Orders per customer before 1997, before 1999 and later; a customer is in those in which they ordered."""
    orders = table(spark, sf_dir, "orders").where("o_custkey is not null")
    period = F.when(F.col("o_orderdate") < F.lit("1997-01-01").cast("timestamp_ntz"), 0).when(F.col("o_orderdate") < F.lit("1999-01-01").cast("timestamp_ntz"), 1).otherwise(2)
    sample = F.min(F.when(F.col("o_custkey") % 7 != 0, F.col("o_orderpriority"))).alias("sample")
    rows = orders.withColumn("period", period).groupBy("o_custkey", "period").agg(F.count("*").alias("n"), F.max("o_totalprice").alias("top"), sample)
    return [rows.where(F.col("period") == k).drop("period") for k in range(3)]


def loaded(spark: SparkSession, sf_dir: str, policy: dict[str, str], **options: bool) -> DataFrame:
    """The table after the first period, merges of the other two, and the second once more, which changes nothing."""
    root = f"{shared_dir(spark)}/granary/{uuid.uuid4().hex}/sink"
    first, *later = periods(spark, sf_dir)
    versioned.created(first, root, ["o_custkey"])
    for name, batch in (("second", later[0]), ("third", later[1]), ("second", later[0])):
        versioned.merged(batch, root, policy, name, **options)
    versioned.cleaned(spark, root)
    return stored(versioned.read(spark, root), "merged")


@plans.query(f"with {PERIODS} select o_custkey, sum(n)::bigint as n, max(top) as top, arg_min(sample, period) filter (where sample is not null) as sample from p group by o_custkey")
def a9_merge_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts added, the largest amount kept, an old sample kept."""
    return loaded(spark, sf_dir, {"n": "sum", "top": "greatest", "sample": "old"})


@plans.query(f"with {PERIODS} select o_custkey, arg_max(n, period) as n, arg_max(top, period) as top, arg_max(sample, period) filter (where sample is not null) as sample from p group by o_custkey")
def a10_replace_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest row of each key."""
    return loaded(spark, sf_dir, {"n": "new", "top": "new", "sample": "new"})


@plans.query(f"with {PERIODS} select o_custkey, max(n) as n, arg_min(top, period) as top, arg_min(sample, period) filter (where sample is not null) as sample from p group by o_custkey")
def a11_coalesce_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Old values stay unless null; the larger count wins."""
    return loaded(spark, sf_dir, {"n": "greatest", "top": "old", "sample": "old"})


@plans.query(f"with {PERIODS} select o_custkey, arg_min(n, period) as n, arg_min(top, period) as top, min(period)::int as period from p group by o_custkey")
def a13_insert_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows inserted where their key is new, and the row that was there where it isn't."""
    root = f"{shared_dir(spark)}/granary/{uuid.uuid4().hex}/sink"
    first, *later = (rows.select("o_custkey", "n", "top", F.lit(k).alias("period")) for k, rows in enumerate(periods(spark, sf_dir)))
    versioned.created(first, root, ["o_custkey"])
    for name, batch in zip(("second", "third"), later, strict=True):
        versioned.merged(batch, root, {"n": "old", "top": "old", "period": "old"}, name, matched=False)
    versioned.cleaned(spark, root)
    return stored(versioned.read(spark, root), "merged")
