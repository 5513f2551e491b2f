"""The case view that most analytics start from."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.sources.tables import table


def line_totals(lines: DataFrame) -> DataFrame:
    """Per case: claimed and approved amounts, whether a query was raised, number of lines.  One partial aggregate, one shuffle."""
    amount, returned = F.col("l_extendedprice"), F.col("l_returnflag") == "R"
    return lines.groupBy("l_orderkey").agg(
        F.sum(amount).alias("claimed"),
        F.coalesce(F.sum(F.when(~returned, amount)), F.lit(0.0)).alias("approved"),
        F.bool_or(returned & (F.col("l_linestatus") == "F")).alias("queried"),
        F.count("*").alias("n_lines"),
    )


def cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """case_id, panel, kind, member_id, opened, status, priority, claimed, approved, queried, n_lines; cases without lines have zeros."""
    orders, customer, nation = (table(spark, sf_dir, n) for n in ("orders", "customer", "nation"))
    totals = line_totals(table(spark, sf_dir, "lineitem"))
    joined = orders.join(customer, orders["o_custkey"] == customer["c_custkey"]).join(nation, customer["c_nationkey"] == nation["n_nationkey"]).join(totals, orders["o_orderkey"] == totals["l_orderkey"], "left")
    return joined.select(
        F.col("o_orderkey").alias("case_id"), F.col("n_name").alias("panel"), F.col("c_mktsegment").alias("kind"), F.col("o_custkey").alias("member_id"), F.col("o_orderdate").alias("opened"), F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("priority"),
        F.coalesce("claimed", F.lit(0.0)).alias("claimed"), F.coalesce("approved", F.lit(0.0)).alias("approved"), F.coalesce("queried", F.lit(False)).alias("queried"), F.coalesce("n_lines", F.lit(0)).cast("long").alias("n_lines"),
    )
