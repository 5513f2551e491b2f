"""Mined patterns (M1-M9) on the case view."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from granary.operators import mining
from granary.operators.cases import cases
from granary.plans.base import CASES, Plans
from granary.sources.tables import table

plans = Plans()


@plans.query(f"with {CASES} select panel, kind, count(*) as n, round(avg(queried::int), 6) as query_rate from cases group by all having count(*) >= 5 and avg(queried::int) > 0.6")
def m1_query_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Panels and kinds whose cases are queried unusually often."""
    found = mining.flag_rates(cases(spark, sf_dir), ("panel", "kind"), F.col("queried"), mining.QUERY_LEAST, mining.QUERY_RATE)
    return found.select("panel", "kind", "n", F.round("rate", 6).alias("query_rate"))


@plans.query(f"with {CASES} select panel, kind, count(*) as n, round(avg((approved < claimed)::int), 6) as cut_rate, round(avg(1 - approved / claimed), 6) as mean_cut from cases where claimed > 0 group by all having count(*) >= 5 and avg((approved < claimed)::int) > 0.4")
def m2_deductions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Panels and kinds whose claims are often cut."""
    return mining.deductions(cases(spark, sf_dir), ("panel", "kind")).select("panel", "kind", "n", F.round("cut_rate", 6).alias("cut_rate"), F.round("mean_cut", 6).alias("mean_cut"))


def case_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct (case_id, category): flag and status of the lines, and whether the case is small."""
    lines = table(spark, sf_dir, "lineitem")
    flags = lines.select(F.col("l_orderkey").alias("case_id"), F.concat("l_returnflag", "l_linestatus").alias("category")).distinct()
    small = lines.groupBy(F.col("l_orderkey").alias("case_id")).count().where("count <= 2").select("case_id", F.lit("small_order").alias("category"))
    return flags.unionByName(small)


CASE_DOCUMENTS = "docs as (select distinct l_orderkey as case_id, l_returnflag || l_linestatus as category from lineitem union all select l_orderkey, 'small_order' from lineitem group by l_orderkey having count(*) <= 2)"


@plans.query(f"""with {CASES}, {CASE_DOCUMENTS},
pairs as (select c.case_id, c.panel, k.category, c.queried::int as q, d.case_id is not null as has from cases c cross join (select distinct category from docs) k left join docs d on d.case_id = c.case_id and d.category = k.category)
select panel, category, count(*) filter (where has) as n_with, count(*) filter (where not has) as n_without, round(avg(q) filter (where has), 6) as rate_with, round(avg(q) filter (where not has), 6) as rate_without,
  round(abs(avg(q) filter (where has) - avg(q) filter (where not has)), 6) as delta
from pairs group by panel, category having count(*) >= 10 and count(*) filter (where has) >= 3 and count(*) filter (where not has) >= 3 and abs(avg(q) filter (where has) - avg(q) filter (where not has)) > 0.2""")
def m3_document_correlation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Document categories that go with more or fewer queries, per panel."""
    found = mining.document_correlations(cases(spark, sf_dir), case_documents(spark, sf_dir), "panel")
    return found.select("panel", "category", "n_with", "n_without", *(F.round(c, 6).alias(c) for c in ("rate_with", "rate_without", "delta")))


DWELL = "dwell as (select event_type, user_id, epoch_us(lead(ts) over (partition by user_id order by ts, event_id)) - epoch_us(ts) as us from events)"


@plans.query(f"""with {DWELL}, ok as (select event_type, us / 1e6 as s from dwell where us is not null)
select event_type, count(*) as n, round(avg(s), 3) as mean_s, round(stddev_pop(s), 3) as sd_s, round(list_sort(list(s))[least(floor(count(*) * 0.95)::bigint + 1, count(*))], 3) as p95_s, round(1 / (1 + stddev_pop(s) / avg(s)), 6) as confidence
from ok group by event_type having count(*) >= 10""")
def m4_stage_dwell(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How long keys stay in each stage until the next event."""
    found = mining.dwell_stats(mining.dwell_times(table(spark, sf_dir, "events"), "user_id", "event_type", "ts", "event_id"), ["event_type"])
    return found.select("event_type", "n", *(F.round(c, 3).alias(c) for c in ("mean_s", "sd_s", "p95_s")), F.round("confidence", 6).alias("confidence"))


@plans.query(f"with {CASES} select panel, kind, count(*) as n, round(avg(approved / claimed), 6) as mean_ratio, round(stddev_samp(approved / claimed), 6) as sd_ratio, round(1 - least(stddev_samp(approved / claimed), 1), 6) as confidence from cases where claimed > 0 group by all having count(*) >= 10")
def m5_amount_variance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spread of the approval ratio."""
    return mining.amount_variance(cases(spark, sf_dir), ("panel", "kind")).select("panel", "kind", "n", *(F.round(c, 6).alias(c) for c in ("mean_ratio", "sd_ratio", "confidence")))


CORRECTIONS = "corrections as (select l_orderkey as case_id, l_linenumber as line, l_partkey as part, l_returnflag as was, lead(l_returnflag) over (partition by l_orderkey order by l_linenumber, l_partkey, l_extendedprice) as became from lineitem)"


def corrections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Successive categories of the lines of a case, as changes from one to the next."""
    after = F.lead("l_returnflag").over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_extendedprice"))
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("case_id"), F.col("l_linenumber").alias("line"), F.col("l_partkey").alias("part"), F.col("l_returnflag").alias("was"), after.alias("became"))


@plans.query(f"with {CORRECTIONS} select was, became, count(*) as n, count(distinct case_id) as n_claims, round(least(0.99, greatest(0.5, 1 - exp(-count(distinct case_id) / 8.0))), 6) as confidence from corrections where became is not null and was <> became group by all having count(distinct case_id) >= 3")
def m6_correction_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changes between categories that recur on several cases."""
    found = mining.change_clusters(corrections(spark, sf_dir).where("became is not null and was <> became"), ("was", "became"), "case_id")
    return found.withColumn("confidence", F.round(mining.saturating_confidence(F.col("n_claims")), 6))


PATTERNS = """patterns as (select panel, kind, n, rate, 'p' || row_number() over (order by panel, kind nulls first) as pattern_id from (
  select panel, kind, count(*) as n, avg(queried::int) as rate from cases group by panel, kind having count(*) >= 5 and avg(queried::int) > 0.5
  union all select panel, null, count(*), avg(queried::int) from cases group by panel having count(*) >= 5 and avg(queried::int) > 0.5))"""


@plans.query(f"""with {CASES}, {PATTERNS.replace("'p' || row_number() over (order by panel, kind nulls first)", "panel || '/' || coalesce(kind, '*')")},
matched as (select case_id, pattern_id, rate, n, row_number() over (partition by case_id order by rate desc, n desc, pattern_id) as place from cases c join patterns p on p.panel = c.panel and (p.kind is null or p.kind = c.kind))
select case_id, pattern_id, round(rate, 6) as rate, place from matched m where place <= 10""".replace("select case_id, pattern_id, rate, n, row", "select case_id, pattern_id, p.rate, p.n, row"))
def m7_pattern_matching(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Patterns whose scope holds for each case, the ten strongest first (the list is a top ten by definition)."""
    known = cases(spark, sf_dir)
    fine = mining.flag_rates(known, ("panel", "kind"), F.col("queried"), 5, 0.5)
    coarse = mining.flag_rates(known, ("panel",), F.col("queried"), 5, 0.5).withColumn("kind", F.lit(None).cast("string"))
    patterns = fine.unionByName(coarse).select(F.col("panel").alias("p_panel"), F.col("kind").alias("p_kind"), "n", "rate", F.concat_ws("/", "panel", F.coalesce("kind", F.lit("*"))).alias("pattern_id"))
    scope = (F.col("panel") == F.col("p_panel")) & (F.col("p_kind").isNull() | (F.col("p_kind") == F.col("kind")))
    place = F.row_number().over(Window.partitionBy("case_id").orderBy(F.desc("rate"), F.desc("n"), "pattern_id"))
    matched = known.select("case_id", "panel", "kind").join(patterns, scope).withColumn("place", place.cast("long"))
    return matched.where("place <= 10").select("case_id", "pattern_id", F.round("rate", 6).alias("rate"), "place")


@plans.query(f"""with {CASES}, {PATTERNS.replace("'p' || row_number() over (order by panel, kind nulls first)", "panel || '/' || coalesce(kind, '*')")}
select pattern_id, count(*) as n_seen, count(*) filter (where c.queried) as n_confirmed, round(avg((c.queried = (p.rate >= 0.5))::int), 6) as hit_rate, count(*) filter (where abs(c.approved / c.claimed - 0.7) <= 0.15) as n_ratio_hits
from cases c join patterns p on p.panel = c.panel and p.kind = c.kind where c.claimed > 0 group by pattern_id""")
def m8_pattern_feedback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predictions of patterns against what happened: queries at a threshold of 0.5, ratios within 0.15."""
    known = cases(spark, sf_dir)
    patterns = mining.flag_rates(known, ("panel", "kind"), F.col("queried"), 5, 0.5).withColumn("pattern_id", F.concat_ws("/", "panel", "kind")).drop("n")
    joined = known.where("claimed > 0").join(patterns, ["panel", "kind"])
    return joined.groupBy("pattern_id").agg(
        F.count("*").alias("n_seen"), F.count_if("queried").alias("n_confirmed"), F.round(mining.rate(F.col("queried") == (F.col("rate") >= 0.5)), 6).alias("hit_rate"),
        F.count_if(F.abs(F.col("approved") / F.col("claimed") - 0.7) <= 0.15).alias("n_ratio_hits"),
    )


@plans.query("""with ranked as (select c_mktsegment as kind, o_orderpriority as field, o_clerk, o_orderkey from (select *, 'x' as o_clerk from orders) join customer on c_custkey = o_custkey),
counted as (select kind, field, count(*) as n, max(o_orderkey) as latest from ranked group by all)
select kind, field, n, latest, round(least(0.99, greatest(0.5, 1 - exp(-n / 8.0))), 6) as confidence from counted where n >= 3""")
def m9_format_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Field formats seen at least three times per kind, with the latest sample."""
    orders, customer = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    counted = orders.join(customer, orders["o_custkey"] == customer["c_custkey"]).groupBy(F.col("c_mktsegment").alias("kind"), F.col("o_orderpriority").alias("field")).agg(F.count("*").alias("n"), F.max("o_orderkey").alias("latest"))
    return counted.where("n >= 3").withColumn("confidence", F.round(mining.saturating_confidence(F.col("n")), 6))
