"""Duplicates, nearest vectors, fusion (D) on the surrogate tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from granary.operators import relational as rel
from granary.operators import similarity as sim
from granary.operators.cases import cases
from granary.operators.neighbours import nearest_pruned
from granary.plans.base import CASES, Plans
from granary.sources.tables import table

plans = Plans()


@plans.query("select doc_id, min(doc_id) over (partition by coalesce(text, '')) as canonical_id from documents")
def d1_exact_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Byte-equal texts point at the first."""
    return sim.first_of_equal(table(spark, sf_dir, "documents"), F.sha2(F.coalesce("text", F.lit("")), 256), "doc_id")


@plans.query("with n as (select doc_id, trim(regexp_replace(lower(coalesce(text, '')), '[^a-z0-9]+', ' ', 'g')) as t from documents) select doc_id, case when t = '' then doc_id else min(doc_id) over (partition by t) end as canonical_id from n")
def d2_normalised_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts equal after normalisation point at the first; empty ones at themselves."""
    return sim.first_of_equal(table(spark, sf_dir, "documents"), sim.text_digest(F.col("text")), "doc_id")


NEAREST_FIVE = """with p as (select q.vec_id as query_id, r.vec_id as neighbour_id, 1 - list_dot_product(q.embedding::double[], r.embedding::double[]) / sqrt(list_dot_product(q.embedding::double[], q.embedding::double[])) / sqrt(list_dot_product(r.embedding::double[], r.embedding::double[])) as d
from embeddings q join embeddings r on q.label = r.label and q.vec_id <> r.vec_id where q.vec_id % 20 = 0) select query_id, neighbour_id, round(d, 6) as distance from (select *, row_number() over (partition by query_id order by d, neighbour_id) as k from p) where k <= 5"""


@plans.query(NEAREST_FIVE)
def d7_nearest_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest vectors of the same facet for each query (a top five by definition), by matrix products of blocks."""
    vectors = table(spark, sf_dir, "embeddings")
    return nearest_pruned(vectors.where("vec_id % 20 = 0"), vectors, "vec_id", "embedding", ["label"], 5).select("query_id", "neighbour_id", F.round("distance", 6).alias("distance"))


@plans.query(NEAREST_FIVE)
def d7_pruned_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest vectors of the same facet for each query, by cells around pivots instead of all pairs."""
    vectors = table(spark, sf_dir, "embeddings")
    return nearest_pruned(vectors.where("vec_id % 20 = 0"), vectors, "vec_id", "embedding", ["label"], 5).select("query_id", "neighbour_id", F.round("distance", 6).alias("distance"))


@plans.query(f"""with {CASES}, p as (select *, lag(case_id) over w as other, lag(kind) over w as k2, lag(priority) over w as p2, lag(claimed) over w as c2 from cases window w as (partition by panel order by opened, case_id))
select case_id, other, round((4 + 3 * (kind = k2)::int + 2 * (priority = p2)::int + 2 * (1 - least(1, abs(claimed - c2) / greatest(claimed, c2, 1)))) / 11, 6) as score from p where other is not null""")
def d8_metadata_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weighted likeness of each case and the one before it of the same panel; ``d8_similar_cases`` searches all earlier ones."""
    w = Window.partitionBy("panel").orderBy("opened", "case_id")
    p = cases(spark, sf_dir).withColumns({"other": F.lag("case_id").over(w), "k2": F.lag("kind").over(w), "p2": F.lag("priority").over(w), "c2": F.lag("claimed").over(w)}).where("other is not null")
    near = 1 - F.least(F.lit(1.0), F.abs(F.col("claimed") - F.col("c2")) / F.greatest("claimed", "c2", F.lit(1.0)))
    score = sim.weighted_match([(4.0, F.lit(1.0)), (3.0, (F.col("kind") == F.col("k2")).cast("double")), (2.0, (F.col("priority") == F.col("p2")).cast("double")), (2.0, near)])
    return p.select("case_id", "other", F.round(score, 6).alias("score"))


@plans.query(f"""with {CASES}, s as (select q.case_id, c.case_id as other, c.opened, round((4 * (q.panel = c.panel)::int + 3 * (q.kind = c.kind)::int + 2 * (q.priority = c.priority)::int + 2 * (1 - least(1, abs(q.claimed - c.claimed) / greatest(q.claimed, c.claimed, 1)))) / 11, 6) as score
from cases q join cases c on c.opened < q.opened or (c.opened = q.opened and c.case_id < q.case_id)), best as (select case_id, unnest(max({{s: score, o: opened, c: other}}, 5)) as b from s group by case_id) select case_id, b.c as other, b.s as score from best""")
def d8_similar_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five most alike of all earlier cases for every case, the latest first on ties."""
    return sim.most_alike(cases(spark, sf_dir), 5)


AUTHORITY = [("A", 3), ("N", 2), ("R", 1)]


@plans.query("""with f as (select l_orderkey, l_linestatus as value, case l_returnflag when 'A' then 3 when 'N' then 2 else 1 end as rank, round(1 - l_discount, 6) as score, l_linenumber, l_partkey from lineitem),
a as (select *, count(distinct rank) over (partition by l_orderkey, value) as sources, count(distinct value) over (partition by l_orderkey) as n_values, row_number() over (partition by l_orderkey order by rank desc, score desc, l_linenumber, l_partkey) as k from f)
select l_orderkey, value, rank, round(least(1, score + least(0.1, 0.04 * (sources - 1))), 6) as confidence, n_values > 1 as contested from a where k = 1""")
def d19_authority_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One value per case by authority, then score; agreeing sources add confidence, others make it contested."""
    rank = F.create_map(*(F.lit(x) for pair in AUTHORITY for x in pair))[F.col("l_returnflag")]
    facts = table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_linestatus").alias("value"), rank.alias("rank"), F.round(1 - F.col("l_discount"), 6).alias("score"), "l_linenumber", "l_partkey")
    best = rel.first_per(facts, ["l_orderkey"], [F.desc("rank"), F.desc("score"), F.asc("l_linenumber"), F.asc("l_partkey")])
    agreeing = facts.groupBy("l_orderkey", "value").agg(F.count_distinct("rank").alias("sources"))
    values = agreeing.groupBy("l_orderkey").agg(F.count("*").alias("n_values"))
    joined = best.join(agreeing, ["l_orderkey", "value"]).join(values, "l_orderkey")
    return joined.select("l_orderkey", "value", "rank", F.round(F.least(F.lit(1.0), F.col("score") + F.least(F.lit(0.1), 0.04 * (F.col("sources") - 1))), 6).alias("confidence"), (F.col("n_values") > 1).alias("contested"))


@plans.query("select l_orderkey, l_returnflag as value, max(round(1 - l_discount, 6)) as confidence, count(*) as n from lineitem group by all")
def d20_multi_value_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every distinct value of a case with its best source."""
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey", F.col("l_returnflag").alias("value")).agg(F.max(F.round(1 - F.col("l_discount"), 6)).alias("confidence"), F.count("*").alias("n"))


@plans.query("""with k as (select o_custkey, o_orderpriority, o_orderstatus, o_totalprice, row_number() over (partition by o_custkey, o_orderpriority, o_orderstatus order by o_orderkey) as n from orders),
t as (select o_custkey, sum(o_totalprice) as all_sum, sum(o_totalprice) filter (where n = 1) as once_sum, count(*) as n_all, count(*) filter (where n = 1) as n_once from k group by 1)
select o_custkey, case when all_sum > 600000 and once_sum <= 600000 then n_once else n_all end as n_kept, round(case when all_sum > 600000 and once_sum <= 600000 then once_sum else all_sum end, 2) as total from t""")
def d22_conditional_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Duplicate lines go only if the total fits the declared one (here a limit) without them."""
    w = Window.partitionBy("o_custkey", "o_orderpriority", "o_orderstatus").orderBy("o_orderkey")
    keyed = table(spark, sf_dir, "orders").withColumn("n", F.row_number().over(w))
    once = F.when(F.col("n") == 1, F.col("o_totalprice"))
    totals = keyed.groupBy("o_custkey").agg(F.sum("o_totalprice").alias("all_sum"), F.sum(once).alias("once_sum"), F.count("*").alias("n_all"), F.count(once).alias("n_once"))
    drop = (F.col("all_sum") > 600000) & (F.col("once_sum") <= 600000)
    return totals.select("o_custkey", F.when(drop, F.col("n_once")).otherwise(F.col("n_all")).alias("n_kept"), F.round(F.when(drop, F.col("once_sum")).otherwise(F.col("all_sum")), 2).alias("total"))


@plans.query(f"with {CASES} select case_id, round(claimed, 2) as line_sum, abs(o_totalprice - claimed) <= greatest(1, 0.01 * o_totalprice) as reconciled from cases join orders on o_orderkey = case_id")
def d23_reconciliation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stated totals against the sum of lines, within one unit or one per cent."""
    stated = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("case_id"), "o_totalprice")
    ok = F.abs(F.col("o_totalprice") - F.col("claimed")) <= F.greatest(F.lit(1.0), 0.01 * F.col("o_totalprice"))
    return cases(spark, sf_dir).join(stated, "case_id").select("case_id", F.round("claimed", 2).alias("line_sum"), ok.alias("reconciled"))


@plans.query("with c as (select conv_id, sum(len(regexp_extract_all(lower(text), '\\bthe\\b')))::bigint as a, sum(len(regexp_extract_all(lower(text), '\\band\\b')))::bigint as b from conversations group by 1) select conv_id, a, b, case when a > b then 'the' when b > a then 'and' end as majority from c")
def d24_token_majority(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which of two tokens a group uses more often; null on a tie."""
    counts = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(*(F.sum(F.regexp_count(F.lower("text"), F.lit(rf"\b{w}\b"))).alias(c) for w, c in (("the", "a"), ("and", "b"))))
    return counts.select("conv_id", "a", "b", F.when(F.col("a") > F.col("b"), "the").when(F.col("b") > F.col("a"), "and").alias("majority"))


@plans.query("with o as (select user_id, 'k' as id_type, replace(json_extract_string(props, '$.k'), ' ', '') || '00' as v from events) select user_id, id_type, count(distinct v) as n_values, count(distinct v) > 1 as conflict from o where length(v) >= 4 group by all")
def d27_identifier_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Identifiers seen for each key; more than one value is a conflict."""
    seen = table(spark, sf_dir, "events").select("user_id", F.lit("k").alias("id_type"), F.concat(F.regexp_replace(F.get_json_object("props", "$.k"), "[ -]", ""), F.lit("00")).alias("v")).where(F.length("v") >= 4)
    found = seen.groupBy("user_id", "id_type").agg(F.count_distinct("v").alias("n_values"))
    return found.withColumn("conflict", F.col("n_values") > 1)
