"""Predicates, joins, aggregates, windows and intervals (A, B, J, G, W, I) on the surrogate tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from granary.operators import ordered
from granary.operators import relational as rel
from granary.operators.cases import cases
from granary.plans.base import CASES, Plans
from granary.sources.tables import table

plans = Plans()


# ---- sources and sinks


@plans.query("select o_orderkey, o_custkey, o_totalprice from orders where o_orderstatus = 'F' and o_totalprice >= 1000 and o_orderpriority in ('1-URGENT', '2-HIGH')")
def a2_parameterised_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bound parameters appended to a growing filter list; all reach the parquet scan."""
    rows = table(spark, sf_dir, "orders")
    for condition in (F.col("o_orderstatus") == "F", F.col("o_totalprice") >= 1000, F.col("o_orderpriority").isin("1-URGENT", "2-HIGH")):
        rows = rows.where(condition)
    return rows.select("o_orderkey", "o_custkey", "o_totalprice")


@plans.query("select r_name as category_group, n_name as category from nation join region on r_regionkey = n_regionkey")
def a3_category_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Categories flattened to their groups, as a view."""
    table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("r_name").alias("category_group"), F.col("n_name").alias("category")).createOrReplaceTempView("category_groups")
    return spark.table("category_groups")


@plans.query("select user_id, event_type, event_id from (select *, row_number() over (partition by user_id, event_type order by ts, event_id) as k from events where event_type <> 'error') where k = 1 and (user_id, event_type) not in (select user_id, 'view' from events where event_type = 'error')")
def a8_insert_if_absent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events to insert under the key (user, type): keys of the target are left out, repeats collapse to the first."""
    events = table(spark, sf_dir, "events")
    target = events.where("event_type = 'error'").select("user_id", F.lit("view").alias("event_type")).distinct()
    return rel.inserted_if_absent(target, events.where("event_type <> 'error'"), ["user_id", "event_type"], [F.asc("ts"), F.asc("event_id")]).select("user_id", "event_type", "event_id")


DUPLICATES = "firsts as (select doc_id, lang, source, min(doc_id) over (partition by coalesce(text, '')) as first_id from documents)"


@plans.query(f"with {DUPLICATES} select a.doc_id, a.first_id, b.lang, b.source from firsts a left join documents b on b.doc_id = a.first_id")
def a14_update_from_canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields of the first of identical texts copied onto its duplicates; texts travel as digests."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", F.sha2(F.coalesce("text", F.lit("")), 256).alias("digest"))
    first = docs.groupBy("digest").agg(F.min_by(F.struct("doc_id", "lang", "source"), "doc_id").alias("f"))
    return docs.select("doc_id", "digest").join(first, "digest").select("doc_id", F.col("f.doc_id").alias("first_id"), "f.lang", "f.source")


@plans.query("select c_custkey, c_custkey in (select o_custkey from orders where o_totalprice > 400000) as marked from customer")
def a15_update_by_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A flag set for the rows whose id is listed."""
    ids = table(spark, sf_dir, "orders").where("o_totalprice > 400000").select(F.col("o_custkey").alias("c_custkey")).distinct().withColumn("hit", F.lit(True))
    return table(spark, sf_dir, "customer").join(ids, "c_custkey", "left").select("c_custkey", rel.holds(F.col("hit")).alias("marked"))


# ---- predicates


@plans.query("select count(*) as n_all, count(*) filter (where o_orderstatus = 'O') as n_open, count(*) filter (where o_orderstatus = 'F') as n_final, count(*) filter (where o_orderstatus = 'P' and o_totalprice > 100000) as n_large from orders")
def b1_tab_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts by status in one scan."""
    status = F.col("o_orderstatus")
    return table(spark, sf_dir, "orders").agg(F.count("*").alias("n_all"), F.count_if(status == "O").alias("n_open"), F.count_if(status == "F").alias("n_final"), F.count_if((status == "P") & (F.col("o_totalprice") > 100000)).alias("n_large"))


@plans.query("select source, count(*) as n, count(quality) as n_scored, round(avg(case when quality = 1 then 1.0 when quality is null then null else 0.0 end), 6) as accuracy from documents left join labels using (doc_id) group by source")
def b2_null_preserving_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """True is 1, false 0, and what can't be scored stays out of the mean."""
    joined = table(spark, sf_dir, "documents").select("doc_id", "source").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    score = F.when(F.col("quality") == 1, 1.0).when(F.col("quality").isNull(), None).otherwise(0.0)
    return joined.groupBy("source").agg(F.count("*").alias("n"), F.count("quality").alias("n_scored"), F.round(F.avg(score), 6).alias("accuracy"))


@plans.query("select p_partkey, p_name, p_type from part where p_name ilike '%re%' or p_type ilike '%STEEL%'")
def b3_search_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A term in any of several columns, whatever its case."""
    return table(spark, sf_dir, "part").where(F.col("p_name").ilike("%re%") | F.col("p_type").ilike("%STEEL%")).select("p_partkey", "p_name", "p_type")


@plans.query("select user_id, string_agg(distinct event_type, ',' order by event_type) as kinds from events group by user_id having list_has_any(list(distinct event_type), ['error', 'signup'])")
def b5_array_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys whose set of values meets a given one."""
    kinds = table(spark, sf_dir, "events").groupBy("user_id").agg(F.array_sort(F.collect_set("event_type")).alias("kinds"))
    return kinds.where(F.arrays_overlap("kinds", F.array(F.lit("error"), F.lit("signup")))).select("user_id", F.array_join("kinds", ",").alias("kinds"))


@plans.query("select event_id, json_extract_string(props, '$.k') as k from events where json_extract_string(props, '$.k') = '7'")
def b6_json_containment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows whose JSON holds all given pairs: one path comparison per key."""
    return rel_contains(table(spark, sf_dir, "events"), "props", {"k": "7"}).select("event_id", F.get_json_object("props", "$.k").alias("k"))


def rel_contains(rows: DataFrame, column: str, pairs: dict[str, str]) -> DataFrame:
    for key, value in pairs.items():
        rows = rows.where(F.get_json_object(column, f"$.{key}") == value)
    return rows


@plans.query("select event_type, count(*) filter (where list_contains(json_keys(props), 'k')) as n_with from events group by event_type")
def b7_json_key_exists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many rows' JSON has a key."""
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.count_if(rel.holds(F.array_contains(F.json_object_keys("props"), "k"))).alias("n_with"))


@plans.query(f"with {CASES}, pick as (select o_orderkey, case when o_orderstatus = 'P' then null else o_orderstatus end as s from orders) select case_id, case when status = 'O' then null else status end is distinct from s as changed from cases join pick on o_orderkey = case_id")
def b8_null_safe_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct-from, in which two nulls are equal."""
    left = F.when(F.col("status") != "O", F.col("status"))
    right = F.when(F.col("status") != "P", F.col("status"))
    return cases(spark, sf_dir).select("case_id", (~left.eqNullSafe(right)).alias("changed"))


@plans.query("select o_orderkey, o_totalprice from orders where exists (select 1 from lineitem where l_orderkey = o_orderkey and l_returnflag = 'R') and not exists (select 1 from lineitem where l_orderkey = o_orderkey and l_quantity < 5)")
def b9_exists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Correlated existence as a semi join and an anti join."""
    orders, lines = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    key = F.col("o_orderkey") == F.col("l_orderkey")
    return orders.join(lines.where("l_returnflag = 'R'"), key, "left_semi").join(lines.where("l_quantity < 5"), key, "left_anti").select("o_orderkey", "o_totalprice")


@plans.query("select e.event_id, (select round(sum(value), 4) from events x where x.user_id = e.user_id) as total, (select round(sum(value), 4) from events x where x.user_id = e.user_id and x.ts between e.ts - interval 1 day and e.ts) as recent from events e where event_type = 'purchase'")
def b10_scalar_subqueries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Total and last day's sum per row; both from one ordering of each key's rows."""
    events = table(spark, sf_dir, "events")
    own, us = Window.partitionBy("user_id"), F.unix_micros(F.col("ts").cast("timestamp"))
    both = events.withColumn("us", us).withColumns({"total": F.sum("value").over(own), "recent": F.sum("value").over(own.orderBy("us").rangeBetween(-86_400_000_000, 0))})
    return both.where("event_type = 'purchase'").select("event_id", F.round("total", 4).alias("total"), F.round("recent", 4).alias("recent"))


@plans.query("select event_id from events where ts >= timestamp '2024-01-30' - interval 3 day")
def b11_relative_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of the last days before a given moment, which is a parameter so that results repeat."""
    return table(spark, sf_dir, "events").where(F.col("ts") >= F.lit("2024-01-27").cast("timestamp_ntz")).select("event_id")


@plans.query("select strftime(date_trunc('day', ts + interval '330 minutes') - interval '330 minutes', '%Y-%m-%d %H:%M') as day_start, count(*) as n, round(sum(value), 4) as spent from events group by all")
def b12_zone_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calendar days of a fixed zone (+05:30), as UTC starts."""
    shift = F.expr("interval '330' minute")
    start = F.date_trunc("day", F.col("ts") + shift) - shift
    return table(spark, sf_dir, "events").groupBy(F.date_format(start, "yyyy-MM-dd HH:mm").alias("day_start")).agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("spent"))


@plans.query("select event_id from events where user_id = 7 or (event_type = 'error' and ts >= timestamp '2024-01-20')")
def b13_fallback_predicate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A key, or a fallback condition where the key is missing."""
    late = F.col("ts") >= F.lit("2024-01-20").cast("timestamp_ntz")
    return table(spark, sf_dir, "events").where((F.col("user_id") == 7) | ((F.col("event_type") == "error") & late)).select("event_id")


@plans.query("""select p_partkey, p_size = 10 as eq, p_size <> 10 as ne, p_size > 10 as gt, p_size >= 10 as ge, p_size < 10 as lt, p_size <= 10 as le, p_size between 5 and 15 as bt, p_size not between 5 and 15 as nb,
p_size in (1, 2, 3) as isin, p_size not in (1, 2, 3) as notin, true as ex, false as nex, contains(p_name, 'a') as ct, not contains(p_name, 'a') as nct, regexp_matches(p_name, '^[a-m]') as mt, false as unknown from part""")
def b14_comparison_operators(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All named comparisons as two-valued columns."""
    size, name = F.col("p_size"), F.col("p_name")
    forms = {
        "eq": ("EQUALS", size, 10), "ne": ("NOT_EQUALS", size, 10), "gt": ("GREATER_THAN", size, 10), "ge": ("GREATER_THAN_OR_EQUAL", size, 10), "lt": ("LESS_THAN", size, 10), "le": ("LESS_THAN_OR_EQUAL", size, 10), "bt": ("BETWEEN", size, 5, 15), "nb": ("NOT_BETWEEN", size, 5, 15),
        "isin": ("IN", size, 1, 2, 3), "notin": ("NOT_IN", size, 1, 2, 3), "ex": ("EXISTS", size), "nex": ("NOT_EXISTS", size), "ct": ("CONTAINS", name, "a"), "nct": ("NOT_CONTAINS", name, "a"), "mt": ("MATCHES_PATTERN", name, "^[a-m]"), "unknown": ("NO_SUCH", size, 1),
    }
    return table(spark, sf_dir, "part").select("p_partkey", *(rel.compared(op, v, *map(F.lit, rest)).alias(c) for c, (op, v, *rest) in forms.items()))


@plans.query("""with s as (select user_id, list(event_type order by ts, event_id) as l from events group by user_id),
step as (select user_id, l, list_position(l, 'signup') as a from s), step2 as (select *, case when a > 0 then list_position(l[a + 1:], 'error') end as b from step), step3 as (select *, case when b > 0 then list_position(l[a + b + 1:], 'purchase') end as c from step2)
select user_id, coalesce(c > 0, false) as matched from step3""")
def b16_ordered_subsequence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether given kinds of events occur in order, gaps allowed."""
    wanted, events = ("signup", "error", "purchase"), table(spark, sf_dir, "events")
    found, _ = ordered.reached(events, ["user_id"], ["ts", "event_id"], F.col("event_type"), len(wanted) + 1, ordered.sequence_step(wanted))
    return found.select("user_id", (F.col("state") == len(wanted)).alias("matched"))


@plans.query("select event_id, json_extract_string(props, '$.k')::bigint as k from events")
def b17_json_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A value at a path."""
    return table(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))


@plans.query("select n_name, r_name, n_regionkey is null or n_regionkey <= 2 as in_stage from nation join region on r_regionkey = n_regionkey")
def b19_stage_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evergreen, unstaged, or at a stage up to the current one."""
    joined = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return joined.select("n_name", "r_name", (F.col("n_regionkey").isNull() | (F.col("n_regionkey") <= 2)).alias("in_stage"))


@plans.query("select l_orderkey, l_linenumber from lineitem where l_shipdate::date > date '1996-01-01' and l_shipdate::date <= date '1996-01-31'")
def b20_expiry_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that expire within the days after a given date."""
    day = F.col("l_shipdate").cast("date")
    return table(spark, sf_dir, "lineitem").where((day > F.lit("1996-01-01").cast("date")) & (day <= F.date_add(F.lit("1996-01-01").cast("date"), 30))).select("l_orderkey", "l_linenumber")


# ---- joins


@plans.query(f"with {CASES} select r_name, count(*) as n_nations, count(c.c_custkey) as n_active from region left join nation on n_regionkey = r_regionkey left join customer c on c_nationkey = n_nationkey and c_acctbal > 5000 group by r_name")
def j4_join_condition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A predicate in the join condition keeps unmatched rows."""
    region, nation, customer = (table(spark, sf_dir, n) for n in ("region", "nation", "customer"))
    joined = region.join(nation, region["r_regionkey"] == nation["n_regionkey"], "left").join(customer, (customer["c_nationkey"] == nation["n_nationkey"]) & (customer["c_acctbal"] > 5000), "left")
    return joined.groupBy("r_name").agg(F.count("*").alias("n_nations"), F.count("c_custkey").alias("n_active"))


@plans.query("select c_custkey, coalesce(n_orders, 0) as n_orders, coalesce(spent, 0) as spent, coalesce(n_events, 0) as n_events from customer left join (select o_custkey, count(*) as n_orders, round(sum(o_totalprice), 2) as spent from orders group by 1) on o_custkey = c_custkey left join (select user_id, count(*) as n_events from events group by 1) on user_id = c_custkey")
def j5_preaggregated_joins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each side is aggregated before the join, so that none multiplies another."""
    orders = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n_orders"), F.round(F.sum("o_totalprice"), 2).alias("spent"))
    events = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("c_custkey")).agg(F.count("*").alias("n_events"))
    return table(spark, sf_dir, "customer").select("c_custkey").join(orders, "c_custkey", "left").join(events, "c_custkey", "left").na.fill(0)


@plans.query("select c_custkey, o_orderkey, o_totalprice from customer left join (select * from (select *, row_number() over (partition by o_custkey order by o_orderdate desc, o_orderkey desc) as k from orders) where k = 1) on o_custkey = c_custkey")
def j6_latest_row(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest row of each key, or nulls."""
    latest = rel.first_per(table(spark, sf_dir, "orders"), ["o_custkey"], [F.desc("o_orderdate"), F.desc("o_orderkey")])
    return table(spark, sf_dir, "customer").join(latest, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", "o_orderkey", "o_totalprice")


@plans.query("select r_name, string_agg(n_name || ':' || n_nationkey, ',' order by n_name) as nations from region left join nation on n_regionkey = r_regionkey group by r_name")
def j7_nested_aggregate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Details of each row as an ordered list."""
    listed = table(spark, sf_dir, "nation").groupBy("n_regionkey").agg(F.array_sort(F.collect_list(F.struct("n_name", "n_nationkey"))).alias("l"))
    joined = table(spark, sf_dir, "region").join(listed, F.col("r_regionkey") == F.col("n_regionkey"), "left")
    return joined.select("r_name", F.array_join(F.transform("l", lambda x: F.concat_ws(":", x["n_name"], x["n_nationkey"])), ",").alias("nations"))


@plans.query("select user_id, k, n_name from (select user_id, unnest(list(distinct json_extract_string(props, '$.k')::bigint)) as k from events group by user_id) join nation on n_nationkey = k")
def j8_unnest_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids in an array as rows, joined to what they name."""
    ids = table(spark, sf_dir, "events").groupBy("user_id").agg(F.collect_set(F.get_json_object("props", "$.k").cast("long")).alias("ids"))
    return ids.select("user_id", F.explode("ids").alias("k")).join(table(spark, sf_dir, "nation"), F.col("n_nationkey") == F.col("k")).select("user_id", "k", "n_name")


@plans.query("select o_orderkey, l_linenumber, l_quantity from orders join lineitem on l_orderkey = o_orderkey where o_orderstatus = 'P'")
def j9_lines_from_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines kept as a JSON array in their document, as rows again."""
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.to_json(F.collect_list(F.struct("l_linenumber", "l_quantity"))).alias("doc"))
    docs = table(spark, sf_dir, "orders").where("o_orderstatus = 'P'").join(lines, F.col("o_orderkey") == F.col("l_orderkey"))
    return docs.select("o_orderkey", F.inline(F.from_json("doc", "array<struct<l_linenumber:int,l_quantity:double>>")))


@plans.query("select (select count(*) from orders) as n_orders, (select count(*) from customer) as n_customers, (select round(sum(value), 2) from events) as spent")
def j11_single_row_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals of several tables side by side; each side is one row."""
    orders, customers, events = (table(spark, sf_dir, n) for n in ("orders", "customer", "events"))
    return orders.agg(F.count("*").alias("n_orders")).crossJoin(customers.agg(F.count("*").alias("n_customers"))).crossJoin(events.agg(F.round(F.sum("value"), 2).alias("spent")))


@plans.query("select p_partkey, p_name from part where not exists (select 1 from nation where contains(lower(p_name), lower(n_name[1:2])))")
def j13_substring_anti_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names in which no term of a small catalogue occurs; the catalogue (one row per nation) is a single array."""
    terms = table(spark, sf_dir, "nation").agg(F.collect_set(F.lower(F.substring("n_name", 1, 2))).alias("terms"))
    joined = table(spark, sf_dir, "part").crossJoin(F.broadcast(terms))
    return joined.where(~F.exists("terms", lambda t: F.lower("p_name").contains(t))).select("p_partkey", "p_name")


@plans.query("select a.event_id, count(b.event_id) as n_near, round(coalesce(sum(b.value), 0), 4) as spent from events a left join events b on b.user_id = a.user_id and b.ts >= a.ts - interval 1 hour and b.ts < a.ts + interval 5 hour where a.event_type = 'signup' group by a.event_id")
def j14_range_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of the same key within a half-open span of time."""
    events = table(spark, sf_dir, "events")
    others = events.select("user_id", F.col("ts").alias("at"), F.col("event_id").alias("other"), F.col("value").alias("v"))
    asked = events.where("event_type = 'signup'").select("user_id", "ts", "event_id")
    near = ordered.near_in_time(asked, others, ["user_id"], "ts", "at", 3600, 5 * 3600).groupBy("event_id").agg(F.count("*").alias("n_near"), F.round(F.sum("v"), 4).alias("spent"))
    return asked.select("event_id").join(near, "event_id", "left").na.fill({"n_near": 0, "spent": 0.0})


RULE_SETS = [(1, None, None, 0), (2, "ASIA", None, 1), (3, "ASIA", "BUILDING", 2), (4, None, "MACHINERY", 1), (5, "EUROPE", None, 1), (6, "EUROPE", None, 1)]


@plans.query("""with sets(id, region, kind) as (values (1, null, null), (2, 'ASIA', null), (3, 'ASIA', 'BUILDING'), (4, null, 'MACHINERY'), (5, 'EUROPE', null), (6, 'EUROPE', null)),
c as (select c_custkey, r_name, c_mktsegment from customer join nation on n_nationkey = c_nationkey join region on r_regionkey = n_regionkey),
m as (select c_custkey, id, (region is not null)::int * 2 + (kind is not null)::int as score from c join sets on (region is null or region = r_name) and (kind is null or kind = c_mktsegment))
select c_custkey, id as rule_set_id, score::bigint as score from (select *, row_number() over (partition by c_custkey order by score desc, id desc) as k from m) where k = 1""")
def j18_best_rule_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The most specific rule set whose dimensions all match or are wild; ties go to the larger id."""
    sets = spark.createDataFrame([r[:3] for r in RULE_SETS], "id int, region string, kind string")
    members = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    scope = (F.col("region").isNull() | (F.col("region") == F.col("r_name"))) & (F.col("kind").isNull() | (F.col("kind") == F.col("c_mktsegment")))
    score = F.col("region").isNotNull().cast("long") * 2 + F.col("kind").isNotNull().cast("long")
    matched = members.join(F.broadcast(sets), scope).select("c_custkey", F.col("id").alias("rule_set_id"), score.alias("score"))
    return rel.first_per(matched, ["c_custkey"], [F.desc("score"), F.desc("rule_set_id")])


@plans.query(f"with {CASES} select case_id, case when queried and approved < claimed then 'reply' when priority = '1-URGENT' then 'thread' when n_lines = 1 then 'token' when kind = 'BUILDING' then 'sender' end as strategy, case when queried and approved < claimed then 0.99 when priority = '1-URGENT' then 0.95 when n_lines = 1 then 0.97 when kind = 'BUILDING' then 0.65 end as confidence from cases")
def j20_cascade_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first strategy that matches wins, whatever its confidence."""
    strategy, confidence = rel.cascade(("reply", F.col("queried") & (F.col("approved") < F.col("claimed")), 0.99), ("thread", F.col("priority") == "1-URGENT", 0.95), ("token", F.col("n_lines") == 1, 0.97), ("sender", F.col("kind") == "BUILDING", 0.65))
    return cases(spark, sf_dir).select("case_id", strategy.alias("strategy"), confidence.alias("confidence"))


@plans.query("select o_orderkey, (select max_by(value, (e.ts, e.event_id)) from events e where e.user_id = o_custkey % 150 and e.ts <= timestamp '2024-01-10' + to_days((o_orderkey % 15)::int)) as cap from orders")
def j21_as_of_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest value at or before each row's moment."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_custkey") % 150).alias("user_id"), (F.lit("2024-01-10").cast("timestamp_ntz") + F.make_dt_interval((F.col("o_orderkey") % 15).cast("int"))).alias("at"))
    points = table(spark, sf_dir, "events").select("user_id", F.col("ts").alias("at"), F.lit(0).alias("side"), "event_id", F.lit(None).cast("long").alias("o_orderkey"), "value")
    asked = orders.select("user_id", "at", F.lit(1).alias("side"), F.lit(None).cast("long").alias("event_id"), "o_orderkey", F.lit(None).cast("double").alias("value"))
    latest = F.when(F.col("value").isNotNull(), F.struct("at", "event_id", "value"))
    found, _ = ordered.running(points.unionByName(asked), ["user_id"], ["at", "side", "event_id", "o_orderkey"], {"latest": ("max", latest)})
    return found.where("side = 1").select("o_orderkey", F.col("latest.value").alias("cap"))


@plans.query(f"with {DUPLICATES} select first_id, count(*) as n, string_agg(doc_id::varchar, ',' order by doc_id) as members from firsts group by first_id having count(*) > 1")
def j22_lineage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each original with everything that points at it, as one ordered list."""
    docs = a14_update_from_canonical(spark, sf_dir).groupBy("first_id").agg(F.count("*").alias("n"), F.array_sort(F.collect_list("doc_id")).alias("l"))
    return docs.where("n > 1").select("first_id", "n", F.array_join(F.col("l").cast("array<string>"), ",").alias("members"))


@plans.query("select l_orderkey, l_linenumber, l_quantity from lineitem where (l_orderkey, l_linenumber) in (select o_orderkey, 1 + o_orderkey % 3 from orders where o_orderpriority = '1-URGENT')")
def j23_tuple_semi_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows whose pair of keys is listed in parallel arrays."""
    wanted = table(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT'").groupBy("o_custkey").agg(F.collect_list(F.struct("o_orderkey", (1 + F.col("o_orderkey") % 3).alias("n"))).alias("l"))
    pairs = wanted.select(F.explode(F.arrays_zip(F.col("l.o_orderkey").alias("a"), F.col("l.n").alias("b"))).alias("p")).select(F.col("p.a").alias("a"), F.col("p.b").alias("b"))
    return table(spark, sf_dir, "lineitem").join(pairs, (F.col("l_orderkey") == F.col("a")) & (F.col("l_linenumber") == F.col("b")), "left_semi").select("l_orderkey", "l_linenumber", "l_quantity")


# ---- aggregates


@plans.query("select event_type, count(*) as n, count(*) filter (where value > 400) as n_large, count(distinct user_id) as n_users, count(distinct case when value > 400 then user_id end) as n_large_users, round(coalesce(sum(value) filter (where user_id < 75), 0), 4) as spent_low, round(sum(value) / nullif(count(*), 0), 6) as mean from events group by event_type")
def g1_group_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Plain, conditional and distinct counts, guarded sums and ratios."""
    large = F.col("value") > 400
    return table(spark, sf_dir, "events").groupBy("event_type").agg(
        F.count("*").alias("n"), F.count_if(large).alias("n_large"), F.count_distinct("user_id").alias("n_users"), F.count_distinct(F.when(large, F.col("user_id"))).alias("n_large_users"),
        F.round(F.coalesce(F.sum(F.when(F.col("user_id") < 75, F.col("value"))), F.lit(0.0)), 4).alias("spent_low"), F.round(F.try_divide(F.sum("value"), F.count("*")), 6).alias("mean"),
    )


@plans.query(f"with {CASES} select panel, string_agg(case_id::varchar, ',' order by case_id) filter (where queried and approved < 1000) as evidence from cases group by panel")
def g7_filtered_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of the rows that a condition picks, in order; null if there are none."""
    ids = F.array_sort(F.collect_list(F.when(F.col("queried") & (F.col("approved") < 1000), F.col("case_id"))))
    listed = cases(spark, sf_dir).groupBy("panel").agg(ids.alias("ids"))
    return listed.select("panel", F.when(F.size("ids") > 0, F.array_join(F.col("ids").cast("array<string>"), ",")).alias("evidence"))


@plans.query("select event_type, round(quantile_cont(value, 0.5), 4) as p50, round(quantile_cont(value, 0.95), 4) as p95, round(stddev_samp(value), 4) as sd from events group by event_type")
def g10_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact interpolated percentiles and sample deviation."""
    events = table(spark, sf_dir, "events").select("event_type", "value")
    found, _ = ordered.percentiles(events, ["event_type"], "value", {"p50": (0.5, "between"), "p95": (0.95, "between")})
    spread = events.groupBy("event_type").agg(F.round(F.stddev_samp("value"), 4).alias("sd"))
    return ordered.matched(spread, found, ["event_type"]).select("event_type", F.round("p50", 4).alias("p50"), F.round("p95", 4).alias("p95"), "sd")


@plans.query("with s as (select least(100, round(value / 4.9)) as v from events) select (floor(v / 20) + 1)::bigint as bucket, count(*) as n, round(avg(v), 6) as mean from s where v >= 0 and v < 100 group by all")
def g11_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five equal buckets of 0 to 100; the top edge falls outside, as in the dashboards."""
    scored = table(spark, sf_dir, "events").select(F.least(F.lit(100.0), F.round(F.col("value") / 4.9)).alias("v")).withColumn("bucket", F.width_bucket("v", F.lit(0.0), F.lit(100.0), F.lit(5)))
    return scored.where(F.col("bucket").between(1, 5)).groupBy("bucket").agg(F.count("*").alias("n"), F.round(F.avg("v"), 6).alias("mean"))


@plans.query(f"with {CASES} select case when claimed < 10000 then '0-10k' when claimed < 50000 then '10k-50k' when claimed < 150000 then '50k-150k' else '150k+' end as bucket, count(*) as n, round(sum(claimed), 2) as total from cases group by 1")
def g12_custom_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Amounts by fixed bounds."""
    v = F.col("claimed")
    bucket = F.when(v < 10_000, "0-10k").when(v < 50_000, "10k-50k").when(v < 150_000, "50k-150k").otherwise("150k+")
    return cases(spark, sf_dir).groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n"), F.round(F.sum("claimed"), 2).alias("total"))


@plans.query("select strftime(date_trunc('week', ts), '%Y-%m-%d') as week, event_type, count(*) as n, round(sum(value), 4) as spent from events group by all")
def g13_weekly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weeks that begin on Monday."""
    return table(spark, sf_dir, "events").groupBy(F.date_format(F.date_trunc("week", "ts"), "yyyy-MM-dd").alias("week"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("spent"))


@plans.query("select user_id, '{' || string_agg('\"' || event_type || '\":' || n, ',' order by event_type) || '}' as counts from (select user_id, event_type, count(*) as n from events group by all) group by user_id")
def g14_json_object(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts per kind as a JSON object with sorted keys."""
    counts = table(spark, sf_dir, "events").groupBy("user_id", "event_type").count().groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("event_type", "count"))).alias("l"))
    return counts.select("user_id", F.to_json(F.map_from_entries("l")).alias("counts"))


@plans.query("select conv_id, string_agg(turn || ':' || role, ',' order by turn, role) as turns, count(*) as n from conversations group by conv_id")
def g15_ordered_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts of each document in order."""
    listed = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role"))).alias("l"))
    return listed.select("conv_id", F.array_join(F.transform("l", lambda x: F.concat_ws(":", x["turn"], x["role"])), ",").alias("turns"), F.size("l").cast("long").alias("n"))


@plans.query("with g as (select *, count(*) over (partition by user_id, event_type) as n, row_number() over (partition by user_id, event_type order by ts desc, event_id desc) as k from events) select user_id, event_type, max(n) as n, string_agg(event_id::varchar, ',' order by k) as latest from g where k <= 3 and n > 3 group by all")
def g16_top_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three latest examples of each group of more than three (a top three by definition)."""
    events, keys = table(spark, sf_dir, "events"), ["user_id", "event_type"]
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("ts"), F.desc("event_id")))
    top = events.withColumn("k", place).where("k <= 3").groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("k", "event_id"))).alias("l"))
    return events.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 3").join(top, keys).select(*keys, "n", F.array_join(F.col("l.event_id").cast("array<string>"), ",").alias("latest"))


@plans.query("with c as (select user_id, event_type, count(*) as n, min((ts, event_id)) as f from events group by all) select user_id, event_type, n from (select *, row_number() over (partition by user_id order by n desc, f, event_type) as k from c) where k = 1")
def g17_mode_first_seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Most frequent kind of each user; of equals that seen first."""
    return rel.mode_first_seen(table(spark, sf_dir, "events"), "user_id", "event_type", ["ts", "event_id"])


@plans.query("with d as (select user_id, (ts::date - date '2024-01-01')::bigint as day from events), w as (select user_id, day, count(*) over (partition by user_id order by day range between current row and 3 following) as n from d) select user_id, day as start, n from (select *, row_number() over (partition by user_id order by n desc, day) as k from w) where k = 1")
def g18_densest_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The four days that hold most events of a user."""
    days = table(spark, sf_dir, "events").select("user_id", F.datediff(F.col("ts").cast("date"), F.lit("2024-01-01").cast("date")).cast("long").alias("day"))
    return rel.densest_window(days, "user_id", "day", 3)


@plans.query("select r_name, count(*) as n_nations, sum(n)::bigint as n_customers, max(n) as most, round(sum(balance), 2) as balance from (select n_nationkey, n_regionkey, count(c_custkey) as n, coalesce(sum(c_acctbal), 0) as balance from nation left join customer on c_nationkey = n_nationkey group by all) join region on r_regionkey = n_regionkey group by r_name")
def g26_two_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counters rolled up over two levels."""
    nation, customer, region = (table(spark, sf_dir, n) for n in ("nation", "customer", "region"))
    low = nation.join(customer, F.col("c_nationkey") == F.col("n_nationkey"), "left").groupBy("n_nationkey", "n_regionkey").agg(F.count("c_custkey").alias("n"), F.coalesce(F.sum("c_acctbal"), F.lit(0.0)).alias("balance"))
    return low.join(region, F.col("r_regionkey") == F.col("n_regionkey")).groupBy("r_name").agg(F.count("*").alias("n_nations"), F.sum("n").alias("n_customers"), F.max("n").alias("most"), F.round(F.sum("balance"), 2).alias("balance"))


# ---- windows, sets, intervals


@plans.query("select user_id, event_id, row_number() over (partition by user_id order by ts desc, event_id desc) as place, count(*) over (partition by user_id) as cluster from events")
def w1_latest_and_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Place from the latest and size of the cluster."""
    events = table(spark, sf_dir, "events").select("user_id", "ts", "event_id")
    placed, _ = ordered.running(events, ["user_id"], ["ts", "event_id"], {"place": ("sum", F.lit(1))}, backwards=True)
    return ordered.matched(placed, events.groupBy("user_id").agg(F.count("*").alias("cluster")), ["user_id"]).select("user_id", "event_id", "place", "cluster")


@plans.query("select distinct on (user_id) user_id, event_id, event_type from events order by user_id, ts desc, event_id desc")
def w3_distinct_on(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest event of each user."""
    return rel.first_per(table(spark, sf_dir, "events"), ["user_id"], [F.desc("ts"), F.desc("event_id")]).select("user_id", "event_id", "event_type")


@plans.query("select doc_id, quality, row_number() over (order by quality desc nulls last, doc_id) as place from documents left join labels using (doc_id) order by place limit 20 offset 10")
def w7_page_of_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Third page of ten and the next, nulls last (a page of a list by definition; W6, W7)."""
    joined = table(spark, sf_dir, "documents").select("doc_id").join(table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id", "left")
    page = joined.orderBy(F.desc_nulls_last("quality"), "doc_id").limit(30)
    return page.withColumn("place", F.row_number().over(Window.orderBy(F.desc_nulls_last("quality"), "doc_id")).cast("long")).where("place > 10")


@plans.query("select * from ((select 'order' as kind, o_orderkey as id, strftime(o_orderdate, '%Y-%m-%d') as day from orders order by o_orderdate desc, o_orderkey desc limit 5) union all (select 'event', event_id, strftime(ts, '%Y-%m-%d') from events order by ts desc, event_id desc limit 5)) order by day desc, kind, id desc limit 8")
def w10_recent_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest of two sources, limited again (a feed by definition)."""
    orders = table(spark, sf_dir, "orders").orderBy(F.desc("o_orderdate"), F.desc("o_orderkey")).limit(5).select(F.lit("order").alias("kind"), F.col("o_orderkey").alias("id"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"))
    events = table(spark, sf_dir, "events").orderBy(F.desc("ts"), F.desc("event_id")).limit(5).select(F.lit("event").alias("kind"), F.col("event_id").alias("id"), F.date_format("ts", "yyyy-MM-dd").alias("day"))
    return orders.unionByName(events).orderBy(F.desc("day"), "kind", F.desc("id")).limit(8)


@plans.query("with h as (select user_id, ts < timestamp '2024-01-15' as early, event_type from events group by all) select user_id, count(*) filter (where a and not b) as only_early, count(*) filter (where b and not a) as only_late, count(*) filter (where a and b) as both from (select user_id, event_type, bool_or(early) as a, bool_or(not early) as b from h group by all) group by user_id")
def w11_set_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kinds seen only before, only after, and on either side of a moment."""
    early = F.col("ts") < F.lit("2024-01-15").cast("timestamp_ntz")
    sets = table(spark, sf_dir, "events").groupBy("user_id").agg(F.collect_set(F.when(early, F.col("event_type"))).alias("a"), F.collect_set(F.when(~early, F.col("event_type"))).alias("b"))
    return sets.select("user_id", *(F.size(x).cast("long").alias(n) for n, x in (("only_early", F.array_except("a", "b")), ("only_late", F.array_except("b", "a")), ("both", F.array_intersect("a", "b")))))


@plans.query("""with p as (select distinct user_id, (ts::date - date '2024-01-01')::int + 1 as page from events), i as (select *, page - row_number() over (partition by user_id order by page) as island from p),
r as (select user_id, min(page) as lo, max(page) as hi from i group by user_id, island) select user_id, string_agg(case when lo = hi then lo::varchar else lo || '-' || hi end, ', ' order by lo) as pages from r group by user_id""")
def i1_page_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Active days of each user as ranges."""
    days = table(spark, sf_dir, "events").select("user_id", (F.datediff(F.col("ts").cast("date"), F.lit("2024-01-01").cast("date")) + 1).alias("page"))
    return rel.page_ranges(days, ["user_id"], "page")





@plans.query("""with s as (select l_orderkey, l_linenumber as k, l_partkey, l_extendedprice, (1 + l_quantity % 3)::bigint as size, l_discount from lineitem),
e as (select l_orderkey, k, l_discount, sum(size) over w as last_page, size from s window w as (partition by l_orderkey order by k, l_partkey, l_extendedprice rows unbounded preceding)),
r as (select l_orderkey, last_page - size + 1 + (l_discount > 0.09)::int as first_page, last_page from e),
f as (select *, coalesce(lag(last_page) over w, 0) + 1 as expected, lead(last_page) over w is null as final, max(last_page) over (partition by l_orderkey) as total from r window w as (partition by l_orderkey order by first_page, last_page)),
g as (select l_orderkey, first_page, case when last_page < first_page then 'inverted_range' when first_page <> expected then 'coverage_gap_or_overlap' when final and last_page <> total then 'last_page_mismatch' end as fault from f)
select l_orderkey, min_by(fault, first_page) filter (where fault is not null) as fault from g group by l_orderkey""")
def i2_cover_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First fault of sections that should tile a document."""
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_extendedprice").rowsBetween(Window.unboundedPreceding, 0)
    size = (1 + F.col("l_quantity") % 3).cast("long")
    sections = table(spark, sf_dir, "lineitem").select("l_orderkey", F.sum(size).over(order).alias("last_page"), size.alias("size"), "l_discount")
    sections = sections.select("l_orderkey", (F.col("last_page") - F.col("size") + 1 + (F.col("l_discount") > 0.09).cast("long")).alias("first_page"), "last_page")
    return rel.cover_faults(sections, "l_orderkey", F.max("last_page").over(Window.partitionBy("l_orderkey")))


@plans.query("select l_orderkey, l_linenumber, least(l_linenumber, 4)::bigint as first_page, least(l_linenumber + 2, 4)::bigint as last_page from lineitem")
def i3_clamped_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranges held within the pages that exist."""
    clamp = lambda c: F.least(c, F.lit(4)).cast("long")
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", clamp(F.col("l_linenumber")).alias("first_page"), clamp(F.col("l_linenumber") + 2).alias("last_page"))


@plans.query("""with s as (select conv_id, turn as first_page, turn as last_page, role <> 'assistant' as readable from conversations), g as (select *, greatest(sum(readable::int) over (partition by conv_id order by first_page rows unbounded preceding), 1) as grp from s)
select conv_id, min(first_page) as first_page, max(last_page) as last_page, bool_or(readable) as readable from g group by conv_id, grp""")
def i4_absorbed_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sections that can't be read join the one before, leading ones the next."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", F.col("turn").alias("first_page"), F.col("turn").alias("last_page"), (F.col("role") != "assistant").alias("readable"))
    return rel.absorbed(turns, "conv_id", "readable")


@plans.query("select l_orderkey, l_linenumber, (l_shipdate::date - o_orderdate::date)::bigint as days, case when l_shipdate::date - o_orderdate::date < -7 then 'too_early' when l_shipdate::date - o_orderdate::date > 14 then 'too_late' end as flag from lineitem join orders on o_orderkey = l_orderkey")
def i5_dated_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dates outside of a grace of 7 days before to 14 after, with the distance."""
    joined = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    days = F.datediff(F.col("l_shipdate").cast("date"), F.col("o_orderdate").cast("date")).cast("long")
    return joined.select("l_orderkey", "l_linenumber", days.alias("days"), F.when(days < -7, "too_early").when(days > 14, "too_late").alias("flag"))
