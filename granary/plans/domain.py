"""Claim-domain plans: sinks, conditions, rule functions, identity, miners, scorers and event policies."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from granary.functions import json_values as jv
from granary.functions import scalars as fn
from granary.operators import domain as d
from granary.operators import mining, ordered
from granary.operators import relational as rel
from granary.operators import similarity as sim
from granary.operators.cases import cases
from granary.plans.base import CASES, Plans
from granary.plans.scalars import LONGEST
from granary.sources.tables import shared_dir, table

plans = Plans()
WORDS = "list_distinct(list_filter(string_split(trim(regexp_replace(lower({}), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')), ' '), lambda t: length(t) >= {}))"


@plans.query("select o_orderstatus, count(*) as n, round(sum(o_totalprice), 2) as total from orders group by o_orderstatus")
def a7_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows appended to a table in three writes, read back."""
    path = f"{shared_dir(spark)}/granary/append-{uuid.uuid4().hex}/orders"
    for part in range(3):  # by key, so that every row is in one of them, whatever its status
        table(spark, sf_dir, "orders").where(F.coalesce(F.pmod("o_orderkey", F.lit(3)), F.lit(0)) == part).write.mode("append").parquet(path)
    return spark.read.parquet(path).groupBy("o_orderstatus").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@plans.query("with old as (select n_nationkey, n_regionkey = 0 as flag from nation where n_regionkey < 3), new as (select n_nationkey, true as flag from nation where n_regionkey >= 2) select n_nationkey, coalesce(new.flag, old.flag) as flag from old full join new using (n_nationkey)")
def a12_insert_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A flag set for a group of rows that a query selects; rows that are there already are overwritten."""
    nation = table(spark, sf_dir, "nation")
    old = nation.where("n_regionkey < 3").select("n_nationkey", (F.col("n_regionkey") == 0).alias("old"))
    new = nation.where("n_regionkey >= 2").select("n_nationkey", F.lit(True).alias("new"))
    return old.join(new, "n_nationkey", "full").select("n_nationkey", F.coalesce("new", "old").alias("flag"))


SPECS = {
    "no_error": {"kind": "doc_missing", "doc": "error"}, "bought": {"kind": "doc_present", "doc": "purchase"}, "in_range": {"kind": "amount_in_range", "low": 10_000, "high": 20_000},
    "sequence": {"kind": "past_outcome_seq", "sequence": ["signup", "error", "purchase"]}, "dwelt": {"kind": "stage_dwell", "stage": "view", "hours": 12}, "unknown": {"kind": "weather"},
}


@plans.query("""with g as (select *, (epoch_us(lead(ts) over (partition by user_id order by ts, event_id)) - epoch_us(ts)) / 3600000000.0 as hours from events),
u as (select user_id, list(distinct event_type) as docs, sum(value) as amount, ',' || string_agg(event_type, ',' order by ts, event_id) || ',' as seq, max(hours) filter (where event_type = 'view') as dwell from g group by user_id)
select user_id, not list_contains(docs, 'error') as no_error, list_contains(docs, 'purchase') as bought, amount between 10000 and 20000 as in_range, regexp_matches(seq, ',signup,(.*,)?error,(.*,)?purchase,') as sequence, coalesce(dwell >= 12, false) as dwelt, null::boolean as unknown from u""")
def b15_conditions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conditions that come as data: documents there or missing, amounts, sequences, dwell times; an unknown kind is null."""
    events = table(spark, sf_dir, "events")
    dwelt = mining.dwell_times(events, "user_id", "event_type", "ts", "event_id")
    stages = dwelt.groupBy("user_id", "event_type").agg((F.max("dwell_s") / 3600).alias("h")).groupBy("user_id").agg(F.map_from_entries(F.collect_list(F.struct("event_type", "h"))).alias("stages"))
    wanted = SPECS["sequence"]["sequence"]
    matched, _ = ordered.reached(events, ["user_id"], ["ts", "event_id"], F.col("event_type"), len(wanted) + 1, ordered.sequence_step(wanted))
    users = events.groupBy("user_id").agg(F.collect_set("event_type").alias("docs"), F.sum("value").alias("amount")).join(matched, "user_id").withColumn("outcomes", F.slice(F.array(*map(F.lit, wanted)), 1, F.col("state")))  # the part of the sequence that came
    return users.join(stages, "user_id", "left").withColumn("stages", F.coalesce("stages", F.map_from_entries(F.array().cast("array<struct<a:string,b:double>>")))).select("user_id", *(d.condition(spec).alias(name) for name, spec in SPECS.items()))


@plans.query("""select event_id, json_extract_string(props, '$.k')::bigint as k, '{"k":' || (json_extract_string(props, '$.k')::bigint + 1) || ',"meta":{"seen":true}}' as patched from events""")
def b18_json_pointer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A value read by its path, changed in place, and a nested one added."""
    doc = F.from_json("props", "k long, meta struct<seen:boolean>")
    patched = table(spark, sf_dir, "events").withColumn("doc", doc).withColumn("doc", F.col("doc").withField("k", F.col("doc.k") + 1).withField("meta", F.struct(F.lit(True).alias("seen"))))
    return patched.select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"), F.to_json("doc").alias("patched"))


@plans.query("select c.p_partkey, c.p_name, p.p_name as parent from part c left join part p on p.p_partkey = c.p_partkey // 10")
def j15_parent_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The label of each code's parent code."""
    part = table(spark, sf_dir, "part")
    return part.alias("c").join(part.alias("p"), F.floor(F.col("c.p_partkey") / 10) == F.col("p.p_partkey"), "left").select("c.p_partkey", "c.p_name", F.col("p.p_name").alias("parent"))


@plans.query("""with h as (select doc_id, source, md5(coalesce(text, ''))[1:14] || lpad(printf('%x', doc_id % 256), 2, '0') as h from documents), t as (select source, h, min(doc_id) as template from h group by all),
m as (select a.doc_id, t.template, (bit_count(xor(('0x' || a.h[1:8])::bigint, ('0x' || t.h[1:8])::bigint)) + bit_count(xor(('0x' || a.h[9:16])::bigint, ('0x' || t.h[9:16])::bigint)))::bigint as distance from h a join t on t.source = a.source and t.template < a.doc_id)
select doc_id, template, distance from (select *, row_number() over (partition by doc_id order by distance, template) as k from m where distance <= 4) where k = 1""")
def j17_template_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest earlier document of the same tenant by 64 bits of a hash, at most 4 bits off; of equal hashes the first stands for all."""
    digest = F.md5(F.coalesce("text", F.lit("")))
    hashed = table(spark, sf_dir, "documents").select("doc_id", "source", F.concat(F.substring(digest, 1, 14), F.lpad(F.lower(F.hex(F.col("doc_id") % 256)), 2, "0")).alias("h"))
    return sim.nearest_earlier_hash(hashed, "doc_id", "source", "h")


RULE_SETS = [(1, ["AF", "RF"], ["BUILDING"]), (2, ["NO"], ["MACHINERY", "BUILDING"]), (3, ["AF", "NF", "NO"], ["AUTOMOBILE"])]


@plans.query(f"""with {CASES}, h as (select l_orderkey as case_id, list(distinct l_returnflag || l_linestatus) as t from lineitem group by 1), s as (select * from (values {', '.join(f"({i}, {a}, {b})" for i, a, b in RULE_SETS)}) as x(rule_set, treatments, specialties)),
m as (select case_id, rule_set, 2 * len(list_intersect(t, treatments)) + list_contains(specialties, kind)::int as score from cases join h using (case_id), s)
select case_id, rule_set, score::bigint as score from (select *, row_number() over (partition by case_id order by score desc, rule_set) as k from m where score > 0) where k = 1""")
def j19_rule_set_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rule set that shares most with a case: two for a treatment, one for the specialty; ties to the first."""
    held = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("case_id")).agg(F.collect_set(F.concat("l_returnflag", "l_linestatus")).alias("t"))
    sets = F.array(*(F.struct(F.lit(i).alias("rule_set"), F.array(*map(F.lit, a)).alias("treatments"), F.array(*map(F.lit, b)).alias("specialties")) for i, a, b in RULE_SETS))
    score = lambda s: (2 * F.size(F.array_intersect("t", s["treatments"])) + F.array_contains(s["specialties"], F.col("kind")).cast("int")).cast("long")
    scored = F.array_sort(F.transform(sets, lambda s: F.struct((-score(s)).alias("lost"), s["rule_set"].alias("rule_set"))))
    best = cases(spark, sf_dir).select("case_id", "kind").join(held, "case_id").select("case_id", F.get(scored, F.lit(0)).alias("b"))
    return best.select("case_id", "b.rule_set", (-F.col("b.lost")).alias("score")).where("score > 0")


@plans.query("select coalesce(l_returnflag, 'all') as field, count(*) as n, round(avg((l_discount <= 0.05)::int), 6) as hit_rate from lineitem group by rollup (l_returnflag)")
def g19_hit_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hit rate per field and over all."""
    hit = (F.col("l_discount") <= 0.05).cast("int")
    return table(spark, sf_dir, "lineitem").rollup("l_returnflag").agg(F.count("*").alias("n"), F.round(F.avg(hit), 6).alias("hit_rate")).select(F.coalesce("l_returnflag", F.lit("all")).alias("field"), "n", "hit_rate")


@plans.query("""select event_type as path, '{"k":' || (json_extract_string(props, '$.k')::bigint // 10) || '}' as ai, '{"k":' || (value::bigint // 100) || '}' as human, count(*) as n from events group by all having count(*) >= 3""")
def g21_drift_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Corrections that agree in path and both values as JSON, three at least."""
    ai = F.to_json(F.struct(F.floor(F.get_json_object("props", "$.k").cast("long") / 10).alias("k")))
    human = F.to_json(F.struct(F.floor(F.round("value").cast("long") / 100).alias("k")))
    return table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("path"), ai.alias("ai"), human.alias("human")).agg(F.count("*").alias("n")).where("n >= 3")


@plans.query("select l_suppkey, count(*) as n, round(avg((l_discount > 0.04)::int), 6) as narrowing from lineitem group by l_suppkey having count(*) >= 5 and avg((l_discount > 0.04)::int) >= 0.6")
def g22_narrowing_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules whose corrections narrow them in 60 of 100 cases, from five cases on."""
    found = table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.count("*").alias("n"), F.avg((F.col("l_discount") > 0.04).cast("int")).alias("rate"))
    return found.where("n >= 5 and rate >= 0.6").select("l_suppkey", "n", F.round("rate", 6).alias("narrowing"))


@plans.query("""with c as (select p_partkey, p_size, '"' || p_name || '"' as name, p_size::varchar as size from part),
v as (select p_partkey, case when p_size <= 30 then name when p_size <= 40 then size else '{"a":' || size || '}' end as before,
case when p_size <= 8 then name when p_size <= 16 then size when p_size <= 24 then '"' || substr(name, 2, 3) || '"' when p_size <= 30 then '"other"' when p_size <= 40 then (p_size + 1)::varchar else '{"b":1}' end as after from c)
select p_partkey, case when before = after then 'no_change' when left(before, 1) = '"' and left(after, 1) <> '"' then 'type_change' when left(before, 1) = '"' and length(after) < length(before) and contains(trim(before, '"'), trim(after, '"')) then 'truncation'
when left(before, 1) = '"' then 'replacement' when left(before, 1) <> '{' then 'numeric' else 'structural' end as shape from v""")
def g23_shape_of_change(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a correction did to a JSON value."""
    size, name = F.col("p_size"), F.concat(F.lit('"'), F.col("p_name"), F.lit('"'))
    text = size.cast("string")
    before = F.when(size <= 30, name).when(size <= 40, text).otherwise(F.concat(F.lit('{"a":'), text, F.lit("}")))
    after = F.when(size <= 8, name).when(size <= 16, text).when(size <= 24, F.concat(F.lit('"'), F.substring(name, 2, 3), F.lit('"'))).when(size <= 30, F.lit('"other"')).when(size <= 40, (size + 1).cast("string")).otherwise(F.lit('{"b":1}'))
    return table(spark, sf_dir, "part").select("p_partkey", d.shape_of_change(before, after).alias("shape"))


@plans.query("select source, count(*) as n, coalesce(sum(strlen(text)), 0)::bigint as bytes, count(distinct lang) as categories from documents group by source")
def g24_storage_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files, bytes and categories per owner."""
    return table(spark, sf_dir, "documents").groupBy("source").agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("bytes"), F.count_distinct("lang").alias("categories"))


@plans.query("select l_linestatus as layer, l_returnflag as target, count(*) as n, round(avg((l_tax < 0.04)::int), 6) as agree from lineitem group by all")
def g27_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Agreement with feedback by layer and target."""
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_linestatus").alias("layer"), F.col("l_returnflag").alias("target")).agg(F.count("*").alias("n"), F.round(F.avg((F.col("l_tax") < 0.04).cast("int")), 6).alias("agree"))


@plans.query("select l_orderkey, l_linenumber, l_partkey, round(coalesce(list_avg(list_filter([case when l_returnflag <> 'N' then l_discount * 10 end, case when l_returnflag = 'A' then l_quantity / 50 end], lambda x: x is not null)), 0.5), 3) as confidence from lineitem")
def g28_nested_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean of the numbers in a map of field confidences, else the section's own."""
    flag = F.col("l_returnflag")
    fields = F.create_map(F.lit("discount"), F.when(flag != "N", F.col("l_discount") * 10), F.lit("quantity"), F.when(flag == "A", F.col("l_quantity") / 50))
    values = F.filter(F.map_values(fields), lambda x: x.isNotNull())
    mean = F.when(F.size(values) > 0, F.aggregate(values, F.lit(0.0), lambda s, x: s + x) / F.size(values)).otherwise(F.lit(0.5))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.round(mean, 3).alias("confidence"))


@plans.query("select o_orderkey, coalesce(string_agg(distinct l_linenumber::varchar, ',' order by l_linenumber::varchar) filter (where l_linenumber between case when o_orderstatus = 'F' then 2 else 1 end and 4), '') as pages from orders join lineitem on l_orderkey = o_orderkey group by o_orderkey")
def i6_pages_in_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of a document within its range."""
    joined = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey"))
    page = F.when(F.col("l_linenumber").between(F.when(F.col("o_orderstatus") == "F", 2).otherwise(1), F.lit(4)), F.col("l_linenumber").cast("string"))
    return joined.groupBy("o_orderkey").agg(F.array_join(F.array_sort(F.collect_set(page)), ",").alias("pages"))


NAMED_LINES = "n as (select distinct l_orderkey, p_name as name from lineitem join part on p_partkey = l_partkey)"


def named_lines(spark: SparkSession, sf_dir: str, **of_name: Column) -> DataFrame:
    """The names of an order's lines, with columns that depend on the name alone: made once for a part, not for each pair of lines."""
    part, lines = table(spark, sf_dir, "part"), table(spark, sf_dir, "lineitem")
    named = part.select("p_partkey", F.col("p_name").alias("name"), *(c.alias(n) for n, c in of_name.items()))
    return lines.join(named, F.col("l_partkey") == F.col("p_partkey")).select("l_orderkey", "name", *of_name).distinct()


@plans.query(f"""with {NAMED_LINES}, t as (select *, {LONGEST.format('name')} as x from n), p as (select a.l_orderkey, a.name as a, b.name as b, levenshtein(a.x, b.x) / greatest(length(a.x), length(b.x)) as d from t a join t b on a.l_orderkey = b.l_orderkey and a.name < b.name)
select l_orderkey, a, b, round(d, 6) as distance from p where d > 0.4""")
def d14_identity_mismatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names on the identity documents of one claim that differ too much, pair by pair; a claim holds few."""
    names = named_lines(spark, sf_dir, token=fn.distinctive(F.col("p_name")))
    a, b = (names.select("l_orderkey", F.col("name").alias(x), F.col("token").alias(f"token_{x}")) for x in "ab")
    pairs = a.join(b, "l_orderkey").where("a < b").withColumn("distance", fn.token_distance(F.col("token_a"), F.col("token_b")))
    return pairs.where("distance > 0.4").select("l_orderkey", "a", "b", F.round("distance", 6).alias("distance"))


@plans.query("""with m as (select p_type, min(p_name) as master from part group by 1), d as (select p_partkey, p_name, master, levenshtein(p_name, master) / greatest(length(p_name), length(master)) as d from part join m using (p_type))
select p_partkey, case when d <= 0.4 then master else p_name end as canonical, case when d <= 0.15 then 'high' when d <= 0.4 then 'medium' else 'low' end as confidence from d""")
def d15_canonical_hospital(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The master's name where it is near enough, with the confidence that the distance gives."""
    part = table(spark, sf_dir, "part")
    masters = part.groupBy("p_type").agg(F.min("p_name").alias("master"))
    far = F.levenshtein("p_name", "master") / F.greatest(F.length("p_name"), F.length("master"))
    told = part.join(masters, "p_type").withColumn("d", far)
    return told.select("p_partkey", F.when(F.col("d") <= 0.4, F.col("master")).otherwise(F.col("p_name")).alias("canonical"), F.when(F.col("d") <= 0.15, "high").when(F.col("d") <= 0.4, "medium").otherwise("low").alias("confidence"))


@plans.query("""with l as (select l_orderkey, l_linenumber, l_partkey, l_returnflag as id, l_linestatus as hospital, l_suppkey // 10 as name, l_shipdate::date as day from lineitem),
mode_of as (select l_orderkey, id, hospital, name, day, count(*) over (partition by l_orderkey, id) as n_id, count(*) over (partition by l_orderkey, hospital) as n_h, count(*) over (partition by l_orderkey, name) as n_n, l_linenumber, l_partkey,
 (select count(*) from l b where b.l_orderkey = l.l_orderkey and abs(b.day - l.day) <= 45) as n_d from l),
top as (select l_orderkey, arg_max(id, (n_id, -l_linenumber, -l_partkey)) as id, arg_max(hospital, (n_h, -l_linenumber, -l_partkey)) as hospital, arg_max(name, (n_n, -l_linenumber, -l_partkey)) as name, arg_max(day, (n_d, -l_linenumber, -l_partkey)) as day from mode_of group by 1),
v as (select l.l_orderkey, l_linenumber, l_partkey, (l.id <> top.id)::int as wrong_id, (l.name <> top.name)::int + (l.hospital <> top.hospital)::int + (abs(l.day - top.day) > 45)::int as others from l join top using (l_orderkey))
select l_orderkey, l_linenumber, l_partkey, case when wrong_id = 1 and others >= 1 or others = 3 then 'quarantine' when wrong_id + others > 0 then 'review' else 'ok' end as verdict from v""")
def d17_foreign_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages against their claim's dominant identifier, name, hospital and 45-day window: quarantine, review or ok.

    Dominant values are the most frequent (first seen on ties), the window is
    around the day with most pages near it; a claim's pages are few.
    """
    pages = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.col("l_returnflag").alias("id"), F.col("l_linestatus").alias("hospital"), F.floor(F.col("l_suppkey") / 10).alias("name"), F.col("l_shipdate").cast("date").alias("day"))
    of = lambda *c: Window.partitionBy("l_orderkey", *c)
    near = Window.partitionBy("l_orderkey").orderBy(F.datediff("day", F.lit("1970-01-01").cast("date"))).rangeBetween(-45, 45)
    counted = pages.withColumns({"n_id": F.count("*").over(of("id")), "n_h": F.count("*").over(of("hospital")), "n_n": F.count("*").over(of("name")), "n_d": F.count("*").over(near)})
    first_seen = [(-F.col("l_linenumber")).alias("l"), (-F.col("l_partkey")).alias("p")]
    top = counted.groupBy("l_orderkey").agg(*(F.max_by(c, F.struct(F.col(n), *first_seen)).alias(f"top_{c}") for c, n in (("id", "n_id"), ("hospital", "n_h"), ("name", "n_n"), ("day", "n_d"))))
    told = pages.join(top, "l_orderkey").withColumn("wrong_id", F.col("id") != F.col("top_id"))
    others = (F.col("name") != F.col("top_name")).cast("int") + (F.col("hospital") != F.col("top_hospital")).cast("int") + (F.abs(F.datediff("day", "top_day")) > 45).cast("int")
    told = told.withColumn("others", others)
    return told.select("l_orderkey", "l_linenumber", "l_partkey", F.when(F.col("wrong_id") & (F.col("others") >= 1) | (F.col("others") == 3), "quarantine").when(F.col("wrong_id") | (F.col("others") > 0), "review").otherwise("ok").alias("verdict"))


@plans.query("""with p as (select user_id, round((12.0 + (event_id % 7) * 0.0004 + (event_type = 'error')::int * 0.1)::double, 3) as lat, round((77.0 + (event_id % 5) * 0.0004)::double, 3) as lon, ts::date as day from events),
c as (select user_id, lat, lon, day, count(*) as n from p group by all), t as (select *, first_value({'lat': lat, 'lon': lon, 'day': day}) over (partition by user_id order by n desc, day, lat, lon) as top from c)
select user_id, lat, lon, strftime(day, '%Y-%m-%d') as day, n, 2 * 6371.0 * asin(least(1, sqrt(pow(sin(radians(top.lat - lat) / 2), 2) + cos(radians(lat)) * cos(radians(top.lat)) * pow(sin(radians(top.lon - lon) / 2), 2)))) > 5 and day <> top.day as far from t""")
def d21_far_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places of a claim's photographs in cells, and those far from its main cell on another day."""
    e = table(spark, sf_dir, "events")
    lat = 12.0 + F.col("event_id") % 7 * 0.0004 + (F.col("event_type") == "error").cast("int") * 0.1
    placed = e.select("user_id", lat.alias("lat"), (77.0 + F.col("event_id") % 5 * 0.0004).alias("lon"), F.date_format("ts", "yyyy-MM-dd").alias("day"))
    return d.far_places(placed, "user_id")


@plans.query(f"""with f as (select l_orderkey, arg_min(l_partkey, (l_linenumber, l_partkey)) as pk from lineitem group by 1), t as (select l_orderkey, 'Claim for ' || p_name as text from f join part on p_partkey = pk),
c as (select distinct l_orderkey, l_partkey, p_name from lineitem join part on p_partkey = l_partkey), s as (select l_orderkey, l_partkey, len(list_intersect({WORDS.format('p_name', 3)}, {WORDS.format('text', 3)})) / len({WORDS.format('p_name', 3)}) as share from c join t using (l_orderkey)),
k as (select *, row_number() over (partition by l_orderkey order by share desc, l_partkey) as k, lead(share) over (partition by l_orderkey order by share desc, l_partkey) as second from s)
select l_orderkey, l_partkey, round(share, 6) as share from k where k = 1 and share >= 0.5 and round(share - coalesce(second, 0), 9) >= 0.34""")
def d25_disambiguation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The claim that a message means: most of its name's tokens in the text, well ahead of the next."""
    lines = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    texts = lines.groupBy("l_orderkey").agg(F.concat(F.lit("Claim for "), F.min_by("p_name", F.struct("l_linenumber", "l_partkey"))).alias("text"))
    scored = lines.select("l_orderkey", "l_partkey", "p_name").distinct().join(texts, "l_orderkey").select("l_orderkey", "l_partkey", d.token_share(F.col("p_name"), F.col("text")).alias("share"))
    return d.disambiguated(scored, "l_orderkey", "l_partkey").withColumn("share", F.round("share", 6))


@plans.query(f"""with {CASES} select case_id, case when queried then 'appeal' when status = 'F' then 'closed' else 'open' end as route, case when queried then 'letter' when status = 'F' then 'record' else 'default' end as source,
case when queried then 0.9 when status = 'F' then 0.7 else 0.3 end as confidence, (status = 'F') <> (n_lines > 0 and approved >= claimed * 0.5) as conflict from cases""")
def f15_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Route of a case with its source and confidence, the first source that knows; and whether the documents contradict it."""
    closed = F.col("status") == "F"
    found = F.coalesce(*(F.when(c, F.struct(F.lit(r).alias("route"), F.lit(s).alias("source"), F.lit(p).alias("confidence"))) for c, r, s, p in ((F.col("queried"), "appeal", "letter", 0.9), (closed, "closed", "record", 0.7), (F.lit(True), "open", "default", 0.3))))
    mix = (F.col("n_lines") > 0) & (F.col("approved") >= F.col("claimed") * 0.5)
    return cases(spark, sf_dir).select("case_id", found.alias("f"), (closed != mix).alias("conflict")).select("case_id", "f.*", "conflict")


@plans.query(f"with {CASES} select case_id, case when claimed = 0 then 'empty' when status = 'P' then 'pending' when approved >= claimed then 'approved' when approved = 0 then 'rejected' else 'partial' end as outcome, case when claimed < 50000 then 'small' when claimed < 200000 then 'medium' else 'large' end as size from cases")
def f18_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outcome and size of a case."""
    c, a = F.col("claimed"), F.col("approved")
    outcome = F.when(c == 0, "empty").when(F.col("status") == "P", "pending").when(a >= c, "approved").when(a == 0, "rejected").otherwise("partial")
    return cases(spark, sf_dir).select("case_id", outcome.alias("outcome"), F.when(c < 50_000, "small").when(c < 200_000, "medium").otherwise("large").alias("size"))


@plans.query(r"""select doc_id, n_chars between 1 and 100000 as in_window, regexp_matches(lower(coalesce(text, '')), 'all rights reserved|lorem ipsum|click here') as boilerplate, case when regexp_matches(coalesce(text, ''), '[À-ÿ]') then 'accented' when regexp_matches(coalesce(text, ''), '[A-Za-z]') then 'plain' else 'none' end as script,
regexp_extract(coalesce(text, ''), '\b[1-9][0-9]{5}\b') as pin from documents""")
def f19_validators(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Field checks: windows, boilerplate, script and postal codes."""
    text = F.coalesce("text", F.lit(""))
    script = F.when(text.rlike("[À-ÿ]"), "accented").when(text.rlike("[A-Za-z]"), "plain").otherwise("none")
    return table(spark, sf_dir, "documents").select("doc_id", F.col("n_chars").between(1, 100_000).alias("in_window"), F.lower(text).rlike("all rights reserved|lorem ipsum|click here").alias("boilerplate"), script.alias("script"), F.regexp_extract(text, r"\b[1-9][0-9]{5}\b", 0).alias("pin"))


@plans.query("""with p as (select p_partkey, lower(p_name) as a, lower(lag(p_name) over (partition by p_type order by p_partkey)) as b from part)
select p_partkey, coalesce(a = b or replace(a, ' ', '') = replace(b, ' ', '') or least(length(a), length(b)) >= 4 and (contains(a, b) or contains(b, a)), false) as hit from p""")
def f21_text_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether two values match as texts: equal, equal without spaces, or one within the other if it has four characters."""
    w = Window.partitionBy("p_type").orderBy("p_partkey")
    p = table(spark, sf_dir, "part").select("p_partkey", F.lower("p_name").alias("a"), F.lower(F.lag("p_name").over(w)).alias("b"))
    bare = lambda c: F.replace(F.col(c), F.lit(" "), F.lit(""))
    hit = (F.col("a") == F.col("b")) | (bare("a") == bare("b")) | (F.least(F.length("a"), F.length("b")) >= 4) & (F.contains(F.col("a"), F.col("b")) | F.contains(F.col("b"), F.col("a")))
    return p.select("p_partkey", F.coalesce(hit, F.lit(False)).alias("hit"))


@plans.query("select event_id, json_extract_string(props, '$.k') as k, event_type <> 'error' as same from events")
def f24_payload_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A path read, and two payloads compared whatever the order of their keys."""
    k, kind = F.get_json_object("props", "$.k"), F.col("event_type")
    one = F.concat(F.lit('{"k":'), k, F.lit(',"t":"'), kind, F.lit('"}'))
    two = F.concat(F.lit('{"t":"'), F.when(kind == "error", "changed").otherwise(kind), F.lit('","k":'), k, F.lit("}"))
    return table(spark, sf_dir, "events").select("event_id", k.alias("k"), jv.same_json(one, two).alias("same"))


@plans.query(f"""with {NAMED_LINES}, p as (select a.l_orderkey, levenshtein(a.name, b.name) as edits, len(list_intersect({WORDS.format('a.name', 1)}, {WORDS.format('b.name', 1)})) / least(len({WORDS.format('a.name', 1)}), len({WORDS.format('b.name', 1)})) as overlap from n a join n b on a.l_orderkey = b.l_orderkey and a.name < b.name),
v as (select l_orderkey, case when edits <= 2 or overlap >= 1 then 0 when edits >= 5 and overlap < 0.5 then 2 else 1 end as level from p)
select l_orderkey, case coalesce(max(level), 0) when 0 then 'pass' when 1 then 'review' else 'block' end as verdict from (select distinct l_orderkey from n) left join v using (l_orderkey) group by 1""")
def r3_fuzzy_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The worst pair of names of a claim: pass, review or block."""
    plain = F.array_join(fn.name_tokens(F.col("p_name"), 1), " ")
    names = named_lines(spark, sf_dir, plain=F.nullif(plain, F.col("p_name")))  # most names are plain already
    a, b = (names.select("l_orderkey", F.col("name").alias(x), F.coalesce("plain", "name").alias(f"plain_{x}")) for x in "ab")
    pairs = a.join(b, "l_orderkey").where("a < b")
    edits = F.levenshtein("a", "b", 4)  # -1 for more: all from 5 on are alike
    tokens = [F.filter(F.split(f"plain_{x}", " "), lambda t: t != "") for x in "ab"]
    verdict = d.name_verdict(F.when(edits < 0, 5).otherwise(edits), fn.token_share_of(*tokens))
    worst = pairs.select("l_orderkey", F.array_position(F.array(*map(F.lit, ("review", "block"))), verdict).alias("level")).groupBy("l_orderkey").agg(F.max("level").alias("level"))
    level = F.coalesce("level", F.lit(0))
    return names.select("l_orderkey").distinct().join(worst, "l_orderkey", "left").select("l_orderkey", F.when(level == 0, "pass").when(level == 1, "review").otherwise("block").alias("verdict"))


FACTS = """f as (select case_id, n_lines as days, case when kind <> 'FURNITURE' then 4 end as benchmark_days, claimed, case when kind = 'BUILDING' then 100000.0 end as cap, case when queried then 5 end as icu_days, case when kind = 'MACHINERY' then 'cardiology' else 'other' end as specialty, status,
  case when priority = '1-URGENT' then n_lines * 3 end as sessions, case when n_lines > 0 then claimed / n_lines / 100 end as room_rate, 50000.0 as insured, year(opened) - 1992 as policy_years, priority = '5-LOW' as pre_existing from cases)"""


@plans.query(f"""with {CASES}, {FACTS} select case_id, case when benchmark_days is null then 'SKIP' when abs(days - benchmark_days) > 2 then 'FAIL' else 'PASS' end as validate_los_against_benchmark, case when cap is null then 'SKIP' when claimed > cap * 1.1 then 'FAIL' else 'PASS' end as validate_package_cap,
case when icu_days is null then 'SKIP' when icu_days > days then 'FAIL' else 'PASS' end as validate_icu_stay, case when specialty <> 'cardiology' then 'SKIP' when status <> 'F' then 'FAIL' else 'PASS' end as require_cardiac_enzymes, case when sessions is null then 'SKIP' when sessions > 10 then 'WARNING' else 'PASS' end as limit_physiotherapy,
case when room_rate is null then 'SKIP' when room_rate > insured * 0.01 then 'FAIL' else 'PASS' end as check_room_eligibility, case when not pre_existing then 'SKIP' when policy_years < 3 then 'FAIL' else 'PASS' end as check_pre_existing, 'SKIP' as unknown_rule, claimed * 0.1 > insured - 1000 as calculated from f""")
def r10_rule_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rule functions by name with parameters, an unknown one, and a calculation over allowed fields."""
    kind, status, priority = F.col("kind"), F.col("status"), F.col("priority")
    facts = cases(spark, sf_dir).select(
        "case_id", F.col("n_lines").alias("days"), F.when(kind != "FURNITURE", 4).alias("benchmark_days"), "claimed", F.when(kind == "BUILDING", 100_000.0).alias("cap"), F.when(F.col("queried"), 5).alias("icu_days"), F.when(kind == "MACHINERY", "cardiology").otherwise("other").alias("specialty"),
        F.when(status == "F", F.array(F.lit("troponin"))).otherwise(F.array(F.lit("x-ray"))).alias("tests"), F.when(priority == "1-URGENT", F.col("n_lines") * 3).alias("sessions"), F.when(F.col("n_lines") > 0, F.col("claimed") / F.col("n_lines") / 100).alias("room_rate"), F.lit(50_000.0).alias("insured"), (F.year("opened") - 1992).alias("policy_years"), (priority == "5-LOW").alias("pre_existing"),
    )
    parameters = {"validate_package_cap": {"factor": 1.1}}
    verdicts = [d.rule_function(name, parameters.get(name)).alias(name) for name in (*d.RULE_FUNCTIONS, "unknown_rule")]
    return facts.select("case_id", *verdicts, d.calculation("claimed * 0.1 > insured - 1000", {"claimed", "insured"}).alias("calculated"))


ARRIVALS = """log as (select user_id, event_id, epoch_us(ts) as us, event_id * 10 + case when event_type = 'error' then 4005 else 0 end as arrival from events union all select user_id, event_id, epoch_us(ts), event_id * 10 + 1 from events where event_type = 'view')"""


@plans.query(f"""with {ARRIVALS}, w as (select *, max({{'t': us, 'a': arrival, 'id': event_id}}) over (partition by user_id order by arrival rows between unbounded preceding and 1 preceding) as last from log)
select user_id, case when last is null then 'applied' when last.id = event_id then 'duplicate' when us < last.t then 'late' else 'applied' end as policy, count(*) as n from w group by all""")
def s3_late_and_duplicate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A log with events that arrive late and ones that arrive twice, by what the fold does with them."""
    e = table(spark, sf_dir, "events").select("user_id", "event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), "event_type")
    late = e.withColumn("arrival", F.col("event_id") * 10 + F.when(F.col("event_type") == "error", 4005).otherwise(0))
    twice = e.where("event_type = 'view'").withColumn("arrival", F.col("event_id") * 10 + 1)
    return d.applied_in_order(late.unionByName(twice), "user_id", "arrival", "us", "event_id").groupBy("user_id", "policy").agg(F.count("*").alias("n"))


@plans.query("select event_id, event_type as old_stage, upper(event_type) as new_stage from events")
def s5_legacy_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two names of one payload read as one: from/to of old events, before/after of new ones."""
    kind = F.col("event_type")
    written = F.when(F.col("value") < 250, F.to_json(F.struct(kind.alias("from"), F.upper(kind).alias("to")))).otherwise(F.to_json(F.struct(kind.alias("before"), F.upper(kind).alias("after"))))
    either = lambda *keys: F.coalesce(*(F.get_json_object("payload", f"$.{k}") for k in keys))
    return table(spark, sf_dir, "events").withColumn("payload", written).select("event_id", either("before", "from").alias("old_stage"), either("after", "to").alias("new_stage"))


@plans.query("""with last as (select user_id, max_by(event_id, (ts, event_id)) as event_id, max(ts) as ts from events where event_type = 'click' group by user_id), now as (select max(ts) as t from events)
select last.user_id, last.event_id from last, now where epoch_us(now.t) - epoch_us(last.ts) > 60000000 and not exists (select 1 from events e where e.user_id = last.user_id and e.event_type = 'purchase' and e.ts > last.ts)""")
def s8_stranded_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs whose latest start is over a minute old and that nothing ended since."""
    events = table(spark, sf_dir, "events")
    last = rel.first_per(events.where("event_type = 'click'").select("user_id", "event_id", "ts"), ["user_id"], [F.desc("ts"), F.desc("event_id")])
    ended = events.where("event_type = 'purchase'").groupBy("user_id").agg(F.max("ts").alias("ended"))
    now = events.agg(F.max("ts").alias("now"))
    old = F.unix_micros(F.col("now").cast("timestamp")) - F.unix_micros(F.col("ts").cast("timestamp")) > 60_000_000
    return last.join(ended, "user_id", "left").crossJoin(F.broadcast(now)).where(old & (F.col("ended").isNull() | (F.col("ended") <= F.col("ts")))).select("user_id", "event_id")  # now is one row


#: Orders as claims, their first line's part as diagnosis, lines that aren't returned as clinical sections.
PLAN_SIDES = {"warm": ("red", "hot"), "cold": ("blue", "cold")}
SIDE_SQL = """l as (select l_orderkey, l_linenumber, l_partkey, l_returnflag, p_name, len(regexp_extract_all(lower(p_name), '\\b(red|hot)\\b')) as a, len(regexp_extract_all(lower(p_name), '\\b(blue|cold)\\b')) as b from lineitem join part on p_partkey = l_partkey),
c as (select l_orderkey, case when arg_min(a, (l_linenumber, l_partkey)) > arg_min(b, (l_linenumber, l_partkey)) then 'warm' when arg_min(b, (l_linenumber, l_partkey)) > arg_min(a, (l_linenumber, l_partkey)) then 'cold' end as diagnosis_side from l group by 1),
v as (select l_orderkey, l_linenumber, l_partkey, case when a > b then 'warm' else 'cold' end as side from l where l_returnflag <> 'R' and a + b > 0),
n as (select c.l_orderkey, any_value(diagnosis_side) as diagnosis_side, count(*) filter (where side = 'warm') as n_first, count(*) filter (where side = 'cold') as n_second from c left join v using (l_orderkey) group by 1),
m as (select *, case when n_first > n_second then 'warm' when n_second > n_first then 'cold' end as majority from n),
w as (select *, coalesce(diagnosis_side <> majority and case when diagnosis_side = 'warm' then n_second else n_first end >= 2, false) as disputed, diagnosis_side is null and majority is not null and greatest(n_first, n_second) >= 2 as observed from m)"""


def _sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    lines = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey")).select("l_orderkey", "l_linenumber", "l_partkey", "l_returnflag", "p_name")
    claims = lines.groupBy("l_orderkey").agg(F.min_by("p_name", F.struct("l_linenumber", "l_partkey")).alias("diagnosis"))
    votes = d.side_votes(lines.where("l_returnflag <> 'R'"), "p_name", PLAN_SIDES).select("l_orderkey", "l_linenumber", "l_partkey", "side")
    return votes, d.side_verdicts(claims, votes, "l_orderkey", "diagnosis", PLAN_SIDES)


@plans.query(f"with {SIDE_SQL} select * from w")
def d24_side_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the sections of a claim dispute the side of its diagnosis, or name one where it has none."""
    return _sides(spark, sf_dir)[1]


@plans.query(f"with {SIDE_SQL}, s as (select v.*, case when side <> diagnosis_side then 'dissents' when observed and side = majority then 'agrees' end as standing from v join w using (l_orderkey)) select * from s where standing is not null")
def d24_dissenting_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sections that dissent from the diagnosis' side, or agree on one where it has none."""
    return d.side_standings(*_sides(spark, sf_dir), "l_orderkey")
