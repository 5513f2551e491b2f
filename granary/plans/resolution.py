"""Entity resolution, further rules and costs (D, J, R, E) that need several operators."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.functions.scalars import hamming_hex
from granary.operators import relational as rel
from granary.operators import rules as r
from granary.operators import similarity as sim
from granary.operators.cases import cases
from granary.plans.base import CASES, Plans
from granary.plans.mining import CASE_DOCUMENTS, case_documents
from granary.sources.tables import shared_dir, table, table_stream
from granary.streaming import folds

plans = Plans()


@plans.query("""with recursive ids as (select distinct o_custkey, lpad((o_orderkey * 37 % 1000000)::varchar, 6, '0') as id from orders), pairs as (select a.o_custkey, a.id as a, b.id as b from ids a join ids b on a.o_custkey = b.o_custkey and a.id <> b.id and hamming(a.id, b.id) <= 2),
reach as (select o_custkey, a as node, b as other from pairs union select r.o_custkey, r.node, p.b from reach r join pairs p on p.o_custkey = r.o_custkey and p.a = r.other),
least_of as (select o_custkey, node, min(other) as m from reach group by all) select i.o_custkey, id, least(id, coalesce(m, id)) as cluster from ids i left join least_of l on l.o_custkey = i.o_custkey and l.node = i.id""")
def d16_id_reconciliation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Identifiers of a member that differ in at most two places are one."""
    ids = table(spark, sf_dir, "orders").select("o_custkey", F.lpad((F.col("o_orderkey") * 37 % 1_000_000).cast("string"), 6, "0").alias("id"))
    pairs = sim.pairs_within(ids, "o_custkey", "id", 6, 2, sim.differing_places)
    return sim.clusters(ids, pairs, "o_custkey", "id")


PAGE_HASH = "sha256(coalesce(text, ''))[1:62] || lpad(printf('%x', doc_id % 256), 2, '0')"
BITS = " + ".join(f"bit_count(xor(('0x' || a.h[{i}:{i + 7}])::bigint, ('0x' || b.h[{i}:{i + 7}])::bigint))::bigint" for i in range(1, 65, 8))


@plans.query(f"""with recursive p as (select doc_id, sha256(coalesce(text, ''))[1:2] as claim, {PAGE_HASH} as h from documents), pairs as (select distinct a.claim, a.h as x, b.h as y from p a join p b on a.claim = b.claim and a.h <> b.h and {BITS} <= 16),
reach as (select claim, x as node, y as other from pairs union select r.claim, r.node, p.y from reach r join pairs p on p.claim = r.claim and p.x = r.other), m as (select claim, node, min(other) as m from reach group by all)
select distinct p.claim, h, least(h, coalesce(m, h)) as cluster from p left join m on m.claim = p.claim and m.node = p.h""")
def d4_page_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Page hashes of a claim within 16 of 256 bits, transitively one group (D4, J16; D3's second hash and page counts of sections are not built)."""
    digest = F.sha2(F.coalesce("text", F.lit("")), 256)
    pages = table(spark, sf_dir, "documents").select(F.substring(digest, 1, 2).alias("claim"), F.lower(F.concat(F.substring(digest, 1, 62), F.lpad(F.lower(F.hex(F.col("doc_id") % 256)), 2, "0"))).alias("h"))
    pairs = sim.pairs_within(pages, "claim", "h", 64, 16, lambda a, b: hamming_hex(a, b, 64))
    return sim.clusters(pages, pairs, "claim", "h")


@plans.query("""with recursive n as (select l_orderkey, split_part(p_name, ' ', 1) as name, sum(l_quantity) as weight from lineitem join part on l_partkey = p_partkey group by all),
o as (select *, row_number() over (partition by l_orderkey order by weight desc, name) as k from n),
g as (select l_orderkey, k, name, name as cluster, [name] as heads from o where k = 1
union all select l_orderkey, k, name, coalesce(near, name), case when near is null then list_append(heads, name) else heads end from (select o.l_orderkey, o.k, o.name, g.heads, list_filter(g.heads, lambda h: levenshtein(o.name, h) / greatest(1, length(o.name), length(h)) <= 0.3)[1] as near from g join o on o.l_orderkey = g.l_orderkey and o.k = g.k + 1))
select l_orderkey, name, cluster from g""")
def d12_name_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of a claim attached greedily to the first near cluster (of D12, without its seed prior; order-dependent)."""
    part, lines = table(spark, sf_dir, "part"), table(spark, sf_dir, "lineitem")
    names = lines.join(part, F.col("l_partkey") == F.col("p_partkey")).select("l_orderkey", F.split("p_name", " ")[0].alias("name"), F.col("l_quantity").alias("weight"))
    return sim.clustered_names(names, "l_orderkey")


@plans.query("""with n as (select p_brand, p_name, min(p_partkey) as first from part group by all), t as (select p_brand, p_name, first, unnest(list_distinct(string_split(p_name, ' '))) as token from n), f as (select *, count(*) over (partition by p_brand, token) as df from t),
s as (select p_brand, p_name, first, sum(df - 1)::bigint as score from f group by all) select p_brand, p_name, score from (select *, row_number() over (partition by p_brand order by score desc, first) as k from s) where k = 1""")
def d18_representative_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The name whose tokens most other names of its group share."""
    names = table(spark, sf_dir, "part").groupBy("p_brand", "p_name").agg(F.min("p_partkey").alias("first"))
    tokens = names.select("*", F.explode(F.array_distinct(F.split("p_name", " "))).alias("token"))
    frequent = tokens.groupBy("p_brand", "token").agg((F.count("*") - 1).alias("others"))
    scored = tokens.join(frequent, ["p_brand", "token"]).groupBy("p_brand", "p_name", "first").agg(F.sum("others").alias("score"))
    return rel.first_per(scored, ["p_brand"], [F.desc("score"), F.asc("first")]).select("p_brand", "p_name", "score")


SLOTS = ["purchase", "signup", "click", "view"]


@plans.query("with s as (select user_id, event_type, round(value, 4) as value, list_position(['purchase', 'signup', 'click', 'view'], event_type) as rank, ts, event_id from events where value > 100 and user_id not in (select user_id from events where event_type = 'error' and value > 480)) select user_id, event_type, value from (select *, row_number() over (partition by user_id order by rank, ts, event_id) as k from s where rank is not null) where k = 1")
def d26_slot_promotion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first value that is there of ranked sources, never from excluded keys."""
    events = table(spark, sf_dir, "events")
    excluded = events.where("event_type = 'error' and value > 480").select("user_id").distinct()
    rank = F.array_position(F.array(*map(F.lit, SLOTS)), F.col("event_type"))
    found = events.where("value > 100").join(excluded, "user_id", "left_anti").withColumn("rank", rank).where("rank > 0")
    return rel.first_per(found, ["user_id"], [F.asc("rank"), F.asc("ts"), F.asc("event_id")]).select("user_id", "event_type", F.round("value", 4).alias("value"))


@plans.query(f"with {CASES}, {CASE_DOCUMENTS}, k as (select panel, category, count(*) as n_with from cases join docs using (case_id) group by all), t as (select panel, count(*) as n from cases group by 1) select panel, category, coalesce(n_with, 0) as n_with, n - coalesce(n_with, 0) as n_without from t cross join (select distinct category from docs) left join k using (panel, category)")
def j10_densified_presence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every panel with every category, with or without; only the two short lists are crossed."""
    known = cases(spark, sf_dir).select("case_id", "panel")
    docs = case_documents(spark, sf_dir)
    held = known.join(docs, "case_id").groupBy("panel", "category").agg(F.count("*").alias("n_with"))
    totals = known.groupBy("panel").agg(F.count("*").alias("n"))
    dense = totals.crossJoin(F.broadcast(docs.select("category").distinct()))  # categories are a fixed vocabulary
    n_with = F.coalesce("n_with", F.lit(0))
    return dense.join(held, ["panel", "category"], "left").select("panel", "category", n_with.alias("n_with"), (F.col("n") - n_with).alias("n_without"))


@plans.query("with d as (select l_orderkey, list(distinct l_returnflag || l_linestatus) as c from lineitem group by 1) select l_orderkey, case when list_contains(c, 'AF') or list_contains(c, 'AO') then 'PASS' else 'FAIL' end as any_group, case when (list_contains(c, 'AF') or list_contains(c, 'RF')) and list_contains(c, 'NO') then 'PASS' else 'FAIL' end as all_groups from d")
def r1_document_presence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of alternative documents: any of one, and one of each."""
    held = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_set(F.concat("l_returnflag", "l_linestatus")).alias("c"))
    group = lambda *names: F.arrays_overlap("c", F.array(*map(F.lit, names)))
    verdict = lambda ok: F.when(ok, "PASS").otherwise("FAIL")
    return held.select("l_orderkey", verdict(group("AF", "AO")).alias("any_group"), verdict(group("AF", "RF") & group("NO")).alias("all_groups"))


@plans.query("select event_id, concat_ws(',', case when json_extract_string(props, '$.k') is null then 'k' end, case when json_extract_string(props, '$.stage') is null then 'stage' end) as missing from events")
def r2_required_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Required fields of a JSON document that are missing or empty."""
    value = lambda f: F.coalesce(F.get_json_object("props", f"$.{f}"), F.lit(""))
    return table(spark, sf_dir, "events").select("event_id", F.concat_ws(",", *(F.when(value(f) == "", f) for f in ("k", "stage"))).alias("missing"))


@plans.query("select o_orderkey, case when count(l_orderkey) = 0 then 'SKIP' when bool_or(l_shipdate::date - o_orderdate::date between 0 and 30) then 'PASS' else 'FAIL' end as verdict from orders left join lineitem on l_orderkey = o_orderkey group by o_orderkey")
def r4_temporal_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A dated document within 30 days after its anchor."""
    joined = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey"), "left")
    near = F.datediff(F.col("l_shipdate").cast("date"), F.col("o_orderdate").cast("date")).between(0, 30)
    found = joined.groupBy("o_orderkey").agg(F.count("l_orderkey").alias("n"), F.bool_or(near).alias("ok"))
    return found.select("o_orderkey", F.when(F.col("n") == 0, "SKIP").when(F.col("ok"), "PASS").otherwise("FAIL").alias("verdict"))


JSON_RULES = """[{"id": "range", "severity": "HIGH", "logic": {"field": "claimed", "op": "BETWEEN", "value": [1000, 200000]}}, {"id": "pattern", "severity": "MEDIUM", "logic": {"field": "kind", "op": "MATCHES_PATTERN", "value": ["^[A-H]"]}}, {"id": "status", "severity": "LOW", "logic": {"field": "status", "op": "NOT_EQUALS", "value": ["P"]}}]"""


@plans.query(f"with {CASES} select case_id, (100 - case when claimed between 1000 and 200000 then 0 else 10 end - case when regexp_matches(kind, '^[A-H]') then 0 else 5 end - case when status <> 'P' then 0 else 2 end)::bigint as score from cases")
def r7_json_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules that come as JSON, compiled to columns (of R7: ranges, patterns and comparisons; no calculation, lookup or existence rule)."""
    own = [r.Rule(x["id"], x["logic"]["field"], x["logic"]["op"], tuple(x["logic"]["value"]), x["severity"]) for x in json.loads(JSON_RULES)]
    return r.readiness(cases(spark, sf_dir), "case_id", own).select("case_id", "score")


@plans.query(f"with {CASES}, g as (select case_id, greatest(0, 100 - 25 * (n_lines < 2)::int - case when kind = 'MACHINERY' then 25 * (approved < 5000)::int else 0 end - 5 * queried::int)::bigint as score from cases) select * from g")
def r9_stage_requirements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requirements in scope: 25 for a blocking one, 5 for a warning, none for information."""
    in_scope = F.col("kind") == "MACHINERY"
    lost = 25 * (F.col("n_lines") < 2).cast("int") + F.when(in_scope, 25 * (F.col("approved") < 5000).cast("int")).otherwise(0) + 5 * F.col("queried").cast("int")
    return cases(spark, sf_dir).select("case_id", F.greatest(F.lit(0), 100 - lost).cast("long").alias("score"))


@plans.query(f"""with {CASES}, g as (select case_id, 'missing_lines' as gap, 'request_doc' as action from cases where n_lines < 2 union all select case_id, 'open_query', 'reply' from cases where queried union all select case_id, 'cut', 'appeal' from cases where approved < claimed * 0.5)
select case_id, gap, action, sha256(case_id || '|' || gap || '|' || action) as idempotency_key from g""")
def r15_action_planning(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gaps of a case as actions with a key that makes repeats harmless."""
    gaps = ((F.col("n_lines") < 2, "missing_lines", "request_doc"), (F.col("queried"), "open_query", "reply"), (F.col("approved") < F.col("claimed") * 0.5, "cut", "appeal"))
    listed = F.array_compact(F.array(*(F.when(c, F.struct(F.lit(g).alias("gap"), F.lit(a).alias("action"))) for c, g, a in gaps)))
    planned = cases(spark, sf_dir).select("case_id", F.inline(listed))
    return planned.select("*", F.sha2(F.concat_ws("|", "case_id", "gap", "action"), 256).alias("idempotency_key"))


@plans.query(f"with {CASES}, m as (select kind, case when n_lines = 0 then 'read' when claimed < 10000 then 'extract' when queried then 'fuse' end as stage from cases), c as (select kind, stage, count(*) as n from m where stage is not null group by all) select kind, stage, n from (select *, row_number() over (partition by kind order by n desc, stage) as k from c) where k = 1")
def e6_miss_attribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stage that fails most often, per field."""
    stage = F.when(F.col("n_lines") == 0, "read").when(F.col("claimed") < 10_000, "extract").when(F.col("queried"), "fuse")
    missed = cases(spark, sf_dir).select("kind", stage.alias("stage")).where("stage is not null").groupBy("kind", "stage").agg(F.count("*").alias("n"))
    return rel.first_per(missed, ["kind"], [F.desc("n"), F.asc("stage")])


@plans.query(f"with {CASES} select case_id, (n_lines * 2 + (status = 'O')::int * 30)::bigint as remaining from cases where status <> 'F'")
def e9_remaining_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cost of what is still owed: parts times a unit, and a section for open cases."""
    owed = F.col("n_lines") * 2 + (F.col("status") == "O").cast("int") * 30
    return cases(spark, sf_dir).where("status <> 'F'").select("case_id", owed.cast("long").alias("remaining"))


@plans.query(f"with {CASES}, s as (select case_id, unnest([case when n_lines = 0 then 'no_lines' end, case when queried then 'queried' end, case when approved < claimed * 0.5 then 'cut' end, case when priority = '1-URGENT' then 'urgent' end]) as signal, claimed from cases) select signal, count(*) as n, round(sum(claimed), 2) as claimed from s where signal is not null group by signal")
def e5_run_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signals of all runs with their number and amounts."""
    signals = (("no_lines", F.col("n_lines") == 0), ("queried", F.col("queried")), ("cut", F.col("approved") < F.col("claimed") * 0.5), ("urgent", F.col("priority") == "1-URGENT"))
    rows = cases(spark, sf_dir).select("claimed", F.explode(F.array_compact(F.array(*(F.when(c, n) for n, c in signals)))).alias("signal"))
    return rows.groupBy("signal").agg(F.count("*").alias("n"), F.round(F.sum("claimed"), 2).alias("claimed"))


@plans.query("select user_id, count(*) as applied, 0 as dropped, max((epoch_us(ts), event_id))[1] as last_us, max((epoch_us(ts), event_id))[2] as last_id, count(*) filter (where event_type = 'signup') as opened, count(*) filter (where event_type = 'purchase') as closed from events group by user_id")
def s2_stream_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stream over the event files, run until they are used up; equals the batch fold.

    Whatever is there is one micro-batch: a limit of files would let the order
    of files, not of times, decide which events are late.  Its size does no harm,
    for it is reduced by partial aggregates before it meets the states.
    """
    root = f"{shared_dir(spark)}/granary/{uuid.uuid4().hex}/fold"
    folds.kept(table_stream(spark, sf_dir, "events"), root).trigger(availableNow=True).start().awaitTermination()
    return folds.newest_states(spark, root)
