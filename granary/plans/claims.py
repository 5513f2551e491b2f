"""Claims over time: ingest, dossiers and their open items, stage rules, bills, slots, scores, entities in messages."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.functions import entities as en
from granary.operators import dossier as ds
from granary.operators import fusion as fu
from granary.operators import rules as r
from granary.operators import similarity as sim
from granary.operators.cases import cases
from granary.operators.domain import shape_of_change
from granary.plans.base import CASES, Plans
from granary.plans.scalars import check_digit_sql
from granary.sources.tables import shared_dir, stored, table, table_stream
from granary.streaming import dossiers

plans = Plans()

# ---- the log of claims: events of the table with the kinds and payloads of claims

KINDS = (*ds.KNOWN, *ds.UNFOLDED, "made_up")
ACCEPTED = {k: () for k in (*ds.KNOWN, *ds.UNFOLDED)} | {k: (key,) for key, adds, removes in ds.LISTS.values() for k in adds + removes} | {"stage_transitioned": ("after_stage",)}

LOG = f"""log as (select *, case when value < 250 or kind = 'claim_created' then 'after' else 'to' end as stage_key from (
  select user_id as claim, event_id, epoch_us(ts) as us, {list(KINDS)}[event_id % {len(KINDS)} + 1] as kind, k, value, event_type, case when k % 10 <> 0 then 'i' || k % 4 end as item, case when k % 7 <> 0 then upper(event_type) end as stage,
  case when k % 3 <> 0 then round(value, 2) end as claimed, case when k % 4 <> 0 then event_type end as outcome, 's' || k % 20 as section
  from (select *, json_extract_string(props, '$.k')::int as k from events)))"""


def claim_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(claim, event_id, us, kind, payload, k) made of the event table."""
    return as_claim_log(table(spark, sf_dir, "events"))


def as_claim_log(events: DataFrame) -> DataFrame:
    k, kind = F.get_json_object("props", "$.k").cast("int"), F.col("event_type")
    item = F.when(k % 10 != 0, F.concat(F.lit("i"), (k % 4).cast("string")))
    stage = F.when(k % 7 != 0, F.upper(kind))
    payload = F.struct(
        *(item.alias(key) for key, _, _ in ds.LISTS.values()), stage.alias("initial_stage"), F.when(F.col("value") < 250, stage).alias("after_stage"), F.when(F.col("value") >= 250, stage).alias("to"), F.when(k % 3 != 0, F.round("value", 2)).alias("claimed"),
        F.when(k % 4 != 0, kind).alias("outcome"), kind.alias("category"), F.concat(F.lit("s"), (k % 20).cast("string")).alias("section_id"), kind.alias("verdict"),
    )
    named = F.get(F.array(*map(F.lit, KINDS)), (F.col("event_id") % len(KINDS)).cast("int"))
    return events.select(F.col("user_id").alias("claim"), "event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), named.alias("kind"), F.to_json(payload).alias("payload"), k.alias("k"))


ITEMS_SQL = "kind in ({})".format(", ".join(f"'{k}'" for k in ds.ITEM_KINDS))
NEEDS_STAGE = "kind = 'stage_transitioned' and (stage is null or value >= 250)"


@plans.query(f"""with {LOG}, t as (select claim, event_id, case when k % 9 <> 0 then kind || k % 5 end as idempotency_key, case when kind = 'made_up' then 'unknown_kind' when {ITEMS_SQL} and item is null or {NEEDS_STAGE} then 'invalid_payload' end as bad from log)
select event_id, claim, coalesce(bad, case when idempotency_key is not null and row_number() over (partition by claim, idempotency_key, bad order by event_id) > 1 then 'duplicate' else 'accepted' end) as verdict from t""")
def s1_event_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events accepted, repeated, of an unknown kind or without a field that their kind requires."""
    log = claim_log(spark, sf_dir).withColumn("idempotency_key", F.when(F.col("k") % 9 != 0, F.concat("kind", (F.col("k") % 5).cast("string"))))
    return ds.ingested(log, ACCEPTED, "idempotency_key").select("event_id", "claim", "verdict")


@plans.query(f"""with {LOG} select claim, count(*) as version, arg_max(stage, (us, event_id)) filter (where stage is not null and kind in ('claim_created', 'stage_transitioned', 'stage_changed')) as stage,
arg_max(claimed, (us, event_id)) filter (where kind = 'claim_created' and claimed is not null) as claimed, max(us) filter (where kind = 'claim_closed') as closed_us, (max({{'us': us, 'id': event_id, 'v': outcome}}) filter (where kind = 'claim_closed')).v as outcome,
count(*) filter (where kind like 'inbound_email_%' and kind <> 'inbound_email_unmatched') as n_emails, count(*) filter (where kind = 'inbound_email_matched') as n_matched, count(*) filter (where kind like 'submission_%') as n_outbound, arg_max(substr(kind, 12), (us, event_id)) filter (where kind like 'submission_%') as last_outbound,
count(distinct event_type || section) filter (where kind = 'section_classified') as n_sections, arg_max(event_type, (us, event_id)) filter (where kind = 'adjudication_run') as verdict,
count(*) filter (where kind in ('query_raised', 'ai_draft_created', 'claim_action_dispatched') and item is null) as n_malformed, count(*) filter (where kind in ('claim_harmonised', 'harmonisation_corrected', 'inbound_email_unmatched', 'rule_override', 'section_corrected', 'made_up')) as n_unknown
from log group by claim""")
def s2_dossier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A claim's events folded to one row; document events other than classified sections only raise the version."""
    return ds.dossier(claim_log(spark, sf_dir))


@plans.query(f"""with {LOG}, o as (select claim, case when kind like 'query%' then 'queries' when kind like 'ai_draft%' then 'drafts' else 'actions' end as list, item, kind in ('query_raised', 'ai_draft_created', 'claim_action_dispatched') as adds, us, event_id from log where {ITEMS_SQL} and item is not null),
w as (select *, max((us, event_id)) filter (where not adds) over (partition by claim, list, item) as gone from o) select claim, list, item, min(us) as opened_us from w where adds and (gone is null or (us, event_id) > gone) group by all""")
def s2_open_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Queries, drafts and actions of a claim that are still open, with the time they were added."""
    return ds.open_items(claim_log(spark, sf_dir))


def streamed(spark: SparkSession, sf_dir: str) -> str:
    """Folder of the tables that the log, read as a stream, was folded into."""
    root = f"{shared_dir(spark)}/granary/{uuid.uuid4().hex}/dossiers"
    dossiers.kept(as_claim_log(table_stream(spark, sf_dir, "events")), root).trigger(availableNow=True).start().awaitTermination()
    return root


@plans.query(plans.sql["s2_dossier"])
def s2_dossier_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The dossiers by a stream over the event files, with state per claim; equals the batch fold."""
    return dossiers.dossiers(spark, streamed(spark, sf_dir))


@plans.query(plans.sql["s2_open_items"])
def s2_open_items_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Open items by the same stream."""
    return dossiers.open_items(spark, streamed(spark, sf_dir))


# ---- rules

STAGE_RULES = [
    r.StageRule("lines", "submit", "n_lines", "GREATER_THAN_OR_EQUAL", (2,), "blocking", everywhere=True),
    r.StageRule("machinery", "submit", "approved", "GREATER_THAN_OR_EQUAL", (5000.0,), "blocking", (("kind", "MACHINERY"),)),
    r.StageRule("urgent_china", "submit", "queried", "EQUALS", (False,), "blocking", (("panel", "CHINA"), ("priority", "1-URGENT"))),
    r.StageRule("open_query", "submit", "queried", "EQUALS", (False,), "warning", everywhere=True),
    r.StageRule("large", "submit", "claimed", "LESS_THAN", (200000.0,), "warning", (("kind", "BUILDING"),), everywhere=True),
    r.StageRule("note", "submit", "status", "EQUALS", ("F",), "info", (("panel", "FRANCE"),)),
    r.StageRule("no_scope", "submit", "claimed", "LESS_THAN", (0.0,), "blocking"),
    r.StageRule("later", "discharge", "claimed", "LESS_THAN", (0.0,), "blocking", everywhere=True),
]


@plans.query(f"""with {CASES}, u as (select case_id, concat_ws(',', case when n_lines < 2 then 'lines' end, case when kind = 'MACHINERY' and approved < 5000 then 'machinery' end, case when panel = 'CHINA' and priority = '1-URGENT' and queried then 'urgent_china' end) as blocking,
concat_ws(',', case when queried then 'open_query' end, case when kind = 'BUILDING' and claimed >= 200000 then 'large' end) as warnings, case when panel = 'FRANCE' then 'note' else '' end as info from cases)
select case_id, greatest(0, 100 - 25 * len(list_filter(string_split(blocking, ','), lambda x: x <> '')) - 5 * len(list_filter(string_split(warnings, ','), lambda x: x <> '')))::bigint as score, blocking = '' as ready, blocking, warnings, info from u""")
def r9_stage_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requirements of one stage that come as data, each within its scope."""
    return r.stage_requirements(cases(spark, sf_dir), "case_id", STAGE_RULES, "submit")


IMPACT_RULES = [
    r.Rule("lines", "n_lines", "GREATER_THAN_OR_EQUAL", (2,), "CRITICAL"),
    r.Rule("share", "approved", "GREATER_THAN", (50000.0,), "HIGH", 0.3),
    r.Rule("status", "status", "NOT_EQUALS", ("P",), "MEDIUM"),
    r.Rule("open_query", "queried", "EQUALS", (False,), "CRITICAL"),
    r.Rule("unknown", "no_such_field", "EQUALS", (1,), "HIGH"),
]


@plans.query(f"""with {CASES}, s as (select case_id, case when n_lines >= 2 then 'PASS' else 'FAIL' end as a, case when n_lines / 7 < 0.3 then 'SKIP' when approved > 50000 then 'PASS' else 'FAIL' end as b, case when status <> 'P' then 'PASS' else 'FAIL' end as c, case when queried then 'FAIL' else 'PASS' end as d from cases)
select case_id, (a = 'PASS')::bigint + (b = 'PASS')::bigint + (c = 'PASS')::bigint + (d = 'PASS')::bigint as passed, (a = 'FAIL')::bigint + (b = 'FAIL')::bigint + (c = 'FAIL')::bigint + (d = 'FAIL')::bigint as failed, (b = 'SKIP')::bigint as skipped, 1::bigint as errored, (a = 'FAIL')::bigint as critical_failures,
100 - 25 * (a = 'FAIL')::bigint - 10 * (b = 'FAIL')::bigint - 5 * (c = 'FAIL')::bigint as score from s""")
def r8_impact_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts by state and a score that rules which only warn don't lower."""
    rows = cases(spark, sf_dir).withColumn("confidence", F.col("n_lines") / 7)
    return r.impact_summary(rows, "case_id", IMPACT_RULES, {"open_query"}, "confidence")


RESULTS = """res as (select case_id, kind as rule_id, case when queried then 'FAIL' else 'PASS' end as expected, case when n_lines = 0 then null when claimed < 50000 then 'SKIP' when approved < 0.6 * claimed then 'FAIL' else 'PASS' end as actual, kind = 'FURNITURE' as semantic, case when claimed > 0 then approved / claimed end as confidence from cases)"""


def results(spark: SparkSession, sf_dir: str) -> DataFrame:
    actual = F.when(F.col("n_lines") == 0, None).when(F.col("claimed") < 50000, "SKIP").when(F.col("approved") < 0.6 * F.col("claimed"), "FAIL").otherwise("PASS")
    return cases(spark, sf_dir).select("case_id", F.col("kind").alias("rule_id"), F.when(F.col("queried"), "FAIL").otherwise("PASS").alias("expected"), actual.alias("actual"), (F.col("kind") == "FURNITURE").alias("semantic"), F.when(F.col("claimed") > 0, F.col("approved") / F.col("claimed")).alias("confidence"))


@plans.query(f"""with {CASES}, {RESULTS}, t as (select *, semantic and actual is not null and actual = 'SKIP' as out, actual is not null and not (semantic and actual = 'SKIP') as ok from res)
select rule_id, count(*) filter (where ok) as scorable, count(*) filter (where ok and expected = actual) as correct, count(*) filter (where ok and expected = 'PASS' and actual = 'FAIL') as false_block, count(*) filter (where ok and expected = 'FAIL' and actual = 'PASS') as false_pass,
count(*) filter (where ok and actual = 'SKIP') as over_abstain, count(*) filter (where actual is null) as missing, count(*) filter (where out) as left_out from t group by rule_id""")
def e8_label_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels against results by rule: false blocks and passes, abstentions, what is missing or left out."""
    return r.label_scores(results(spark, sf_dir))


@plans.query(f"""with {CASES}, {RESULTS}, b as (select unnest([0.0, 0.5, 0.7, 0.9])::double as low), f as (select case when confidence >= 0.9 then 0.9 when confidence >= 0.7 then 0.7 when confidence >= 0.5 then 0.5 else 0.0 end::double as low, expected = actual as correct from res where actual is not null and confidence between 0 and 1 and not (semantic and actual = 'SKIP'))
select b.low, count(correct) as n, round(avg(correct::int), 6) as accuracy from b left join f on f.low = b.low group by b.low""")
def e8_confidence_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often results are right by their confidence."""
    scored = results(spark, sf_dir).where("actual is not null and not (semantic and actual = 'SKIP')")
    return r.confidence_bins(scored.select("confidence", (F.col("expected") == F.col("actual")).alias("correct")))


# ---- corrections

MODES, INSTRUCTIONS = ("AIR", "MAIL", "RAIL", "SHIP", "TRUCK", "FOB", "REG AIR"), ("NONE", "IN PERSON", "BACK", "COD")
SHIPPED = f"shipped as (select *, {list(MODES)}[l_partkey % 7 + 1] as l_shipmode, {list(INSTRUCTIONS)}[l_suppkey % 4 + 1] as l_shipinstruct from lineitem)"


def shipped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines with a mode and an instruction, which the table lacks."""
    pick = lambda values, key: F.get(F.array(*map(F.lit, values)), (F.col(key) % len(values)).cast("int"))
    return table(spark, sf_dir, "lineitem").select("*", pick(MODES, "l_partkey").alias("l_shipmode"), pick(INSTRUCTIONS, "l_suppkey").alias("l_shipinstruct"))


@plans.query(f"""with {SHIPPED}, c as (select l_shipinstruct as path, l_orderkey as claim, '"' || l_shipmode || '"' as before, case when l_tax < 0.03 then '"' || l_shipmode || '"' when l_tax < 0.06 then l_linenumber::varchar when l_tax < 0.07 then '"' || left(l_shipmode, 2) || '"' else '"other"' end as after from shipped),
s as (select path, claim, case when before = after then 'no_change' when left(after, 1) <> '"' then 'type_change' when length(after) < length(before) and contains(trim(before, '"'), trim(after, '"')) then 'truncation' else 'replacement' end as shape from c)
select path, shape, count(*) as n, count(distinct claim) as claims, round(least(0.95, 0.5 + count(*) / 20), 6) as confidence from s where shape <> 'no_change' group by all having count(distinct claim) >= 3""")
def m6_extraction_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields that people correct in the same way in three claims or more."""
    mode, tax = F.col("l_shipmode"), F.col("l_tax")
    quoted = lambda c: F.concat(F.lit('"'), c, F.lit('"'))
    after = F.when(tax < 0.03, quoted(mode)).when(tax < 0.06, F.col("l_linenumber").cast("string")).when(tax < 0.07, quoted(F.left(mode, F.lit(2)))).otherwise(F.lit('"other"'))
    told = shipped(spark, sf_dir).select(F.col("l_shipinstruct").alias("path"), F.col("l_orderkey").alias("claim"), shape_of_change(quoted(mode), after).alias("shape")).where("shape <> 'no_change'")
    found = told.groupBy("path", "shape").agg(F.count("*").alias("n"), F.count_distinct("claim").alias("claims")).where("claims >= 3")
    return found.withColumn("confidence", F.round(F.least(F.lit(0.95), 0.5 + F.col("n") / 20), 6))


# ---- values out of several sources


@plans.query("""with f as (select l_orderkey as claim, strftime(l_shipdate, '%Y-%m-%d') as value, case l_returnflag when 'A' then 0 when 'N' then 1 else 2 end as rank, round(1 - l_discount, 6) as score, l_linenumber * 1000000 + l_partkey as page, abs(l_shipdate::date - date '1995-06-17') > 730 as era from lineitem),
a as (select *, count(*) over (partition by claim, value) as agreeing, row_number() over (partition by claim order by rank, era, score desc, page) as k, min(value) over (partition by claim) <> max(value) over (partition by claim) as contested from f)
select claim, value, rank, page, round(least(1, score + least(0.1, 0.04 * (agreeing - 1))), 6) as confidence, contested from a where k = 1""")
def d19_era_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One date per claim by authority, then nearness to the episode, then score."""
    flag = F.col("l_returnflag")
    facts = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("claim"), F.date_format("l_shipdate", "yyyy-MM-dd").alias("value"), F.when(flag == "A", 0).when(flag == "N", 1).otherwise(2).alias("rank"), F.round(1 - F.col("l_discount"), 6).alias("score"),
        (F.col("l_linenumber") * 1_000_000 + F.col("l_partkey")).alias("page"), F.col("l_shipdate").cast("date").alias("day"), F.lit("1995-06-17").cast("date").alias("reference"),
    )
    return fu.fused(facts, ["claim"], "reference")


ROLES = {"AIR": "final", "MAIL": "interim", "RAIL": "fallback", "SHIP": "pharmacy", "TRUCK": "implant", "FOB": "subbill"}
ROLE_SQL = "case l_shipmode " + " ".join(f"when '{k}' then '{v}'" for k, v in ROLES.items()) + " end"


@plans.query(f"""with {SHIPPED}, b as (select l_orderkey as claim, {ROLE_SQL} as role, case when l_tax > 0.02 then l_extendedprice end as stated, case when l_tax < 0.06 then l_extendedprice - l_discount * 10000 end as line_sum from shipped),
u as (select *, coalesce(stated, line_sum) as worth, coalesce(role is not null and (role <> 'fallback' or stated is not null) and coalesce(stated, line_sum) is not null, false) as ok from b),
g as (select claim, max(worth) filter (where ok and role = 'final') as f, min(worth) filter (where ok and role = 'final') as f0, max(worth) filter (where ok and role = 'interim') as i, min(worth) filter (where ok and role = 'interim') as i0, max(worth) filter (where ok and role = 'fallback') as b, min(worth) filter (where ok and role = 'fallback') as b0,
  sum(worth) filter (where ok and role = 'pharmacy') as pharmacy, sum(worth) filter (where ok and role = 'implant') as implant, sum(worth) filter (where ok and role = 'subbill') as subbill, count(*) filter (where ok) as n_sources, coalesce(bool_or(ok and abs(stated - line_sum) > greatest(1, 0.01 * greatest(stated, line_sum))), false) as split from u group by claim),
h as (select *, coalesce(f, i, b) as hospital, case when f is not null then f0 when i is not null then i0 else b0 end as low from g)
select claim, round(hospital, 2) as hospital, round(pharmacy, 2) as pharmacy, round(implant, 2) as implant, round(subbill, 2) as subbill, round(coalesce(hospital, case when coalesce(pharmacy, implant, subbill) is not null then coalesce(pharmacy, 0) + coalesce(implant, 0) + coalesce(subbill, 0) end), 2) as total, n_sources,
case when n_sources = 0 then 'no_financial_data' when split or coalesce(hospital - low > greatest(1, 0.01 * hospital), false) then 'discrepancy' when n_sources = 1 then 'single_source' else 'reconciled' end as status from h""")
def d23_bill_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bills of a claim: final before interim before fallback, side bills added up, disagreements told."""
    role = F.create_map(*(F.lit(x) for pair in ROLES.items() for x in pair))
    price = F.col("l_extendedprice")
    bills = shipped(spark, sf_dir).select(F.col("l_orderkey").alias("claim"), F.try_element_at(role, F.col("l_shipmode")).alias("role"), F.when(F.col("l_tax") > 0.02, price).alias("stated"), F.when(F.col("l_tax") < 0.06, price - F.col("l_discount") * 10000).alias("line_sum"))
    return fu.reconciled_bills(bills, "claim")


SLOTS = {"handling": [("AIR", "instruct"), ("RAIL", "instruct"), ("SHIP", "flag")], "flag": [("TRUCK", "flag"), ("AIR", "flag")]}


@plans.query(f"""with {SHIPPED}, s as (select l_orderkey as claim, l_linenumber * 1000000 + l_partkey as section, l_shipmode, case when l_shipinstruct <> 'NONE' then l_shipinstruct else '' end as instruct, l_returnflag as flag, l_discount from shipped), x as (select distinct claim, section from s where l_discount > 0.08),
kept as (select o_orderkey as claim, 'flag' as slot, 'set' as value from orders where o_orderstatus = 'F'),
c as (select claim, section, instruct as value, 'handling' as slot, case l_shipmode when 'AIR' then 0 when 'RAIL' then 1 end as rank from s where l_shipmode in ('AIR', 'RAIL') union all select claim, section, flag, 'handling', 2 from s where l_shipmode = 'SHIP' union all select claim, section, flag, 'flag', case l_shipmode when 'TRUCK' then 0 else 1 end from s where l_shipmode in ('TRUCK', 'AIR')),
k as (select *, row_number() over (partition by claim, slot order by rank, section, value) as n from c where value <> '' and not exists (select 1 from x where x.claim = c.claim and x.section = c.section))
select claim, slot, value, null::bigint as section from kept union all select claim, slot, value, section::bigint from k where n = 1 and not exists (select 1 from kept where kept.claim = k.claim and kept.slot = k.slot)""")
def d26_filled_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slots of a claim filled from ranked sources, never from excluded ones, never over a value that is there."""
    lines = shipped(spark, sf_dir).select(F.col("l_orderkey").alias("claim"), (F.col("l_linenumber") * 1_000_000 + F.col("l_partkey")).cast("long").alias("section"), F.col("l_shipmode").alias("category"), F.when(F.col("l_shipinstruct") != "NONE", F.col("l_shipinstruct")).otherwise("").alias("instruct"), F.col("l_returnflag").alias("flag"), "l_discount")
    field = lambda name: F.struct(F.lit(name).alias("field"), F.col(name).alias("value"))
    facts = lines.select("claim", "section", "category", F.inline(F.array(field("instruct"), field("flag"))))
    existing = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("claim"), F.lit("flag").alias("slot"), F.lit("set").alias("value"))
    return fu.filled_slots(existing, facts, lines.where("l_discount > 0.08").select("claim", "section"), SLOTS)


# ---- sections of pages

PAGES = """p as (select doc_id, sha256(coalesce(text, ''))[1:2] as claim, 1 + length(coalesce(text, '')) % 2 as n, sha256(coalesce(text, ''))[1:62] || lpad(printf('%x', doc_id % 256), 2, '0') as h, sha256('d' || coalesce(text, ''))[1:63] || printf('%x', doc_id % 16) as g from documents)"""
FAR = " + ".join(f"bit_count(xor(('0x' || a.{{0}}[{i}:{i + 7}])::bigint, ('0x' || b.{{0}}[{i}:{i + 7}])::bigint))::bigint" for i in range(1, 65, 8))


@plans.query(f"""with recursive {PAGES}, pairs as (select a.doc_id as x, b.doc_id as y from p a join p b on a.claim = b.claim and a.n = b.n and a.doc_id <> b.doc_id and {FAR.format("h")} <= 16 and {FAR.format("g")} <= 16),
reach as (select x as node, y as other from pairs union select r.node, p.y from reach r join pairs p on p.x = r.other), m as (select node, min(other) as m from reach group by 1)
select doc_id as section, least(doc_id, coalesce(m, doc_id)) as first_section from p left join m on m.node = doc_id""")
def d3_section_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sections of a claim with equally many pages, each page near in both hashes, as transitive groups."""
    text = F.coalesce("text", F.lit(""))
    low = lambda digits: F.lpad(F.lower(F.hex(F.col("doc_id") % 16**digits)), digits, "0")
    h = F.concat(F.substring(F.sha2(text, 256), 1, 62), low(2))
    g = F.concat(F.substring(F.sha2(F.concat(F.lit("d"), text), 256), 1, 63), low(1))
    n = 1 + F.length(text) % 2
    sections = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("section"), F.substring(F.sha2(text, 256), 1, 2).alias("claim"), F.array_repeat(F.struct(h.alias("p"), g.alias("d")), n).alias("pages"))
    return sim.near_sections(stored(sections, "sections"), "claim")


# ---- entities


def _letters(key: Column) -> Column:
    return F.concat(F.lit("XQ"), F.lpad(key.cast("string"), 7, "0"))


@plans.query(check_digit_sql("""select o_orderkey, 'MPMC:K' || (10000 + o_orderkey % 80000) as registrations, case when valid then digits else '' end as national_ids, case when o_orderkey % 3 <> 2 then 'XQ' || lpad(o_orderkey::varchar, 7, '0') else '' end as scheme_ids,
case when o_orderkey % 4 <> 0 then '91' || lpad(o_orderkey::varchar, 12, '0') else '' end as health_ids, case when o_orderkey % 2 = 0 then '98' || lpad(o_orderkey::varchar, 8, '0') else '' end as mobiles, strftime(o_orderdate, '%Y-%m-%d') as days, round(o_totalprice, 2) as first_amount, 2 as n_amounts from ({checked}) join orders using (o_orderkey)"""))
def f6_letter_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts found in letters: registrations with their council, identities by check digit and nearby words, mobile numbers, dates, amounts."""
    key = F.col("o_orderkey")
    digits, national = F.lpad(key.cast("string"), 12, "0"), F.lpad((key * 7919 + 200_000_000_000).cast("string"), 12, "0")
    grouped = lambda c, *sizes: F.concat_ws("-", *(F.substring(c, 1 + sum(sizes[:i]), n) for i, n in enumerate(sizes)))
    scheme = F.when(key % 3 == 0, F.concat(F.lit("PMJAY card "), _letters(key))).when(key % 3 == 1, F.concat(F.lit("card "), _letters(key), F.lit(" of Ayushman Bharat"))).otherwise(F.concat(F.lit("card "), _letters(key)))
    health = F.concat(F.when(key % 4 != 0, "ABHA ").otherwise("No "), F.lit("91-"), grouped(digits, 4, 4, 4))
    mobile = F.when(key % 2 == 0, F.concat(F.lit("+91 98"), F.lpad(key.cast("string"), 8, "0"))).otherwise(F.concat(F.lit("12398"), F.lpad(key.cast("string"), 8, "0")))
    day = F.when(key % 3 == 0, F.date_format("o_orderdate", "yyyy-MM-dd")).when(key % 3 == 1, F.date_format("o_orderdate", "dd MMM yyyy")).otherwise(F.date_format("o_orderdate", "dd/MM/yyyy"))
    letter = F.concat_ws("; ", F.concat(F.lit("Dr A, M.P.M.C. Reg. No. K"), 10000 + key % 80000), F.concat(F.lit("id "), grouped(national, 4, 4, 4)), scheme, F.lit("." * 90), health, F.concat(F.lit("call "), mobile), F.concat(F.lit("on "), day), F.concat(F.lit("Rs. "), F.format_number("o_totalprice", 2)), F.lit("paid 1/-"))
    t = F.col("t")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate", "o_totalprice")
    spread = orders.repartition(4 * spark.sparkContext.defaultParallelism, "o_orderkey")  # a small file of many letters is one task otherwise
    told = spread.select("o_orderkey", letter.alias("t")).select("o_orderkey", *_facts(t))
    return told.withColumns({"first_amount": F.get("amounts", F.lit(0)), "n_amounts": F.size("amounts")}).drop("amounts")


def _facts(text: Column) -> list[Column]:
    return [F.array_join(c, ",").alias(name) for name, c in en.facts(text).items()] + [en.amounts(text).alias("amounts")]


@plans.query()
def f6_document_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same facts in every whole text of the documents; a null text has none."""
    told = table(spark, sf_dir, "documents").select("doc_id", *_facts(F.coalesce("text", F.lit(""))))
    return told.withColumn("amounts", F.array_join(F.transform("amounts", lambda a: F.format_string("%.2f", a)), ","))


@plans.query("""select o_orderkey, case o_orderkey % 5 when 0 then 'CLM-' || lpad(o_orderkey::varchar, 8, '0') when 4 then null else lpad(o_orderkey::varchar, 8, '0') end as claim_no, case when o_orderkey % 2 = 0 then '00000000-0000-4000-8000-' || lpad(o_orderkey::varchar, 12, '0') else 'ffffffff-0000-4000-8000-000000000000' end as uuid,
case when o_orderkey % 3 = 0 then 't' || lpad(o_orderkey::varchar, 12, '0') end as token from orders""")
def f10_message_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Claim numbers, identifiers and address tokens of messages."""
    key = F.col("o_orderkey")
    eight, twelve = F.lpad(key.cast("string"), 8, "0"), F.lpad(key.cast("string"), 12, "0")
    number = F.when(key % 5 == 0, F.concat(F.lit("re clm-"), eight)).when(key % 5 == 1, F.concat(F.lit("Claim # "), eight)).when(key % 5 == 2, F.concat(F.lit("CCN: "), eight)).when(key % 5 == 3, F.concat(F.lit("claim id : "), eight)).otherwise("no number")
    body = F.concat(F.upper(number), F.lit(" see FFFFFFFF-0000-4000-8000-000000000000"), F.when(key % 2 == 0, F.concat(F.lit(" Patient UHID 00000000-0000-4000-8000-"), twelve)).otherwise(""))
    to = F.array(F.lit("a@b.example"), F.when(key % 3 == 0, F.concat(F.lit("desk+T"), twelve, F.lit("@b.example"))).otherwise(F.lit("desk+x@b.example")))
    return table(spark, sf_dir, "orders").select("o_orderkey", en.claim_number(body).alias("claim_no"), en.patient_uuid(body).alias("uuid"), en.address_token(to).alias("token"))


@plans.query("""with d as (select *, round(o_totalprice)::bigint::varchar as a from orders) select o_orderkey, 'Claim ' || o_orderkey || ' of ' || o_clerk_name || ': ₹' || case when length(a) <= 3 then a when length(a) <= 5 then left(a, length(a) - 3) || ',' || right(a, 3) else left(a, length(a) - 5) || ',' || substr(a, length(a) - 4, 2) || ',' || right(a, 3) end || ', flags ' || o_orderstatus || ', ' || o_orderpriority || ' {x}' as text
from (select *, 'member ' || o_custkey as o_clerk_name from d)""")
def f14_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages rendered from a template with nested paths, an array, a currency and a field that is missing."""
    context = F.to_json(F.struct(F.col("o_orderkey").alias("id"), F.struct(F.concat(F.lit("member "), "o_custkey").alias("name")).alias("member"), F.col("o_totalprice").alias("amount_inr"), F.array(F.struct(F.array("o_orderstatus", "o_orderpriority").alias("flags"))).alias("list")))
    text = en.rendered("Claim {{id}} of {{ member.name }}: {{amount_inr}}, flags {{list[0].flags}}{{member.none}} {x}", context, ("amount_inr",))
    return table(spark, sf_dir, "orders").select("o_orderkey", text.alias("text"))
