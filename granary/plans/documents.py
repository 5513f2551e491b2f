"""Queries over free JSON: paths, setting, merging, deep comparison (B17, B18, F12, F24), and rules over documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.functions import json_values as jv
from granary.operators import rule_logic as rl
from granary.operators.cases import cases
from granary.plans.base import CASES, Plans
from granary.sources.tables import table

plans = Plans()

NOTE = """'{"k":' || k || ',"who":{"name":"' || event_type || '","tags":[' || k % 3 || ',"' || event_type || '",null]},"x":1.50}'"""
NOTES = f"n as (select event_id, event_type, k, {NOTE} as note from (select *, json_extract_string(props, '$.k')::int as k from events))"


def notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(event_id, event_type, k, note): a nested JSON text made of each event."""
    k = F.get_json_object("props", "$.k").cast("int")
    note = F.concat(F.lit('{"k":'), k, F.lit(',"who":{"name":"'), "event_type", F.lit('","tags":['), k % 3, F.lit(',"'), "event_type", F.lit('",null]},"x":1.50}'))
    return table(spark, sf_dir, "events").select("event_id", "event_type", k.alias("k"), note.alias("note"))


@plans.query("""with l as (select l_orderkey, l_linenumber, l_returnflag, l_quantity::bigint as q from lineitem)
select l_orderkey, string_agg(l_returnflag, ',' order by l_linenumber, l_returnflag, q) as flags, string_agg(q::varchar, ',' order by l_linenumber, l_returnflag, q) as quantities, arg_min(q, (l_linenumber, l_returnflag, q))::varchar as first_quantity, count(*) as n_values from l group by l_orderkey""")
def b17_wildcard_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All values at paths with wildcards, of a document per order."""
    line = F.struct("l_linenumber", F.struct(F.col("l_returnflag").alias("flag")).alias("f"), F.col("l_quantity").cast("long").alias("q"))
    docs = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.to_json(F.struct(F.array_sort(F.collect_list(line)).alias("lines"))).alias("doc"))  # seven lines an order at most
    doc = F.try_parse_json("doc")
    joined = lambda path: F.array_join(F.transform(jv.values_at(doc, path), jv.text_of), ",")
    return docs.select("l_orderkey", joined("$.lines[*].f.*").alias("flags"), joined("$['lines'][*].q").alias("quantities"), joined("$.lines[0].q").alias("first_quantity"), F.size(jv.values_at(doc, "$.lines[*].q")).cast("long").alias("n_values"))


@plans.query(f"""with {NOTES} select event_id, k % 3 as tag, '{{"k":' || k || ',"who":{{"name":"' || event_type || '","tags":[' || k % 3 || ',{{"seen":true}},null]}},"x":1.5}}' as patched, '{{"k":' || k || ',"new":[null,null,' || k || '],"who":{{"name":"' || event_type || '","tags":[' || k % 3 || ',"' || event_type || '",null]}},"x":1.5}}' as grown from n""")
def b18_free_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values read and set at nested paths and places of free JSON; everything else stays, missing parents are made."""
    note = F.col("note")
    patched = jv.with_value(note, "$.who.tags[1]", F.lit('{"seen":true}'))
    grown = jv.with_value(note, "$.new[2]", F.col("k").cast("string"))
    return notes(spark, sf_dir).select("event_id", F.try_variant_get(jv.read_path(F.try_parse_json(note), "who.tags.0"), "$", "int").alias("tag"), jv.canonical(patched).alias("patched"), jv.canonical(grown).alias("grown"))


@plans.query(f"""with {NOTES} select event_id, '{{"k":' || k || ',"who":"' || event_type || '","x":1.5,"y":{{"z":[1]}}}}' as merged, '[1,' || k || ',"a"]' as listed from n""")
def f12_free_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Objects merged, the second's keys over the first's and all others kept; arrays joined."""
    over = F.concat(F.lit('{"y":{"z":[1]},"who":"'), "event_type", F.lit('"}'))
    return notes(spark, sf_dir).select("event_id", jv.canonical(jv.merged(F.col("note"), over)).alias("merged"), jv.merged(F.concat(F.lit("[1,"), "k", F.lit("]")), F.lit('["a"]')).alias("listed"))


@plans.query("select event_id, event_id % 8 in (0, 1, 7) as same, event_type as name from events")
def f24_deep_equality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Payloads with other key orders, number forms, element orders, kinds, missing and additional keys, compared deeply."""
    kind = F.col("event_type")
    text = lambda *parts: F.concat(*(kind if p is None else F.lit(p) for p in parts))
    one = text('{"a":[1,{"n":"', None, '","m":null}],"b":{"x":2,"y":3}}')
    others: list[Column] = [
        text('{"b":{"y":3,"x":2},"a":[1,{"m":null,"n":"', None, '"}]}'), text('{"a":[1.0,{"n":"', None, '","m":null}],"b":{"x":2.00,"y":3}}'), text('{"a":[{"n":"', None, '","m":null},1],"b":{"x":2,"y":3}}'), text('{"a":["1",{"n":"', None, '","m":null}],"b":{"x":2,"y":3}}'),
        text('{"a":[1,{"n":"', None, '"}],"b":{"x":2,"y":3}}'), text('{"a":[1,{"n":"', None, '","m":null}],"b":{"x":2,"y":3},"c":0}'), text('{"a":[1,{"n":"', None, '","m":null}],"b":{"x":2,"y":true}}'), one,
    ]
    two = F.get(F.array(*others), (F.col("event_id") % 8).cast("int"))
    return table(spark, sf_dir, "events").select("event_id", jv.same_json(one, two).alias("same"), jv.text_of(jv.read_path(F.try_parse_json(two), "a.1.n")).alias("found"), kind.alias("kind")).select("event_id", "same", F.when(F.col("event_id") % 8 == 2, F.col("kind")).otherwise(F.col("found")).alias("name"))


# ---- rules over documents

DOCUMENT_RULES = [
    {"rule_id": "status", "logic": {"logic_type": "SIMPLE_COMPARISON", "json_path": "$.meta.status", "operator": "EQUALS", "expected_value": "F"}},
    {"rule_id": "lines", "logic": {"logic_type": "RANGE_CHECK", "json_path": "$.bill.lines", "operator": "BETWEEN", "expected_value": [2, 5]}},
    {"rule_id": "kind", "logic": {"logic_type": "PATTERN_MATCH", "json_path": "$.meta.kind", "operator": "MATCHES_PATTERN", "expected_value": "^[A-H]"}},
    {"rule_id": "tags", "logic": {"logic_type": "EXISTENCE_CHECK", "json_path": "$.tags[*].name"}},
    {"rule_id": "share", "logic": {"logic_type": "CALCULATION", "calculation_formula": "(claimed - approved) / claimed", "fields": {"claimed": "$.bill.claimed", "approved": "$.bill.approved"}, "operator": "LESS_THAN_OR_EQUAL", "expected_value": 0.3}},
    {"rule_id": "panel", "logic": {"logic_type": "LOOKUP_TABLE", "json_path": "$.meta.panel", "lookup_table_ref": "panels"}},
    {"rule_id": "tree", "logic": {"logic_type": "ALL", "rules": [
        {"logic_type": "ANY", "rules": [{"logic_type": "SIMPLE_COMPARISON", "json_path": "$.meta.status", "operator": "IN", "expected_value": ["F", "P"]}, {"logic_type": "LOOKUP_TABLE", "json_path": "$.meta.panel", "lookup_table_ref": "panels"}]},
        {"logic_type": "NOT", "rules": [{"logic_type": "EXISTENCE_CHECK", "json_path": "$.tags[*]"}]}]}},
    {"rule_id": "no_table", "logic": {"logic_type": "LOOKUP_TABLE", "json_path": "$.meta.panel", "lookup_table_ref": "none"}},
    {"rule_id": "no_function", "logic": {"logic_type": "CUSTOM", "custom_function": "none"}},
    {"rule_id": "no_kind", "logic": {"logic_type": "GUESS"}},
]


@plans.query(f"""with {CASES}, p as (select n_name from nation where n_regionkey = 2), d as (select *, panel in (select n_name from p) as listed from cases)
select case_id, unnest(['status', 'lines', 'kind', 'tags', 'share', 'panel', 'tree', 'no_table', 'no_function', 'no_kind']) as rule_id, unnest([case when status = 'F' then 'PASS' else 'FAIL' end, case when n_lines between 2 and 5 then 'PASS' else 'FAIL' end, case when kind < 'I' then 'PASS' else 'FAIL' end, case when queried then 'PASS' else 'FAIL' end,
  case when claimed = 0 then 'ERROR' when (claimed - approved) / claimed <= 0.3 then 'PASS' else 'FAIL' end, case when listed then 'PASS' else 'FAIL' end, case when (status in ('F', 'P') or listed) and not queried then 'PASS' else 'FAIL' end, 'ERROR', 'ERROR', 'ERROR']) as status from d""")
def r7_document_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All kinds of rules, a nested tree, a table to look up, and rules that can't be evaluated, over a JSON document per case."""
    tags = F.when(F.col("queried"), F.array(F.struct(F.lit("open_query").alias("name")))).otherwise(F.array())
    doc = F.to_json(F.struct(F.struct("status", "kind", "panel").alias("meta"), F.struct(F.col("n_lines").alias("lines"), "claimed", "approved").alias("bill"), tags.alias("tags")))
    panels = table(spark, sf_dir, "nation").where("n_regionkey = 2").select(F.col("n_name").alias("code"))
    found = rl.evaluated(cases(spark, sf_dir).select("case_id", doc.alias("doc")), "case_id", "doc", DOCUMENT_RULES, {"panels": panels}, rl.EPISODE_FUNCTIONS)
    return found.select("case_id", "rule_id", "status")


@plans.query("""with e as (select o_orderkey, any_value(o_orderpriority) in ('1-URGENT', '2-HIGH') as managed, bool_or(l_discount > 0.05 and l_tax > 0.04) as raised, coalesce(sum(case when l_linestatus = 'F' then l_linenumber else l_linenumber / 24.0 end) filter (where l_returnflag = 'R'), 0) as days,
  coalesce(sum(l_linenumber % 3) filter (where l_returnflag = 'R'), 0) as notes, bool_or(l_tax > 0.05 and l_linenumber % 3 > 0) as progress from orders join lineitem on l_orderkey = o_orderkey group by o_orderkey)
select o_orderkey, case when o_orderkey % 3 = 2 then 'SKIP' when raised then 'PASS' else 'FAIL' end as enzymes, case when not managed or days <= 0 then 'SKIP' when days <= 3 or notes >= 3 then 'PASS' else 'FAIL' end as icu, case when o_orderkey % 2 = 1 then 'SKIP' when o_orderkey % 5 = 0 and progress then 'PASS' else 'FAIL' end as physiotherapy from e""")
def r10_episode_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rule functions over episode documents: raised enzymes, notes of long intensive care, prescribed physiotherapy."""
    key, facts = F.col("o_orderkey"), F.struct("l_linenumber", "l_discount", "l_tax", "l_returnflag", "l_linestatus")

    def phase(fact: Column) -> Column:
        line = fact["l_linenumber"]
        notes = F.slice(F.array_repeat(F.when(fact["l_tax"] > 0.05, "Physio session").otherwise("stable"), 3), 1, (line % 3).cast("int"))
        test = F.struct(F.struct(F.when(fact["l_discount"] > 0.05, "Troponin I").otherwise("CBC").alias("test_name")).alias("diagnostic_meta"), F.when(fact["l_tax"] > 0.04, "high").otherwise("normal").alias("flag"))
        return F.struct(line.alias("n"), F.when(fact["l_returnflag"] == "R", "ICU_STAY").otherwise("WARD").alias("phase_code"), F.struct(line.alias("value"), F.when(fact["l_linestatus"] == "F", "DAYS").otherwise("HOURS").alias("unit")).alias("duration"), notes.alias("daily_progress"), F.array(test).alias("diagnostics_performed"))

    # Facts of lines are gathered (seven an order at most); phases are made of them after the shuffle and the join.
    lines = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.collect_list(facts).alias("facts"))
    timeline = F.sort_array(F.transform("facts", phase)).alias("clinical_timeline")
    kind = F.when(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH"), "medical_management").otherwise("SURGERY")
    diagnosis = F.struct(F.struct(F.when(key % 3 == 0, "I21.4").otherwise("J18").alias("icd_code"), F.when(key % 3 == 1, "Unstable angina").otherwise("other").alias("diagnosis_name")).alias("primary_diagnosis"))
    items = F.struct(F.array(F.struct(F.when(key % 2 == 0, "Physiotherapy").otherwise("Bed").alias("description"))).alias("line_items"))
    doc = F.to_json(F.struct(F.struct(kind.alias("episode_type")).alias("meta"), diagnosis.alias("diagnosis"), timeline, items.alias("financial_summary"), F.when(key % 5 == 0, "needs physio").otherwise("rest").alias("treatment_plan")))
    docs = table(spark, sf_dir, "orders").join(lines, "o_orderkey").select("o_orderkey", F.try_parse_json(doc).alias("doc"))
    return docs.select("o_orderkey", rl.cardiac_enzymes(F.col("doc")).alias("enzymes"), rl.icu_stay(F.col("doc")).alias("icu"), rl.physiotherapy(F.col("doc")).alias("physiotherapy"))
