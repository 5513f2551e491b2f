"""Rules over JSON documents, compiled from data: eight kinds of leaves, trees of them, tables to look up, functions by name.

A rule is a dict with ``rule_id`` and ``logic``; logic has a ``logic_type``:

* SIMPLE_COMPARISON, RANGE_CHECK, PATTERN_MATCH: the value at ``json_path`` against
  ``expected_value`` by ``operator``
* EXISTENCE_CHECK: the list of all values at ``json_path`` (EXISTS if none is given)
* CALCULATION: ``calculation_formula`` over ``fields`` (name to path), then ``operator``
* LOOKUP_TABLE: whether the value is a code of the table ``lookup_table_ref``
* CUSTOM, COMPLEX_CONDITION: a function by name
* ALL, ANY, NOT: trees over ``rules``

Each rule gives PASS, FAIL, SKIP or ERROR with its evidence as JSON.  Unknown kinds,
tables, functions and names in formulas, and formulas without a value, are ERROR rows, never
exceptions.  ALL fails with any failure, else errs with any error, and passes if not
all were skipped; ANY mirrors it; NOT swaps PASS and FAIL.  All is one projection of
the documents and a left join per lookup table, whose codes are made distinct first.
A null or broken document has no values.
"""

from __future__ import annotations

import ast
import json
import operator
import re
from collections.abc import Callable, Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granary.functions import json_values as jv
from granary.functions.scalars import let
from granary.operators.relational import holds

PASS, FAIL, SKIP, ERROR = "PASS", "FAIL", "SKIP", "ERROR"
DOC = "rule_logic:doc"


def single(values: Column) -> Column:
    """The value itself where there is one, null for none, all as an array for more."""
    return let(values, lambda vs: F.when(F.size(vs) == 1, F.get(vs, F.lit(0))).when(F.size(vs) > 1, F.parse_json(F.to_json(vs))))


def number(value: Column) -> Column:
    return F.try_variant_get(value, "$", "double")


def compared(op: str | None, value: Column, wanted) -> Column:
    """Whether a JSON value (null: missing) stands to a Python value as the operator says; never null; unknown operators are false."""
    text = F.to_json(value)
    same = lambda w: holds(text == F.to_json(jv.literal(w)))
    listed = list(wanted) if isinstance(wanted, list | tuple) else None
    inside = let(text, lambda t: reduce(lambda a, b: a | b, (holds(t == F.to_json(jv.literal(w))) for w in listed or []), F.lit(False)))
    size = lambda test: holds(test) if isinstance(wanted, int | float) else F.lit(False)
    pair = listed is not None and len(listed) == 2 and all(isinstance(w, int | float) for w in listed)
    elements = F.try_variant_get(value, "$", "array<variant>")
    has = F.coalesce(F.exists(elements, lambda v: holds(F.to_json(v) == F.to_json(jv.literal(wanted)))), F.contains(F.when(F.schema_of_variant(value) == "STRING", jv.text_of(value)), F.lit(str(wanted))))
    empty = value.isNull() | F.is_variant_null(value) | F.coalesce(F.size(elements) == 0, F.lit(False))
    forms: Mapping[str, Callable[[], Column]] = {
        "EQUALS": lambda: same(wanted), "NOT_EQUALS": lambda: ~same(wanted), "GREATER_THAN": lambda: size(number(value) > wanted), "LESS_THAN": lambda: size(number(value) < wanted), "GREATER_THAN_OR_EQUAL": lambda: size(number(value) >= wanted), "LESS_THAN_OR_EQUAL": lambda: size(number(value) <= wanted),
        "BETWEEN": lambda: let(number(value), lambda n: holds(n.between(*listed))) if pair else F.lit(False), "NOT_BETWEEN": lambda: let(number(value), lambda n: holds(~n.between(*listed))) if pair else F.lit(False), "IN": lambda: inside, "NOT_IN": lambda: ~inside if listed is not None else F.lit(False),
        "EXISTS": lambda: ~empty, "NOT_EXISTS": lambda: empty, "CONTAINS": lambda: holds(has), "NOT_CONTAINS": lambda: holds(~has), "MATCHES_PATTERN": lambda: F.coalesce(jv.text_of(value), F.lit("")).rlike(str(wanted)) if valid_pattern(str(wanted)) else F.lit(False),
    }
    return forms[op]() if op in forms else F.lit(False)


def valid_pattern(pattern: str) -> bool:
    try:
        return bool(re.compile(pattern))
    except re.error:
        return False


def told(status: Column | str, evidence: Column) -> Column:
    return F.struct((F.lit(status) if isinstance(status, str) else status).alias("status"), evidence.alias("evidence"))


def wrong(reason: str) -> Column:
    return told(ERROR, F.lit(json.dumps({"reason": reason})))


def verdict(passed: Column) -> Column:
    return F.when(passed, PASS).otherwise(FAIL)


def combined(kind: str, statuses: Column) -> Column:
    """One status of an array of them: see the module's text."""
    any_is = lambda s: F.array_contains(statuses, s)
    decides, rest = (FAIL, PASS) if kind == "ALL" else (PASS, FAIL)
    return F.when(any_is(decides), decides).when(any_is(ERROR), ERROR).when(any_is(rest), rest).otherwise(SKIP)


class Compiler:
    """Turns logic into columns over a parsed document and the lookup hits that were joined to it.

    What is read more than once (a value, the parts of a tree) is made once by ``let``.
    """

    def __init__(self, functions: Mapping[str, Callable[[Column], Column]], hits: Mapping[str, Column], doc: Column) -> None:
        self.functions, self.hits, self.doc = functions, hits, doc

    def compiled(self, logic: dict) -> Column:
        """struct<status, evidence> of a rule's logic."""
        kind, path, op, wanted = str(logic.get("logic_type", "")).upper(), logic.get("json_path"), logic.get("operator"), logic.get("expected_value")
        if kind in ("ALL", "ANY", "NOT"):
            parts = [self.compiled(x) for x in logic.get("rules", [])]
            if not parts or kind == "NOT" and len(parts) > 1:
                return wrong(f"{kind} of {len(parts)} rules")
            turned = lambda s: F.when(s == PASS, FAIL).when(s == FAIL, PASS).otherwise(s)
            status = lambda states: turned(F.get(states, F.lit(0))) if kind == "NOT" else combined(kind, states)
            return let(F.array(*(p["status"] for p in parts)), lambda states: told(status(states), F.to_json(F.struct(F.lit(kind).alias("tree"), states.alias("parts")))))
        if kind in ("CUSTOM", "COMPLEX_CONDITION"):
            name = logic.get("custom_function")
            return told(self.functions[name](self.doc), F.lit(json.dumps({"function": name}))) if name in self.functions else wrong(f"no function {name}")
        if kind == "CALCULATION":
            return self.calculated(logic)
        if kind not in ("SIMPLE_COMPARISON", "RANGE_CHECK", "PATTERN_MATCH", "EXISTENCE_CHECK", "LOOKUP_TABLE"):
            return wrong(f"unknown kind {kind}")
        try:
            values = jv.values_at(self.doc, path) if path else F.array().cast("array<variant>")
        except ValueError as error:
            return wrong(str(error))
        if kind == "EXISTENCE_CHECK":

            def existing(vs: Column) -> Column:
                n = F.size(vs)
                passed = {"EXISTS": n > 0, "NOT_EXISTS": n == 0}.get(op or "EXISTS")
                return told(verdict(let(F.parse_json(F.to_json(vs)), lambda v: compared(op, v, wanted)) if passed is None else passed), F.to_json(F.struct(n.alias("matches"))))

            return let(values, existing)
        evidence = lambda actual: F.to_json(F.struct(F.to_json(actual).alias("actual")))
        if kind == "LOOKUP_TABLE":
            ref = logic.get("lookup_table_ref")
            return told(verdict(self.hits[lookup_key(logic)]), evidence(single(values))) if lookup_key(logic) in self.hits else wrong(f"no table {ref}")
        return let(single(values), lambda actual: told(verdict(compared(op, actual, wanted)), evidence(actual)))

    def calculated(self, logic: dict) -> Column:
        formula, fields = str(logic.get("calculation_formula", "")), logic.get("fields", {})
        try:
            paths = {name: number(single(jv.values_at(self.doc, path))) for name, path in fields.items()}
            value = formula_value(formula, paths)
        except ValueError as error:
            return wrong(str(error))
        passed = lambda v: let(F.try_parse_json(v.cast("string")), lambda x: compared(logic.get("operator", "LESS_THAN_OR_EQUAL"), x, logic.get("expected_value")))
        return let(value, lambda v: told(F.when(v.isNull(), ERROR).otherwise(verdict(passed(v))), F.to_json(F.struct(v.alias("value")))))


def formula_value(formula: str, fields: Mapping[str, Column]) -> Column:
    """Arithmetic (+ - * / and brackets) over named columns; null where a part is null or divided by zero; ValueError for anything else.

    Python's own reader of expressions does the reading.
    """
    kinds = {ast.Add: operator.add, ast.Sub: operator.sub, ast.Mult: operator.mul, ast.Div: F.try_divide}

    def made(node: ast.AST) -> Column:
        if isinstance(node, ast.BinOp) and type(node.op) in kinds:
            return kinds[type(node.op)](made(node.left), made(node.right))
        if isinstance(node, ast.UnaryOp) and isinstance(node.op, ast.USub):
            return -made(node.operand)
        if isinstance(node, ast.Name) and node.id in fields:
            return fields[node.id]
        if isinstance(node, ast.Constant) and type(node.value) in (int, float):
            return F.lit(float(node.value))
        raise ValueError(f"not allowed in a formula: {formula!r}")

    try:
        return made(ast.parse(formula.strip(), mode="eval").body)
    except SyntaxError:
        raise ValueError(f"not a formula: {formula!r}") from None


def lookup_key(logic: dict) -> str:
    return f"{logic.get('lookup_table_ref')}|{logic.get('json_path')}"


def lookups_of(logic: dict) -> list[dict]:
    own = [logic] if str(logic.get("logic_type", "")).upper() == "LOOKUP_TABLE" else []
    return own + [x for part in logic.get("rules", []) for x in lookups_of(part)]


def evaluated(docs: DataFrame, key: str, doc: str, rules: list[dict], tables: Mapping[str, DataFrame] | None = None, functions: Mapping[str, Callable[[Column], Column]] | None = None) -> DataFrame:
    """(key, rule_id, status, evidence): a row per document and rule; ``tables`` have a column ``code``."""
    rows = docs.select(F.col(key).alias("rule_logic:key"), F.col(doc).alias(DOC))
    hits: dict[str, Column] = {}
    for logic in (x for rule in rules for x in lookups_of(rule["logic"])):
        ref, name = logic.get("lookup_table_ref"), lookup_key(logic)
        if name in hits or ref not in (tables or {}):
            continue
        code, hit = f"rule_logic:code{len(hits)}", f"rule_logic:hit{len(hits)}"
        try:
            value = jv.text_of(single(jv.values_at(F.try_parse_json(F.col(f"`{DOC}`")), logic["json_path"])))
        except (KeyError, ValueError):
            continue
        known = tables[ref].where("code is not null").select(F.col("code").cast("string").alias(code)).distinct().withColumn(hit, F.lit(True))
        rows = rows.withColumn("rule_logic:value", value).join(known, F.col("`rule_logic:value`") == F.col(f"`{code}`"), "left").drop("rule_logic:value", code)
        hits[name] = F.coalesce(F.col(f"`{hit}`"), F.lit(False))

    def told_of(parsed: Column) -> Column:
        compiler = Compiler(functions or {}, hits, parsed)
        return F.array(*(F.struct(F.lit(r["rule_id"]).alias("rule_id"), compiler.compiled(r["logic"]).alias("t")) for r in rules))

    made = let(F.try_parse_json(F.col(f"`{DOC}`")), told_of)  # parsed once for all rules
    return rows.select(F.col("`rule_logic:key`").alias(key), F.inline(made)).select(key, "rule_id", "t.status", "t.evidence")


# ---- functions over an episode document

# Codes and words of an acute coronary syndrome, of its enzymes and of raised results.
CORONARY_CODES, CORONARY_WORDS = ("I20", "I21", "I22", "I23", "I24", "I25"), ("ACS", "ACUTE CORONARY", "STEMI", "UNSTABLE ANGINA")
ENZYMES, RAISED = ("TROPONIN", "CKMB", "CK-MB", "CK MB"), ("HIGH", "ELEVATED", "CRITICAL", "POSITIVE")
# Days of intensive care that need no notes, notes that longer care needs.
FREE_ICU_DAYS, LEAST_NOTES = 3, 3


# What the functions read of a phase and of a test; anything of another type counts as missing.
TEST = "struct<diagnostic_meta:struct<test_name_normalized:string,test_name:string,reference_range_high:double>,result_flag:string,flag:string,interpretation:string,numeric_value:double,value:double,reference_range_high:double>"
PHASE = "struct<phase_code:string,room_category:string,duration:struct<unit:string,value:double>,days:double,daily_progress:variant>"


def _upper(*texts: Column) -> Column:
    """Upper-case text of the first of some that is there, else empty."""
    return F.upper(F.coalesce(*texts, F.lit("")))


def _text(value: Column, *paths: str) -> Column:
    """``_upper`` of the values at some paths."""
    return _upper(*(jv.read_path(value, p, "string") for p in paths))


def _any(text: Column, words) -> Column:
    return text.rlike("|".join(map(re.escape, words)))


def cardiac_enzymes(doc: Column) -> Column:
    """An acute coronary syndrome needs enzyme tests, one of them raised by its flag or above its range; else SKIP."""
    code, name = _text(doc, "diagnosis.primary_diagnosis.icd_code"), _text(doc, "diagnosis.primary_diagnosis.diagnosis_name")
    coronary = F.substring(code, 1, 3).isin(*CORONARY_CODES) | _any(name, CORONARY_WORDS)
    enzyme = lambda t: _any(_upper(t["diagnostic_meta"]["test_name_normalized"]), ENZYMES) | _any(_upper(t["diagnostic_meta"]["test_name"]), ENZYMES)
    above = lambda t: holds(F.coalesce(t["numeric_value"], t["value"]) > F.coalesce(t["reference_range_high"], t["diagnostic_meta"]["reference_range_high"]))
    high = lambda t: _any(_upper(t["result_flag"], t["flag"], t["interpretation"]), RAISED) | above(t)
    tests = jv.values_at(doc, "$.clinical_timeline[*].diagnostics_performed[*]", TEST)
    return F.when(~coronary, SKIP).otherwise(verdict(F.exists(tests, lambda t: enzyme(t) & high(t))))


def icu_stay(doc: Column) -> Column:
    """Medical management with more than three days of intensive care needs three progress notes there; SKIP without such a stay."""
    room = lambda p: F.contains(_upper(p["phase_code"]), F.lit("ICU")) | (_upper(p["room_category"]) == "ICU")
    unit, value = lambda p: _upper(p["duration"]["unit"]), lambda p: p["duration"]["value"]
    length = lambda p: F.coalesce(F.when(unit(p) == "HOURS", value(p) / 24).when(unit(p) == "DAYS", value(p)), p["days"], F.lit(0.0))
    managed = _text(doc, "meta.episode_type") == "MEDICAL_MANAGEMENT"

    def judged(phases: Column) -> Column:
        total = F.aggregate(phases, F.lit(0.0), lambda s, p: s + length(p))
        notes = F.aggregate(phases, F.lit(0), lambda s, p: s + F.size(jv.values_at(p["daily_progress"], "$[*]", "string")))
        return let(total, lambda t: F.when(t <= 0, SKIP).otherwise(verdict((t <= FREE_ICU_DAYS) | (notes >= LEAST_NOTES))))

    return F.when(~managed, SKIP).otherwise(let(F.filter(jv.values_at(doc, "$.clinical_timeline[*]", PHASE), room), judged))


def physiotherapy(doc: Column) -> Column:
    """A physiotherapy charge needs a prescription and progress notes that name it; SKIP without a charge."""
    named = lambda text: F.contains(_upper(text), F.lit("PHYSIO"))
    charge = F.exists(jv.values_at(doc, "$.financial_summary.line_items[*]", "struct<description:string,name:string>"), lambda v: named(F.coalesce(v["description"], v["name"]))) | holds(jv.read_path(doc, "financial_summary.breakdown.physiotherapy_charges.total", "double") > 0)
    ordered = F.exists(jv.values_at(doc, "$.discharge_medications[*]", "struct<name:string,drug:string,description:string>"), lambda v: named(F.coalesce(v["name"], v["drug"], v["description"]))) | named(jv.read_path(doc, "treatment_plan", "string"))
    return F.when(~charge, SKIP).otherwise(verdict(ordered & F.exists(jv.values_at(doc, "$.clinical_timeline[*].daily_progress[*]", "string"), named)))


EPISODE_FUNCTIONS: Mapping[str, Callable[[Column], Column]] = {
    "validate_cardiac_enzymes_for_acs": cardiac_enzymes,
    "validate_icu_stay_cardiac_medical_mgmt": icu_stay,
    "validate_physiotherapy_prescription": physiotherapy,
}
