"""Claim-domain operators: conditions and rule functions by name, identity checks, disambiguation, correction shapes."""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from granary.functions.scalars import name_tokens
from granary.operators.ordered import running
from granary.operators.relational import first_per

# Mean radius of the earth in km.
EARTH_KM = 6371.0


# ---- conditions (docs: array, outcomes: array in order, stages: map of stage to hours)


def in_order(found: Column, wanted: list[str]) -> Column:
    """Whether the wanted values occur in an array in this order, with anything between."""
    reached = F.aggregate(found, F.lit(0), lambda k, x: F.when(x == F.get(F.array(*map(F.lit, wanted)), k), k + 1).otherwise(k))
    return reached == len(wanted)


CONDITIONS: Mapping[str, Callable[[dict], Column]] = {
    "doc_missing": lambda c: ~F.array_contains("docs", c["doc"]),
    "doc_present": lambda c: F.array_contains("docs", c["doc"]),
    "amount_in_range": lambda c: F.col("amount").between(c["low"], c["high"]),
    "past_outcome_seq": lambda c: in_order(F.col("outcomes"), c["sequence"]),
    "stage_dwell": lambda c: F.coalesce(F.try_element_at("stages", F.lit(c["stage"])) >= c["hours"], F.lit(False)),
}


def condition(spec: dict) -> Column:
    """A condition as a boolean column; one of unknown kind is skipped (null)."""
    made = CONDITIONS.get(spec["kind"])
    return made(spec) if made else F.lit(None).cast("boolean")


# ---- rule functions by name, and calculations


def _verdict(bad: Column, known: Column, level: str = "FAIL") -> Column:
    return F.when(~F.coalesce(known, F.lit(False)), "SKIP").when(bad, level).otherwise("PASS")


RULE_FUNCTIONS: Mapping[str, Callable[[dict], Column]] = {
    "validate_los_against_benchmark": lambda p: _verdict(F.abs(F.col("days") - F.col("benchmark_days")) > p.get("tolerance", 2), F.col("benchmark_days").isNotNull()),
    "validate_package_cap": lambda p: _verdict(F.col("claimed") > F.col("cap") * p.get("factor", 1.0), F.col("cap").isNotNull()),
    "validate_icu_stay": lambda p: _verdict(F.col("icu_days") > F.col("days"), F.col("icu_days").isNotNull()),
    "require_cardiac_enzymes": lambda p: _verdict(~F.array_contains("tests", p.get("test", "troponin")), F.col("specialty") == "cardiology"),
    "limit_physiotherapy": lambda p: _verdict(F.col("sessions") > p.get("most", 10), F.col("sessions").isNotNull(), "WARNING"),
    "check_room_eligibility": lambda p: _verdict(F.col("room_rate") > F.col("insured") * p.get("share", 0.01), F.col("room_rate").isNotNull()),
    "check_pre_existing": lambda p: _verdict(F.col("policy_years") < p.get("waiting_years", 3), F.col("pre_existing")),
}
CALCULATION = re.compile(r"[A-Za-z_][A-Za-z_0-9]*|[0-9]+(?:\.[0-9]+)?|<=|>=|[-+*/()<>=]|\s+")


def rule_function(name: str, parameters: dict | None = None) -> Column:
    """PASS, FAIL, WARNING or SKIP by the named function; an unknown name skips."""
    made = RULE_FUNCTIONS.get(name)
    return made(parameters or {}) if made else F.lit("SKIP")


def calculation(expression: str, fields: set[str]) -> Column:
    """An arithmetic comparison over allowed fields; a part outside of numbers, operators and these is an error."""
    at = 0
    while at < len(expression):
        part = CALCULATION.match(expression, at)
        if not part or (part[0][0].isalpha() or part[0][0] == "_") and part[0] not in fields:
            raise ValueError(f"not allowed in a calculation: {expression[at:]!r}")
        at = part.end()
    return F.expr(expression)


# ---- names


def name_verdict(edits: Column, overlap: Column) -> Column:
    """pass up to 2 edits or where one name's tokens are all the other's; block from 5 with little overlap; else review."""
    return F.when((edits <= 2) | (overlap >= 1.0), "pass").when((edits >= 5) & (overlap < 0.5), "block").otherwise("review")


def token_share(name: Column, text: Column) -> Column:
    """Share of a name's tokens (three characters or more) that a text holds; 0 without such tokens."""
    tokens = name_tokens(name)
    return F.when(F.size(tokens) > 0, F.size(F.array_intersect(tokens, name_tokens(text))) / F.size(tokens)).otherwise(F.lit(0.0))


def disambiguated(candidates: DataFrame, key: str, choice: str, least: float = 0.5, margin: float = 0.34) -> DataFrame:
    """(key, choice, share): the best candidate if its share is high enough and well above the second's."""
    two = first_per(candidates, [key], [F.desc("share"), F.asc(choice)], 2)
    best = two.groupBy(key).agg(F.max_by(choice, F.struct("share", (-F.col(choice)).alias("c"))).alias(choice), F.max("share").alias("share"), F.when(F.count("*") > 1, F.min("share")).otherwise(0.0).alias("second"))
    return best.where((F.col("share") >= least) & (F.round(F.col("share") - F.col("second"), 9) >= margin)).select(key, choice, "share")


# ---- corrections


def json_kind(value: Column) -> Column:
    """string, number, boolean, object, array or null of a JSON value."""
    first = F.substring(F.trim(value), 1, 1)
    return F.when(value.isNull() | (F.trim(value) == "null"), "null").when(first == '"', "string").when(first == "{", "object").when(first == "[", "array").when(first.isin("t", "f"), "boolean").otherwise("number")


def shape_of_change(before: Column, after: Column) -> Column:
    """no_change, type_change, truncation, replacement, numeric or structural, of two JSON values."""
    a, b = json_kind(before), json_kind(after)
    x, y = F.btrim(before, F.lit('"')), F.btrim(after, F.lit('"'))
    shorter = (F.length(y) < F.length(x)) & F.contains(x, y)
    return F.when(before.eqNullSafe(after), "no_change").when(a != b, "type_change").when(a == "string", F.when(shorter, "truncation").otherwise("replacement")).when(a == "number", "numeric").otherwise("structural")


# ---- places


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    a, b = F.radians(lat2 - lat1) / 2, F.radians(lon2 - lon1) / 2
    return 2 * EARTH_KM * F.asin(F.least(F.lit(1.0), F.sqrt(F.pow(F.sin(a), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(b), 2))))


def far_places(rows: DataFrame, claim: str, limit_km: float = 5.0) -> DataFrame:
    """Cells (claim, lat, lon, day, n, far): 0.001 degree and day; far if beyond the limit from the claim's largest cell and on another day.

    Cells are counts by partial aggregates; the window sees a row per cell.
    """
    cells = rows.groupBy(claim, F.round("lat", 3).alias("lat"), F.round("lon", 3).alias("lon"), "day").agg(F.count("*").alias("n"))
    largest = F.first(F.struct("lat", "lon", "day")).over(Window.partitionBy(claim).orderBy(F.desc("n"), "day", "lat", "lon"))
    told = cells.withColumn("top", largest)
    far = (haversine_km(F.col("lat"), F.col("lon"), F.col("top.lat"), F.col("top.lon")) > limit_km) & (F.col("day") != F.col("top.day"))
    return told.select(claim, "lat", "lon", "day", "n", far.alias("far"))


# ---- events


def applied_in_order(log: DataFrame, key: str, arrival: str, time: str, event_id: str) -> DataFrame:
    """The log with ``policy``: duplicate of the last applied event, late (older than the last applied: dropped), or applied.

    The last applied time is the largest before, for what is dropped is smaller;
    its id is that of the latest row that reached it.
    """
    last = F.struct(F.col(time).alias("t"), F.col(arrival).alias("a"), F.col(event_id).alias("id"))
    told, _ = running(log, [key], [arrival], {"_last": ("max", last)}, inclusive=False)
    policy = F.when(F.col("_last").isNull(), "applied").when(F.col("_last.id") == F.col(event_id), "duplicate").when(F.col(time) < F.col("_last.t"), "late").otherwise("applied")
    return told.withColumn("policy", policy).drop("_last")


# ---- sides

# Words for the two sides.
SIDES = {"left": ("left", "lt", "lside", "l side", "l-side"), "right": ("right", "rt", "rside", "r side", "r-side")}


def _side_words(text: Column, words: tuple[str, ...]) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(rf"(?i)\b(?:{'|'.join(map(re.escape, words))})\b"))


def side_votes(sections: DataFrame, text: str, sides: Mapping[str, tuple[str, ...]] = SIDES) -> DataFrame:
    """Sections with the side that most of their side words name, the second side on a tie; sections without such words go."""
    (one, a), (other, b) = sides.items()
    counted = sections.withColumns({"_a": _side_words(F.col(text), a), "_b": _side_words(F.col(text), b)}).where("_a + _b > 0")
    return counted.withColumn("side", F.when(F.col("_a") > F.col("_b"), one).otherwise(other)).drop("_a", "_b")


def side_verdicts(claims: DataFrame, votes: DataFrame, claim: str, diagnosis: str, sides: Mapping[str, tuple[str, ...]] = SIDES, least: int = 2) -> DataFrame:
    """(claim, diagnosis_side, n_first, n_second, majority, disputed, observed): what the sections of a claim say against its diagnosis.

    disputed: ``least`` sections differ from the diagnosis' side, and so does
    the majority.  observed: the diagnosis names no side (none, a tie, null),
    and the majority has ``least`` sections.  A claim without votes has counts
    of 0; a null claim has no sections.  Votes are counted before they meet the claims.
    """
    (one, a), (other, b) = sides.items()
    larger = lambda x, y: F.when(x > y, one).when(y > x, other)
    counts = votes.groupBy(claim).agg(*(F.count_if(F.col("side") == s).alias(f"n_{k}") for s, k in ((one, "first"), (other, "second"))))
    n = [F.coalesce(f"n_{k}", F.lit(0)).alias(f"n_{k}") for k in ("first", "second")]
    joined = claims.select(claim, larger(_side_words(F.col(diagnosis), a), _side_words(F.col(diagnosis), b)).alias("diagnosis_side")).join(counts, claim, "left")
    found = joined.select(claim, "diagnosis_side", *n).withColumn("majority", larger(F.col("n_first"), F.col("n_second")))
    dissents = F.when(F.col("diagnosis_side") == one, F.col("n_second")).otherwise(F.col("n_first"))
    disputed = F.col("diagnosis_side").isNotNull() & (dissents >= least) & F.coalesce(F.col("majority") != F.col("diagnosis_side"), F.lit(False))
    observed = F.col("diagnosis_side").isNull() & F.col("majority").isNotNull() & (F.greatest("n_first", "n_second") >= least)
    return found.withColumns({"disputed": disputed, "observed": observed})


def side_standings(votes: DataFrame, verdicts: DataFrame, claim: str) -> DataFrame:
    """Votes that dissent from the diagnosis' side, and, where a side is only observed, those that agree with the majority; a row each."""
    met = votes.join(verdicts.select(claim, "diagnosis_side", "majority", "observed"), claim)
    standing = F.when(F.col("side") != F.col("diagnosis_side"), "dissents").when(F.col("observed") & (F.col("side") == F.col("majority")), "agrees")
    return met.withColumn("standing", standing).where("standing is not null").drop("diagnosis_side", "majority", "observed")
