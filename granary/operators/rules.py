"""Rules as data, compiled to columns: evaluation, readiness, calibration, shadow runs."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granary.operators.relational import compared

# What a failure costs by severity, and the bounds of the readiness buckets.
PENALTY = {"CRITICAL": 25, "HIGH": 10, "MEDIUM": 5, "LOW": 2}
READY, ALMOST = 80, 50


@dataclass(frozen=True)
class Rule:
    """``field op expected`` must hold; below min_confidence the rule abstains."""

    rule_id: str
    field: str
    op: str
    expected: tuple
    severity: str
    min_confidence: float = 0.0


def outcome(rule: Rule, columns: list[str], confidence: Column | None) -> Column:
    """PASS, FAIL, SKIP (too little confidence) or ERROR (no such field) of one rule."""
    if rule.field not in columns:
        return F.lit("ERROR")
    passed = F.when(compared(rule.op, F.col(rule.field), *map(F.lit, rule.expected)), "PASS").otherwise("FAIL")
    return passed if confidence is None or not rule.min_confidence else F.when(F.coalesce(confidence, F.lit(0.0)) < rule.min_confidence, "SKIP").otherwise(passed)


def evaluated(rows: DataFrame, key: str, rules: list[Rule], confidence: str | None = None) -> DataFrame:
    """(key, rule_id, severity, status): one row per rule.  A projection and an explode; nothing is shuffled."""
    known = F.col(confidence) if confidence else None
    made = F.array(*(F.struct(F.lit(r.rule_id).alias("rule_id"), F.lit(r.severity).alias("severity"), outcome(r, rows.columns, known).alias("status")) for r in rules))
    return rows.select(key, F.inline(made))


def readiness(rows: DataFrame, key: str, rules: list[Rule], confidence: str | None = None) -> DataFrame:
    """Score from 100 and rule lists per row, without a shuffle: what ``evaluated`` says, folded in place."""
    return rows.select(key, *(c.alias(name) for name, c in readiness_columns(rows, rules, confidence).items()))


def readiness_columns(rows: DataFrame, rules: list[Rule], confidence: str | None = None) -> dict[str, Column]:
    """score, blocking, warnings, errored and abstained as columns of rows."""
    known = F.col(confidence) if confidence else None
    status = {r.rule_id: outcome(r, rows.columns, known) for r in rules}
    grave = ("CRITICAL", "HIGH")
    lost = sum((F.when(status[r.rule_id] == "FAIL", PENALTY[r.severity]).otherwise(0) for r in rules), F.lit(0))
    listed = lambda state, severe: F.array_join(F.array_compact(F.array(*(F.when(status[r.rule_id] == state, r.rule_id) for r in rules if severe is None or (r.severity in grave) == severe), F.lit(None).cast("string"))), ",")
    return {"score": F.greatest(F.lit(0), 100 - lost).cast("long"), "blocking": listed("FAIL", True), "warnings": listed("FAIL", False), "errored": listed("ERROR", None), "abstained": listed("SKIP", True)}


def bucket(score: Column) -> Column:
    return F.when(score >= READY, "ready").when(score >= ALMOST, "almost").otherwise("blocked")


def action(score: Column, blocking: Column, queried: Column) -> Column:
    """An open query overrides; then the bucket decides."""
    b = bucket(score)
    return F.when(queried | (b == "blocked"), "request_doc").when(b == "ready", "file_now").when(F.length(blocking) > 0, "request_doc").otherwise("review")


def calibration(evaluations: DataFrame, feedback: DataFrame) -> DataFrame:
    """Fire rate and agreement of each rule, with a verdict; rules without feedback stay.

    Both sides are aggregated to a row per rule before they meet.
    """
    fired = evaluations.groupBy("rule_id").agg(F.count("*").alias("evaluated"), F.count_if(F.col("status") == "FAIL").alias("fired"))
    told = feedback.groupBy("rule_id").agg(F.count("*").alias("feedback"), F.count_if("agreed").alias("agreed"))
    both = fired.join(told, "rule_id", "left").na.fill(0, ["feedback", "agreed"])
    fire_rate, agreement = F.col("fired") / F.col("evaluated"), F.try_divide(F.col("agreed"), F.col("feedback"))
    verdict = F.when((F.col("feedback") >= 3) & (agreement < 0.5), "over_strict").when(F.col("fired") == 0, "never_fires").when((F.col("feedback") > 0) & (agreement < 0.8), "watch").when(F.col("feedback") == 0, "unreviewed").otherwise("healthy")
    return both.select("rule_id", "evaluated", "fired", "feedback", F.round(fire_rate, 6).alias("fire_rate"), F.round(agreement, 6).alias("agreement"), verdict.alias("verdict"))


def shadow(rows: DataFrame, key: str, live: list[Rule], draft: list[Rule]) -> DataFrame:
    """Scores of both rule sets and what the draft newly blocks or no longer blocks: one projection of rows."""
    now, then = readiness_columns(rows, live), readiness_columns(rows, draft)
    both = rows.select(key, now["score"].alias("live_score"), then["score"].alias("draft_score"), now["blocking"].alias("live"), then["blocking"].alias("draft"))
    a, b = (F.filter(F.split(c, ","), lambda x: x != "") for c in ("live", "draft"))
    return both.select(key, "live_score", "draft_score", F.array_join(F.array_except(b, a), ",").alias("newly_blocking"), F.array_join(F.array_except(a, b), ",").alias("no_longer_blocking"))


@dataclass(frozen=True)
class RuleSet:
    """Rules that hold from a moment on, until the next set of a later one."""

    version: int
    valid_from: str
    rules: tuple[Rule, ...]


def version_at(moment: Column, sets: list[RuleSet]) -> Column:
    """The version that holds at a moment; null before the first and for a null moment."""
    chosen = F.lit(None).cast("int")
    for s in sorted(sets, key=lambda s: s.valid_from):
        chosen = F.when(moment >= F.lit(s.valid_from).cast("timestamp"), s.version).otherwise(chosen)
    return chosen


def replayed(rows: DataFrame, key: str, moment: str, sets: list[RuleSet], target: int, confidence: str | None = None) -> DataFrame:
    """(key, version, rule_id, before, after, score_before, score_after): each row's rules by the set of its moment and by the target set.

    A rule that only one set has is null under the other; a row from before the first set
    is left out.  One projection and an explode, whatever the number of sets: each set
    is compiled once, and a row takes the columns of its own.
    """
    known = F.col(confidence) if confidence else None
    by_version = {s.version: {r.rule_id: outcome(r, rows.columns, known) for r in s.rules} for s in sets}
    scores = {s.version: readiness_columns(rows, list(s.rules), confidence)["score"] for s in sets}
    version = version_at(F.col(moment).cast("timestamp"), sets)

    def of_own(columns: dict[int, Column | None]) -> Column:
        chosen = F.lit(None)
        for v, c in columns.items():
            chosen = chosen if c is None else F.when(F.col("_version") == v, c).otherwise(chosen)
        return chosen

    names = sorted({r.rule_id for s in sets for r in s.rules})
    parts = F.array(*(F.struct(F.lit(n).alias("rule_id"), of_own({v: rules.get(n) for v, rules in by_version.items()}).cast("string").alias("before"), by_version[target].get(n, F.lit(None)).cast("string").alias("after")) for n in names))
    told = rows.withColumn("_version", version).where("_version is not null").select(key, F.col("_version").alias("version"), of_own(scores).cast("long").alias("score_before"), scores[target].alias("score_after"), F.inline(parts))
    return told.where("before is not null or after is not null").select(key, "version", "rule_id", "before", "after", "score_before", "score_after")


@dataclass(frozen=True)
class StageRule:
    """What a stage requires: ``field op expected``, of severity blocking, warning or info, within a scope of column values."""

    rule_id: str
    stage: str
    field: str
    op: str
    expected: tuple
    severity: str
    scope: tuple[tuple[str, str], ...] = ()
    everywhere: bool = False


# What an unmet requirement of a stage costs.
STAGE_PENALTY = {"blocking": 25, "warning": 5}


def stage_requirements(rows: DataFrame, key: str, rules: list[StageRule], stage: str) -> DataFrame:
    """(key, score, ready, blocking, warnings, info): the stage's rules that apply to a row, by a projection without a shuffle.

    All dimensions of a scope must match, also those of a rule for everywhere; a
    rule with neither applies to nothing.  Information is listed whether met or
    not and costs nothing.
    """
    own = [x for x in rules if x.stage == stage and (x.everywhere or x.scope)]
    applies = {x.rule_id: reduce(lambda a, b: a & b, (F.coalesce(F.col(c) == v, F.lit(False)) for c, v in x.scope), F.lit(True)) for x in own}
    unmet = {x.rule_id: applies[x.rule_id] & ~compared(x.op, F.col(x.field), *map(F.lit, x.expected)) for x in own}
    lost = sum((F.when(unmet[x.rule_id], STAGE_PENALTY[x.severity]).otherwise(0) for x in own if x.severity in STAGE_PENALTY), F.lit(0))

    def listed(severity: str, which: dict[str, Column]) -> Column:
        return F.array_join(F.array_compact(F.array(*(F.when(which[x.rule_id], x.rule_id) for x in own if x.severity == severity), F.lit(None).cast("string"))), ",")

    blocking = listed("blocking", unmet)
    return rows.select(key, F.greatest(F.lit(0), 100 - lost).cast("long").alias("score"), (blocking == "").alias("ready"), blocking.alias("blocking"), listed("warning", unmet).alias("warnings"), listed("info", applies).alias("info"))


def impact_summary(rows: DataFrame, key: str, rules: list[Rule], warning_only: set[str], confidence: str | None = None) -> DataFrame:
    """(key, passed, failed, skipped, errored, critical_failures, score): failures of rules that only warn count as failed and cost nothing."""
    known = F.col(confidence) if confidence else None
    status = {x.rule_id: outcome(x, rows.columns, known) for x in rules}
    count = lambda state, of: sum((F.when(status[x.rule_id] == state, 1).otherwise(0) for x in of), F.lit(0)).cast("long")
    costly = [x for x in rules if x.rule_id not in warning_only]
    lost = sum((F.when(status[x.rule_id] == "FAIL", PENALTY[x.severity]).otherwise(0) for x in costly), F.lit(0))
    states = [count(s, rules).alias(n) for s, n in (("PASS", "passed"), ("FAIL", "failed"), ("SKIP", "skipped"), ("ERROR", "errored"))]
    critical = count("FAIL", [x for x in costly if x.severity == "CRITICAL"]).alias("critical_failures")
    return rows.select(key, *states, critical, F.greatest(F.lit(0), 100 - lost).cast("long").alias("score"))


def label_scores(results: DataFrame) -> DataFrame:
    """(rule_id, scorable, correct, false_block, false_pass, over_abstain, missing, left_out) of rows (rule_id, expected, actual, semantic).

    A null actual is missing; a semantic rule that skipped is left out of what can be scored.
    """
    left_out = F.col("semantic") & F.coalesce(F.col("actual") == "SKIP", F.lit(False))
    scored = F.col("actual").isNotNull() & ~left_out
    pair = lambda e, a: F.count_if(scored & (F.col("expected") == e) & (F.col("actual") == a))
    abstained = F.count_if(scored & (F.col("actual") == "SKIP") & F.col("expected").isin("PASS", "FAIL"))
    return results.groupBy("rule_id").agg(
        F.count_if(scored).alias("scorable"), F.count_if(scored & (F.col("expected") == F.col("actual"))).alias("correct"), pair("PASS", "FAIL").alias("false_block"), pair("FAIL", "PASS").alias("false_pass"),
        abstained.alias("over_abstain"), F.count_if(F.col("actual").isNull()).alias("missing"), F.count_if(left_out).alias("left_out"),
    )


# Lower bounds of the confidence bins, the last one closed at 1.
BINS = (0.0, 0.5, 0.7, 0.9)


def confidence_bins(results: DataFrame) -> DataFrame:
    """(low, n, accuracy) per confidence bin of rows (confidence, correct); bins without rows stay, with a null accuracy."""
    low = reduce(lambda rest, b: F.when(F.col("confidence") >= b, b).otherwise(rest), BINS, F.lit(None).cast("double"))
    found = results.where("confidence between 0 and 1").groupBy(low.alias("low")).agg(F.count("*").alias("n"), F.round(F.avg(F.col("correct").cast("int")), 6).alias("accuracy"))
    bins = results.sparkSession.createDataFrame([(b,) for b in BINS], "low double")
    return bins.join(found, "low", "left").select("low", F.coalesce("n", F.lit(0)).alias("n"), "accuracy")
