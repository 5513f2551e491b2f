"""Rules, readiness, calibration and evaluation (R, E) on the case view."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.operators import ordered
from granary.operators import rules as r
from granary.operators.cases import cases
from granary.plans.base import CASES, Plans
from granary.sources.tables import stored, table

plans = Plans()

LIVE = [
    r.Rule("amount", "claimed", "LESS_THAN_OR_EQUAL", (250_000.0,), "CRITICAL"), r.Rule("lines", "n_lines", "BETWEEN", (1, 6), "HIGH"), r.Rule("queried", "queried", "EQUALS", (False,), "MEDIUM"),
    r.Rule("priority", "priority", "NOT_IN", ("4-NOT SPECIFIED", "5-LOW"), "LOW"), r.Rule("panel", "panel", "EXISTS", (), "HIGH"), r.Rule("room", "room", "EXISTS", (), "HIGH"), r.Rule("ratio", "approved", "GREATER_THAN", (10_000.0,), "HIGH", 0.5),
]
DRAFT = [r.Rule("amount", "claimed", "LESS_THAN_OR_EQUAL", (150_000.0,), "CRITICAL"), LIVE[2], r.Rule("lines", "n_lines", "BETWEEN", (1, 7), "HIGH")]

STATUS = """states as (select *, case when claimed <= 250000 then 'PASS' else 'FAIL' end as s_amount, case when n_lines between 1 and 6 then 'PASS' else 'FAIL' end as s_lines, case when queried then 'FAIL' else 'PASS' end as s_queried,
case when priority in ('4-NOT SPECIFIED', '5-LOW') then 'FAIL' else 'PASS' end as s_priority, 'PASS' as s_panel, 'ERROR' as s_room, case when (case_id % 10) / 10 < 0.5 then 'SKIP' when approved > 10000 then 'PASS' else 'FAIL' end as s_ratio from cases)"""
EVALUATED = f"""with {CASES}, {STATUS}, evaluations as (select case_id, unnest([{{'rule_id': 'amount', 'severity': 'CRITICAL', 'status': s_amount}}, {{'rule_id': 'lines', 'severity': 'HIGH', 'status': s_lines}}, {{'rule_id': 'queried', 'severity': 'MEDIUM', 'status': s_queried}}, {{'rule_id': 'priority', 'severity': 'LOW', 'status': s_priority}},
{{'rule_id': 'panel', 'severity': 'HIGH', 'status': s_panel}}, {{'rule_id': 'room', 'severity': 'HIGH', 'status': s_room}}, {{'rule_id': 'ratio', 'severity': 'HIGH', 'status': s_ratio}}], recursive := true) from states)"""


def sure_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cases(spark, sf_dir).withColumn("confidence", (F.col("case_id") % 10) / 10)


@plans.query(f"{EVALUATED} select case_id, rule_id, severity, status from evaluations")
def r5_rule_evaluation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every rule on every case: pass, fail, abstain or error."""
    return r.evaluated(sure_cases(spark, sf_dir), "case_id", LIVE, "confidence")


@plans.query(f"""{EVALUATED} select case_id, greatest(0, 100 - sum(case when status = 'FAIL' then case severity when 'CRITICAL' then 25 when 'HIGH' then 10 when 'MEDIUM' then 5 else 2 end else 0 end))::bigint as score,
array_to_string([x for x in ['amount', 'lines', 'panel', 'room', 'ratio'] if list_contains(list(rule_id) filter (where status = 'FAIL'), x)], ',') as blocking,
array_to_string([x for x in ['queried', 'priority'] if list_contains(list(rule_id) filter (where status = 'FAIL'), x)], ',') as warnings,
coalesce(string_agg(rule_id, ',') filter (where status = 'ERROR'), '') as errored, coalesce(string_agg(rule_id, ',') filter (where status = 'SKIP'), '') as abstained from evaluations group by case_id""")
def r6_readiness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score and rule lists per case."""
    return r.readiness(sure_cases(spark, sf_dir), "case_id", LIVE, "confidence")


@plans.query(f"""{EVALUATED}, scored as (select case_id, greatest(0, 100 - sum(case when status = 'FAIL' then case severity when 'CRITICAL' then 25 when 'HIGH' then 10 when 'MEDIUM' then 5 else 2 end else 0 end))::bigint as score, bool_or(status = 'FAIL' and severity in ('CRITICAL', 'HIGH')) as blocked from evaluations group by case_id)
select case_id, case when score >= 80 then 'ready' when score >= 50 then 'almost' else 'blocked' end as bucket, case when queried or score < 50 then 'request_doc' when score >= 80 then 'file_now' when blocked then 'request_doc' else 'review' end as action from scored join cases using (case_id)""")
def r14_bucket_and_action(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Readiness bucket and the recommended next action."""
    known = sure_cases(spark, sf_dir)
    scored = r.readiness(known, "case_id", LIVE, "confidence").join(known.select("case_id", "queried"), "case_id")
    return scored.select("case_id", r.bucket(F.col("score")).alias("bucket"), r.action(F.col("score"), F.col("blocking"), F.col("queried")).alias("action"))


@plans.query(f"""{EVALUATED}, feedback as (select rule_id, case_id % 3 <> 0 and rule_id <> 'lines' as agreed from evaluations where status = 'FAIL' and case_id % 2 = 0 and rule_id <> 'priority'),
e as (select rule_id, count(*) as evaluated, count(*) filter (where status = 'FAIL') as fired from evaluations group by 1), f as (select rule_id, count(*) as feedback, count(*) filter (where agreed) as agreed from feedback group by 1),
b as (select rule_id, evaluated, fired, coalesce(feedback, 0) as feedback, coalesce(agreed, 0) as agreed from e left join f using (rule_id))
select rule_id, evaluated, fired, feedback, round(fired / evaluated, 6) as fire_rate, round(agreed / nullif(feedback, 0), 6) as agreement,
case when feedback >= 3 and agreed / nullif(feedback, 0) < 0.5 then 'over_strict' when fired = 0 then 'never_fires' when feedback > 0 and agreed / nullif(feedback, 0) < 0.8 then 'watch' when feedback = 0 then 'unreviewed' else 'healthy' end as verdict from b""")
def r12_rule_calibration(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fire rates and reviewers' agreement of each rule."""
    evaluations = r.evaluated(sure_cases(spark, sf_dir), "case_id", LIVE, "confidence")
    reviewed = evaluations.where("status = 'FAIL' and case_id % 2 = 0 and rule_id <> 'priority'")
    return r.calibration(evaluations, reviewed.select("rule_id", ((F.col("case_id") % 3 != 0) & (F.col("rule_id") != "lines")).alias("agreed")))


@plans.query(f"""{EVALUATED} select rule_id, severity, count(*) as n_failed, count(*) filter (where case_id % 4 = 0) as n_overridden from evaluations where status = 'FAIL' group by all having count(*) filter (where case_id % 4 = 0) >= 2""")
def r13_override_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Failures that reviewers overrode, by rule."""
    failed = r.evaluated(sure_cases(spark, sf_dir), "case_id", LIVE, "confidence").where("status = 'FAIL'")
    return failed.groupBy("rule_id", "severity").agg(F.count("*").alias("n_failed"), F.count_if(F.col("case_id") % 4 == 0).alias("n_overridden")).where("n_overridden >= 2")


@plans.query(f"""with {CASES}, s as (select case_id, claimed > 250000 as a, not n_lines between 1 and 6 as l, queried as q, priority in ('4-NOT SPECIFIED', '5-LOW') as p, approved <= 10000 as t, claimed > 150000 as a2, not n_lines between 1 and 7 as l2 from cases)
select case_id, greatest(0, 100 - 25 * a::int - 10 * l::int - 5 * q::int - 2 * p::int - 10 * t::int)::bigint as live_score, greatest(0, 100 - 25 * a2::int - 5 * q::int - 10 * l2::int)::bigint as draft_score,
concat_ws(',', case when a2 and not a then 'amount' end, case when l2 and not l then 'lines' end) as newly_blocking, concat_ws(',', case when a and not a2 then 'amount' end, case when l and not l2 then 'lines' end, case when t then 'ratio' end) as no_longer_blocking from s""")
def r11_shadow_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A draft rule set against the live one."""
    return r.shadow(cases(spark, sf_dir), "case_id", LIVE, DRAFT)


@plans.query(f"with {CASES} select case_id, case when claimed = 0 then null else round(abs(claimed * 0.7 - approved) / claimed, 6) end as amount_error, ((priority in ('1-URGENT', '2-HIGH')) = queried)::boolean as query_correct, case when status = 'P' then null else (status = 'F') = (n_lines >= 4) end as action_correct from cases")
def e1_prediction_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Errors of predictions; null where they can't be scored."""
    error = F.when(F.col("claimed") != 0, F.round(F.abs(F.col("claimed") * 0.7 - F.col("approved")) / F.col("claimed"), 6))
    right = (F.col("status") == "F") == (F.col("n_lines") >= 4)
    return cases(spark, sf_dir).select("case_id", error.alias("amount_error"), (F.col("priority").isin("1-URGENT", "2-HIGH") == F.col("queried")).alias("query_correct"), F.when(F.col("status") != "P", right).alias("action_correct"))


@plans.query(f"with {CASES}, p as (select panel, abs(claimed * 0.7 - approved) / nullif(claimed, 0) as err, case when status <> 'P' then (status = 'F') = (n_lines >= 4) end as ok from cases) select panel, count(*) as n, round(avg(err), 6) as mean_error, round(quantile_cont(err, 0.95), 6) as p95_error, round(avg(ok::int), 6) as accuracy from p group by panel")
def e2_metrics_by_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headline metrics per panel."""
    error = F.try_divide(F.abs(F.col("claimed") * 0.7 - F.col("approved")), F.col("claimed"))
    ok = F.when(F.col("status") != "P", ((F.col("status") == "F") == (F.col("n_lines") >= 4)).cast("int"))
    rows = stored(cases(spark, sf_dir).select("panel", error.alias("err"), ok.alias("ok")), "errors")  # read twice
    means = rows.groupBy("panel").agg(F.count("*").alias("n"), F.round(F.avg("err"), 6).alias("mean_error"), F.round(F.avg("ok"), 6).alias("accuracy"))
    highest, _ = ordered.percentiles(rows, ["panel"], "err", {"p95_error": (0.95, "between")})
    return means.join(highest, "panel", "left").withColumn("p95_error", F.round("p95_error", 6))


@plans.query(f"with {CASES}, p as (select greatest(0, 100 - n_lines * 10) as old_score, greatest(0, 100 - n_lines * 10 - queried::int * 20) as new_score from cases) select count(*) as n, count(*) filter (where new_score < old_score) as n_worse, round(avg(new_score - old_score), 6) as mean_change, min(new_score - old_score)::bigint as worst from p")
def e3_backtest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New scores against old ones over all closed cases."""
    old, new = F.greatest(F.lit(0), 100 - F.col("n_lines") * 10), F.greatest(F.lit(0), 100 - F.col("n_lines") * 10 - F.col("queried").cast("int") * 20)
    return cases(spark, sf_dir).select((new - old).alias("d")).agg(F.count("*").alias("n"), F.count_if(F.col("d") < 0).alias("n_worse"), F.round(F.avg("d"), 6).alias("mean_change"), F.min("d").cast("long").alias("worst"))


@plans.query("select o_orderkey, coalesce(n, 0) as rendered, 4 as expected, coalesce(n, 0) < 4 as short from orders left join (select l_orderkey, count(*) as n from lineitem group by 1) on l_orderkey = o_orderkey")
def e4_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rendered against expected parts; documents without any are there with zero."""
    counts = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n"))
    n = F.coalesce("n", F.lit(0))
    return table(spark, sf_dir, "orders").join(counts, F.col("o_orderkey") == F.col("l_orderkey"), "left").select("o_orderkey", n.alias("rendered"), F.lit(4).alias("expected"), (n < 4).alias("short"))


@plans.query("select user_id, round(sum(value), 4) as spent, case when sum(value) >= 16000 then 'block' when sum(value) >= 14000 then 'pause_for_consent' when sum(value) >= 12000 then 'throttle' else 'allow' end as verdict from events group by user_id")
def e7_budget_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spend per key against soft and hard limits."""
    spent = F.col("spent")
    totals = table(spark, sf_dir, "events").groupBy("user_id").agg(F.sum("value").alias("spent"))
    return totals.select("user_id", F.round(spent, 4).alias("spent"), F.when(spent >= 16000, "block").when(spent >= 14000, "pause_for_consent").when(spent >= 12000, "throttle").otherwise("allow").alias("verdict"))


@plans.query("with p as (select quality as actual, (n_chars > 500)::int as predicted from labels join documents using (doc_id)) select actual, predicted, count(*) as n from p group by all")
def e8_confusion_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels against a predicted class."""
    joined = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "n_chars"), "doc_id")
    return joined.groupBy(F.col("quality").alias("actual"), (F.col("n_chars") > 500).cast("int").alias("predicted")).agg(F.count("*").alias("n"))


REPLAYED = [
    r.RuleSet(1, "1995-01-01", (r.Rule("lines", "n_lines", "GREATER_THAN_OR_EQUAL", (1,), "CRITICAL"), r.Rule("open_query", "queried", "EQUALS", (False,), "HIGH"))),
    r.RuleSet(2, "1997-06-01", (r.Rule("lines", "n_lines", "GREATER_THAN_OR_EQUAL", (2,), "CRITICAL"), r.Rule("open_query", "queried", "EQUALS", (False,), "HIGH"), r.Rule("share", "approved", "GREATER_THAN", (50000.0,), "LOW"))),
    r.RuleSet(3, "2000-01-01", (r.Rule("lines", "n_lines", "GREATER_THAN_OR_EQUAL", (3,), "HIGH"), r.Rule("status", "status", "NOT_EQUALS", ("P",), "MEDIUM"), r.Rule("share", "approved", "GREATER_THAN", (50000.0,), "LOW"))),
]


@plans.query(f"""with {CASES}, v as (select *, case when opened >= timestamp '2000-01-01' then 3 when opened >= timestamp '1997-06-01' then 2 when opened >= timestamp '1995-01-01' then 1 end as version from cases),
s as (select *, case when n_lines >= case version when 1 then 1 when 2 then 2 else 3 end then 'PASS' else 'FAIL' end as l0, case when n_lines >= 3 then 'PASS' else 'FAIL' end as l1, case when version < 3 then case when queried then 'FAIL' else 'PASS' end end as q0, case when version > 1 then case when approved > 50000 then 'PASS' else 'FAIL' end end as s0, case when approved > 50000 then 'PASS' else 'FAIL' end as s1,
  case when version = 3 then case when status <> 'P' then 'PASS' else 'FAIL' end end as t0, case when status <> 'P' then 'PASS' else 'FAIL' end as t1 from v where version is not null),
p as (select *, 100 - case when l0 = 'FAIL' then case when version < 3 then 25 else 10 end else 0 end - case when q0 = 'FAIL' then 10 else 0 end - case when s0 = 'FAIL' then 2 else 0 end - case when t0 = 'FAIL' then 5 else 0 end as old, 100 - case when l1 = 'FAIL' then 10 else 0 end - case when s1 = 'FAIL' then 2 else 0 end - case when t1 = 'FAIL' then 5 else 0 end as new from s),
u as (select version, old, new, 'lines' as rule_id, l0 as before, l1 as after from p union all select version, old, new, 'open_query', q0, null from p union all select version, old, new, 'share', s0, s1 from p union all select version, old, new, 'status', t0, t1 from p)
select version, rule_id, before, after, count(*) as n, round(avg(new - old), 6) as mean_change from u where before is not null or after is not null group by all""")
def e3_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Closed and open cases replayed under the newest rule set: what each rule said by the set of the case's day and says now, with the change of scores."""
    told = r.replayed(cases(spark, sf_dir), "case_id", "opened", REPLAYED, 3)
    return told.groupBy("version", "rule_id", "before", "after").agg(F.count("*").alias("n"), F.round(F.avg(F.col("score_after") - F.col("score_before")), 6).alias("mean_change"))
