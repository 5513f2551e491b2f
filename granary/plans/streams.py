"""Folds, sessions and sweeps (S) over the event table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.plans.base import Plans
from granary.sources.tables import table
from granary.streaming import folds

plans = Plans()


@plans.query("select user_id, count(*) as applied, 0 as dropped, max((epoch_us(ts), event_id))[1] as last_us, max((epoch_us(ts), event_id))[2] as last_id, count(*) filter (where event_type = 'signup') as opened, count(*) filter (where event_type = 'purchase') as closed from events group by user_id")
def s4_rebuild_from_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """State of every key, folded from the whole log."""
    return folds.batch_fold(table(spark, sf_dir, "events"))


@plans.query("""with l as (select user_id, ts, case when ts - lag(ts) over (partition by user_id order by ts, event_id) <= interval 6 hour then 0 else 1 end as fresh from events), s as (select *, sum(fresh) over (partition by user_id order by ts rows unbounded preceding) as k from l)
select user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') as start, strftime(max(ts) + interval 6 hour, '%Y-%m-%d %H:%M:%S') as end, count(*) as n from s group by user_id, k""")
def s11_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions that end after six hours of silence."""
    found = folds.sessions(table(spark, sf_dir, "events"))
    return found.select("user_id", *(F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c) for c in ("start", "end")), "n")


@plans.query("select user_id || '-' || (epoch_us(ts) // 3600000000) as job_id, min(event_id) as event_id, count(*) as n from events group by 1")
def s9_job_coalescing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeated jobs of a key within an hour collapse."""
    return folds.coalesced_jobs(table(spark, sf_dir, "events"))


@plans.query("select user_id, max(epoch_us(ts)) as last_us from events group by user_id having max(epoch_us(ts)) < epoch_us(timestamp '2024-01-30') - 21600000000")
def s7_stalled_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys without an event for six hours at a given moment."""
    return folds.stalled(table(spark, sf_dir, "events"), 1_706_572_800_000_000, 21_600)
