"""Event folds per key, in batch and as a stateful stream, and session windows.

The fold keeps, per key: how many events were applied, the kinds still open, the
last event and how many were dropped.  An event older than the last one applied
is dropped, one with the last id is a repeat; equal times are applied in id
order.  The batch fold over ordered events and the stream over the same events
in order give the same state.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from granary.sources.tables import exists

STATE = "applied long, dropped long, last_us long, last_id long, opened long, closed long"
OUTPUT = f"user_id long, {STATE}"
OPENS, CLOSES = "signup", "purchase"


def timed(events: DataFrame) -> DataFrame:
    """(user_id, us, event_id, event_type) of an event table."""
    return events.select("user_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), "event_id", "event_type")


def batch_fold(events: DataFrame) -> DataFrame:
    """The state of each key after all its events in (time, id) order; repeated ids count once.

    In this order nothing is late, so the fold is a plain aggregate with partial sums.
    """
    once = timed(events).dropDuplicates(["user_id", "event_id"])
    last = F.max(F.struct("us", "event_id"))
    return once.groupBy("user_id").agg(
        F.count("*").alias("applied"), F.lit(0).cast("long").alias("dropped"), last.alias("last"), F.count_if(F.col("event_type") == OPENS).alias("opened"), F.count_if(F.col("event_type") == CLOSES).alias("closed")
    ).select("user_id", "applied", "dropped", F.col("last.us").alias("last_us"), F.col("last.event_id").alias("last_id"), "opened", "closed")


def _apply(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    applied, dropped, last_us, last_id, opened, closed = state.get if state.exists else (0, 0, -1, -1, 0, 0)
    rows = pd.concat(list(batches)).sort_values(["us", "event_id"])  # one key's rows of one micro-batch
    for us, event_id, kind in rows[["us", "event_id", "event_type"]].itertuples(index=False):
        if event_id == last_id:
            continue
        if us < last_us:
            dropped += 1
            continue
        applied, last_us, last_id = applied + 1, us, event_id
        opened, closed = opened + (kind == OPENS), closed + (kind == CLOSES)
    new = tuple(int(x) for x in (applied, dropped, last_us, last_id, opened, closed))
    state.update(new)
    yield pd.DataFrame([(key[0], *new)], columns=[c.split()[0] for c in OUTPUT.split(", ")])


def fold_batch(events: DataFrame, states: DataFrame) -> DataFrame:
    """The states after one more micro-batch, by partial aggregates: a key with many events sends one row per task.

    Events are split at the last one of the stored state: older ones are
    dropped, that one again is a repeat, and of the others ids count once.
    """
    last = states.select("user_id", F.col("last_us").alias("_us"), F.col("last_id").alias("_id"))
    once = timed(events).dropDuplicates(["user_id", "event_id"]).join(last, "user_id", "left")
    split = once.where("_id is null or event_id <> _id").withColumn("_late", F.coalesce(F.col("us") < F.col("_us"), F.lit(False)))
    kind = lambda k: F.count_if(~F.col("_late") & (F.col("event_type") == k))
    found = split.groupBy("user_id").agg(
        F.count_if(~F.col("_late")).alias("n_applied"), F.count_if("_late").alias("n_dropped"), F.max(F.when(~F.col("_late"), F.struct("us", "event_id"))).alias("last"), kind(OPENS).alias("n_opened"), kind(CLOSES).alias("n_closed")
    )
    total = lambda c: (F.coalesce(F.col(c), F.lit(0)) + F.coalesce(F.col(f"n_{c}"), F.lit(0))).alias(c)
    latest = [F.coalesce(F.col(a), F.col(b), F.lit(-1)).cast("long").alias(b) for a, b in (("last.us", "last_us"), ("last.event_id", "last_id"))]
    return states.join(found, "user_id", "full").select("user_id", total("applied"), total("dropped"), *latest, total("opened"), total("closed"))


def states_after(spark: SparkSession, root: str, batch: int) -> DataFrame:
    """The states that a batch left; none before the first."""
    return spark.read.schema(OUTPUT).parquet(f"{root}/states/{batch:09d}") if batch >= 0 else spark.createDataFrame([], OUTPUT)


def newest_states(spark: SparkSession, root: str) -> DataFrame:
    """The states after the last batch under a folder."""
    batch = -1
    while exists(spark, f"{root}/states/{batch + 1:09d}/_SUCCESS"):
        batch += 1
    return states_after(spark, root, batch)


def kept(events: DataFrame, root: str):
    """A writer that folds an event stream into states under ``root``, by ``fold_batch``; call ``start``.

    Batch n reads what batch n - 1 left, by the number that the checkpoint under
    ``root`` gives it, so a restart, also in another session, goes on where the last
    batch ended, and a repeated batch replaces itself.
    """

    def keep(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        fold_batch(batch, states_after(spark, root, number - 1)).write.mode("overwrite").parquet(f"{root}/states/{number:09d}")

    return events.writeStream.foreachBatch(keep).option("checkpointLocation", f"{root}/checkpoint")


def stream_fold(events: DataFrame) -> DataFrame:
    """The state of each key after every micro-batch that touches it (update mode).

    A key's rows of a micro-batch meet in one task; ``fold_batch`` has no such limit.
    """
    return timed(events).groupBy("user_id").applyInPandasWithState(_apply, OUTPUT, STATE, "update", GroupStateTimeout.NoTimeout)


def sessions(events: DataFrame, gap: str = "6 hours") -> DataFrame:
    """(user_id, start, end, n): runs of events no more than a gap apart; works on streams under a watermark too."""
    return events.groupBy("user_id", F.session_window(F.col("ts").cast("timestamp"), gap).alias("w")).agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def coalesced_jobs(events: DataFrame, span_seconds: int = 3600) -> DataFrame:
    """Jobs with a deterministic id per key and span of time: repeats collapse to the first."""
    slot = F.floor(F.unix_seconds(F.col("ts").cast("timestamp")) / span_seconds)
    job = events.select("user_id", "event_id", F.concat_ws("-", "user_id", slot).alias("job_id"))
    return job.groupBy("job_id").agg(F.min("event_id").alias("event_id"), F.count("*").alias("n"))


def stalled(events: DataFrame, as_of_us: int, seconds: int) -> DataFrame:
    """Keys whose last event is older than so many seconds at a given moment."""
    last = timed(events).groupBy("user_id").agg(F.max("us").alias("last_us"))
    return last.where(F.col("last_us") < as_of_us - seconds * 1_000_000)


def latest_first(events: DataFrame) -> DataFrame:
    """(user_id, place, event_id): events of each key from the latest on."""
    return timed(events).select("user_id", F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("us"), F.desc("event_id"))).alias("place"), "event_id")
