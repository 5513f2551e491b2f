"""Runs that stall or strand, raised once by timers, and event ingest as a stream with a table of refused events.

``alarms`` keeps for each key when its run began and when it last moved.  Each event
moves two processing-time timers: one fires when nothing has happened for
``stalled_s`` seconds, the other when the run is open for ``stranded_s`` seconds,
whatever happened since.  An alarm is raised once; a stalled run that moves again can
stall again; an event of a kind that ends a run clears both.  A key's state is one row.

``ingested`` checks each micro-batch as the batch form does (``dossier.ingested``),
inserts valid events into a versioned table by (claim, idempotency key), where a known
key is a repeat, whichever batch it came in, and refused ones into another.  Both take a
batch under its number once.
"""

from __future__ import annotations

import time
from collections.abc import Iterator, Mapping, Sequence

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from granary.operators import dossier as ds
from granary.sources import versioned
from granary.sources.tables import dropped, stored
from granary.streaming.dossiers import PROVIDER, ROCKS

ALARM = "key long, alarm string, since_us long"


class Watch(StatefulProcessor):
    """One key's run."""

    def __init__(self, ends: Sequence[str], stalled_s: float, stranded_s: float) -> None:
        self.ends, self.stalled_ms, self.stranded_ms = set(ends), int(1000 * stalled_s), int(1000 * stranded_s)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.run = handle.getValueState("run", "began_us long, moved_us long, stall_ms long, strand_ms long")

    def cleared(self) -> None:
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        began, moved, _, strand = self.run.get() if self.run.exists() else (None, None, None, None)
        now, open_run = int(time.time() * 1000), began is not None
        for r in sorted(rows, key=lambda r: (r.us, r.event_id)):  # one micro-batch of a run
            if r.kind in self.ends:
                open_run, began, moved, strand = False, None, None, None
            else:
                if not open_run:
                    open_run, began, strand = True, r.us, now + self.stranded_ms
                moved = r.us if moved is None else max(moved, r.us)
        self.cleared()
        if not open_run:
            self.run.clear()
            return iter(())
        stall = now + self.stalled_ms
        self.run.update((began, moved, stall, strand))
        for at in {stall, strand} - {None}:
            self.handle.registerTimer(at)
        return iter(())

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[Row]:
        if not self.run.exists():
            return
        began, moved, stall, strand = self.run.get()
        at = expiredTimerInfo.getExpiryTimeInMs()
        if stall is not None and at >= stall:
            yield Row(key=key[0], alarm="stalled", since_us=moved)
            stall = None
        if strand is not None and at >= strand:
            yield Row(key=key[0], alarm="stranded", since_us=began)
            strand = None
        self.run.update((began, moved, stall, strand))  # what was raised has no timer any more

    def close(self) -> None:
        pass


def alarms(events: DataFrame, ends: Sequence[str], stalled_s: float, stranded_s: float) -> DataFrame:
    """A stream of (key, alarm, since_us) from one of (key, event_id, us, kind), in append mode."""
    events.sparkSession.conf.set(PROVIDER, ROCKS)
    return events.groupBy("key").transformWithState(Watch(ends, stalled_s, stranded_s), ALARM, "Append", "ProcessingTime")


def ingested(log: DataFrame, required: Mapping[str, Sequence[str]], key: str, root: str):
    """A writer of a log stream's events into ``accepted`` and ``refused`` under ``root``; call ``start``.

    Of events of one claim with one key the first batch's, in it the smallest id, is
    accepted; those without a key go by their event id.  Refused are unknown kinds,
    invalid payloads and, within a batch, repeats; a repeat of an earlier batch is left out.
    """

    def keep(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        told = stored(ds.ingested(batch.where("claim is not null and event_id is not null").dropDuplicates(["claim", "event_id"]), required, key), "told")
        by_key = F.coalesce(F.concat(F.lit("key:"), F.col(key)), F.concat(F.lit("id:"), F.col("event_id"))).alias("once")
        parts = {"accepted": (told.where("verdict = 'accepted'").select("claim", by_key, "event_id", "us", "kind", "payload"), ["claim", "once"]), "refused": (told.where("verdict <> 'accepted'").select("event_id", "claim", "us", "kind", "payload", "verdict"), ["event_id", "claim"])}
        for name, (rows, keys) in parts.items():
            target = f"{root}/{name}"
            if versioned.version_of(spark, target) < 0:
                versioned.created(spark.createDataFrame([], rows.schema), target, keys)
            versioned.merged(rows, target, {c: "old" for c in rows.columns if c not in keys}, f"batch {number}", matched=False)
            versioned.cleaned(spark, target)
        dropped(told)

    return log.writeStream.foreachBatch(keep).option("checkpointLocation", f"{root}/checkpoint")
