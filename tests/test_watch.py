"""Timers that raise alarms once, also over a restart; ingest as a stream over several batches."""

from __future__ import annotations

import time

from granary.operators import dossier as ds
from granary.sources import versioned
from granary.streaming import watch

EVENTS = "key long, event_id long, us long, kind string"
LOG = "claim long, event_id long, us long, kind string, payload string, once_key string"


def test_alarms_are_raised_once(spark, tmp_path):
    source, out, found = f"{tmp_path}/in", f"{tmp_path}/c", []

    def add(rows):
        spark.createDataFrame(rows, EVENTS).coalesce(1).write.mode("append").parquet(source)

    def run(until, seconds=45):
        stream = spark.readStream.schema(EVENTS).parquet(source)
        query = watch.alarms(stream, ["done"], 3, 8).writeStream.foreachBatch(lambda df, n: found.extend(tuple(r) for r in df.collect())).option("checkpointLocation", out).trigger(processingTime="1 second").start()
        end = time.time() + seconds
        while time.time() < end and not until() and query.exception() is None:
            time.sleep(0.5)
        query.stop()
        assert query.exception() is None

    add([(1, 1, 10, "start"), (2, 2, 11, "start"), (2, 3, 12, "done"), (3, 4, 20, "start"), (3, 5, 15, "step")])
    run(lambda: len(found) >= 4)
    assert sorted(found) == [(1, "stalled", 10), (1, "stranded", 10), (3, "stalled", 20), (3, "stranded", 15)]
    add([(1, 6, 30, "step"), (3, 7, 31, "done"), (2, 8, 40, "step")])  # 1 moves again, 3 ends, 2 begins anew
    run(lambda: len(found) >= 7)
    assert sorted(found[4:]) == [(1, "stalled", 30), (2, "stalled", 40), (2, "stranded", 40)]


def test_ingest_over_batches(spark, tmp_path):
    source, root = f"{tmp_path}/in", f"{tmp_path}/out"
    required = {"claim_closed": (), "query_raised": ("query_id",)}
    batches = [
        [(1, 1, 1, "claim_closed", "{}", "a"), (1, 2, 2, "claim_closed", "{}", "a"), (1, 3, 3, "made_up", "{}", "b"), (2, 4, 4, "query_raised", "{}", "c"), (2, 5, 5, "query_raised", '{"query_id":"q"}', None)],
        [(1, 6, 6, "claim_closed", "{}", "a"), (2, 5, 5, "query_raised", '{"query_id":"q"}', None), (2, 7, 7, "claim_closed", "{}", "a"), (2, 8, 8, "query_raised", "{", "d")],
    ]
    for rows in batches:
        spark.createDataFrame(rows, LOG).coalesce(1).write.mode("append").parquet(source)
        watch.ingested(spark.readStream.schema(LOG).parquet(source), required, "once_key", root).trigger(availableNow=True).start().awaitTermination()
    assert sorted(r["event_id"] for r in versioned.read(spark, f"{root}/accepted").collect()) == [1, 5, 7]
    assert sorted((r["event_id"], r["verdict"]) for r in versioned.read(spark, f"{root}/refused").collect()) == [(2, "duplicate"), (3, "unknown_kind"), (4, "invalid_payload"), (8, "invalid_payload")]
    assert ds.KNOWN
