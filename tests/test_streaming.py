"""The stateful stream equals the batch fold; late events are dropped."""

from __future__ import annotations

import tempfile



from granary.plans import resolution
from granary.streaming import folds

SCHEMA = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


def run(spark, batches: list[list[tuple]]) -> dict[int, tuple]:
    """Last state per key after the batches, each a file of its own."""
    source, name = tempfile.mkdtemp(prefix="stream-"), f"s{abs(hash(tuple(map(tuple, batches))))}"
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(f"{source}/{i:03d}")
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(source)
    query = folds.stream_fold(stream).writeStream.outputMode("update").format("memory").queryName(name).start()
    try:
        query.processAllAvailable()
    finally:
        query.stop()
    out: dict[int, tuple] = {}
    for r in spark.table(name).collect():
        if r["applied"] + r["dropped"] >= sum(out.get(r["user_id"], (0, 0))[:2]):
            out[r["user_id"]] = tuple(r)[1:]
    return out


def events(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def at(second: int):
    from datetime import datetime, timedelta

    return datetime(2024, 1, 1) + timedelta(seconds=second)


def row(event_id: int, second: int, user: int, kind: str = "view") -> tuple:
    return (event_id, at(second), user, kind, 1.0, "{}")



def test_stream_equals_batch_on_ordered_input(spark):
    rows = [row(i, 10 * i, i % 3, ("view", "signup", "purchase")[i % 5 % 3]) for i in range(30)]
    assert run(spark, [rows[:10], rows[10:25], rows[25:]]) == {r["user_id"]: tuple(r)[1:] for r in folds.batch_fold(events(spark, rows)).collect()}



def test_late_events_are_dropped_and_equal_times_applied(spark):
    got = run(spark, [[row(1, 100, 1), row(2, 200, 1)], [row(3, 150, 1), row(4, 200, 1)], [row(4, 200, 1)]])
    assert got[1][:2] == (3, 1)


def test_batch_fold_counts_repeats_once(spark):
    rows = [row(1, 5, 1, "signup"), row(1, 5, 1, "signup"), row(2, 5, 1, "purchase")]
    state = folds.batch_fold(events(spark, rows)).first()
    assert (state["applied"], state["opened"], state["closed"], state["last_id"]) == (2, 1, 1, 2)


def test_session_windows(spark):
    rows = [row(1, 0, 1), row(2, 59, 1), row(3, 200, 1), row(4, 0, 2)]
    got = sorted((r["user_id"], r["n"]) for r in folds.sessions(events(spark, rows), "60 seconds").collect())
    assert got == [(1, 1), (1, 2), (2, 1)]


def test_stream_over_a_table_of_part_files(spark):
    rows = [row(i, 10 * i, i % 3, ("view", "signup", "purchase")[i % 5 % 3]) for i in range(40)]
    for table in (rows, []):
        folder = tempfile.mkdtemp(prefix="parts-")
        events(spark, table).repartition(4, "event_id").write.parquet(f"{folder}/events.parquet")
        got = sorted(map(tuple, resolution.s2_stream_fold(spark, folder).collect()))
        assert got == sorted(map(tuple, folds.batch_fold(events(spark, table)).collect()))


def test_fold_batch_splits_at_the_stored_state(spark):
    states = spark.createDataFrame([(9, 5, 0, 50, 8, 1, 0)], folds.OUTPUT)
    for batch in ([row(1, 100, 1), row(2, 200, 1)], [row(3, 150, 1, "signup"), row(4, 200, 1, "signup"), row(4, 200, 1, "signup")], [row(4, 200, 1), row(5, 90, 2, "purchase")]):
        states = spark.createDataFrame(folds.fold_batch(events(spark, batch), states).collect(), folds.OUTPUT)
    us = 1_704_067_200_000_000
    assert sorted(map(tuple, states.collect())) == [(1, 3, 1, us + 200_000_000, 4, 1, 0), (2, 1, 0, us + 90_000_000, 5, 0, 1), (9, 5, 0, 50, 8, 1, 0)]


def test_fold_goes_on_after_a_restart(spark, small, tmp_path):
    """Three starts, each with new part files and a new query; the states go on from the checkpoint."""
    events = spark.read.parquet(f"{small}/events.parquet")
    cuts = events.approxQuantile("event_id", [0.3, 0.7], 0.01)
    source, root = f"{tmp_path}/events", f"{tmp_path}/out"
    parts = [events.where(events.event_id <= cuts[0]), events.where((events.event_id > cuts[0]) & (events.event_id <= cuts[1])), events.where(events.event_id > cuts[1])]
    states = None
    for part in parts:
        part.write.mode("append").parquet(source)
        folds.kept(spark.readStream.schema(events.schema).parquet(source), root).trigger(availableNow=True).start().awaitTermination()
        states = part if states is None else states.unionByName(part)
    plain = folds.states_after(spark, root, -1)
    for part in parts:
        plain = spark.createDataFrame(folds.fold_batch(part, plain).collect(), folds.OUTPUT)
    assert sorted(map(tuple, folds.newest_states(spark, root).collect())) == sorted(map(tuple, plain.collect()))
