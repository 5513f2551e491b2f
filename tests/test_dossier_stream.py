"""The dossier as a stream against the batch fold, after each micro-batch and after a restart from its checkpoint."""

from __future__ import annotations

import random

from pyspark.sql import Row

from granary.operators import dossier as ds
from granary.plans.claims import KINDS
from granary.streaming import dossiers

LOG = "claim long, event_id long, us long, kind string, payload string"


def events(n: int, seed: int) -> list[tuple]:
    """A log out of order, with repeated ids, equal times, missing fields, broken payloads and one hot claim."""
    draw, rows = random.Random(seed), []
    for i in range(n):
        fields = {key: f"i{draw.randrange(4)}" for key, _, _ in ds.LISTS.values()} | {"initial_stage": "A", "after_stage": draw.choice(["B", "C", ""]), "to": "D", "claimed": "12.5", "outcome": draw.choice(["x", "y"]), "category": "c", "section_id": f"s{draw.randrange(5)}", "verdict": draw.choice("pq")}
        body = "{" + ", ".join(f'"{k}": "{v}"' for k, v in fields.items() if draw.random() < 0.8) + "}"
        rows.append((1 if draw.random() < 0.4 else draw.randrange(2, 7), i, draw.randrange(n // 3), draw.choice(KINDS), draw.choice([body, body, body, None, "{"])))
    rows += draw.sample(rows, n // 8)
    draw.shuffle(rows)
    return rows


def same(a, b):
    columns = sorted(a.columns)
    assert columns == sorted(b.columns)
    plain = lambda df: sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)
    assert plain(a) == plain(b) and plain(a)


def test_stream_equals_batch_after_each_batch_and_restart(spark, tmp_path):
    rows, root, source = events(240, 1), f"{tmp_path}/out", f"{tmp_path}/log"
    log = spark.createDataFrame(rows, LOG)
    for part in range(3):
        log.sparkSession.createDataFrame(rows[part::3], LOG).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(LOG).parquet(source)
        query = dossiers.kept(stream, root).trigger(availableNow=True).start()  # each time a new query from the checkpoint
        query.awaitTermination()
        so_far = spark.createDataFrame([r for p in range(part + 1) for r in rows[p::3]], LOG)
        same(dossiers.dossiers(spark, root), ds.dossier(so_far))
        same(dossiers.open_items(spark, root), ds.open_items(so_far))


class Calls:
    """A state of any kind in memory; counts the messages that a real one would send."""

    def __init__(self, log: list) -> None:
        self.log, self.kept = log, {}

    def __getattr__(self, name: str):
        def call(*args):
            self.log.append(name)
            if name in ("exists", "containsKey"):
                return (args[0] if args else None) in self.kept
            if name in ("get", "getValue"):
                return self.kept[args[0] if args else None]
            self.kept[args[0] if len(args) > 1 else None] = args[-1]

        return call


class Handle:
    def __init__(self) -> None:
        self.log: list[str] = []

    def getValueState(self, *_):
        return Calls(self.log)

    getMapState = getValueState


def test_state_calls_do_not_grow_with_events():
    fold, handle = dossiers.Fold(), Handle()
    fold.init(handle)
    plain = dict.fromkeys([*dossiers.LAST, "closes", "outcome", "category", "section", "list", "item", "adds"]) | dict.fromkeys(dossiers.COUNTS, 0)
    for batch in range(2):
        rows = [Row(**plain | {"event_id": i, "us": i, "category": "c", "section": f"s{i % 3}", "list": "queries", "item": f"i{i % 4}", "adds": i % 8 < 4}) for i in range(batch * 400, batch * 400 + 400)]
        handle.log.clear()
        (told,) = fold.handleInputRows((1,), iter(rows), None)
        assert len(handle.log) < 30, len(handle.log)
        assert (told.version, told.n_sections, {i.item: i.opened_us for i in told["items"]}) == (400 * (batch + 1), 3, dict.fromkeys(("i0", "i1", "i2", "i3")))
