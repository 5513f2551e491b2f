"""The dossier of a claim as a stream: state per claim, one row per claim and micro-batch, tables of all claims.

Repeated events are dropped by ``dropDuplicates``, whose state is spread by claim and
event id.  ``transformWithState`` keeps for each claim

* one value: counts, and for stage, amount, closure, message and verdict the last
  value together with the (us, event_id) that set it
* a map of (category, section), the distinct sections
* a map of open items: the last removal, and the additions after it

Each call of a state is a message to the JVM, so a claim's states are read and written
once per micro-batch, not once per event, and those of a new claim aren't looked up.

All of it is defined in (us, event_id) order whatever the order of arrival, so after
each micro-batch the rows equal the batch fold (``granary.operators.dossier``) of all
events so far.  States live in RocksDB and in the checkpoint: a restart goes on where
the last batch ended.  Payloads are read by columns in the JVM; Python sees typed
fields, one row at a time, whatever the number of rows of a claim.

``kept`` writes each micro-batch into two versioned tables under its batch number, so
a batch that is repeated after a failure changes nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from granary.operators import dossier as ds
from granary.sources import versioned
from granary.sources.tables import dropped, stored

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Values that the last event with one decides, and counts.
LAST = {"stage": "string", "claimed": "double", "last_outbound": "string", "verdict": "string"}
COUNTS = ("n_emails", "n_matched", "n_outbound", "n_malformed", "n_unknown")
ROWS = ("version", "stage", "claimed", "closed_us", "outcome", "n_emails", "n_matched", "n_outbound", "last_outbound", "n_sections", "verdict", "n_malformed", "n_unknown")
OUTPUT = "claim long, version long, stage string, claimed double, closed_us long, outcome string, n_emails long, n_matched long, n_outbound long, last_outbound string, n_sections long, verdict string, n_malformed long, n_unknown long, items array<struct<list string, item string, opened_us long>>"
STATE = ", ".join(["version long, n_sections long, closed_us long, closed_id long, outcome string", *(f"{c} long" for c in COUNTS), *(f"{c} {t}, {c}_us long, {c}_id long" for c, t in LAST.items())])


def typed(log: DataFrame) -> DataFrame:
    """The fields of a log that the state needs: what each event sets, counts, adds and removes."""
    kind, field = F.col("kind"), ds.field
    named = lambda k: F.when(F.coalesce(kind == k, F.lit(False)), F.lit(True)).otherwise(F.lit(False))
    one = lambda c: F.coalesce(c, F.lit(False)).cast("long")
    item: Column = F.lit(None).cast("struct<list:string,item:string,adds:boolean>")
    malformed = F.lit(False)
    for name, (key, adds, removes) in ds.LISTS.items():
        item = F.coalesce(item, F.when(kind.isin(*adds, *removes), F.struct(F.lit(name).alias("list"), field(key).alias("item"), kind.isin(*adds).alias("adds"))))
        malformed = malformed | (kind.isin(*adds) & field(key).isNull())
    return log.select(
        F.col("claim").cast("long").alias("claim"), "event_id", "us",
        F.when(kind == "claim_created", field("initial_stage")).when(kind.isin(*ds.LIFECYCLE[1:3]), F.coalesce(field("after_stage"), field("to"))).alias("stage"), F.when(kind == "claim_created", field("claimed").try_cast("double")).alias("claimed"),
        F.when(kind.isin(*ds.OUTBOUND), F.regexp_replace(kind, "^submission_", "")).alias("last_outbound"), F.when(kind == "adjudication_run", field("verdict")).alias("verdict"),
        named("claim_closed").alias("closes"), field("outcome").alias("outcome"), F.when(kind == "section_classified", field("category")).alias("category"), F.when(kind == "section_classified", field("section_id")).alias("section"), item["list"].alias("list"), item["item"].alias("item"), item["adds"].alias("adds"),
        one(kind.isin(*ds.INBOUND)).alias("n_emails"), one(kind == ds.INBOUND[1]).alias("n_matched"), one(kind.isin(*ds.OUTBOUND)).alias("n_outbound"), one(malformed).alias("n_malformed"), one(~F.coalesce(kind.isin(*ds.KNOWN), F.lit(False))).alias("n_unknown"),
    )


class Item:
    """The last removal of an item and the additions after it, from its stored state on."""

    def __init__(self, state: tuple | None) -> None:
        gone_us, gone_id, us, ids = state or (None, None, (), ())
        self.gone = None if gone_us is None else (gone_us, gone_id)
        self.added = list(zip(us, ids, strict=True))

    def change(self, adds: bool, at: tuple[int, int]) -> None:
        if adds and (self.gone is None or at > self.gone):
            self.added.append(at)
        elif not adds and (self.gone is None or at > self.gone):
            self.gone = at

    def state(self) -> tuple:
        added = sorted({a for a in self.added if self.gone is None or a > self.gone})
        return (*(self.gone or (None, None)), [us for us, _ in added], [i for _, i in added])


class Fold(StatefulProcessor):
    """One claim's dossier."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.value = handle.getValueState("dossier", STATE)
        self.sections = handle.getMapState("sections", "category string, section string", "us long")
        self.items = handle.getMapState("items", "list string, item string", "gone_us long, gone_id long, us array<long>, ids array<long>")
        self.columns = [c.split()[0] for c in STATE.split(", ")]

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        known = self.value.exists()
        if known:
            now = dict(zip(self.columns, self.value.get(), strict=True))
        else:
            now = dict.fromkeys(self.columns) | dict.fromkeys(("version", "n_sections", *COUNTS), 0)
        sections: set[tuple[str, str]] = set()
        items: dict[tuple[str, str], Item] = {}
        for r in rows:
            now["version"] += 1
            for c in COUNTS:
                now[c] += r[c]
            at = (r.us, r.event_id)
            for c in LAST:
                if r[c] is not None and (now[f"{c}_us"] is None or at > (now[f"{c}_us"], now[f"{c}_id"])):
                    now[c], now[f"{c}_us"], now[f"{c}_id"] = r[c], *at
            if r.closes and (now["closed_us"] is None or at > (now["closed_us"], now["closed_id"])):
                now["closed_us"], now["closed_id"], now["outcome"] = *at, r.outcome
            if r.category is not None and r.section is not None and (r.category, r.section) not in sections:
                sections.add((r.category, r.section))
                if not (known and self.sections.containsKey((r.category, r.section))):
                    self.sections.updateValue((r.category, r.section), (r.us,))
                    now["n_sections"] += 1
            if r.item is not None:
                name = (r.list, r.item)
                if name not in items:
                    items[name] = Item(self.items.getValue(name) if known and self.items.containsKey(name) else None)
                items[name].change(r.adds, at)
        opened = []
        for name, item in items.items():
            left = item.state()
            self.items.updateValue(name, left)
            opened.append(Row(list=name[0], item=name[1], opened_us=left[2][0] if left[2] else None))
        self.value.update(tuple(now[c] for c in self.columns))
        yield Row(claim=key[0], **{c: now[c] for c in ROWS}, items=opened)

    def close(self) -> None:
        pass


def folded(log: DataFrame) -> DataFrame:
    """A stream of dossiers (update mode): each claim that a micro-batch touches, with the items that it changed (opened_us null: closed)."""
    log.sparkSession.conf.set(PROVIDER, ROCKS)
    once = typed(log).dropDuplicates(["claim", "event_id"])
    return once.groupBy("claim").transformWithState(Fold(), OUTPUT, "Update", "None")


def kept(log: DataFrame, root: str, **reader: str):
    """A writer that folds a log stream into the tables ``dossiers`` and ``items`` under ``root``; call ``start``."""

    def keep(batch: DataFrame, number: int) -> None:
        spark, rows = batch.sparkSession, stored(batch, "changed")  # so that the states are computed once
        for name, part, keys in (("dossiers", rows.drop("items"), ["claim"]), ("items", rows.select("claim", F.inline("items")), ["claim", "list", "item"])):
            target = f"{root}/{name}"
            if versioned.version_of(spark, target) < 0:
                versioned.created(spark.createDataFrame([], part.schema), target, keys)
            versioned.merged(part, target, {c: "replace" for c in part.columns if c not in keys}, f"batch {number}")
            versioned.cleaned(spark, target)
        dropped(rows)

    return folded(log).writeStream.foreachBatch(keep).outputMode("update").option("checkpointLocation", f"{root}/checkpoint")


def dossiers(spark: SparkSession, root: str) -> DataFrame:
    return versioned.read(spark, f"{root}/dossiers")


def open_items(spark: SparkSession, root: str) -> DataFrame:
    """(claim, list, item, opened_us) of items that are open."""
    return versioned.read(spark, f"{root}/items").where("opened_us is not null")
