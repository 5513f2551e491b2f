"""Event logs of claims: ingest checks, the fold of a log into a dossier, and its open items.

A log has the columns claim, event_id, us (microseconds), kind and payload
(JSON).  The fold is defined in (us, event_id) order with repeated ids counted
once.  "The last value" and "added again after its last removal" are maxima over
that order, so all of it is plain aggregates with partial sums: a claim with a
third of all events sends one row a task.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Kinds of events that the fold knows, those that are valid but fold to a warning, and the states of a sent message.
LIFECYCLE = ("claim_created", "stage_transitioned", "stage_changed", "claim_closed")
DOCUMENTS = ("doc_uploaded", "doc_segmented", "section_classified", "section_extracted")
INBOUND = ("inbound_email_received", "inbound_email_matched")
OUTBOUND = ("submission_drafted", "submission_queued", "submission_sent", "submission_failed")
UNFOLDED = ("claim_harmonised", "harmonisation_corrected", "inbound_email_unmatched", "rule_override", "section_corrected")
# Lists of open items, the payload field that names an item, the kinds that add it and those that remove it.
LISTS = {
    "queries": ("query_id", ("query_raised",), ("query_resolved",)),
    "drafts": ("draft_id", ("ai_draft_created",), ("ai_draft_applied", "ai_draft_rejected")),
    "actions": ("action_id", ("claim_action_dispatched",), ("claim_action_acked", "claim_action_declined")),
}
ITEM_KINDS = tuple(k for _, adds, removes in LISTS.values() for k in adds + removes)
KNOWN = (*LIFECYCLE, *DOCUMENTS, *INBOUND, *OUTBOUND, *ITEM_KINDS, "adjudication_run")


def field(name: str) -> Column:
    """A payload field as text; null if missing or empty."""
    return F.nullif(F.get_json_object("payload", f"$.{name}"), F.lit(""))


def ingested(log: DataFrame, required: Mapping[str, Sequence[str]], key: str) -> DataFrame:
    """The log with ``verdict``: unknown_kind, invalid_payload (no JSON, or a required field is missing), duplicate, or accepted.

    Of valid events of one claim with the same idempotency key the one with the
    smallest id is accepted; a null key is never a duplicate.  ``required`` has
    every valid kind with the fields its payload must hold.
    """
    valid_json = F.try_parse_json("payload").isNotNull()
    lacks = F.lit(False)
    for kind, names in required.items():
        for name in names:
            lacks = lacks | ((F.col("kind") == kind) & field(name).isNull())
    unknown = ~F.coalesce(F.col("kind").isin(*required), F.lit(False))
    told = log.withColumn("verdict", F.when(unknown, "unknown_kind").when(~valid_json | lacks, "invalid_payload"))
    first = told.where(F.col("verdict").isNull() & F.col(key).isNotNull()).groupBy("claim", key).agg(F.min("event_id").alias("_first"))
    joined = told.join(first, ["claim", key], "left")
    repeat = F.when(F.col("event_id") > F.col("_first"), "duplicate").otherwise("accepted")
    return joined.withColumn("verdict", F.coalesce("verdict", repeat)).drop("_first")


def _once(log: DataFrame) -> DataFrame:
    return log.dropDuplicates(["claim", "event_id"])


def _last(value: Column, when: Column) -> Column:
    """The last value that isn't null among events for which ``when`` holds."""
    return F.max(F.when(when & value.isNotNull(), F.struct("us", "event_id", value.alias("v"))))["v"]


def dossier(log: DataFrame) -> DataFrame:
    """One row a claim: events folded, stage, amount, closure, messages, sections, verdict, malformed and unknown events.

    The stage comes from creation or from a transition under either of its
    names; an event that names none leaves it.  Closing again replaces closure
    and outcome, a missing outcome included.
    """
    kind = F.col("kind")
    after = F.when(kind == "claim_created", field("initial_stage")).otherwise(F.coalesce(field("after_stage"), field("to")))
    closed = F.max(F.when(kind == "claim_closed", F.struct("us", "event_id", field("outcome").alias("v"))))
    malformed = F.lit(False)
    for name, adds, _ in LISTS.values():
        malformed = malformed | (kind.isin(*adds) & field(name).isNull())
    section = F.when((kind == "section_classified") & field("category").isNotNull() & field("section_id").isNotNull(), F.struct(field("category"), field("section_id")))
    return _once(log).groupBy("claim").agg(
        F.count("*").alias("version"),
        _last(after, kind.isin(*LIFECYCLE[:3])).alias("stage"),
        _last(field("claimed").try_cast("double"), kind == "claim_created").alias("claimed"),
        closed["us"].alias("closed_us"),
        closed["v"].alias("outcome"),
        F.count_if(kind.isin(*INBOUND)).alias("n_emails"),
        F.count_if(kind == INBOUND[1]).alias("n_matched"),
        F.count_if(kind.isin(*OUTBOUND)).alias("n_outbound"),
        _last(F.regexp_replace(kind, "^submission_", ""), kind.isin(*OUTBOUND)).alias("last_outbound"),
        F.count_distinct(section).alias("n_sections"),
        _last(field("verdict"), kind == "adjudication_run").alias("verdict"),
        F.count_if(malformed).alias("n_malformed"),
        F.count_if(~F.coalesce(kind.isin(*KNOWN), F.lit(False))).alias("n_unknown"),
    )


def open_items(log: DataFrame) -> DataFrame:
    """(claim, list, item, opened_us): what was added and not removed since; adding again while open changes nothing.

    Rows, not arrays, so a claim with many items stays many rows.  Items without
    a name are left out.
    """
    kind = F.col("kind")
    ops = None
    for name, (key, adds, removes) in LISTS.items():
        part = F.when(kind.isin(*adds, *removes), F.struct(F.lit(name).alias("list"), field(key).alias("item"), kind.isin(*adds).alias("adds")))
        ops = part if ops is None else F.coalesce(ops, part)
    moment = F.struct("us", "event_id")
    rows = _once(log.where(kind.isin(*ITEM_KINDS))).select("claim", ops.alias("o"), moment.alias("at")).select("claim", "o.*", "at").where("item is not null")
    removed = rows.where("not adds").groupBy("claim", "list", "item").agg(F.max("at").alias("gone"))
    standing = rows.where("adds").join(removed, ["claim", "list", "item"], "left").where("gone is null or at > gone")
    return standing.groupBy("claim", "list", "item").agg(F.min("at").alias("at")).select("claim", "list", "item", F.col("at.us").alias("opened_us"))
