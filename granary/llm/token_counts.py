"""Token totals kept up to date by signed changes.

A batch of changes is reduced to one signed row per (source, language,
tokenizer version).  The rollup is the sum over all committed batches: totals are
additive, so inserts add, deletes subtract and a revised count adds the
difference.

Commits are idempotent and atomic.  A batch's rows go to a folder of their own
that no reader looks at; then a note of one row in ``commits`` names that folder
and a digest of its rows.  Spark moves the note's single file into place last, so
a batch is there as a whole or not at all, and a crash before leaves only an
unread folder.  A batch id that has a note already is not written again: a replay
with the same content changes nothing, one with other content is refused.
``totals`` reads the batches that have notes.  ``compact`` folds all of them into
one, whose note names those it replaces; their ids stay known, so late replays
still change nothing.  A store has one writer at a time.

Partial aggregation runs before the only shuffle, so a source that holds a third
of all rows sends one row per task.  Null source, language or tokenizer form
groups of their own; a null count is 0; an unknown ``op`` raises an error rather
than being skipped; repeated rows each count.  An empty batch is a batch without
rows; a store without batches has no totals.  Extra columns are ignored.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from granary.sources.tables import exists

KEYS = ("source", "lang", "tokenizer")
NOTE = "batch_id long, folder string, digest string, replaces array<long>"
SCHEMA = "source string, lang string, tokenizer string, n_docs long, n_tokens long"


def signed(changes: DataFrame) -> DataFrame:
    """Changes (op, source, lang, tokenizer, n_tokens, old_tokens) as signed (n_docs, n_tokens) rows.

    op: ``insert`` adds a document, ``delete`` takes one away, ``revise``
    replaces old_tokens by n_tokens.
    """
    new, old = (F.coalesce(F.col(c).cast("long"), F.lit(0)) for c in ("n_tokens", "old_tokens"))
    docs = F.when(F.col("op") == "insert", 1).when(F.col("op") == "delete", -1).when(F.col("op") == "revise", 0)
    tokens = F.when(F.col("op") == "insert", new).when(F.col("op") == "delete", -new).when(F.col("op") == "revise", new - old)
    checked = F.coalesce(docs.cast("long"), F.raise_error(F.concat(F.lit("unknown op: "), F.coalesce("op", F.lit("null")))).cast("long"))
    return changes.select(*KEYS, checked.alias("n_docs"), tokens.alias("n_tokens"))


def reduced(rows: DataFrame) -> DataFrame:
    """Sum of signed rows per key."""
    return rows.groupBy(*KEYS).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))


def notes(spark: SparkSession, store: str) -> list[Row]:
    """One row per batch ever committed: bounded by the number of commits, not by the data."""
    if not exists(spark, f"{store}/commits"):
        return []
    return spark.read.schema(NOTE).option("recursiveFileLookup", "true").parquet(f"{store}/commits").collect()


def committed(spark: SparkSession, store: str) -> set[int]:
    """Ids whose changes are in the totals, be it by a compacted batch."""
    return {i for note in notes(spark, store) for i in (note["batch_id"], *note["replaces"])}


def _published(rows: DataFrame, store: str, batch_id: int, replaces: list[int]) -> str:
    """Write rows, then the note that makes them count; returns their digest."""
    spark = rows.sparkSession
    folder = f"rows/{uuid.uuid4().hex}"
    rows.write.parquet(f"{store}/{folder}")
    digest = digest_of(spark.read.schema(SCHEMA).parquet(f"{store}/{folder}"))
    note = spark.createDataFrame([(batch_id, folder, digest, replaces)], NOTE).coalesce(1)
    note.write.parquet(f"{store}/commits/{batch_id:019d}")  # an error if another writer was faster
    return digest


def digest_of(rows: DataFrame) -> str:
    """A digest of rows in any order."""
    sums = rows.select(F.xxhash64(F.to_json(F.struct(*KEYS, "n_docs", "n_tokens"), {"ignoreNullFields": "false"})).cast("decimal(38,0)").alias("h")).agg(F.count("*").alias("n"), F.coalesce(F.sum("h"), F.lit(0)).alias("h")).first()
    return f"{sums['n']}:{sums['h']}"


def commit(changes: DataFrame, store: str, batch_id: int) -> bool:
    """Commit a batch under its id; False if it was committed before.  Other content under a known id is an error."""
    spark = changes.sparkSession
    rows = reduced(signed(changes)).where("n_docs <> 0 or n_tokens <> 0")
    for note in notes(spark, store):
        if batch_id == note["batch_id"]:
            if digest_of(rows) != note["digest"]:
                raise ValueError(f"batch {batch_id} is committed with other content")
            return False
    if batch_id in committed(spark, store):
        return False
    _published(rows, store, batch_id, [])
    return True


def totals(spark: SparkSession, store: str) -> DataFrame:
    """The rollup over all committed batches; groups without documents and tokens vanish."""
    known = notes(spark, store)
    replaced = {i for note in known for i in note["replaces"]}
    folders = [f"{store}/{note['folder']}" for note in known if note["batch_id"] not in replaced]
    rows = spark.read.schema(SCHEMA).parquet(*folders) if folders else spark.createDataFrame([], SCHEMA)
    return reduced(rows).where("n_docs <> 0 or n_tokens <> 0")


def compact(spark: SparkSession, store: str, into: int) -> None:
    """Fold all committed batches into batch ``into`` (a new id), so that few folders are read."""
    known = committed(spark, store)
    if into in known:
        raise ValueError(f"batch {into} is committed already")
    if known:
        _published(totals(spark, store), store, into, sorted(known))
