"""A keyed table of parquet files with versions, as the target of merges.

    root/ranges            key ranges, fixed when the table is made
    root/data/<uuid>       files of one write, a folder per range
    root/versions/<n>      the manifest: which folder holds each range, and which batch made it

A merge reads and writes only the ranges that its rows fall into; the others keep
their files.  Files of a write are nowhere named until its manifest is there, and the
manifest appears as a whole: a writer makes its folder first and fails if another was
faster.  So a crash leaves the last version as it was (``cleaned`` removes such files),
readers of a version are never disturbed, and a batch id that a manifest knows is not
merged again.

The ranges come from approximate quantiles of the first key column, so rows spread
evenly whatever the keys; a range of later keys may grow.  What reaches the driver: the range borders and a row per range.

Defined results: keys have no nulls and are unique within a batch (anything else is an
error, before anything is written); columns of a batch that the table lacks are an
error; an empty batch makes a version without changes; an empty table has one range.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from granary.operators.relational import upserted
from granary.sources.tables import exists

RANGE = "versioned_range"
MANIFEST = "version long, batch_id string, part int, folder string"


def _layout(spark: SparkSession, root: str) -> Row:
    return spark.read.parquet(f"{root}/ranges").first()


def _manifests(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.schema(MANIFEST).option("recursiveFileLookup", "true").parquet(f"{root}/versions")


def version_of(spark: SparkSession, root: str) -> int:
    """The newest version; -1 where there is no table."""
    return _manifests(spark, root).agg(F.max("version")).first()[0] if exists(spark, f"{root}/versions") else -1


def _part(key: Column, borders: Sequence) -> Column:
    """The range of a key: how many borders are at or below it."""
    return F.size(F.filter(F.array(*map(F.lit, borders)), lambda b: b <= key)).cast("int") if borders else F.lit(0)


def _folders(spark: SparkSession, root: str, version: int) -> dict[int, str]:
    return {r["part"]: r["folder"] for r in _manifests(spark, root).where((F.col("version") == version) & F.col("folder").isNotNull()).collect()}


def _published(spark: SparkSession, root: str, version: int, batch_id: str, folders: Mapping[int, str]) -> None:
    rows = [(version, batch_id, part, folder) for part, folder in folders.items()] or [(version, batch_id, None, None)]
    spark.createDataFrame(rows, MANIFEST).coalesce(1).write.parquet(f"{root}/versions/{version:012d}")  # an error if it is there


def _written(rows: DataFrame, root: str, part: Column) -> str:
    folder = f"data/{uuid.uuid4().hex}"
    rows.withColumn(RANGE, part).repartition(RANGE).write.partitionBy(RANGE).parquet(f"{root}/{folder}")
    return folder


def _stored_parts(spark: SparkSession, root: str, folder: str) -> dict[int, str]:
    """Ranges that a write has files for."""
    found = spark.read.schema(f"{RANGE} int").parquet(f"{root}/{folder}")  # the folders' names only
    return {r[RANGE]: f"{folder}/{RANGE}={r[RANGE]}" for r in found.distinct().collect()}


def _checked(rows: DataFrame, keys: Sequence[str]) -> None:
    null = rows.where(" or ".join(f"`{k}` is null" for k in keys)).limit(1).count()
    if null or rows.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1").limit(1).count():
        raise ValueError(f"{', '.join(keys)} must be unique and not null within a batch")


def created(rows: DataFrame, root: str, keys: Sequence[str], n_ranges: int = 16, batch_id: str = "create") -> None:
    """A new table of rows, as version 0."""
    spark = rows.sparkSession
    if version_of(spark, root) >= 0:
        raise ValueError(f"there is a table at {root}")
    _checked(rows, keys)
    borders = _borders(rows, keys[0], n_ranges)
    key_type = rows.schema[keys[0]].dataType.simpleString()
    spark.createDataFrame([(list(keys), borders, rows.schema.json())], f"keys array<string>, borders array<{key_type}>, schema string").coalesce(1).write.parquet(f"{root}/ranges")
    folder = _written(rows, root, _part(F.col(keys[0]), borders))
    _published(spark, root, 0, batch_id, _stored_parts(spark, root, folder))


def _borders(rows: DataFrame, key: str, n_ranges: int) -> list:
    """Keys at which ranges begin: approximate quantiles; of texts, those of a bounded sample."""
    kind = rows.schema[key].dataType.typeName()
    if kind in ("string", "binary"):
        sample = rows.select(key).distinct().orderBy(F.xxhash64(key)).limit(64 * n_ranges)  # a bounded sample; it steers balance only
        keys = sorted(r[0] for r in sample.collect())
        return sorted({keys[len(keys) * i // n_ranges] for i in range(1, n_ranges)}) if keys else []
    found = rows.agg(F.percentile_approx(key, [i / n_ranges for i in range(1, n_ranges)], 10_000)).first()[0] if n_ranges > 1 else []
    return sorted(set(found or []))


def read(spark: SparkSession, root: str, version: int | None = None) -> DataFrame:
    """The rows of a version, by default the newest."""
    layout = _layout(spark, root)
    folders = _folders(spark, root, version_of(spark, root) if version is None else version)
    return _rows(spark, root, layout, folders.values())


def _rows(spark: SparkSession, root: str, layout: Row, folders) -> DataFrame:
    schema = StructType.fromJson(json.loads(layout["schema"]))
    paths = [f"{root}/{f}" for f in folders]
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def merged(rows: DataFrame, root: str, policy: Mapping[str, str], batch_id: str, matched: bool = True, unmatched: bool = True) -> dict[str, int]:
    """Merge a batch into the newest version; how many rows were inserted, updated, kept and skipped, and the ranges written.

    ``policy`` says of each column that is no key how old and new meet (see
    ``upserted``).  Without ``matched`` rows of known keys are skipped, without
    ``unmatched`` those of new keys.  A batch that was merged before changes nothing.
    """
    spark = rows.sparkSession
    layout, version = _layout(spark, root), version_of(spark, root)
    keys, borders = layout["keys"], layout["borders"]
    if _manifests(spark, root).where(F.col("batch_id") == batch_id).limit(1).count():
        return {"inserted": 0, "updated": 0, "kept": 0, "skipped": 0, "ranges": 0}
    _checked(rows, keys)
    folders = _folders(spark, root, version)
    part = _part(F.col(keys[0]), borders)
    touched = sorted(r[0] for r in rows.select(part.alias("p")).distinct().collect())
    old = _rows(spark, root, layout, [folders[p] for p in touched if p in folders])
    met = upserted(old, rows, keys, dict(policy))
    skip = F.when(F.col("action") == "updated", F.lit(not matched)).when(F.col("action") == "inserted", F.lit(not unmatched)).otherwise(F.lit(False))
    if not matched:  # known keys keep what they have
        met = met.join(old.select(*keys, F.struct(*(F.col(c).alias(c) for c in policy)).alias("versioned_old")), list(keys), "left").select(*keys, *(F.when(F.col("action") == "inserted", F.col(c)).otherwise(F.col(f"versioned_old.{c}")).alias(c) for c in policy), "action")
    counts = {r["action"]: r["count"] for r in met.groupBy("action").count().collect()}
    left = met.where(~skip | (F.col("action") != "inserted")).select(*(F.col(f.name).cast(f.dataType) for f in old.schema))
    new = _stored_parts(spark, root, _written(left, root, part)) if touched else {}
    _published(spark, root, version + 1, batch_id, {p: f for p, f in folders.items() if p not in touched} | new)
    updated, inserted = counts.get("updated", 0), counts.get("inserted", 0)
    return {"inserted": inserted if unmatched else 0, "updated": updated if matched else 0, "kept": counts.get("kept", 0), "skipped": (0 if matched else updated) + (0 if unmatched else inserted), "ranges": len(touched)}


def cleaned(spark: SparkSession, root: str, keep_versions: int = 1) -> int:
    """Delete files that none of the newest versions names; how many writes went.  Not while another writer is at work."""
    newest = version_of(spark, root)
    named = {r["folder"].split("/")[1] for r in _manifests(spark, root).where((F.col("version") > newest - keep_versions) & F.col("folder").isNotNull()).collect()}
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/data")
    files = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    gone = [s.getPath() for s in files.listStatus(path) if s.getPath().getName() not in named] if exists(spark, f"{root}/data") else []
    for p in gone:
        files.delete(p, True)
    return len(gone)
