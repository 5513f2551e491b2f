"""Table access and lineage cuts shared by every operator."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The parquet table ``name`` of a data directory, whatever file system it is on."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def table_stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A stream over the files of a parquet table, be it a directory of part files or a single file."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{sf_dir}/{name}.parquet")
    reader = spark.readStream.schema(table(spark, sf_dir, name).schema)
    if path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(path).isDirectory():
        return reader.parquet(f"{sf_dir}/{name}.parquet")
    return reader.option("pathGlobFilter", f"{name}.parquet").parquet(sf_dir)  # streams list directories only


def views(spark: SparkSession, sf_dir: str, *names: str) -> None:
    """Register the named tables as temporary views."""
    for name in names:
        table(spark, sf_dir, name).createOrReplaceTempView(name)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: the session's ``spark.checkpoint.dir``.

    Only where it is unset and everything runs on this machine (``local`` master,
    as in tests) a folder of the driver is used; on a cluster that is an error.
    """
    context = spark.sparkContext
    configured = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not configured:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        configured = f"file://{tempfile.mkdtemp(prefix='granary-')}"
        context.setCheckpointDir(configured)
    return configured.rstrip("/")


#: Rows and bytes of an Arrow batch where rows carry whole texts: what a Python worker holds at a time (one longer text is a batch of its own).
TEXT_BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": 500, "spark.sql.execution.arrow.maxBytesPerBatch": 4 << 20}


def small_batches(spark: SparkSession) -> None:
    """Hand whole texts to Python workers a few at a time; smaller settings of the session stay.

    For operators that return a column or a table that is computed when the
    caller uses it: the settings stay for the session.  Where an operator writes
    its own tables, ``text_batches`` sets them for that time only.
    """
    for key, most in TEXT_BATCH.items():
        now = int(spark.conf.get(key).rstrip("b"))
        if not 0 < now <= most:
            spark.conf.set(key, str(most))


@contextmanager
def text_batches(spark: SparkSession) -> Iterator[None]:
    """``small_batches`` while the block runs."""
    before = {key: spark.conf.get(key) for key in TEXT_BATCH}
    small_batches(spark)
    try:
        yield
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a parquet table in the shared folder and read it back.

    Cuts the lineage with files that survive the loss of any executor. The
    shuffle files behind the written rows are no longer needed, so they are
    released as soon as the write ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/granary/{uuid.uuid4().hex}/{name}"
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, "false")
    spark.conf.set(key, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(key, before)
    return spark.read.schema(df.schema).parquet(path)


def exists(spark: SparkSession, path: str) -> bool:
    """Whether there is a file or folder of this name, on any file system that Spark can read."""
    found = spark._jvm.org.apache.hadoop.fs.Path(path)
    return found.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(found)


def dropped(*tables: DataFrame) -> None:
    """Delete the files of tables made by ``stored`` once nothing reads them any more."""
    for df in tables:
        spark = df.sparkSession
        for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            if "/granary/" in folder:
                path = spark._jvm.org.apache.hadoop.fs.Path(folder)
                path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
