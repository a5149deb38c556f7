"""Session helpers: builder defaults and durable intermediate results."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


#: Input bytes that one shuffle partition should stand for.
PARTITION_BYTES = 128 << 20
#: Rows of texts, images or tokens that go to Python at once.
BATCH_ROWS = 256
ARROW_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def build_session(app: str = "pixquill", master: str | None = None, input_bytes: int | None = None, **conf) -> SparkSession:
    """Session with the settings the operators are written for.

    Adaptive execution coalesces small shuffle partitions and splits skewed ones
    of sort-merge joins, but it never adds any: give ``input_bytes``, the size of
    what will be read, to start from enough of them.
    """
    if input_bytes:
        first = str(max(200, -(-input_bytes // PARTITION_BYTES)))
        conf.setdefault("spark.sql.adaptive.coalescePartitions.initialPartitionNum", first)
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    ship(spark)
    return spark


def ship(spark: SparkSession) -> None:
    """Send this package to the workers, once per application; functions name it there.

    Needless where it is installed on all machines, and harmless there.
    """
    context = spark.sparkContext
    if getattr(context, "_pixquill_shipped", False):
        return
    home = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    folder = tempfile.mkdtemp(prefix="pixquill-package-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    context.addPyFile(shutil.make_archive(f"{folder}/pixquill", "zip", home, "pixquill"))
    context._pixquill_shipped = True


def small_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """Have the session send wide rows to Python some hundred at a time, unless it sends fewer: what a worker holds
    then doesn't grow with the table."""
    if not 0 < int(spark.conf.get(ARROW_ROWS)) <= rows:
        spark.conf.set(ARROW_ROWS, str(rows))


@contextmanager
def in_small_batches(spark: SparkSession):
    """``small_batches`` for the jobs that run inside."""
    before = spark.conf.get(ARROW_ROWS)
    small_batches(spark)
    try:
        yield
    finally:
        spark.conf.set(ARROW_ROWS, before)


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share, from ``spark.checkpoint.dir``.

    Where it is unset, a local session (driver and executors on one disk) gets
    one temporary folder, which goes when Python ends; a cluster has to set it.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
        folder = tempfile.mkdtemp(prefix="pixquill-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def _file_system(spark: SparkSession, path: str):
    """(file system, path) of the JVM for a path on whatever file system it names."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), target


def scratch(spark: SparkSession, name: str) -> str:
    """A new path for a table between two jobs, in the application's own folder under the shared one.

    That folder goes when the application ends.
    """
    context = spark.sparkContext
    folder = f"{shared_folder(spark)}/pixquill-{context.applicationId}"
    if getattr(context, "_pixquill_scratch", None) != folder:
        files, target = _file_system(spark, folder)
        files.mkdirs(target)
        files.deleteOnExit(target)
        context._pixquill_scratch = folder
    return f"{folder}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet under the shared folder and read back.

    Cuts the lineage: what several later steps read is computed once, and a
    lost executor costs none of it.  ``release`` frees it.
    """
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    written = df.sparkSession.read.schema(df.schema).parquet(path)
    written._pixquill_path = path
    return written


def release(*written: DataFrame) -> None:
    """Delete tables that ``materialize`` wrote, once nothing will read them again; others are left alone."""
    for df in written:
        path = getattr(df, "_pixquill_path", None)
        if path:
            files, target = _file_system(df.sparkSession, path)
            files.delete(target, True)


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(spark))


def durable(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared checkpoint folder and cut its lineage.

    Used after stages whose output may differ when recomputed (network fetch,
    model calls), so that a lost executor cannot make two readers disagree.
    """
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)
