"""Resumable ingest and running counters as Structured Streaming jobs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import path_exists


def stream_folder(
    spark: SparkSession,
    folder: str,
    schema: str,
    fmt: str = "parquet",
    files_per_batch: int | None = None,
    glob: str | None = None,
) -> DataFrame:
    """Streaming read of the files of a folder, optionally by file name pattern.

    ``folder`` may be a pattern itself, which a file or a folder of files meets.
    """
    reader = spark.readStream.schema(schema)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.format(fmt).load(folder)


def ingest_incremental(
    source: DataFrame,
    target: str,
    checkpoint: str,
    transform: Callable[[DataFrame], DataFrame] | None = None,
    written: Callable[[int], None] | None = None,
):
    """Process everything new in a streaming source, then stop.

    Each micro-batch overwrites its own folder ``target/batch_id=N``, so a batch
    repeated after a failure replaces what it had written.  The stream
    checkpoint, not the largest finished batch, decides what is left to do.
    ``written`` is called with the number of a batch once its folder is there,
    before the checkpoint takes note of it; if it fails, the batch is repeated by
    the next run.  Returns the finished query.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        rows = transform(batch) if transform else batch
        rows.write.mode("overwrite").parquet(f"{target}/batch_id={batch_id}")
        if written:
            written(batch_id)

    query = (
        source.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return query


def running_counts(source: DataFrame, status: str = "status") -> DataFrame:
    """Row counts per status, of a table, or running ones of a stream for a sink in complete or update mode."""
    return source.groupBy(F.col(status)).agg(F.count(F.lit(1)).alias("n_rows"))


def write_running_counts(
    source: DataFrame, target: str, checkpoint: str, status: str = "status", written: Callable[[int], None] | None = None
):
    """Count the rows of a stream per status, until all waiting input is processed.

    Each micro-batch writes its own counts alone, a row per status that it has,
    into ``target/batch_id=N``; one repeated after a failure overwrites them, so
    totals never count a row twice, and no batch writes what others did.
    ``read_running_counts`` adds up, ``compact_running_counts`` folds many small
    folders into one.
    """

    def transform(batch: DataFrame) -> DataFrame:
        return running_counts(batch, status)

    return ingest_incremental(source, target, checkpoint, transform, written)


def read_running_counts(spark: SparkSession, target: str, status: str = "status") -> DataFrame:
    """The totals of all batches so far; folded ones count once."""
    every = spark.read.option("mergeSchema", True).parquet(target)
    if "upto" in every.columns:
        folded = every.agg(F.coalesce(F.max("upto"), F.lit(-1))).scalar()
        latest = F.col("upto").isNotNull() & (F.col("upto") == folded)
        every = every.where(latest | F.col("upto").isNull() & (F.col("batch_id") > folded))
    return every.groupBy(status).agg(F.sum("n_rows").alias("n_rows"))


def compact_running_counts(spark: SparkSession, target: str, status: str = "status") -> int:
    """Fold the counts of all batches so far into one folder; gives the last batch in it.

    Nothing is deleted: totals read the latest folded folder and what came after
    it, so a fold that dies, or runs beside a reader, changes none.  Call it
    between two runs of the stream.
    """
    last = int(spark.read.parquet(target).agg(F.max("batch_id")).first()[0])
    folder = f"{target}/batch_id={-1 - last}"
    if not path_exists(spark, f"{folder}/_SUCCESS"):
        totals = read_running_counts(spark, target, status).withColumn("upto", F.lit(last).cast("bigint"))
        totals.write.mode("overwrite").parquet(folder)
    return last
