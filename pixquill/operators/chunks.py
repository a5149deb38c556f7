"""Work that is dear to repeat, done chunk by chunk under a folder."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


#: Jobs that the chunks of a table take at most.
MAX_CHUNKS = 64


def _files(spark: SparkSession, path: str):
    """(file system, path) of the JVM."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), target


def _there(spark: SparkSession, path: str) -> bool:
    files, target = _files(spark, path)
    return files.exists(target)


def in_chunks(df: DataFrame, key: str, path: str, step: Callable[[DataFrame], DataFrame], chunk: int, schema: str) -> DataFrame:
    """``step`` over all rows of ``df``, kept chunk by chunk under ``path``; gives the rows of all chunks (``schema``).

    ``df`` is read once: it is written to ``path/rows``, then dealt into parts of
    about ``chunk`` rows by a hash of ``key``, and these into folders under
    ``path/plan``.  A step reads its folder alone and leaves ``path/chunk=N``, whose
    ``_SUCCESS`` is the mark of a finished chunk, which is never done again: a run
    that died goes on where it stopped, without ``df``.  Rows of one key are in one
    chunk.  A chunk has one part while these are ``MAX_CHUNKS`` at most, and else as
    many as keep to that number: it bounds the jobs, and what a run that died may lose
    to a share of one in so many.
    """
    spark = df.sparkSession
    kept, plan = f"{path}/rows", f"{path}/plan"
    if not _there(spark, f"{plan}/_SUCCESS"):
        if not _there(spark, f"{kept}/_SUCCESS"):
            df.write.mode("overwrite").parquet(kept)
        rows = spark.read.schema(df.schema).parquet(kept)
        parts = max(1, -(-rows.count() // chunk))
        part = F.pmod(F.xxhash64(key), F.lit(parts))
        # a task has all rows of a part, which are as many as a part may have
        dealt = rows.select(*df.columns, part.alias("_part"), F.pmod(part, F.lit(MAX_CHUNKS)).alias("chunk")).repartition("_part")
        dealt.drop("_part").write.mode("overwrite").partitionBy("chunk").parquet(plan)
    files, target = _files(spark, plan)
    # a folder per chunk
    numbers = sorted(int(f.getPath().getName().split("=")[1]) for f in files.listStatus(target) if f.isDirectory())
    for n in numbers:
        folder = f"{path}/chunk={n}"
        if not _there(spark, f"{folder}/_SUCCESS"):
            own = spark.read.schema(df.schema).parquet(f"{plan}/chunk={n}")
            tasks = max(spark.sparkContext.defaultParallelism, own.rdd.getNumPartitions())
            step(own.repartition(tasks)).write.mode("overwrite").parquet(folder)
    if not numbers:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(*[f"{path}/chunk={n}" for n in numbers])
