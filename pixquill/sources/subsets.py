"""Multi-subset corpus: one parquet folder per named subset."""

from __future__ import annotations

from itertools import batched

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import constants as K
from ..operators.corpus import union_subsets
from .tables import path_exists

#: Files without rows that are opened at once.
SUSPECTS = 1000
SUBSET_COLUMNS = (
    "instruction string, inputs string, outputs string, "
    "image_base64_str array<string>, position bigint"
)


def read_subsets(
    spark: SparkSession, root: str, names: list[str] | None = None, schema: str | None = None
) -> tuple[DataFrame, DataFrame]:
    """(samples with a ``subset`` column, status table).

    Folders are ``root/subset=name``; subsets may differ in their columns.  With
    a ``schema`` all subsets are one partitioned scan; otherwise each brings its
    own columns.  Unreadable files are skipped and counted: the status table has
    ``files`` and ``unreadable`` per subset, and the status "loaded", "partial"
    (some files are unreadable), "failed" (all are) or "missing".  The count
    reads the footers of files, no column of theirs, and the end of files that
    gave no rows.
    """
    names = names or K.INSTRUCTION_SUBSETS
    status = {n: "loaded" if path_exists(spark, f"{root}/subset={n}") else "missing" for n in names}
    reader = spark.read.option("ignoreCorruptFiles", True)
    present = [n for n in names if status[n] == "loaded"]
    frames = {}
    if schema is not None:
        paths = [f"{root}/subset={n}" for n in present]
        partitioned = reader.schema(f"{schema}, subset string").option("basePath", root)
        samples = partitioned.parquet(*paths) if paths else None
    else:
        for n in present:
            try:
                # merging footers passes over an unreadable file
                frames[n] = reader.option("mergeSchema", True).parquet(f"{root}/subset={n}")
            except AnalysisException:
                status[n] = "failed"
        samples = union_subsets(frames) if frames else None
    return (
        samples if samples is not None else spark.createDataFrame([], f"{schema or SUBSET_COLUMNS}, subset string"),
        _files(spark, root, status, samples),
    )


def _files(spark: SparkSession, root: str, status: dict[str, str], samples: DataFrame | None) -> DataFrame:
    """The status table, with the files of each subset and those that are no Parquet."""
    rows = spark.createDataFrame(list(status.items()), "subset string, _status string")
    listed = [f"{root}/subset={n}" for n, s in status.items() if s != "missing"]
    if not listed:
        return rows.selectExpr("subset", "_status status", "0L files", "0L unreadable")

    def scan(paths: list[str]) -> DataFrame:
        reader = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.parquet")
        return reader.load(paths)

    def place(path: Column) -> list[Column]:
        decoded = F.url_decode(F.replace(path, F.lit("+"), F.lit("%2B")))
        return [F.regexp_extract(decoded, "subset=([^/]+)/", 1).alias("subset"), F.regexp_extract(decoded, "([^/]+)$", 1).alias("file")]

    files = scan(listed).select("path", *place(F.col("path")))
    rowless = files
    if samples is not None:
        full = samples.select(*place(F.input_file_name())).distinct()
        rowless = files.join(full, ["subset", "file"], "left_anti")
    # paths come to the driver some at a time, to be opened
    found: dict[str, int] = {}
    for some in batched((r["path"] for r in rowless.select("path").toLocalIterator()), SUSPECTS):
        ends = scan(list(some)).select(place(F.col("path"))[0], F.substring("content", -4, 4).alias("end"))
        torn = ends.where(F.coalesce(F.col("end").cast("string"), F.lit("")) != "PAR1").groupBy("subset").count()
        for r in torn.collect():  # a row per subset
            found[r["subset"]] = found.get(r["subset"], 0) + r["count"]
    bad = spark.createDataFrame(list(found.items()), "subset string, _bad bigint")
    counts = files.groupBy("subset").agg(F.count(F.lit(1)).alias("files"))
    known = rows.join(counts, "subset", "left").join(bad, "subset", "left").select(
        "subset", "_status", F.coalesce("files", F.lit(0)).alias("files"), F.coalesce("_bad", F.lit(0)).alias("unreadable")
    )
    return known.select(
        "subset",
        F.when(F.col("_status") != "loaded", F.col("_status")).when(F.col("unreadable") == F.col("files"), "failed")
        .when(F.col("unreadable") > 0, "partial").otherwise("loaded").alias("status"),
        "files", "unreadable",
    )
