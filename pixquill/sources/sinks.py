"""Table, request, benchmark and image writers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import in_small_batches
from .nested import line_order

TSV_COLUMNS = "img_name string, question string, gt_ans string, pred_ans string"


def write_table(
    df: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite", partition_by: list[str] | None = None
) -> None:
    """Write parquet, JSON lines or CSV (header, quoted line breaks)."""
    writer = df.write.mode(mode)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    if fmt == "csv":
        # null and "" must stay apart; a blank field is null
        writer = writer.option("header", True).option("escape", '"').option("emptyValue", '""')
        writer = writer.options(ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    writer.format(fmt).save(path)


def write_report(report: DataFrame, folder: str) -> str:
    """One-row report as JSON under a time-stamped folder; returns the path."""
    from datetime import datetime

    path = f"{folder}/download_report_{datetime.now():%Y%m%d_%H%M%S}"
    report.write.mode("overwrite").json(path)
    return path


def write_llm_requests(requests: DataFrame, path: str) -> None:
    """JSON lines, one folder per batch; needs columns request and batch."""
    spread = requests.repartition("batch").sortWithinPartitions("batch", "custom_id")
    spread.select(F.col("request").alias("value"), "batch").write.mode("overwrite").partitionBy(
        "batch"
    ).text(path)


def _clean(name: str):
    return F.regexp_replace(name, "[\t\r\n]", " ").alias(name)


def write_answers(answers: DataFrame, path: str, part: str = "part") -> None:
    """(question_id, question, gt_ans, pred_ans) as JSON arrays of four-element arrays.

    Each value of ``part`` becomes one file, in the order of ``ord``; choose parts
    that fit a task.
    """
    item = F.struct("ord", F.array("question_id", "question", "gt_ans", "pred_ans").alias("a"))
    rows = answers.groupBy(part).agg(F.sort_array(F.collect_list(item)).alias("_items"))
    text = F.to_json(F.transform("_items", lambda x: x["a"]), {"ignoreNullFields": "false"})
    rows.select(part, text.alias("value")).write.mode("overwrite").partitionBy(part).text(path)


def write_mme_dir(answers: DataFrame, path: str, order: str | None = None) -> None:
    """Tab-separated answers, one folder per category, no header, overwriting.

    With ``order`` the lines of a category follow that column, over its files in
    the order of their names.  Tabs and line breaks inside a field become blanks.
    """
    fields = ["img_name", "question", "gt_ans", "pred_ans"]
    if order:
        answers = answers.repartitionByRange("category", order).sortWithinPartitions("category", order)
    (
        answers.select("category", *[_clean(f) for f in fields])
        .write.mode("overwrite")
        .partitionBy("category")
        .options(sep="\t", header=False, quote="", emptyValue="", nullValue="")
        .csv(path)
    )


def read_mme_dir(spark: SparkSession, path: str) -> DataFrame:
    """Answer files of a folder with their category and ``ord``, the order of their lines.

    Takes both layouts: ``category=name/`` folders and ``name.txt`` files.
    Missing trailing fields are null.
    """
    reader = spark.read.schema(TSV_COLUMNS).options(sep="\t", header=False, quote="", mode="PERMISSIVE")
    rows = reader.option("recursiveFileLookup", True).csv(path)
    file = F.url_decode(F.replace(F.input_file_name(), F.lit("+"), F.lit("%2B")))
    folder = F.regexp_extract(file, "category=([^/]+)/", 1)
    stem = F.regexp_extract(file, r"([^/]+)\.txt$", 1)
    return rows.withColumns({"category": F.when(folder != "", folder).otherwise(stem), "ord": line_order()})


def number_lines(lines: DataFrame, category: str = "category") -> DataFrame:
    """Add ``line``, 0..n-1 in each category by ``ord``: blocks of files are counted, and
    lines numbered inside a block."""
    block = F.struct("ord.file", "ord.block")
    keyed = lines.withColumn("_block", block)
    sizes = keyed.groupBy(category, "_block").agg(F.count(F.lit(1)).alias("_n"))
    earlier = Window.partitionBy(category).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(category, "_block", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_start"))
    inside = F.row_number().over(Window.partitionBy(category, "_block").orderBy("ord.row")) - 1
    return keyed.withColumn("_in", inside).join(starts, [category, "_block"]).select(
        *lines.columns, (F.col("_start") + F.col("_in")).alias("line")
    )


def write_images(images: DataFrame, path: str, encoder: Callable | None = None) -> None:
    """Processed images as parquet rows (identifier, width, height, data).

    ``encoder(data, width, height)`` returns encoded file bytes and adds the
    column ``encoded``; it runs on Arrow batches.
    """
    rows = images.select("identifier", "width", "height", "data")
    if encoder is not None:

        def run(frames):
            for pdf in frames:
                coded = [encoder(d, w, h) for d, w, h in zip(pdf["data"], pdf["width"], pdf["height"])]
                yield pdf.assign(encoded=coded)

        rows = rows.mapInPandas(
            run, "identifier string, width int, height int, data binary, encoded binary"
        )
    with in_small_batches(images.sparkSession):
        rows.write.mode("overwrite").parquet(path)


def append_scalars(rows: DataFrame, path: str) -> None:
    """Append (run, tag, step, value) rows to the scalar table."""
    rows.select("run", "tag", F.col("step").cast("bigint").alias("step"), "value").write.mode("append").parquet(path)


def local_file(path: str):
    """Opens a file for writing on a mounted file system, with its folder."""
    import os

    if "://" in path or path.startswith(("hdfs:", "s3:", "viewfs:")):
        raise ValueError(f"{path} is no mounted folder; give an opener of its file system")
    os.makedirs(os.path.dirname(path), exist_ok=True)
    return open(path, "wb")


def write_files(files: DataFrame, path: str, opener: Callable | None = None) -> int:
    """One file per row of ``files`` (name, content) under ``path``; gives their number.

    Each task writes its own rows, where they are; a repeated task overwrites
    its files with the same bytes.  ``opener(path)`` gives a binary file to
    write to, by default one of a mounted folder.  Names are those of files,
    without folders, and unique; null contents are left out.
    """
    opener = opener or local_file
    folder = path[len("file:") :] if path.startswith("file:") else path
    folder = "/" + folder.lstrip("/") if path.startswith("file:") else folder

    def run(frames):
        import pandas as pd

        for pdf in frames:
            for name, content in zip(pdf["name"], pdf["content"]):
                if "/" in name or name in ("", ".", ".."):
                    raise ValueError(f"no name of a file: {name!r}")
                with opener(f"{folder}/{name}") as out:
                    out.write(content)
            yield pd.DataFrame({"n": [len(pdf)]})

    written = files.select("name", "content").where("name is not null and content is not null").mapInPandas(run, "n bigint")
    with in_small_batches(files.sparkSession):
        return written.groupBy().sum("n").first()[0] or 0
