"""JSON scans: nested documents, arrays, answers, response lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .blocks import JsonArray, read_records, scan_splits, torn_files

VQA_QUESTIONS = "questions array<struct<question_id: bigint, image_id: bigint, question: string>>"
VQA_ANNOTATIONS = (
    "annotations array<struct<question_id: bigint, image_id: bigint, "
    "multiple_choice_answer: string, answer_type: string>>"
)
DUMP = (
    "id string, image string, conversations array<struct<"
    "`from`: string, value: string, role: string, content: string>>"
)
QA_DUMP = "instruction string, input string, output string"
REPLY = "array<array<string>>"
ADDED_TOKENS = "added_tokens array<struct<type: string, token: string, value: string>>"


def read_vqa(spark: SparkSession, questions: str, annotations: str) -> tuple[DataFrame, DataFrame]:
    """The question and annotation documents as tables."""

    def load(path: str, schema: str, field: str) -> DataFrame:
        return unpack(spark.read.schema(schema).option("multiLine", True).json(path), field)

    return load(questions, VQA_QUESTIONS, "questions"), load(annotations, VQA_ANNOTATIONS, "annotations")


def unpack(docs: DataFrame, field: str) -> DataFrame:
    """The records of a nested array field, one row each."""
    return docs.select(F.explode(field).alias("_r")).select("_r.*")


def read_json_array(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The records of files that hold one top-level JSON array each, or several after one another.

    Files are cut into records by many tasks, wherever their splits begin.  A
    document that is no array is one record; a record that is none gives nulls.
    """
    records = read_records(scan_splits(spark, path, JsonArray), JsonArray)
    return records.select(F.from_json("value", schema).alias("_r")).select("_r.*")


def read_answers(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    """(ord, question_id, question, gt_ans, pred_ans) from files of one array of arrays each.

    ``ord`` is the place in the file.  Files are cut by many tasks.  Strict mode
    fails on a file that ends inside its array and on an element that is no
    array; otherwise such an element gives a row of nulls.
    """
    splits = scan_splits(spark, path, JsonArray)
    if strict and not torn_files(splits.changes).isEmpty():
        raise ValueError(f"a file of {path} ends inside its array")
    records = read_records(splits, JsonArray, numbered=True)
    read = F.from_json("value", "array<string>")
    if strict:
        refuse = F.raise_error(F.concat(F.lit("no array of answers: "), F.left("value", F.lit(80))))
        read = F.when(read.isNull(), refuse.cast("array<string>")).otherwise(read)
    return records.select("ord", *_answer(read))


def _answer(item: Column) -> list[Column]:
    names = ["question_id", "question", "gt_ans", "pred_ans"]
    return [F.try_element_at(item, F.lit(i + 1)).alias(n) for i, n in enumerate(names)]


def parse_answers(documents: DataFrame, value: str = "value", strict: bool = True) -> DataFrame:
    """Answer rows of JSON documents, each an array of four-element arrays.

    Strict mode fails on a document that is no such array; otherwise it gives
    one row of nulls, so that it can be counted.
    """
    read = F.from_json(value, REPLY)
    if strict:
        refuse = F.raise_error(F.concat(F.lit("no array of answers: "), F.left(F.col(value), F.lit(80))))
        read = F.when(read.isNull() & F.col(value).isNotNull(), refuse.cast(REPLY)).otherwise(read)
    explode = F.posexplode if strict else F.posexplode_outer
    items = documents.select(explode(read).alias("ord", "_a"))
    return items.select(F.col("ord").cast("bigint").alias("ord"), *_answer(F.col("_a")))


def read_special_tokens(spark: SparkSession, path: str) -> DataFrame:
    """(position, type, token) from a configuration document with
    ``added_tokens``."""
    doc = spark.read.schema(ADDED_TOKENS).option("multiLine", True).json(path)
    return doc.select(F.posexplode("added_tokens").alias("position", "_t")).select(
        "position", F.col("_t.type").alias("type"), F.col("_t.token").alias("token")
    )


def read_llm_responses(spark: SparkSession, path: str) -> DataFrame:
    """Response lines (value, ord) for ``parse_llm_responses``.

    ``ord`` puts lines in the order of the files' names and then of their lines.
    """
    lines = spark.read.text(path)
    return lines.select("value", line_order().alias("ord"))


def line_order() -> Column:
    """Orders the rows of a text scan by file and place in it: a file's splits are read
    as blocks, and a split's rows one after another."""
    within = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    return F.struct(
        F.input_file_name().alias("file"), F.input_file_block_start().alias("block"), within.alias("row")
    )
