"""Batch augmentation with a language model: requests, responses, join-back."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as K
from ..session import scratch
from ..sources.tables import path_exists
from .numbering import QUANTILES, number_rows, quantile_bucket

ANSWER_PATH = "$.response.body.choices[0].message.content"


def request_struct(custom_id: Column, question: Column, answer: Column) -> Column:
    """One batch-API request as a nested struct."""
    content = F.concat(
        F.lit(f"{K.AUGMENT_PROMPT} Question: "), question, F.lit(". Answer: "), answer
    )
    turn = lambda role, c: F.struct(F.lit(role).alias("role"), c.alias("content"))
    body = F.struct(
        F.lit(K.REQUEST_MODEL).alias("model"),
        F.array(turn("system", F.lit(K.AUGMENT_SYSTEM_PROMPT)), turn("user", content)).alias("messages"),
        F.lit(K.REQUEST_MAX_TOKENS).alias("max_tokens"),
    )
    return F.struct(
        custom_id.cast("string").alias("custom_id"),
        F.lit(K.REQUEST_METHOD).alias("method"),
        F.lit(K.REQUEST_URL).alias("url"),
        body.alias("body"),
    )


def llm_requests(
    df: DataFrame,
    key: str,
    question: str = "question",
    answer: str = "multiple_choice_answer",
) -> DataFrame:
    """(custom_id, request) with the request as JSON text; the id is the key."""
    request = request_struct(F.col(key), F.col(question), F.col(answer))
    return df.select(F.col(key).cast("string").alias("custom_id"), F.to_json(request).alias("request"))


def request_batches(df: DataFrame, key: str, batch_size: int = K.REQUEST_BATCH_SIZE, buckets: int = QUANTILES) -> DataFrame:
    """Add the batch number: rows by numeric key, ``batch_size`` to a batch.

    Rows are numbered inside ``buckets`` quantiles of the key, so neither far-off
    keys nor dense ranges put many rows in one of them.  Null keys come first,
    equal keys in any order.
    """
    numbered = number_rows(df, order=[F.col(key)], bucket=quantile_bucket(df, key, buckets), name="_position")
    return numbered.withColumn("batch", F.floor(F.col("_position") / batch_size)).drop("_position")


def parse_llm_responses(lines: DataFrame, output_type: str = "text", line: str = "value", order: str | None = None) -> DataFrame:
    """(custom_id, answer) from response lines.

    "text" keeps the content.  "structured" keeps contents that are JSON
    themselves and drops the rest.  With ``order`` the last answer per id wins.
    """
    if output_type not in ("text", "structured"):
        raise ValueError("output_type not supported")
    parsed = lines.select(
        F.get_json_object(line, "$.custom_id").alias("custom_id"),
        F.get_json_object(line, ANSWER_PATH).alias("answer"),
        *([F.col(order)] if order else []),
    ).where(F.col("custom_id").isNotNull() & F.col("answer").isNotNull())
    if output_type == "structured":
        parsed = parsed.where(F.try_parse_json("answer").isNotNull())
    if order:
        parsed = parsed.groupBy("custom_id").agg(F.max_by("answer", order).alias("answer"))
    return parsed


def join_llm_responses(samples: DataFrame, responses: DataFrame, key: str, order: str | None = None) -> DataFrame:
    """Answers joined back by id, with a status per sample.

    Of several answers for an id the last by ``order`` counts, without one the
    greatest; a sample is never multiplied.
    """
    one = F.max_by("answer", order) if order else F.max("answer")
    answers = responses.groupBy(F.col("custom_id").alias("_id")).agg(one.alias("complete_answer"))
    joined = samples.join(answers, F.col(key).cast("string") == F.col("_id"), "left").drop("_id")
    status = F.when(F.col("complete_answer").isNull(), F.lit("missing")).otherwise(F.lit("answered"))
    return joined.withColumn("status", status)


def augmentation_coverage(joined: DataFrame) -> DataFrame:
    return joined.groupBy("status").agg(F.count(F.lit(1)).alias("n_samples"))


ANSWERS = "custom_id string, answer string, batch bigint, error string"


def llm_augment(
    batched: DataFrame,
    client: Callable[[list[str], int], dict[str, str]],
    path: str | None = None,
) -> DataFrame:
    """Send each batch of (custom_id, request, batch) through a user client.

    ``client(requests, batch)`` returns answers by custom id.  Returns
    (custom_id, answer, batch, error); a batch whose client raises gives one row
    with the error's text and no id.

    Answers are written under ``path`` (a new folder of the shared one by
    default) before they are read, so later actions send nothing again.  With
    the same folder again only batches without answers are sent; a lost executor
    repeats at most the batches of the tasks it was running.
    """
    spark = batched.sparkSession
    path = path or scratch(spark, "answers")
    todo = batched.select("custom_id", "request", F.col("batch").cast("bigint").alias("batch"))
    if path_exists(spark, path):
        done = spark.read.schema(ANSWERS).parquet(path).where("error is null").select("batch").distinct()
        todo = todo.join(done, "batch", "left_anti")

    def send(pdf):
        import pandas as pd

        batch = int(pdf["batch"].iloc[0])
        ordered = pdf.sort_values("custom_id")
        try:
            answers = client(list(ordered["request"]), batch)
            rows = [(i, a, batch, None) for i, a in answers.items()] or [(None, None, batch, None)]
        except Exception as e:  # a failing batch is recorded, the others go on
            rows = [(None, None, batch, str(e) or type(e).__name__)]
        return pd.DataFrame(rows, columns=["custom_id", "answer", "batch", "error"], dtype=object)

    todo.groupBy("batch").applyInPandas(send, ANSWERS).write.mode("append").parquet(path)
    sent = spark.read.schema(ANSWERS).parquet(path)
    # an error of an earlier run does not count once its batch has been answered
    answered = sent.where("error is null").select("batch").distinct()
    return sent.where("error is null").unionByName(sent.where("error is not null").join(answered, "batch", "left_anti").select(*sent.columns))
