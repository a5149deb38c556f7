"""Typed inputs of the operators, derived from the given tables.

Every view covers the whole table it is made from.  Values the tables lack
(image sizes, outcomes, duplicates) are functions of a key hash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import constants as K
from ..functions.rand import hash_uniform
from ..operators.numbering import number_rows
from ..operators.similarity import label_centroids

TASKS = [task for tasks in K.TASK_TYPES.values() for task in tasks]

ERROR_MESSAGES = [
    "HTTPSConnectionPool: Read timed out. (read Timeout=5)",
    "Failed to establish a new connection: refused",
    "404 Client Error: Not Found for url",
    "EOF occurred in SSL handshake",
    "Cannot allocate memory",
    "cannot identify image file",
]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _digest_int(key: Column, start: int, length: int = 4) -> Column:
    return F.conv(F.substring(F.md5(key), start, length), 16, 10).cast("int")


def links(spark, sf_dir) -> DataFrame:
    url = F.col("url")
    return table(spark, sf_dir, "pages").select(
        "page_id",
        url.alias("image_url"),
        F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("capsfusion"),
        (_digest_int(url, 1) % 1500 + 64).alias("original_width"),
        (_digest_int(url, 5) % 1500 + 64).alias("original_height"),
    )


def link_manifest(spark, sf_dir) -> DataFrame:
    """Two cached identifiers for about 40 % of the links, by page: some pages share a link."""
    known = links(spark, sf_dir).where(hash_uniform("page_id", "cache") < 0.4)
    name = F.col("page_id").cast("string")
    return known.select(
        "page_id",
        "image_url",
        F.explode(F.array(F.concat(F.lit("b-"), name), F.concat(F.lit("a-"), name))).alias("identifier"),
    )


def fetches(spark, sf_dir) -> DataFrame:
    events = table(spark, sf_dir, "events")
    ok = F.col("event_type") != "error"
    # the outcome of about 2 % was never recorded
    recorded = F.when(hash_uniform("event_id", "lost") >= 0.02, ok)
    key = F.col("event_id").cast("string")
    k = F.get_json_object("props", "$.k").cast("int")
    messages = F.array(*[F.lit(m) for m in ERROR_MESSAGES])
    return events.select(
        "event_id",
        "ts",
        key.alias("identifier"),
        (F.col("user_id") % 29).alias("subset"),
        F.floor(F.col("event_id") / 1000).alias("batch_id"),
        recorded.alias("ok"),
        F.col("value").alias("elapsed"),
        F.when(~ok, F.element_at(messages, (k % 6 + 1).cast("int"))).alias("error"),
        F.when(recorded, _digest_int(key, 1) % 1500 + 64).alias("original_width"),
        F.when(recorded, _digest_int(key, 5) % 1500 + 64).alias("original_height"),
    )


def turn_key(turn: Column | None = None) -> Column:
    """Id of a turn of a conversation, without a bound on the number of turns."""
    name = F.concat_ws(":", "conv_id", turn if turn is not None else F.col("turn"))
    return F.conv(F.substring(F.md5(name), 1, 15), 16, 10).cast("bigint")


def it_samples(spark, sf_dir) -> DataFrame:
    """One instruction sample per user turn and per answer: a question, the
    answer of the next turn, and the conversation's first system turn.

    A question without an answer has null outputs, an answer to no question null
    inputs, so every user and assistant turn is in exactly one sample.
    """
    turns = table(spark, sf_dir, "conversations")
    asked = turns.where(F.col("role") == "user").select("conv_id", "turn", F.col("text").alias("inputs"))
    answered = turns.where(F.col("role") == "assistant").select(
        "conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("outputs")
    )
    system = turns.where(F.col("role") == "system").groupBy("conv_id").agg(F.min_by("text", "turn").alias("instruction"))
    return (
        asked.join(answered, ["conv_id", "turn"], "full").join(system, "conv_id", "left")
        .select(turn_key().alias("sample_id"), "conv_id", "instruction", "inputs", "outputs")
    )


def dump(spark, sf_dir) -> DataFrame:
    """Documents as nested dialogs: one turn per line, speakers alternating."""
    speaker = [F.lit("human"), F.lit("gpt"), F.lit("tool")]

    def turn(line: Column, i: Column) -> Column:
        who = F.when(i % 3 == 0, speaker[0]).when(i % 3 == 1, speaker[1]).otherwise(speaker[2])
        value = F.when(i == 0, F.concat(F.lit(K.DUMP_PLACEHOLDER), line)).otherwise(line)
        return F.struct(who.alias("from"), value.alias("value"))

    return table(spark, sf_dir, "documents").select(
        "doc_id", F.transform(F.split("text", "\n"), turn).alias("conversations")
    )


def vqa_questions(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "conversations").where(F.col("role") == "user").select(
        turn_key().alias("question_id"),
        F.col("conv_id").alias("image_id"),
        F.col("text").alias("question"),
    )


def vqa_annotations(spark, sf_dir) -> DataFrame:
    qid = turn_key(F.col("turn") - 1)
    return table(spark, sf_dir, "conversations").where(F.col("role") == "assistant").select(
        qid.alias("question_id"),
        F.col("conv_id").alias("image_id"),
        F.col("text").alias("multiple_choice_answer"),
        F.when(hash_uniform(qid, "answer_type") < 0.5, F.lit("other")).otherwise(F.lit("yes/no")).alias("answer_type"),
    )


def mme_answers(spark, sf_dir) -> DataFrame:
    """All labelled documents as benchmark answers; two neighbours in the order
    of ids make an image, and the last may stay alone."""
    labels = number_rows(
        table(spark, sf_dir, "labels").select("doc_id", "quality"),
        order=[F.col("doc_id")], bucket=F.floor(F.col("doc_id") / 1000), name="position",
    ).withColumn("pair", F.floor(F.col("position") / 2))
    texts = table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("pred_ans"))
    names = F.array(*[F.lit(t) for t in TASKS])
    return labels.join(texts, "doc_id").select(
        "doc_id",
        "pair",
        F.element_at(names, (F.col("pair") % len(TASKS) + 1).cast("int")).alias("category"),
        F.when(F.col("quality") == 1, F.lit("Yes")).otherwise(F.lit("No")).alias("gt_ans"),
        "pred_ans",
    )


def items(spark, sf_dir) -> DataFrame:
    """Embeddings to classify; about 2 % lost their image, about 2 % are all zero."""
    blank = F.transform("embedding", lambda x: x * 0)
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("id"),
        F.when(hash_uniform("vec_id", "broken") < 0.02, None)
        .when(hash_uniform("vec_id", "blank") < 0.02, blank)
        .otherwise(F.col("embedding")).alias("embedding"),
    )


def taxonomy(spark, sf_dir) -> DataFrame:
    """A label per embedding label, and some whose vector is null or all zero."""
    blank = F.when(F.col("vec_id") % 2 == 0, F.transform("embedding", lambda x: (x * 0).cast("double")))
    empty = table(spark, sf_dir, "embeddings").where(hash_uniform("vec_id", "empty") < 0.05).select(
        F.concat(F.lit("empty "), F.col("vec_id").cast("string")).alias("label"), blank.alias("embedding")
    )
    centroids = label_centroids(table(spark, sf_dir, "embeddings"))
    return centroids.select(F.col("label").cast("string").alias("label"), "embedding").unionByName(empty)


def patches(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(
        F.floor(F.col("vec_id") / 16).alias("image_id"),
        (F.col("vec_id") % 16).cast("int").alias("patch_idx"),
        "embedding",
    )


def caption_pairs(spark, sf_dir) -> DataFrame:
    answers = vqa_annotations(spark, sf_dir).select("question_id", F.col("multiple_choice_answer").alias("gen"))
    asked = vqa_questions(spark, sf_dir).select(
        "question_id",
        (F.col("image_id") % 2).alias("rank"),
        F.floor(F.col("image_id") / 16).alias("batch"),
        F.col("question").alias("ref"),
    )
    return asked.join(answers, "question_id")


def scalars(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        F.concat(F.lit("run"), (F.col("user_id") % 3).cast("string")).alias("run"),
        F.col("event_type").alias("tag"),
        F.col("event_id").alias("step"),
        "value",
    )


def metric_logs(spark, sf_dir) -> DataFrame:
    value = F.col("value")
    entries = F.create_map(
        F.lit("loss"), value.cast("string"),
        F.lit("learning_rate"), (value / 1000).cast("string"),
        F.lit("eval_loss"), value.cast("string"),
        F.lit("note"), F.lit("n/a"),
        F.col("event_type"), F.get_json_object("props", "$.k"),
    )
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("step"), entries.alias("metrics"))


def _response(custom_id: Column, content: Column) -> Column:
    choice = F.struct(F.struct(content.alias("content")).alias("message"))
    body = F.struct(F.array(choice).alias("choices"))
    return F.to_json(
        F.struct(custom_id.cast("string").alias("custom_id"), F.struct(body.alias("body")).alias("response"))
    )


def response_lines(spark, sf_dir, structured: bool = False) -> DataFrame:
    """Response lines for the annotations: about 5 % cut short, about 20 %
    never returned.  Structured contents are JSON for about half of them."""
    qid = F.col("question_id")
    content = F.col("multiple_choice_answer")
    if structured:
        content = F.when(
            hash_uniform(qid, "json") < 0.5, F.to_json(F.struct(content.alias("answer")))
        ).otherwise(content)
    line = _response(qid, content)
    cut = F.when(hash_uniform(qid, "cut") < 0.05, F.substring(line, 1, 20)).otherwise(line)
    answered = vqa_annotations(spark, sf_dir).where(hash_uniform(qid, "returned") < 0.8)
    return answered.select(cut.alias("value"), qid.alias("ord"))


def repeated_response_lines(spark, sf_dir) -> DataFrame:
    """Several answers per conversation under one id, ordered by turn."""
    return table(spark, sf_dir, "conversations").where(F.col("role") == "assistant").select(
        _response(F.col("conv_id"), F.col("text")).alias("value"), F.col("turn").alias("ord")
    )


def decoded_samples(spark, sf_dir) -> DataFrame:
    """Decoded generations: some without a reply marker, some with two."""
    u = hash_uniform("sample_id", "decoded")
    marker = F.lit(K.REPLY_MARKER)
    reply = F.coalesce("outputs", F.lit(""))
    tail = F.when(u < 0.1, reply).when(u > 0.8, F.concat(marker, reply, marker, F.lit("again"))).otherwise(
        F.concat(marker, reply)
    )
    return it_samples(spark, sf_dir).select(
        "sample_id", F.concat(F.lit("user\n\n"), F.coalesce("inputs", F.lit("")), tail).alias("decoded")
    )


def model_requests(spark, sf_dir) -> DataFrame:
    """Interactive requests from user turns: some blank, some with an image, a few with a broken one."""
    key = turn_key()
    u = hash_uniform(key, "request")
    image = F.concat(F.lit("data:image/png;base64,"), F.base64(F.encode("text", "UTF-8")))
    return table(spark, sf_dir, "conversations").where(F.col("role") == "user").select(
        key.alias("request_id"),
        F.when(u < 0.1, F.lit(" \n ")).when(u < 0.3, F.concat(F.lit(K.PLACEHOLDER), F.col("text"))).otherwise(
            F.concat(F.lit("  "), F.col("text"), F.lit(" \n"))
        ).alias("message"),
        F.when(u > 0.95, F.lit("data:image/png;base64")).when(u > 0.2, image).alias("image"),
    )
