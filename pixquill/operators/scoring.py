"""Yes/no benchmark scoring."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import constants as K
from ..functions.text import parse_yes_no, strip


def task_types(spark: SparkSession) -> DataFrame:
    """The 14 benchmark tasks and their evaluation type."""
    rows = [
        F.struct(F.lit(task).alias("category"), F.lit(kind).alias("eval_type"))
        for kind, tasks in K.TASK_TYPES.items()
        for task in tasks
    ]
    return spark.range(1).select(F.inline(F.array(*rows)))


def format_answers(answers: DataFrame) -> DataFrame:
    """(category, img_name, question, gt_ans, pred_ans) from raw answers.

    The question id is "category/image"; texts are stripped, and line breaks are
    deleted from the prediction.
    """
    return answers.select(
        F.split_part("question_id", F.lit("/"), F.lit(1)).alias("category"),
        strip(F.split_part("question_id", F.lit("/"), F.lit(2))).alias("img_name"),
        strip("question").alias("question"),
        strip("gt_ans").alias("gt_ans"),
        strip(F.replace(F.col("pred_ans"), F.lit("\n"), F.lit(""))).alias("pred_ans"),
    )


def judge(answers: DataFrame, strict: bool = True) -> DataFrame:
    """Add ``gt`` and ``pred`` labels; strict mode fails on a truth that is
    neither yes nor no."""
    gt = F.lower("gt_ans")
    if strict:
        gt = F.when(gt.isin("yes", "no"), gt).otherwise(
            F.raise_error(F.concat(F.lit("ground truth is not yes/no: "), F.coalesce("gt_ans", F.lit("null"))))
        )
    return answers.withColumns({"gt": gt, "pred": parse_yes_no("pred_ans")})


def mme_pairs(judged: DataFrame, pair: str | Column, category: str = "category", strict: bool = True) -> DataFrame:
    """One row per (category, pair): question count, correct, other.

    ``pair`` identifies the image: a column, or ``floor(position / 2)`` of the
    position inside the category.  Strict mode fails on a pair without exactly
    two questions.
    """
    pair = F.col(pair) if isinstance(pair, str) else pair
    pairs = judged.groupBy(F.col(category).alias("category"), pair.alias("pair")).agg(
        F.count(F.lit(1)).alias("questions"),
        F.count_if(F.col("gt") == F.col("pred")).alias("correct"),
        F.count_if(F.col("pred") == "other").alias("other"),
    )
    if strict:
        checked = F.when(F.col("questions") == 2, F.col("questions")).otherwise(
            F.raise_error(F.concat(F.lit("incomplete pair in "), F.col("category")))
        )
        pairs = pairs.withColumn("questions", checked)
    return pairs


def incomplete_pairs(pairs: DataFrame) -> DataFrame:
    return pairs.where(F.col("questions") != 2)


def mme_scores(pairs: DataFrame) -> DataFrame:
    """Per category: counts, accuracy, accuracy+ and score (all in percent)."""
    sums = pairs.groupBy("category").agg(
        F.sum("questions").alias("questions"),
        F.sum("correct").alias("correct"),
        F.count(F.lit(1)).alias("images"),
        F.count_if(F.col("correct") == 2).alias("both_correct"),
        F.sum("other").alias("other"),
    )
    acc = F.col("correct") / F.col("questions") * 100
    plus = F.col("both_correct") / F.col("images") * 100
    return sums.withColumns({"acc": acc, "acc_plus": plus, "score": acc + plus})


def mme_rollup(scores: DataFrame, tasks: DataFrame) -> DataFrame:
    """Score sums per evaluation type, plus the row "total"."""
    typed = scores.join(tasks, "category")
    return (
        typed.rollup("eval_type")
        .agg(F.sum("score").alias("score"), F.count(F.lit(1)).alias("tasks"))
        .withColumn("eval_type", F.coalesce("eval_type", F.lit("total")))
    )


def confusion(judged: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Confusion counts, accuracy, precision and recall, per group or overall.

    Accuracy counts "other" as wrong; the matrix leaves "other" out; precision
    and recall are 0 on an empty denominator.
    """
    gt, pred = F.col("gt"), F.col("pred")
    counts = judged.groupBy(*(by or [])).agg(
        F.count_if((gt == "yes") & (pred == "yes")).alias("tp"),
        F.count_if((gt == "yes") & (pred == "no")).alias("fn"),
        F.count_if((gt == "no") & (pred == "yes")).alias("fp"),
        F.count_if((gt == "no") & (pred == "no")).alias("tn"),
        F.count_if(pred == "other").alias("other_num"),
        F.avg((gt == pred).cast("double")).alias("acc"),
    )
    tp = F.col("tp").cast("double")
    return counts.withColumns(
        {
            "precision": F.coalesce(F.try_divide(tp, F.col("tp") + F.col("fp")), F.lit(0.0)),
            "recall": F.coalesce(F.try_divide(tp, F.col("tp") + F.col("fn")), F.lit(0.0)),
        }
    )
