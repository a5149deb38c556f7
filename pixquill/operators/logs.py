"""Metric logs: routing into tags, series."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import constants as K


def metric_rows(
    logs: DataFrame,
    metrics: str = "metrics",
    phase: str = "train",
    prefix: str | None = None,
    keep: tuple[str, ...] = ("run", "step"),
) -> DataFrame:
    """Explode a metric map into (run, step, tag, value) rows.

    Training logs route loss, grad_norm and learning_rate to ``training/``,
    other names to ``other/``, and drop names starting with ``eval_``.
    Evaluation logs go to ``evaluation/``.  Values that are not numbers are
    dropped.  With ``prefix`` a column ``prefixed`` holds prefix_name.
    """
    if phase not in ("train", "eval"):
        raise ValueError("phase must be 'train' or 'eval'")
    columns = [c for c in keep if c in logs.columns]
    rows = logs.select(*columns, F.explode(F.map_entries(metrics)).alias("_e")).select(
        *columns,
        F.col("_e.key").alias("_name"),
        F.expr("try_cast(_e.value AS double)").alias("value"),
    ).where(F.col("value").isNotNull())
    name = F.col("_name")
    if phase == "eval":
        tag = F.concat(F.lit(K.TAG_EVALUATION), name)
    else:
        rows = rows.where(~F.startswith(name, F.lit(K.EVAL_PREFIX)))
        main = name.isin(K.TRAINING_METRICS)
        tag = F.when(main, F.concat(F.lit(K.TAG_TRAINING), name)).otherwise(F.concat(F.lit(K.TAG_OTHER), name))
    extra = [F.concat(F.lit(f"{prefix}_"), name).alias("prefixed")] if prefix else []
    return rows.select(*columns, tag.alias("tag"), "value", *extra)


def metric_series(scalars: DataFrame, tags: list[str] | None = None, skip_first: bool = False) -> DataFrame:
    """Points of the given tags; optionally without the first step of a series.

    (run, tag, step) is unique.  The first step comes from a partial aggregate
    and is removed by an anti join whose key includes the step, so a series
    holding most of the log is never ordered in one task.
    """
    points = scalars.where(F.col("tag").isin(tags)) if tags else scalars
    if not skip_first:
        return points
    first = points.groupBy("run", "tag").agg(F.min("step").alias("step"))
    return points.join(first, ["run", "tag", "step"], "left_anti")


def join_series(scalars: DataFrame, tags: list[str]) -> DataFrame:
    """One row per (run, step) with a column per tag."""
    return (
        scalars.where(F.col("tag").isin(tags))
        .groupBy("run", "step")
        .pivot("tag", tags)
        .agg(F.max("value"))
    )
