"""Fetch outcomes: reports, error classes, progress."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as K
from ..functions import geometry
from ..functions.text import classify_error
from .joins import skew_join


def attach_outcomes(links: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Fetched sizes by identifier (unique in ``outcomes``); rows without an
    outcome keep nulls."""
    return skew_join(links, outcomes, "identifier")


def download_report(
    outcomes: DataFrame,
    total_seconds: Column | float,
    ok: str = "ok",
    elapsed: str = "elapsed",
    width: str = "original_width",
    height: str = "original_height",
) -> DataFrame:
    """One-row report over fetch outcomes.

    ``total_seconds`` is the wall time: a number, or an aggregate column such as
    the spread of start times.  Seconds count successful fetches only.  Ratios
    with a zero denominator are null.
    """
    wall = F.lit(float(total_seconds)) if not isinstance(total_seconds, Column) else total_seconds
    good = F.col(ok)
    act = geometry.action(width, height)
    totals = outcomes.agg(
        F.count(F.lit(1)).alias("total_images"),
        F.count_if(good).alias("downloaded"),
        F.count_if(~F.coalesce(good, F.lit(False))).alias("failed"),
        F.sum(F.when(good, F.col(elapsed))).alias("_seconds"),
        wall.cast("double").alias("total_seconds"),
        F.count_if(good & (act == "crop")).alias("center_cropped"),
        F.count_if(good & (act == "pad")).alias("padded"),
    )
    done = F.col("downloaded").cast("double")
    return totals.select(
        "total_images",
        "downloaded",
        "failed",
        (F.try_divide(done, F.col("total_images").cast("double")) * 100).alias("success_rate"),
        F.try_divide(F.col("_seconds"), done).alias("average_seconds"),
        "total_seconds",
        F.try_divide(done, F.col("total_seconds")).alias("images_per_second"),
        F.try_divide(done, F.col("_seconds")).alias("theoretical_images_per_second"),
        "center_cropped",
        "padded",
    )


def report_text(report: DataFrame, errors: DataFrame) -> DataFrame:
    """The report and its error classes as one text row."""
    classes = errors.agg(
        F.array_sort(F.collect_list(F.format_string(K.REPORT_ERROR_LINE, "error_type", "n_errors")))
    )
    failed = F.concat(F.array(F.lit(K.REPORT_ERRORS_TITLE)), classes.scalar())
    # a ratio without a value leaves its line out
    figures = [F.when(F.col(name).isNotNull(), F.format_string(form, name)) for form, name in K.REPORT_LINES]
    lines = F.array_compact(F.array(F.lit(K.REPORT_TITLE), F.lit(K.REPORT_RULE), *figures, F.lit(K.REPORT_RULE)))
    return report.select(
        F.array_join(F.when(F.col("failed") > 0, F.concat(lines, failed)).otherwise(lines), "\n").alias("value")
    )


def error_types(outcomes: DataFrame, ok: str = "ok", error: str = "error") -> DataFrame:
    """Failure counts per error class; an unrecorded outcome is a failure, as in the report."""
    return (
        outcomes.where(~F.coalesce(ok, F.lit(False)))
        .groupBy(classify_error(F.coalesce(error, F.lit(""))).alias("error_type"))
        .agg(F.count(F.lit(1)).alias("n_errors"))
    )


def failures(outcomes: DataFrame) -> DataFrame:
    """The failed downloads, unrecorded outcomes among them, as a table."""
    return outcomes.where(~F.coalesce("ok", F.lit(False))).select(F.col("image_url").alias("url"), "identifier", "error")


def ingest_progress(manifest: DataFrame, group: str, done: Column, batch: str = "batch_id") -> DataFrame:
    """Per group: rows, rows done, whole percent, latest batch with done rows."""
    return manifest.groupBy(group).agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(done).alias("processed"),
        F.floor(F.count_if(done) * 100 / F.count(F.lit(1))).alias("percent"),
        F.max(F.when(done, F.col(batch))).alias("latest_batch"),
    )
