"""Quality classifier: perplexity under a Kneser-Ney model of trusted text.

An interpolated modified Kneser-Ney model of characters is trained on half of the
trusted documents, dealt by hash.  Every document's windows are joined with the
model's tables, which gives its perplexity.  The other trusted documents tell
what is usual in their language: how far their losses lie above the language's
median, less one standard error of the mean loss, which matters for short texts.
A document is accepted up to the ``ACCEPTED`` quantile of that, so the trusted
documents it costs are known.  A language without such documents takes the median
of all its documents, and the deviations of the other languages above it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.numbering import among_first, hash_order
from ..session import materialize
from . import char_lm
from .common import broadcast_if_small

#: Characters of a window.  Windows of three repeat far more often inside a block than longer ones,
#: so the tables that travel stay small.
ORDER = 3
#: The deviations of all languages count as so many documents of a language, so rare ones lean on them smoothly.
POOLED_WEIGHT = 200
#: Share of the trusted documents of the other half that is accepted in each language.
ACCEPTED = 0.97
#: About the standard deviation of the loss of one token, in nats.
TOKEN_SPREAD = 1.5
#: Losses are compared in steps, so a language has a bounded number of different ones.
STEPS = 1000


def training_ids(trusted: DataFrame, size: int | None = None) -> DataFrame:
    """Half of the ids, drawn by hash, and at most ``size`` if that is given.

    The other half gives the limits: a model is surer of texts that it was trained on.
    """
    ids = trusted.select("doc_id").where("doc_id is not null").distinct()
    order, bucket = hash_order("doc_id", "trusted")
    return ids.where(among_first(ids, order, bucket, lambda n: F.least(F.lit(size), F.floor(n / 2)) if size is not None else F.floor(n / 2)))


def perplexities(
    docs: DataFrame, trusted: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang",
    order: int = ORDER, size: int | None = None,
) -> DataFrame:
    """``doc_id, lang, trained, n_tokens, loss``: mean loss per token in nats, of each row of ``docs``."""
    sample = training_ids(trusted, size).withColumn("mark", F.lit(True))
    rows = docs.select(
        F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.coalesce(F.col(lang).cast("string"), F.lit("")).alias("tag")
    )
    blocks = char_lm.text_blocks(rows.join(broadcast_if_small(sample), "doc_id", "left"), order)
    counts = char_lm.gram_counts(blocks).where("marked > 0").select("gram", F.col("marked").alias("c"))
    top = materialize(counts, "grams")
    levels = char_lm.continuation_levels(top, order)
    model = char_lm.kneser_ney(levels).withColumnRenamed("value", "loss")
    losses = char_lm.text_losses(blocks, model, ["loss"], char_lm.vocabulary(levels), order)
    return losses.select(
        "doc_id", F.col("tag").alias("lang"), F.coalesce("mark", F.lit(False)).alias("trained"), "n_tokens",
        (F.col("loss") / F.col("n_tokens")).alias("loss"),
    )


def language_limits(losses: DataFrame, everyone: DataFrame | None = None, accepted: float = ACCEPTED) -> DataFrame:
    """Per language (lang, limit): the limit of a text's loss less its standard error.

    ``losses`` has the calibration rows (lang, n_tokens, loss), ``everyone`` those of
    all documents, which give languages without calibration rows their median.  Quantiles come
    from histograms in steps of 1 / ``STEPS``; those of deviations from the
    language's median are taken per language and over all languages together, and
    the fewer documents a language has, the more the latter count.
    """

    def quantile(value: Column, rows: DataFrame, keys: list[str], q: float, name: str) -> DataFrame:
        bins = rows.groupBy(*keys, F.floor(value * STEPS).cast("bigint").alias("bin")).agg(F.count(F.lit(1)).alias("n"))
        upto = Window.partitionBy(*keys).orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
        ranked = bins.select(
            *keys, "bin", F.sum("n").over(upto).alias("upto"), F.sum("n").over(Window.partitionBy(*keys)).alias("m")
        )
        reached = F.min(F.when(F.col("upto") >= q * F.col("m"), F.col("bin") + 1)) / STEPS
        return ranked.groupBy(*keys).agg(reached.alias(name), F.max("m").alias("m"))

    medians = materialize(quantile(F.col("loss"), losses, ["lang"], 0.5, "median").drop("m"), "medians")
    above = F.col("loss") - F.col("median") - TOKEN_SPREAD / F.sqrt("n_tokens")
    near = losses.join(broadcast_if_small(medians), "lang")
    own = quantile(above, near, ["lang"], accepted, "own")
    # one row per step
    pooled = quantile(above, near, [], accepted, "pooled").first()
    weight = F.col("m") / (F.col("m") + POOLED_WEIGHT)
    among = weight * F.col("own") + (1 - weight) * F.lit(pooled["pooled"] if pooled else None).cast("double")
    limits = own.join(medians, "lang").select("lang", (F.col("median") + among).alias("limit"))
    if everyone is None or pooled is None or pooled["pooled"] is None:
        return limits
    others = everyone.join(broadcast_if_small(medians.select("lang")), "lang", "left_anti")
    middle = quantile(F.col("loss"), others, ["lang"], 0.5, "median")
    return limits.unionByName(middle.select("lang", (F.col("median") + pooled["pooled"]).alias("limit")))


def classify(
    docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", **how
) -> DataFrame:
    """``doc_id, lang, n_tokens, perplexity, limit, kept`` for each row of ``docs``.

    ``labels`` (doc_id, quality, toxic) names trusted documents: good quality and
    not toxic.  A text without words has perplexity null and is not kept; a null
    language is a language of its own, written as empty.  Without trusted
    documents nothing can be judged, and every text with words is kept.
    """
    trusted = labels.where((F.col("quality") == 1) & (F.coalesce("toxic", F.lit(0)) == 0)).select("doc_id").distinct()
    losses = materialize(perplexities(docs, trusted, doc_id, text, lang, **how), "losses")
    known = losses.where(~F.col("trained") & (F.col("n_tokens") > 1)).join(trusted, "doc_id", "left_semi")
    limits = language_limits(known, losses.where("n_tokens > 1"))
    error = TOKEN_SPREAD / F.sqrt("n_tokens")
    judged = losses.join(broadcast_if_small(materialize(limits, "limits")), "lang", "left").withColumn("limit", F.col("limit") + error)
    filled = F.col("n_tokens") > 1
    return judged.select(
        "doc_id", "lang", "n_tokens",
        F.when(filled, F.exp("loss")).alias("perplexity"),
        F.exp("limit").alias("limit"),
        (filled & (F.col("limit").isNull() | (F.col("loss") <= F.col("limit")))).alias("kept"),
    )


def keep_good(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", **how) -> DataFrame:
    """``docs`` without those that the classifier rejects; rows with a null id stay, as no verdict can reach them."""
    verdicts = classify(docs, labels, doc_id, **how)
    bad = verdicts.where(~F.col("kept") & F.col("doc_id").isNotNull()).select(F.col("doc_id").alias(doc_id)).distinct()
    return docs.join(broadcast_if_small(materialize(bad, "rejected")), doc_id, "left_anti").select(*docs.columns)
