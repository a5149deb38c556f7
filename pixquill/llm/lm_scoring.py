"""Cross-entropy difference: how much more a text is like the target than like the corpus.

Two character n-gram models of the same order and smoothing are counted over all
texts: one over the target (texts of good quality), one over everything.  They
share the vocabulary of characters of the whole corpus, and a text's score is
the mean over its tokens of target loss minus background loss; lower is closer
to the target.  Target documents are scored by the model that counted them, as
all documents are by that of the background, so their scores lean to the target.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from . import char_lm
from .common import broadcast_if_small


def cross_entropy_difference(
    docs: DataFrame, target: DataFrame, doc_id: str = "doc_id", text: str = "text", order: int = char_lm.ORDER
) -> DataFrame:
    """``doc_id, n_tokens, target_loss, background_loss, score`` for each row of ``docs``.

    ``target`` has the ids of the target's documents.  Losses are means per
    token in nats; a null or empty text is its end alone.  Without any target
    text the target model is uniform.
    """
    ids = target.select(F.col(doc_id).alias("doc_id")).where("doc_id is not null").distinct().withColumn("mark", F.lit(True))
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.lit("").alias("tag"))
    marked = rows.join(broadcast_if_small(ids), "doc_id", "left")
    blocks = char_lm.text_blocks(marked, order)
    counts = materialize(char_lm.gram_counts(blocks), "grams")
    background = char_lm.raw_levels(counts.select("gram", F.col("n").alias("c")), order)
    wanted = char_lm.raw_levels(counts.where("marked > 0").select("gram", F.col("marked").alias("c")), order)
    model = (
        char_lm.witten_bell(wanted).withColumnRenamed("value", "target_loss")
        .join(char_lm.witten_bell(background).withColumnRenamed("value", "background_loss"), "key", "full")
    )
    names = ["target_loss", "background_loss"]
    losses = char_lm.text_losses(blocks, model, names, char_lm.vocabulary(background), order)
    mean = [(F.col(n) / F.col("n_tokens")).alias(n) for n in names]
    return losses.select("doc_id", "n_tokens", *mean).withColumn("score", F.col(names[0]) - F.col(names[1]))
