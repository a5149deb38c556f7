"""Token tables: chat tokens, label masks, vocabulary, padded batches."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import constants as K
from ..functions import chat
from ..session import small_batches
from .joins import skew_join
from .numbering import digest_bucket, number_rows

HEAD_VOCABULARY = 4096


def tokenize_chat(
    df: DataFrame,
    messages: str = "messages",
    tokenizer: Callable[[Column], Column] | None = None,
    add_generation_prompt: bool = False,
) -> DataFrame:
    """Add ``input_ids``, ``attention_mask`` and ``assistant_masks``.

    ``tokenizer`` maps an array<string> column of rendered pieces to an
    array<array<int>> column, for example a pandas UDF around a sub-word model.
    The default cuts word tokens and hashes them into the base vocabulary.
    """
    segs = chat.segments(messages, add_generation_prompt)
    if tokenizer is None:
        cut = df.withColumn("_cut", chat.segment_tokens(segs))
        out = cut.withColumns(
            {
                "input_ids": chat.hashed_ids(F.flatten(F.transform("_cut", lambda s: s["tokens"]))),
                "assistant_masks": chat.assistant_mask("_cut"),
            }
        ).drop("_cut")
    else:
        pieces = F.arrays_zip(
            tokenizer(F.transform("_segs", lambda s: s["text"])).alias("tokens"),
            F.transform("_segs", lambda s: s["generated"]).alias("generated"),
        )
        out = (
            df.withColumn("_segs", segs)
            .withColumn("_cut", pieces)
            .withColumns(
                {
                    "input_ids": F.flatten(F.transform("_cut", lambda s: s["tokens"])),
                    "assistant_masks": chat.assistant_mask("_cut"),
                }
            )
            .drop("_segs", "_cut")
        )
    return out.withColumn("attention_mask", F.array_repeat(F.lit(1), F.size("input_ids")))


def tokenize_offsets(
    df: DataFrame, tokenizer: Callable[[Column], Column], messages: str = "messages", add_generation_prompt: bool = False
) -> DataFrame:
    """Add ``input_ids``, ``attention_mask`` and ``assistant_masks`` from a sub-word tokenizer of whole texts.

    ``tokenizer`` maps the rendered text to an array of struct(id, start, end), the
    places in characters, for example a pandas UDF around a tokenizer with offsets.
    It sees the text uncut, so its tokens may lie across the edge of an assistant's
    content; such a token is in the mask, as the ones inside are.  Texts go to
    Python some hundred at a time, as their tokens take far more room.
    """
    small_batches(df.sparkSession)
    segs = chat.segments(messages, add_generation_prompt)
    cut = df.withColumn("_segs", segs).withColumns(
        {"_tokens": tokenizer(F.array_join(F.transform("_segs", lambda s: s["text"]), "")), "_spans": chat.generated_spans("_segs")}
    )
    out = cut.withColumns(
        {"input_ids": F.transform("_tokens", lambda t: t["id"]), "assistant_masks": chat.offset_mask("_tokens", "_spans")}
    ).drop("_segs", "_tokens", "_spans")
    return out.withColumn("attention_mask", F.array_repeat(F.lit(1), F.size("input_ids")))


def create_labels(df: DataFrame) -> DataFrame:
    """Extend ``assistant_masks`` over the end of turn and add ``labels``."""
    extended = df.withColumn("assistant_masks", chat.extend_mask("assistant_masks"))
    return extended.withColumn("labels", chat.labels("input_ids", "assistant_masks"))


def pad_batch(
    df: DataFrame,
    batch: str,
    fill: dict[str, int],
    side: str = "right",
    length_of: str = "input_ids",
) -> DataFrame:
    """Pad array columns to the longest row of their batch.

    ``fill`` maps each array column to its padding value.  A batch holds at most
    the training batch size, so the window partitions stay small.
    """
    if side not in ("left", "right"):
        raise ValueError("side must be 'left' or 'right'")
    longest = F.max(F.size(length_of)).over(Window.partitionBy(batch))
    sized = df.withColumn("_gap", longest - F.size(length_of))
    padded = {}
    for name, value in fill.items():
        padding = F.array_repeat(F.lit(value), F.col("_gap"))
        parts = [F.col(name), padding] if side == "right" else [padding, F.col(name)]
        padded[name] = F.concat(*parts)
    return sized.withColumns(padded).drop("_gap")


def collate(df: DataFrame, batch: str, order: str, columns: list[str]) -> DataFrame:
    """One row per batch with each column gathered into a list, in order."""
    item = F.struct(F.col(order).alias("_o"), *columns)
    gathered = df.groupBy(batch).agg(F.sort_array(F.collect_list(item)).alias("_items"))

    def field(name: str) -> Column:
        return F.transform("_items", lambda item: item[name]).alias(name)

    return gathered.select(batch, *[field(c) for c in columns])


def collate_batches(df: DataFrame, fn: Callable, schema: str, batch: str = "batch") -> DataFrame:
    """User collate function on training batches: the frame of one batch in, a frame out.

    All rows of a batch are in its frame, whatever the partitioning; a batch
    holds at most the training batch size.
    """
    return df.groupBy(batch).applyInPandas(fn, schema)


# --- vocabulary -------------------------------------------------------------


def build_vocab(tokens: DataFrame, token: str = "token", base: int | None = None) -> DataFrame:
    """Vocabulary (token, n, token_id) by falling frequency.

    Ties are ordered by the first three hex digits of the token's md5, then by
    token.  Added tokens take the ids after the corpus tokens, in their fixed
    order (or after ``base`` when the base size is given).
    """
    added = [t for _, t in K.ADDED_TOKENS]
    counts = tokens.where(~F.col(token).isin(added)).groupBy(F.col(token).alias("token")).agg(
        F.count(F.lit(1)).alias("n")
    )
    ranked = number_rows(
        counts,
        order=[F.col("token")],
        bucket=digest_bucket("token"),
        lead=["n"],
        lead_order=[F.col("n").desc()],
        name="token_id",
    )
    specials = F.array(*[F.lit(t) for t in added])
    size = F.lit(base).cast("bigint") if base is not None else F.col("_size")
    extra = (
        # counting over n keeps the aggregate, and so its shuffle, the same as above
        counts.agg(F.count_if(F.col("n") > 0).alias("_size"))
        .select("_size", F.posexplode(specials).alias("_i", "token"))
        .select("token", F.lit(0).cast("bigint").alias("n"), (size + F.col("_i")).cast("bigint").alias("token_id"))
    )
    return ranked.select("token", "n", "token_id").unionByName(extra)


def special_token_map(tokens: DataFrame, base: int = K.BASE_VOCAB_SIZE) -> DataFrame:
    """(type, token, id) of an added-token table (position, type, token): ids
    follow the base vocabulary in table order."""
    return tokens.select(
        "type", "token", (F.lit(base) + F.col("position")).cast("int").alias("id")
    )


def lookup_token_ids(tokens: DataFrame, vocab: DataFrame, unknown: int = -1, complete: bool = False) -> DataFrame:
    """Add ``token_id`` to a long table with a ``token`` column.

    The most frequent tokens (ids below a constant, hence of bounded size) and
    the added tokens, which stand many times in a sample though their ids come
    last, are broadcast and never shuffled.  The remaining rows join the rest of
    the vocabulary; a frequent token that it lacks is dealt over all tasks.  With
    ``complete``, for a vocabulary built from these very tokens, no frequent one
    is left outside the first, so none is looked for.
    """
    ids = vocab.select("token", "token_id")
    first = (F.col("token_id") < HEAD_VOCABULARY) | F.col("token").isin([t for _, t in K.ADDED_TOKENS])
    head = F.broadcast(ids.where(first))
    common = tokens.join(head, "token")
    others, rest = tokens.join(head, "token", "left_anti"), ids.where(~first)
    rare = others.join(rest, "token", "left") if complete else skew_join(others, rest, "token")
    rare = rare.withColumn("token_id", F.coalesce("token_id", F.lit(unknown).cast("bigint")))
    return common.unionByName(rare)


# --- image token alignment --------------------------------------------------


def align_patches(
    samples: DataFrame,
    patches: DataFrame,
    image_token_id: int,
    sample: str = "sample_id",
    ids: str = "input_ids",
    patch_rank: str = "patch_rank",
) -> DataFrame:
    """Match the i-th image token of a sample with its i-th patch row.

    Ranks come from the filtered position array of the row itself, so only the
    (sample, rank) join shuffles.
    """
    indexed = F.transform(ids, lambda t, i: F.struct(i.alias("position"), t.alias("token_id")))
    slots = F.filter(indexed, lambda s: s["token_id"] == image_token_id)
    positions = samples.select(sample, F.posexplode(slots).alias(patch_rank, "_slot")).select(
        sample, patch_rank, F.col("_slot.position").alias("position")
    )
    return positions.join(patches, [sample, patch_rank], "inner")
