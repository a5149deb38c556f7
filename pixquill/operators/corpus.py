"""Operators on link, subset and sample tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import constants as K
from ..functions import chat, geometry, imagebytes, rand, text
from .joins import skew_join
from .numbering import number_rows


def require_columns(df: DataFrame, names: list[str]) -> DataFrame:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"missing required columns: {', '.join(missing)}")
    return df


# --- identifiers ------------------------------------------------------------


def latest_identifiers(manifest: DataFrame, key: str = "image_url") -> DataFrame:
    """One identifier per URL (or other key of a link), so that a join keeps the link row count."""
    return manifest.groupBy(key).agg(F.min("identifier").alias("identifier"))


def join_identifiers(links: DataFrame, manifest: DataFrame, key: str = "image_url") -> DataFrame:
    """Links with their cached identifier, null where there is none.

    Rows that share a URL share its identifier; with another ``key`` each has that of its key.
    """
    return skew_join(links, latest_identifiers(manifest, key), key)


def assign_identifier(links: DataFrame, manifest: DataFrame | None = None, key: str = "image_url") -> DataFrame:
    """Identifier from the manifest where known, else the md5 of the URL."""
    fresh = F.md5("image_url")
    if manifest is None:
        return links.withColumn("identifier", fresh)
    return join_identifiers(links, manifest, key).withColumn("identifier", F.coalesce("identifier", fresh))


def not_done(links: DataFrame, manifest: DataFrame) -> DataFrame:
    """Links whose identifier is not in the manifest: the work left to do."""
    return skew_join(links, manifest, "identifier", "left_anti")


# --- image geometry ---------------------------------------------------------


def image_plan(
    df: DataFrame,
    size: int = K.IMAGE_SIZE,
    threshold: float = K.CROP_THRESHOLD,
    width: str = "original_width",
    height: str = "original_height",
) -> DataFrame:
    """Add action, scaled size, offsets and validity of each image.

    ``offset`` is the corner of the cut window for "crop" and the paste position
    for "pad".  Unknown sizes give nulls; a side scaled to zero is not valid.
    """
    act = geometry.action(width, height, threshold)
    crop = geometry.crop_geometry(width, height, size)
    pad = geometry.pad_geometry(width, height, size)
    planned = df.withColumns(
        {"aspect": geometry.aspect_ratio(width, height), "action": act}
    ).withColumns(
        {
            name: F.when(F.col("action") == "crop", crop[name]).when(F.col("action") == "pad", pad[name])
            for name in crop
        }
    )
    valid = (F.col("scaled_w") > 0) & (F.col("scaled_h") > 0)
    return planned.withColumn("valid", F.coalesce(valid, F.lit(False)))


def aspect_histogram(df: DataFrame, width: str, height: str, bins: int = 20) -> DataFrame:
    """Image counts per aspect-ratio bin; ratio 1 falls into the last bin."""
    ratio = geometry.aspect_ratio(width, height)
    slot = F.least(F.floor(ratio * bins), F.lit(bins - 1)).cast("int")
    return (
        df.select(slot.alias("bin"))
        .where(F.col("bin").isNotNull())
        .groupBy("bin")
        .agg(F.count(F.lit(1)).alias("images"))
        .withColumns({"low": F.col("bin") / F.lit(float(bins)), "high": (F.col("bin") + 1) / F.lit(float(bins))})
    )


# --- sample building --------------------------------------------------------


def adapt_pretrain(df: DataFrame, seed: str = "caption", key: str = "identifier", folder: str = "images/") -> DataFrame:
    """Caption rows to training samples with a random caption prompt."""
    u = rand.hash_uniform(key, seed)
    return df.select(
        F.lit(K.CAPTION_INSTRUCTION).alias("instruction"),
        rand.choose(u, K.CAPTION_PROMPTS).alias("inputs"),
        F.col("capsfusion").alias("outputs"),
        F.concat(F.lit(folder), F.col("identifier"), F.lit(".jpg")).alias("image_path"),
    )


def mix_prompts(df: DataFrame, key: str, seed: str = "mix") -> DataFrame:
    """Three-way mix of instruction and inputs, drawn per row from its key."""
    draw = rand.hash_uniform(key, seed)
    drawn = df.withColumn("_u", draw)
    instruction, inputs = text.mix_prompt("instruction", "inputs", F.col("_u"))
    return drawn.withColumns({"instruction": instruction, "inputs": inputs}).drop("_u")


def keep_fetched(df: DataFrame, width: str = "original_width") -> DataFrame:
    return df.where(F.col(width).isNotNull())


def keep_valid_images(samples: DataFrame, images: DataFrame, path: str = "image_path") -> DataFrame:
    """Samples whose image is in the table of decodable images."""
    return skew_join(samples, images, path, "left_semi")


def validation_summary(samples: DataFrame, images: DataFrame, path: str = "image_path") -> DataFrame:
    """One row: initial, valid and removed sample counts."""
    # samples collapse to one count per path before the join
    per_path = samples.groupBy(path).agg(F.count(F.lit(1)).alias("n"))
    known = images.select(path).distinct().withColumn("ok", F.lit(True))
    return per_path.join(known, path, "left").agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("initial_rows"),
        F.coalesce(F.sum(F.when(F.col("ok"), F.col("n"))), F.lit(0)).alias("valid_rows"),
        F.coalesce(F.sum(F.when(F.col("ok").isNull(), F.col("n"))), F.lit(0)).alias("removed_rows"),
    )


def decode_images(df: DataFrame, images: str = "image_base64_str") -> DataFrame:
    """Replace the base64 array by bytes and header size; bad payloads are null."""
    decoded = df.withColumn("content", imagebytes.decode_base64(images)).drop(images)
    width, height = imagebytes.header_size("content")
    return decoded.withColumns({"width": width, "height": height})


# --- subsets ----------------------------------------------------------------


def union_subsets(frames: dict[str, DataFrame]) -> DataFrame:
    """Union of named tables with differing columns, absent ones null."""
    tagged = [df.withColumn("subset", F.lit(name)) for name, df in frames.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged)


def dense_image_ids(
    df: DataFrame,
    subset: str = "subset",
    position: str = "position",
    subsets: list[str] | None = None,
    chunk: int = K.CHUNK_ROWS,
    name: str = "image_id",
) -> DataFrame:
    """Global ids 0..n-1: subsets in the given order (else by name), rows by
    their integer position inside the subset."""
    if subsets:
        rank = F.array_position(F.array(*[F.lit(s) for s in subsets]), F.col(subset))
        lead_order = [F.when(rank > 0, rank).otherwise(len(subsets) + 1), F.col(subset)]
    else:
        lead_order = [F.col(subset)]
    return number_rows(
        df,
        order=[F.col(position)],
        bucket=F.floor(F.col(position) / chunk),
        lead=[subset],
        lead_order=lead_order,
        name=name,
    )


def offset_image_ids(
    df: DataFrame,
    subsets: list[str],
    subset: str = "subset",
    position: str = "position",
    name: str = "image_id",
) -> DataFrame:
    """Global ids as the start of the subset plus the position, for positions
    that already run 0..n-1 inside each subset.

    Subsets that are not listed follow in the order of their names, as in
    ``dense_image_ids``.  Only the sizes of the subsets are aggregated; rows,
    which may carry image bytes, stay where they are.
    """
    rank = F.array_position(F.array(*[F.lit(s) for s in subsets]), F.col(subset))
    order = [F.when(rank > 0, rank).otherwise(len(subsets) + 1), F.col(subset)]
    sizes = df.groupBy(F.coalesce(subset, F.lit("")).alias(subset)).agg(F.count(F.lit(1)).alias("_n"))
    earlier = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(subset, F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_start"))
    lookup = starts.agg(F.map_from_entries(F.collect_list(F.struct(subset, "_start")))).scalar()
    placed = df.withColumn("_starts", lookup)
    start = F.try_element_at("_starts", F.coalesce(subset, F.lit("")))
    return placed.withColumn(name, start + F.col(position)).drop("_starts")


# --- VQA --------------------------------------------------------------------


def vqa_join(questions: DataFrame, annotations: DataFrame) -> DataFrame:
    return questions.join(annotations, ["question_id", "image_id"], "inner")


def vqa_prompts(joined: DataFrame, folder: str = "VQA/") -> DataFrame:
    """(image_id, image_path, prompt) from joined questions and answers."""
    answer = text.vqa_answer("multiple_choice_answer", "answer_type")
    return joined.select(
        "image_id",
        F.concat(F.lit(folder), F.col("image_id").cast("string")).alias("image_path"),
        text.vqa_prompt("question", answer).alias("prompt"),
    )


# --- conversations ----------------------------------------------------------


def normalize_dump(df: DataFrame, conversations: str = "conversations") -> DataFrame:
    """Nested foreign dump to ``messages``."""
    fields = set(df.schema[conversations].dataType.elementType.fieldNames())
    turns = chat.unify_turns(conversations, fields)
    return df.withColumn("messages", chat.normalize_conversation(turns)).drop(conversations)


def normalize_turns(turns: DataFrame, conversation: str, turn: str, role: str, content: str) -> DataFrame:
    """The same normalisation on a long table of turns, as (conversation, turn,
    role, content) with the system message at turn -1.

    Rows are converted where they are; a conversation of any length is never
    gathered.
    """
    system = turns.select(conversation).distinct().select(
        conversation,
        F.lit(-1).cast("bigint").alias(turn),
        F.lit("system").alias("role"),
        F.lit(K.DIALOG_SYSTEM_PROMPT).alias("content"),
    )
    converted = turns.select(
        conversation,
        F.col(turn).cast("bigint").alias(turn),
        chat.target_role(F.col(role)).alias("role"),
        chat.target_content(F.col(content)).alias("content"),
    )
    return system.unionByName(converted)


def prepare_requests(requests: DataFrame, suffix: str = K.SERVE_SUFFIX, default: str = K.SERVE_DEFAULT_PROMPT) -> DataFrame:
    """Model requests (message, image data URL) to prompt and image bytes.

    A blank message becomes the default prompt; the placeholder is added only
    when an image came along.  An image that does not decode gives an ``error``
    for the reply.
    """
    stripped = text.strip(text.text_or_empty("message"))
    prompt = F.when(stripped == "", F.lit(default)).otherwise(F.concat(stripped, F.lit(suffix)))
    has_image = F.coalesce(F.length("image") > 0, F.lit(False))
    return requests.withColumns(
        {
            "prompt": F.when(has_image, text.ensure_placeholder(prompt)).otherwise(prompt),
            "image_bytes": imagebytes.decode_data_url("image"),
        }
    ).withColumn(
        "error", F.when(has_image & F.col("image_bytes").isNull(), F.lit(K.SERVE_IMAGE_ERROR))
    ).drop("message", "image")
