"""End-to-end flows composed of the operators."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as K
from ..functions import chat
from ..functions.text import ensure_placeholder, extract_reply, text_or_empty
from ..operators import corpus, ingest, sampling, scoring, tokens
from ..session import scratch
from ..sources import images as image_sources


@dataclass
class CaptionCorpus:
    metadata: DataFrame
    report: DataFrame
    errors: DataFrame
    failures: DataFrame
    samples: DataFrame
    images: DataFrame


def caption_corpus(
    links: DataFrame,
    manifest: DataFrame | None = None,
    fetch: Callable[[str], bytes] | None = None,
    fetched: str | None = None,
    total_seconds: float | Column = 0.0,
) -> CaptionCorpus:
    """Links to training samples: identify, skip finished work, fetch, plan,
    report, adapt.

    Only the fetch leaves the JVM.  Its outcomes, image bytes included, are
    written chunk by chunk to ``fetched`` (a new folder under the shared one by
    default) and read from there, so everything below sees one and the same
    fetch; given the same folder again, a run that died goes on from its last
    finished chunk.
    """
    spark = links.sparkSession
    identified = corpus.assign_identifier(links)
    if manifest is not None:
        identified = corpus.not_done(identified, manifest)
    fetched = fetched or scratch(spark, "fetched")
    images = image_sources.fetch_in_chunks(identified, fetched, fetch).drop("image_url")
    outcomes = images.drop("content")
    rows = ingest.attach_outcomes(identified, outcomes)
    kept = corpus.keep_fetched(rows)
    metadata = kept.select("image_url", "capsfusion", "identifier", "original_width", "original_height")
    return CaptionCorpus(
        metadata=metadata,
        report=ingest.download_report(rows, total_seconds),
        errors=ingest.error_types(rows),
        failures=ingest.failures(rows),
        samples=corpus.adapt_pretrain(metadata),
        images=images.where("ok").select("identifier", "original_width", "original_height", "content"),
    )


def instruction_corpus(
    raw: DataFrame, subsets: list[str], folder: str = "data/it_images"
) -> tuple[DataFrame, DataFrame]:
    """Raw subset rows to (mixed samples with a readable image, images).

    ``raw`` has subset, position (0..n-1 inside each subset), instruction,
    inputs, outputs and image_base64_str.  Ids count every row, readable or not.
    No row is shuffled.
    """
    numbered = corpus.offset_image_ids(corpus.decode_images(raw), subsets)
    readable = numbered.where((F.col("width") > 0) & (F.col("height") > 0)).withColumn(
        "image_path", F.concat(F.lit(f"{folder}/"), F.col("image_id").cast("string"), F.lit(".jpg"))
    )
    samples = corpus.mix_prompts(readable, "image_id").drop("content", "width", "height")
    return samples, readable.select("image_id", "image_path", "width", "height", "content")


def chat_samples(samples: DataFrame, n_tokens: int = K.NUM_IMAGE_TOKENS) -> DataFrame:
    """Add ``messages`` to training samples; an image placeholder is ensured."""
    placed = ensure_placeholder(text_or_empty("inputs"))
    return samples.withColumn("messages", chat.to_messages("instruction", placed, "outputs", n_tokens=n_tokens))


def training_batches(
    samples: DataFrame,
    position: str,
    batch_size: int,
    tokenizer: Callable[[Column], Column] | None = None,
    pad_id: int = K.BASE_VOCAB_SIZE - 1,
) -> DataFrame:
    """Samples with a dense position to right-padded token rows per batch."""
    tokenized = tokens.create_labels(tokens.tokenize_chat(chat_samples(samples), tokenizer=tokenizer))
    batched = tokenized.withColumn("batch", sampling.batch_index(position, batch_size))
    return tokens.pad_batch(
        batched,
        "batch",
        {"input_ids": pad_id, "attention_mask": 0, "assistant_masks": 0, "labels": K.IGNORE_LABEL},
        side="right",
    )


def rendered_training_prompts(samples: DataFrame, key: str, validation: float) -> DataFrame:
    """Mixed, rendered training texts with their split."""
    mixed = corpus.mix_prompts(samples, key)
    split = sampling.train_valid_split(mixed, key, validation)
    return chat_samples(split).select(
        key, "split", chat.render_chat("messages").alias("text")
    )


def score_benchmark(decoded: DataFrame, tasks: DataFrame, text: str = "decoded") -> tuple[DataFrame, DataFrame, DataFrame]:
    """Decoded model texts of benchmark items to (scores, rollup, confusion).

    ``decoded`` has ord, question_id, question, answer and the decoded text.
    """
    answers = decoded.select(
        "question_id", "question", F.col("answer").alias("gt_ans"), extract_reply(text).alias("pred_ans")
    )
    judged = scoring.judge(scoring.format_answers(answers))
    scores = scoring.mme_scores(scoring.mme_pairs(judged, "img_name"))
    return scores, scoring.mme_rollup(scores, tasks), scoring.confusion(judged)
