"""String expressions: placeholders, tokens, replies, labels."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import constants as K

WORD_PATTERN = r"[\p{L}\p{N}]+|[^\s\p{L}\p{N}]"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c: Column | str) -> Column:
    """Remove Unicode whitespace at both ends."""
    return F.btrim(col(c), F.lit(K.WHITESPACE))


def text_or_empty(c: Column | str) -> Column:
    return F.coalesce(col(c), F.lit(""))


def ensure_placeholder(c: Column | str, placeholder: str = K.PLACEHOLDER) -> Column:
    """Put the image placeholder in front unless the text already has one."""
    c = col(c)
    return F.when(F.contains(c, F.lit(placeholder)), c).otherwise(F.concat(F.lit(placeholder), c))


def expand_placeholder(
    c: Column | str,
    n_tokens: int = K.NUM_IMAGE_TOKENS,
    placeholder: str = K.PLACEHOLDER,
    start: str = K.IMAGE_START,
    token: str = K.IMAGE_TOKEN,
    end: str = K.IMAGE_END,
) -> Column:
    """Replace each placeholder by start marker, ``n_tokens`` image tokens, end marker."""
    return F.replace(col(c), F.lit(placeholder), F.lit(start + token * n_tokens + end))


def mix_prompt(instruction: Column | str, inputs: Column | str, u: Column) -> tuple[Column, Column]:
    """Three-way prompt mix driven by ``u``: (new instruction, new inputs)."""
    ins, inp = text_or_empty(instruction), text_or_empty(inputs)
    mixed = F.when(u < 0.33, F.concat(inp, ins)).when(u < 0.66, F.concat(ins, inp)).otherwise(inp)
    kept = F.when(u < 0.66, F.lit("")).otherwise(ins)
    return kept, mixed


def word_tokens(c: Column | str, lower: bool = True) -> Column:
    """Letter/digit runs and single other characters, as an array."""
    c = col(c)
    return F.regexp_extract_all(F.lower(c) if lower else c, F.lit(WORD_PATTERN), F.lit(0))


def chat_tokens(c: Column | str, specials: list[str]) -> Column:
    """Word tokens that keep the given special tokens whole; case is kept."""
    heads = "|".join(re.escape(s).replace(r"\_", "_") for s in specials)
    return F.regexp_extract_all(col(c), F.lit(f"(?:{heads})|{WORD_PATTERN}"), F.lit(0))


def extract_reply(c: Column | str, marker: str = K.REPLY_MARKER) -> Column:
    """Text between the first and the second marker; null without a marker."""
    c = col(c)
    return F.when(F.contains(c, F.lit(marker)), F.split_part(c, F.lit(marker), F.lit(2)))


def parse_yes_no(c: Column | str) -> Column:
    """yes / no / other by substring, "yes" first (so "know" is a no)."""
    c = F.lower(col(c))
    return (
        F.when(F.contains(c, F.lit("yes")), F.lit("yes"))
        .when(F.contains(c, F.lit("no")), F.lit("no"))
        .otherwise(F.lit("other"))
    )


def classify_error(c: Column | str) -> Column:
    """Error class of a fetch failure message; the first match decides."""
    c = F.lower(col(c))
    label = F
    for name, needle in K.ERROR_CLASSES:
        label = label.when(F.contains(c, F.lit(needle)), F.lit(name))
    return label.otherwise(F.lit("Other"))


def eval_prompt(question: Column | str, suffix: str = "", placeholder: str = K.PLACEHOLDER) -> Column:
    return F.concat(F.lit(placeholder), col(question), F.lit(suffix))


def vqa_answer(answer: Column | str, answer_type: Column | str) -> Column:
    a = col(answer)
    return F.when(col(answer_type) == "other", F.concat(F.lit(K.VQA_OPEN_ANSWER), a)).otherwise(a)


def vqa_prompt(question: Column | str, answer: Column | str, system: str = K.VQA_SYSTEM_PROMPT) -> Column:
    """One tagged training text from question and answer."""
    def tagged(role: str, content: Column) -> list[Column]:
        opening, closing = K.VQA_TAGS[role]
        return [F.lit(opening), content, F.lit(closing)]

    return F.concat(
        *tagged("system", F.lit(system)), *tagged("user", col(question)), *tagged("assistant", col(answer))
    )
