"""Conversations as arrays of (role, content) and their rendered text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import constants as K
from .text import chat_tokens, col, expand_placeholder, strip, text_or_empty

SPECIALS = K.CHAT_SPECIALS + [token for _, token in K.ADDED_TOKENS]


def message(role: Column | str, content: Column) -> Column:
    role = F.lit(role) if isinstance(role, str) else role
    return F.struct(role.alias("role"), content.alias("content"))


def to_messages(
    instruction: Column | str,
    inputs: Column | str,
    outputs: Column | str,
    system_prompt: str = K.TRAIN_SYSTEM_PROMPT,
    n_tokens: int = K.NUM_IMAGE_TOKENS,
) -> Column:
    """System, user and assistant message of one training sample."""
    return F.array(
        message("system", F.concat(F.lit(system_prompt), text_or_empty(instruction))),
        message("user", expand_placeholder(text_or_empty(inputs), n_tokens)),
        message("assistant", text_or_empty(outputs)),
    )


def generation_messages(messages: Column | str) -> Column:
    """The conversation without its last message."""
    m = col(messages)
    return F.slice(m, F.lit(1), F.greatest(F.size(m) - 1, F.lit(0)))


def inference_messages(
    prompt: Column | str,
    system_prompt: str = K.DIALOG_SYSTEM_PROMPT,
    n_tokens: int = K.NUM_IMAGE_TOKENS,
    start: str = K.INFERENCE_IMAGE_START,
    end: str = K.INFERENCE_IMAGE_END,
) -> Column:
    """System and user message of a prompt to generate from.  The image markers
    of inference differ from those of training."""
    return F.array(
        message("system", F.lit(system_prompt)),
        message("user", expand_placeholder(prompt, n_tokens, start=start, end=end)),
    )


def qa_messages(question: Column | str, answer: Column | str, system_prompt: str = K.DIALOG_SYSTEM_PROMPT) -> Column:
    """System, user, assistant from a plain instruction/output pair."""
    return F.array(
        message("system", F.lit(system_prompt)),
        message("user", col(question)),
        message("assistant", col(answer)),
    )


def target_role(role: Column) -> Column:
    return F.when(role == "human", F.lit("user")).when(role == "gpt", F.lit("assistant")).otherwise(role)


def target_content(content: Column) -> Column:
    return F.replace(content, F.lit(K.DUMP_PLACEHOLDER), F.lit(K.PLACEHOLDER))


def normalize_conversation(turns: Column | str, system_prompt: str = K.DIALOG_SYSTEM_PROMPT) -> Column:
    """Array of {from, value[, role, content]} to (role, content), system first.

    Where a turn carries both spellings, ``from``/``value`` win.
    """
    turns = col(turns)

    def convert(turn: Column) -> Column:
        return message(target_role(turn["role"]), target_content(turn["content"]))

    return F.concat(
        F.array(message("system", target_content(F.lit(system_prompt)))),
        F.transform(turns, convert),
    )


def unify_turns(turns: Column | str, names: set[str]) -> Column:
    """Rename ``from``/``value`` fields to role/content, coalescing with fields
    already called so.  ``names`` are the field names present."""

    def pick(turn: Column, first: str, second: str) -> Column:
        found = [turn[n] for n in (first, second) if n in names]
        return F.coalesce(*found)

    return F.transform(
        col(turns),
        lambda t: message(pick(t, "from", "role"), pick(t, "value", "content")),
    )


def _first_is_system(messages: Column) -> Column:
    return F.coalesce(F.try_element_at(messages, F.lit(1))["role"] == "system", F.lit(False))


def _header(role: Column | str) -> Column:
    role = F.lit(role) if isinstance(role, str) else role
    return F.concat(F.lit(K.HEADER_OPEN), role, F.lit(K.HEADER_CLOSE))


def segments(messages: Column | str, add_generation_prompt: bool = False) -> Column:
    """Rendered conversation cut into (text, generated) pieces.

    ``generated`` is true exactly for assistant contents.  Joining the texts
    gives the rendered conversation.
    """
    m = col(messages)
    has_system = _first_is_system(m)
    system_text = F.when(has_system, strip(F.element_at(m, 1)["content"])).otherwise(F.lit(""))
    rest = F.when(has_system, F.slice(m, F.lit(2), F.greatest(F.size(m) - 1, F.lit(0)))).otherwise(m)

    def piece(text: Column, generated: Column | bool) -> Column:
        generated = F.lit(generated) if isinstance(generated, bool) else generated
        return F.struct(text.alias("text"), generated.alias("generated"))

    def render(t: Column) -> Column:
        generated = t["role"] == "assistant"
        body = strip(t["content"])
        return F.array(
            piece(_header(t["role"]), False),
            piece(F.when(generated, F.concat(body, F.lit(K.GENERATION_BREAK))).otherwise(body), generated),
            piece(F.lit(K.END_OF_TURN), False),
        )

    head = F.concat(
        F.lit(K.BOS), _header("system"), F.lit(K.SYSTEM_PREAMBLE), system_text, F.lit(K.END_OF_TURN)
    )
    parts = [F.array(piece(head, False)), F.flatten(F.transform(rest, render))]
    if add_generation_prompt:
        parts.append(F.array(piece(F.concat(_header("assistant"), F.lit(K.GENERATION_BREAK)), False)))
    return F.concat(*parts)


def render_chat(messages: Column | str, add_generation_prompt: bool = False) -> Column:
    """Plain-conversation chat text."""
    return F.array_join(F.transform(segments(messages, add_generation_prompt), lambda s: s["text"]), "")


def segment_tokens(segs: Column | str, specials: list[str] | None = None) -> Column:
    """Per segment: (tokens, generated)."""
    return F.transform(
        col(segs),
        lambda s: F.struct(
            chat_tokens(s["text"], specials or SPECIALS).alias("tokens"),
            s["generated"].alias("generated"),
        ),
    )


def assistant_mask(seg_tokens: Column | str) -> Column:
    """1 for tokens inside assistant contents, else 0."""
    return F.flatten(
        F.transform(
            col(seg_tokens),
            lambda s: F.array_repeat(s["generated"].cast("int"), F.size(s["tokens"])),
        )
    )


def generated_spans(segs: Column | str) -> Column:
    """struct(start, end) in characters of the rendered text, for each generated segment that has any."""
    empty = F.array().cast("array<struct<start:int,end:int>>")
    start = F.struct(F.lit(0).alias("at"), empty.alias("spans"))

    def add(acc: Column, s: Column) -> Column:
        end = acc["at"] + F.length(s["text"])
        span = F.array(F.struct(acc["at"].alias("start"), end.alias("end")))
        grown = F.when(s["generated"] & (end > acc["at"]), F.concat(acc["spans"], span)).otherwise(acc["spans"])
        return F.struct(end.alias("at"), grown.alias("spans"))

    return F.aggregate(col(segs), start, add, lambda acc: acc["spans"])


def offset_mask(tokens: Column | str, spans: Column | str) -> Column:
    """1 for tokens (struct with ``start`` and ``end``) that share a character with a span, else 0.

    A token across the edge of a span belongs to it; one of no characters to none.
    """
    def inside(t: Column) -> Column:
        met = F.exists(col(spans), lambda s: (t["start"] < s["end"]) & (s["start"] < t["end"]))
        return ((t["end"] > t["start"]) & met).cast("int")

    return F.transform(col(tokens), inside)


def extend_mask(mask: Column | str) -> Column:
    """Set the position right after each 1 -> 0 edge, so the end-of-turn token
    is learned too."""
    m = col(mask)
    previous = F.slice(F.concat(F.array(F.lit(0)), m), F.lit(1), F.size(m))
    return F.zip_with(m, previous, lambda v, p: F.when((v == 1) | (p == 1), F.lit(1)).otherwise(F.lit(0)))


def labels(ids: Column | str, mask: Column | str, ignore: int = K.IGNORE_LABEL) -> Column:
    """Token id where the (extended) mask is 1, the ignore label elsewhere."""
    return F.zip_with(col(ids), col(mask), lambda t, v: F.when(v == 1, t).otherwise(F.lit(ignore)))


def hashed_ids(tokens: Column | str, base: int = K.BASE_VOCAB_SIZE) -> Column:
    """Token ids without a vocabulary table: added tokens follow the base range
    in their fixed order, other tokens hash into it."""
    added = [token for _, token in K.ADDED_TOKENS]

    def one(token: Column) -> Column:
        hashed = F.conv(F.substring(F.md5(token), 1, 8), 16, 10).cast("bigint") % base
        out = F
        for i, text in enumerate(added):
            out = out.when(token == text, F.lit(base + i))
        return out.otherwise(hashed.cast("int"))

    return F.transform(col(tokens), one)
