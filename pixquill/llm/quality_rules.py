"""Quality rules, lines first: failing lines go, then documents that lost too much.

Every line is held against a punctuation, a navigation and a boilerplate rule.
A document fails on the base counts (too few words, too many repeated windows)
or if the lines that go hold more than ``max_lost`` of its characters.

What the rules mean: a line that is kept ends as a sentence does in European
languages or Chinese and Japanese, is not mostly punctuation, has fewer than
``MIN_SEPARATORS`` separators of menus, and names no boilerplate, whose phrases
are English.  So hard-wrapped prose, verse and lists lose their lines, and
boilerplate of other languages goes only by the first three.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, bind, col, words

SYMBOLS = "#*$%&|<>"
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~…«»“”„–—"
SEPARATORS = "|»›•·¦"
ENDINGS = r"[.!?…:;。！？][\"'”’»)\]]*$"
BOILERPLATE = (
    r"\b(cookies?|javascript|privacy policy|terms of (use|service)|all rights reserved|licen[cs]ed under"
    r"|copyright|subscribe|sign up|log in|sign in|click here|read more|lorem ipsum)\b"
)

MIN_WORDS = 50
MAX_REPEATED = 50
MAX_LOST = 0.5
MIN_SEPARATORS = 3
MAX_PUNCTUATION = 15
DENSE_FROM = 30


def count_chars(text: Column, chars: str) -> Column:
    return F.length(text) - F.length(F.translate(text, chars, ""))


def repeated_words(n_words: Column, hashes: Column) -> Column:
    """Words in windows of three found twice or more, from the windows' hashes in order."""

    def covered(pairs: Column) -> Column:
        twice = F.filter(
            pairs, lambda p, k: F.get(pairs, k - 1)["h"].eqNullSafe(p["h"]) | F.get(pairs, k + 1)["h"].eqNullSafe(p["h"])
        )
        starts = F.sort_array(F.transform(twice, lambda p: p["i"]))
        zero = F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(0).cast("bigint").alias("end"))
        add = lambda acc, i: F.struct(
            (acc["n"] + i + 3 - F.greatest(acc["end"], i)).alias("n"), (i + 3).cast("bigint").alias("end")
        )
        return F.aggregate(starts, zero, add, lambda acc: acc["n"])

    pairs = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    none = F.size(F.array_distinct(hashes)) == F.size(hashes)
    return F.when(none, F.lit(0).cast("bigint")).otherwise(bind(pairs, covered))


def base_counts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, text`` and the base counts of each row; a null text counts as empty.

    Windows are compared by 64-bit hashes, inside one document.
    """
    value = F.coalesce(col(text), F.lit(""))
    rows = docs.select(F.col(doc_id).alias("doc_id"), value.alias("text"), words(text).alias("_w"))
    n = F.greatest(F.size("_w") - 2, F.lit(0))
    windows = F.arrays_zip(*[F.slice("_w", i, n) for i in (1, 2, 3)])
    hashed = rows.select(
        "doc_id",
        "text",
        F.size("_w").cast("bigint").alias("n_words"),
        F.transform(windows, lambda z: F.xxhash64(z["0"], z["1"], z["2"])).alias("_h"),
    )
    lines = F.filter(F.split("text", "\n"), lambda x: F.btrim(x, F.lit(SPACE)) != "")
    dup = bind(lines, lambda x: F.size(x) - F.size(F.array_distinct(x)))
    return hashed.select(
        "doc_id",
        "text",
        "n_words",
        F.length(F.translate("text", SPACE, "")).cast("bigint").alias("word_chars"),
        count_chars(F.col("text"), SYMBOLS).cast("bigint").alias("n_symbols"),
        dup.cast("bigint").alias("n_dup_lines"),
        repeated_words(F.col("n_words"), F.col("_h")).alias("n_repeat_words"),
    )


def line_passes(line: Column) -> Column:
    """The three rules on one line with words; blank lines pass."""

    def rules(s: Column) -> Column:
        size = F.length(s)
        ends = s.rlike(ENDINGS)
        dense = (size >= DENSE_FROM) & (100 * count_chars(s, PUNCTUATION) > MAX_PUNCTUATION * size)
        navigation = count_chars(s, SEPARATORS) >= MIN_SEPARATORS
        return (s == "") | (ends & ~dense & ~navigation & ~F.lower(s).rlike(BOILERPLATE))

    return bind(F.btrim(line, F.lit(SPACE)), rules)


def quality_rules(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", max_lost: float = MAX_LOST
) -> DataFrame:
    """Base counts, verdicts and the cleaned text of each row, in one pass without a shuffle.

    ``cleaned`` has the lines that pass; ``lost`` is the share of the characters
    of lines with words that went with the others (0 without such lines);
    ``kept`` is false on a base failure or if ``lost`` exceeds ``max_lost``.
    """
    counted = base_counts(docs, doc_id, text)
    lines = F.split("text", "\n")
    filled = lambda xs: F.aggregate(
        xs, F.lit(0).cast("bigint"), lambda n, x: n + F.when(F.btrim(x, F.lit(SPACE)) == "", 0).otherwise(F.length(x))
    )
    passed = counted.select("*", lines.alias("_lines"), F.filter(lines, line_passes).alias("_passed"))
    sized = passed.select(
        "*", filled(F.col("_lines")).alias("_all"), filled(F.col("_passed")).alias("_left")
    )
    lost = F.when(F.col("_all") == 0, F.lit(0.0)).otherwise(1 - F.col("_left") / F.col("_all"))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED * F.col("n_words"))
    return sized.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        failed.alias("base_failed"),
        (~failed & (F.col("_all") - F.col("_left") <= max_lost * F.col("_all"))).alias("kept"),
        (F.size("_lines") - F.size("_passed")).cast("bigint").alias("n_lines_removed"),
        lost.alias("lost"),
        F.array_join("_passed", "\n").alias("cleaned"),
    )
