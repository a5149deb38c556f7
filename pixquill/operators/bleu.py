"""n-gram overlap and sentence BLEU over tables of text pairs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import extract_reply, word_tokens

ORDERS = (1, 2, 3, 4)
SMOOTH = 0.1  # numerator used for an n-gram order without a match


def _grams(tokens: str, n: int) -> str:
    """SQL text: the n-grams of a token column, tokens joined by a blank.
    Entries are picked one by one, which is much cheaper than slicing."""
    if n == 1:
        return tokens
    gram = ", ' ', ".join(f"get({tokens}, i + {j})" for j in range(n))
    starts = f"if(size({tokens}) >= {n}, sequence(0, size({tokens}) - {n}), CAST(array() AS array<int>))"
    return f"transform({starts}, i -> concat({gram}))"


def _unrepeated(n: int) -> str:
    """SQL text: does one side have no n-gram twice?"""
    return " OR ".join(f"size(array_distinct({side})) = size({side})" for side in (f"_g_{n}", f"_r_{n}"))


def _sorted(n: int) -> str:
    """SQL text: the n-grams of both sides in order, each ending in a separator
    and its side (0 generated, 1 reference)."""
    tagged = [f"transform(_{side}_{n}, x -> concat(x, '\\u0001{i}'))" for i, side in enumerate("gr")]
    return f"if({_unrepeated(n)}, NULL, sort_array(concat({', '.join(tagged)})))"


def _run_starts(n: int) -> str:
    """SQL text: start positions of equal entries in the sorted list ``_all_n``."""
    positions = f"if(size(_all_{n}) > 0, sequence(0, size(_all_{n}) - 1), CAST(array() AS array<int>))"
    return f"filter({positions}, i -> NOT coalesce(get(_all_{n}, i - 1) = get(_all_{n}, i), false))"


def _matches(n: int) -> str:
    """SQL text: clipped matches.

    Where one side repeats nothing, each common n-gram counts once.  Otherwise,
    in sort order the generated run of a gram directly precedes its reference
    run, and the shorter of the two counts.
    """
    here, before = f"get(_all_{n}, s)", f"get(_runs_{n}, j - 1)"
    twin = f"concat(substr({here}, 1, length({here}) - 1), '0')"
    by_runs = (
        f"aggregate(transform(_runs_{n}, (s, j) -> if("
        f"j > 0 AND endswith({here}, '1') AND get(_all_{n}, {before}) = {twin}, "
        f"least(s - {before}, coalesce(get(_runs_{n}, j + 1), size(_all_{n})) - s), 0)), "
        f"0, (a, x) -> a + x)"
    )
    return f"if(_all_{n} IS NULL, size(array_intersect(_g_{n}, _r_{n})), {by_runs})"


def ngram_counts(
    pairs: DataFrame, key: str, gen: str = "gen", ref: str = "ref", keep: tuple[str, ...] = (),
    tokenizer: Callable[[Column], Column] = word_tokens,
) -> DataFrame:
    """Per pair: text lengths, clipped matches and generated n-grams per order.

    Works inside the row: common n-grams are intersected, or, where both sides
    repeat some, sorted together and counted as runs.  Nothing is exploded or
    shuffled, and a long text costs no more than its sort.  ``keep`` columns are
    carried along.  ``tokenizer`` maps a text column to an array<string> of its
    tokens, for example a pandas UDF around another word tokenizer.
    """
    carried = [key, *keep]
    tokens = pairs.select(
        *carried,
        tokenizer(F.coalesce(gen, F.lit(""))).alias("_gt"),
        tokenizer(F.coalesce(ref, F.lit(""))).alias("_rt"),
    )
    grams = tokens.select(
        *carried,
        F.size("_gt").alias("gen_len"),
        F.size("_rt").alias("ref_len"),
        *[F.expr(f"{_grams(f'_{side}t', n)} AS _{side}_{n}") for n in ORDERS for side in "gr"],
    )
    ordered = grams.withColumns({f"_all_{n}": F.expr(_sorted(n)) for n in ORDERS})
    runs = ordered.withColumns({f"_runs_{n}": F.expr(_run_starts(n)) for n in ORDERS})
    return runs.select(
        *carried,
        "gen_len",
        "ref_len",
        *[F.expr(_matches(n)).alias(f"matches_{n}") for n in ORDERS],
        *[F.greatest(F.col("gen_len") - (n - 1), F.lit(0)).alias(f"total_{n}") for n in ORDERS],
    )


def ngram_overlap(
    pairs: DataFrame, key: str, gen: str = "gen", ref: str = "ref", tokenizer: Callable[[Column], Column] = word_tokens
) -> DataFrame:
    """(key, n, matches, total) for the orders occurring on either side."""
    counts = ngram_counts(pairs, key, gen, ref, tokenizer=tokenizer)
    orders = F.array(
        *[
            F.struct(
                F.lit(n).alias("n"),
                F.col(f"matches_{n}").cast("bigint").alias("matches"),
                F.col(f"total_{n}").cast("bigint").alias("total"),
            )
            for n in ORDERS
        ]
    )
    longest = F.greatest("gen_len", "ref_len")
    return counts.select(key, longest.alias("_longest"), F.inline(orders)).where(F.col("n") <= F.col("_longest")).drop("_longest")


def sentence_bleu(
    pairs: DataFrame, key: str, gen: str = "gen", ref: str = "ref", keep: tuple[str, ...] = (),
    tokenizer: Callable[[Column], Column] = word_tokens,
) -> DataFrame:
    """(key, keep, bleu_1 .. bleu_4): cumulative uniform weights, brevity penalty.

    A precision without a match has numerator 0.1 over a total of at least 1; a
    pair without any common word scores 0.
    """
    wide = ngram_counts(pairs, key, gen, ref, keep, tokenizer)

    def log_precision(n: int) -> Column:
        hits = F.col(f"matches_{n}").cast("double")
        return F.log(
            F.when(hits > 0, hits).otherwise(F.lit(SMOOTH)) / F.greatest(F.col(f"total_{n}"), F.lit(1))
        )

    ratio = F.try_divide(F.col("ref_len").cast("double"), F.col("gen_len").cast("double"))
    penalty = (
        F.when(F.col("gen_len") > F.col("ref_len"), F.lit(1.0))
        .when(F.col("gen_len") == 0, F.lit(0.0))
        .otherwise(F.exp(1.0 - ratio))
    )
    scores = []
    for n in ORDERS:
        mean = sum((log_precision(i) for i in range(2, n + 1)), log_precision(1)) / n
        score = F.when(F.col("matches_1") == 0, F.lit(0.0)).otherwise(penalty * F.exp(mean))
        scores.append(score.alias(f"bleu_{n}"))
    return wide.select(key, *keep, *scores)


BLEU_COLUMNS = [f"bleu_{n}" for n in ORDERS]


def metric_mean(rows: DataFrame, rank: str, batch: str, columns: list[str] | None = None) -> DataFrame:
    """One row: mean over ranks of the mean over batches of batch means, and
    beside it (``row_*``) the plain mean over rows."""
    columns = columns or BLEU_COLUMNS
    batches = rows.groupBy(rank, batch).agg(
        *[F.avg(c).alias(c) for c in columns],
        *[F.sum(c).alias(f"_s_{c}") for c in columns],
        *[F.count(c).alias(f"_n_{c}") for c in columns],
    )
    ranks = batches.groupBy(rank).agg(
        *[F.avg(c).alias(c) for c in columns],
        *[F.sum(f"_s_{c}").alias(f"_s_{c}") for c in columns],
        *[F.sum(f"_n_{c}").alias(f"_n_{c}") for c in columns],
    )
    return ranks.agg(
        *[F.avg(c).alias(c) for c in columns],
        *[F.try_divide(F.sum(f"_s_{c}"), F.sum(f"_n_{c}")).alias(f"row_{c}") for c in columns],
    )


def evaluate_captions(
    decoded: DataFrame,
    key: str,
    text: str = "decoded",
    reference: str = "ref",
    rank: str = "rank",
    batch: str = "batch",
    losses: tuple[str, ...] = (),
    tokenizer: Callable[[Column], Column] = word_tokens,
) -> DataFrame:
    """Decoded model texts to averaged BLEU: extract the reply, score each pair,
    average over batches and ranks.  Texts without a reply count as empty.
    ``losses`` are further numeric columns to average the same way."""
    pairs = decoded.select(
        key, rank, batch, *losses, extract_reply(text).alias("gen"), F.col(reference).alias("ref")
    )
    scored = sentence_bleu(pairs, key, keep=(rank, batch, *losses), tokenizer=tokenizer)
    return metric_mean(scored, rank, batch, [*BLEU_COLUMNS, *losses])
