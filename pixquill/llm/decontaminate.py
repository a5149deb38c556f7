"""Benchmark decontamination by spaced seeds.

A mask of ones and zeros laid over a window of words keeps the words under ones
and ignores the others, so a window with substituted words in the ignored places
still has the same hash.  Hashes of all windows of the benchmark and of the
training texts are joined.  Each hit names a diagonal (a shift between item and
document); along it the words are compared, and the document is contaminated if
some stretch of ``stretch`` words agrees in ``similarity`` of them or more.

Items shorter than a window are matched exactly: by one hash of all their words,
held against the hashes of the documents' stretches of that many words.  Below
``LEAST_WORDS`` words a match inside other text says nothing, so such an item
matches documents of just these words.  Of items of 8 words those with the first
or last word substituted are missed (2 of 8 single substitutions), of items of
10 words 2 of 45 double ones; from 11 words on the masks miss nothing at 80 %.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .common import bind, broadcast_if_small, col

#: Five words of windows of eight; no two masks ignore the same places.
MASKS = ("11010011", "11001101", "10110101")
SPAN = 8
STRETCH = 13
SIMILARITY = 0.8
#: Items of fewer words match whole documents only.
LEAST_WORDS = 4


def plain_words(text: Column | str) -> Column:
    """Lower-cased runs of letters and digits; none of a null text."""
    parts = F.split(F.lower(F.coalesce(col(text), F.lit(""))), r"[^\p{L}\p{N}]+")
    return F.filter(parts, lambda w: w != "")


def seeds(rows: DataFrame, id_name: str, words: str = "_w") -> DataFrame:
    """``id, at, seed``: the masked hashes of every window of every row.

    The window is put together from shifted slices, so a row's words are never
    copied per window.
    """
    n = F.greatest(F.size(words) - (SPAN - 1), F.lit(0))
    shifted = F.arrays_zip(*[F.slice(words, i + 1, n) for i in range(SPAN)])
    windows = rows.select(id_name, F.posexplode(shifted).alias("at", "z"))
    hashes = [
        F.xxhash64(F.lit(k), *[F.col(f"z.{i}") for i, bit in enumerate(mask) if bit == "1"])
        for k, mask in enumerate(MASKS)
    ]
    return windows.select(id_name, "at", F.explode(F.array(*hashes)).alias("seed"))


def overlap(words: Column, item: Column, shift: Column, stretch: int) -> Column:
    """Largest share of equal words over stretches of the item laid on the document at ``shift``."""

    def best(same: Column) -> Column:
        width = F.least(F.size(same), F.lit(stretch))
        share = lambda i: F.aggregate(F.slice(same, i, width), F.lit(0), lambda a, b: a + b) / width
        return F.array_max(F.transform(F.sequence(F.lit(1), F.size(same) - width + 1), share))

    same = F.transform(item, lambda w, k: F.coalesce(F.get(words, shift + k) == w, F.lit(False)).cast("int"))
    return bind(same, best)


def contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    stretch: int = STRETCH,
    similarity: float = SIMILARITY,
) -> DataFrame:
    """``doc_id, item_id, shift, overlap``: verified overlaps, one row per document, item and shift.

    Items of fewer words than the seed window match word for word, those of fewer
    than ``LEAST_WORDS`` only documents of these words and no others; an item
    shorter than ``stretch`` has to agree as a whole.  Null texts and items have
    no words; rows with a null id take no part.  Documents sharing an id are
    judged together.
    """
    every = benchmark.select(F.col(item_id).alias("item_id"), plain_words(item_text).alias("_item"))
    every = materialize(every.where((F.size("_item") > 0) & F.col("item_id").isNotNull()), "items")
    items, short = every.where(F.size("_item") >= SPAN), every.where(F.size("_item") < SPAN)
    texts = docs.where(F.col(doc_id).isNotNull()).select(
        F.col(doc_id).alias("doc_id"), plain_words(text).alias("_w")
    )
    known = seeds(items, "item_id", "_item").select("item_id", F.col("at").alias("_item_at"), "seed").distinct()
    hits = seeds(texts, "doc_id").join(broadcast_if_small(materialize(known, "seeds")), "seed")
    diagonals = materialize(
        hits.select("doc_id", "item_id", (F.col("at") - F.col("_item_at")).alias("shift")).distinct(), "hits"
    )
    # few documents have a hit: their ids thin the texts out before the words travel
    hit_ids = broadcast_if_small(diagonals.select("doc_id").distinct())
    hit_texts = texts.join(hit_ids, "doc_id", "left_semi")
    size = F.aggregate("_item", F.lit(64), lambda n, w: n + F.octet_length(w) + 24)
    aligned = diagonals.join(broadcast_if_small(items, width=size), "item_id").join(hit_texts, "doc_id")
    measured = aligned.select(
        "doc_id", "item_id", "shift", overlap(F.col("_w"), F.col("_item"), F.col("shift"), stretch).alias("overlap")
    )
    found = measured.where(F.col("overlap") >= similarity).groupBy("doc_id", "item_id", "shift").agg(
        F.max("overlap").alias("overlap")
    )
    lengths = [r[0] for r in short.select(F.size("_item")).distinct().collect()]  # fewer than SPAN
    return found.unionByName(_whole_items(texts, short, sorted(lengths))) if lengths else found


def _whole_items(texts: DataFrame, short: DataFrame, lengths: list[int]) -> DataFrame:
    """The short items whose words stand in a document one after another, as overlaps of 1."""
    n = F.size("_w")

    def stretches(k: int) -> Column:
        last = F.when(n >= k, n - k) if k >= LEAST_WORDS else F.when(n == k, F.lit(0))
        at = F.when(last.isNotNull(), F.sequence(F.lit(0), last))
        hashed = F.transform(at, lambda i: F.struct(i.alias("shift"), F.xxhash64(F.lit(k), F.slice("_w", i + 1, F.lit(k))).alias("mark")))
        return F.coalesce(hashed, F.array().cast("array<struct<shift:int,mark:bigint>>"))

    each = texts.select("doc_id", F.explode(F.concat(*map(stretches, lengths))).alias("s")).select("doc_id", "s.*")
    marks = short.select("item_id", F.xxhash64(F.size("_item"), "_item").alias("mark")).distinct()
    met = each.join(broadcast_if_small(marks), "mark").select("doc_id", "item_id", F.col("shift").cast("int").alias("shift"))
    return met.distinct().withColumn("overlap", F.lit(1.0))


def contaminated_documents(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", **how) -> DataFrame:
    """``doc_id, contaminated, n_items, best_overlap``: each row of ``docs`` with its verdict."""
    found = contamination(docs, benchmark, doc_id, **how)
    per = found.groupBy("doc_id").agg(
        F.countDistinct("item_id").alias("n_items"), F.max("overlap").alias("best_overlap")
    )
    return (
        docs.select(F.col(doc_id).alias("doc_id"))
        .join(per, "doc_id", "left")
        .select(
            "doc_id",
            F.col("n_items").isNotNull().alias("contaminated"),
            F.coalesce("n_items", F.lit(0)).alias("n_items"),
            F.coalesce("best_overlap", F.lit(0.0)).alias("best_overlap"),
        )
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", **how) -> DataFrame:
    """``docs`` without the contaminated ones; rows with a null id stay."""
    found = materialize(contamination(docs, benchmark, doc_id, **how).select(F.col("doc_id").alias(doc_id)).distinct(), "leaks")
    return docs.join(broadcast_if_small(found), doc_id, "left_anti").select(*docs.columns)
