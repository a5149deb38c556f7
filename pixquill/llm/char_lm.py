"""Character n-gram models over whole corpora, looked up by sharded joins.

Texts are cut into windows of ``order`` characters, one for each character and
one for the end, padded at the start.  A block of texts holds far fewer distinct
windows than characters, so only those travel: blocks are written once, their
distinct windows are joined with the model's tables by window, and the values
come back to their block, where the texts are summed up again.

A model is a table of (key, value): ``a`` + n-gram has the discounted share of
the n-gram, ``g`` + context the weight of the next lower order there.  The
probability of a window is built up from the uniform distribution:
p(k) = a(k) + g(k) * p(k - 1), where a missing a counts 0 and a missing g 1.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .common import slices, text_batches, trim

ORDER = 4
START, END = "\x02", "\x03"
BLOCK_BYTES = 8 << 20
STEP_CHARS = 1 << 19
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
LEVEL = 9


def normal(text: str | None) -> str:
    """White space as single blanks, without the two marks."""
    return " ".join((text or "").replace(START, " ").replace(END, " ").split())


def windows(texts: list[str], order: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(codes, last position, key, text number) of all windows, some millions at a time.

    Long texts go on in the next step with their last characters as context.
    """
    pad = np.full(order - 1, ord(START), np.uint32)
    parts, valid, owner, held = [], [], [], 0

    def step() -> tuple:
        codes, ends, own = np.concatenate(parts), np.concatenate(valid), np.concatenate(owner)
        n = len(codes) - order + 1
        key = np.zeros(n, np.uint64)
        for j in range(order):
            key *= MULTIPLIER
            key += codes[j : j + n]
        last = np.flatnonzero(ends)
        parts.clear(), valid.clear(), owner.clear()
        return codes, last, key[last - order + 1], own[last]

    for number, text in enumerate(texts):
        codes, before = np.frombuffer((text + END).encode("utf-32-le", "surrogatepass"), np.uint32), pad
        for at in range(0, len(codes), STEP_CHARS):
            piece = codes[at : at + STEP_CHARS]
            parts += [before, piece]
            valid += [np.zeros(order - 1, bool), np.ones(len(piece), bool)]
            owner.append(np.full(order - 1 + len(piece), number, np.int32))
            before = np.concatenate([before, piece])[-(order - 1) :]
            held += len(piece)
            if held >= STEP_CHARS:
                yield step()
                held = 0
    if parts:
        yield step()


class Places:
    """Numbers distinct windows in the order of their first occurrence."""

    def __init__(self) -> None:
        self.of: dict[int, int] = {}

    def numbers(self, key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(number of each window, first occurrences of the new ones, all numbers here by code)."""
        codes, unique = pd.factorize(key)
        first = np.empty(len(unique), np.int64)
        first[codes[::-1]] = np.arange(len(codes))[::-1]
        known = len(self.of)
        place = np.fromiter((self.of.setdefault(k, len(self.of)) for k in unique.tolist()), np.int64, len(unique))
        return place[codes], first[place >= known], place


def text_blocks(rows: DataFrame, order: int = ORDER) -> DataFrame:
    """Blocks of ``rows`` (doc_id, tag, mark, text), written to the shared folder.

    ``grams`` has the distinct windows of a block, ``counts`` how often they
    occur, ``marked`` how often in rows whose ``mark`` is true.
    """
    kind = rows.schema["doc_id"].dataType.simpleString()
    text_batches(rows.sparkSession)

    def close(prefix: str, made: int, docs: list[pa.RecordBatch], texts: list[str]) -> pa.RecordBatch:
        ids, tags, marks = (pa.concat_arrays([d.column(i) for d in docs]) for i in range(3))
        chosen = np.array(marks.fill_null(False).to_pylist(), bool)
        places, grams = Places(), []
        counts, marked = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for codes, last, key, own in windows(texts, order):
            number, first, _ = places.numbers(key)
            at = last[first]
            flat = np.stack([codes[at - order + 1 + j] for j in range(order)], axis=1).tobytes().decode("utf-32-le", "surrogatepass")
            grams += [flat[i : i + order] for i in range(0, len(flat), order)]
            size = len(grams)
            counts = np.bincount(number, minlength=size) + np.pad(counts, (0, size - len(counts)))
            marked = np.bincount(number[chosen[own]], minlength=size) + np.pad(marked, (0, size - len(marked)))
        payload = zstandard.ZstdCompressor(level=LEVEL).compress(END.join(texts).encode("utf-8", "surrogatepass"))
        one = lambda x: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x)
        return pa.RecordBatch.from_arrays(
            [
                pa.array([f"{prefix}-{made}"]), pa.array([payload], pa.binary()), one(ids), one(tags), one(marks),
                one(pa.array(grams, pa.string())), one(pa.array(counts, pa.int64())), one(pa.array(marked, pa.int64())),
            ],
            ["block", "payload", "doc_ids", "tags", "marks", "grams", "counts", "marked"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        prefix, made = str(TaskContext.get().partitionId()), 0
        docs, texts, held = [], [], 0
        for batch in slices(batches, "text"):
            docs.append(batch.select(["doc_id", "tag", "mark"]))
            texts += [normal(x) for x in batch.column("text").to_pylist()]
            held += batch.column("text").nbytes
            if held >= BLOCK_BYTES:
                yield close(prefix, made, docs, texts)
                docs, texts, held, made = [], [], 0, made + 1
        if docs:
            yield close(prefix, made, docs, texts)
        docs, texts = [], []
        trim()

    schema = (
        f"block string, payload binary, doc_ids array<{kind}>, tags array<string>, marks array<boolean>, "
        "grams array<string>, counts array<bigint>, marked array<bigint>"
    )
    return materialize(rows.select("doc_id", "tag", "mark", "text").mapInArrow(run, schema), "blocks")


def gram_counts(blocks: DataFrame) -> DataFrame:
    """``gram, n, marked``: windows of the whole corpus and of its marked part."""
    each = blocks.select(F.explode(F.arrays_zip("grams", "counts", "marked")).alias("z"))
    return each.groupBy(F.col("z.grams").alias("gram")).agg(
        F.sum("z.counts").alias("n"), F.sum("z.marked").alias("marked")
    )


# --- models -------------------------------------------------------------------


def _suffix(gram: Column, n: int) -> Column:
    return F.when(F.length(gram) > n, F.substring(gram, -n, n)).otherwise(gram) if n else F.lit("")


def _levels(top: DataFrame, order: int, lower) -> DataFrame:
    """``k, gram, ctx, c`` for orders 1 to ``order``, written once; ``lower`` sums an order up into the one below."""
    level, parts = top.select("gram", "c"), []
    for k in range(order, 0, -1):
        parts.append(level.select(F.lit(k).alias("k"), "gram", F.substring("gram", 1, k - 1).alias("ctx"), "c"))
        if k > 1:
            gram = _suffix(F.col("gram"), k - 1)
            level = level.groupBy(gram.alias("gram")).agg(F.sum(lower(gram)).cast("bigint").alias("c"))
    return materialize(reduce(DataFrame.unionByName, parts), "levels")


def raw_levels(top: DataFrame, order: int) -> DataFrame:
    """Counts of all orders, from those of the highest (gram, c)."""
    return _levels(top, order, lambda gram: F.col("c"))


def continuation_levels(top: DataFrame, order: int) -> DataFrame:
    """The same, with lower orders counting the distinct characters before an n-gram.

    N-grams that begin with the start mark have only that before them and keep
    their plain counts.
    """
    return _levels(top, order, lambda gram: F.when(gram.startswith(START), F.col("c")).otherwise(F.lit(1)))


def vocabulary(levels: DataFrame) -> int:
    """Characters of the model, with one for those it has not seen."""
    return levels.where("k = 1").count() + 1


def _model(levels: DataFrame, stats: DataFrame, share: Column, lower: Column) -> DataFrame:
    """(key, value) from the counts and, per context, what ``share`` and ``lower`` need."""
    # contexts of up to one character: as many as there are characters, and the largest ones
    few = F.col("k") <= 2
    near = levels.where(few).join(F.broadcast(stats.where(few)), ["k", "ctx"])
    shares = near.unionByName(levels.where(~few).join(stats.where(~few), ["k", "ctx"])).select(F.concat(F.lit("a"), "gram").alias("key"), share.alias("value"))
    return shares.unionByName(stats.select(F.concat(F.lit("g"), "ctx").alias("key"), lower.alias("value")))


def witten_bell(levels: DataFrame) -> DataFrame:
    """(key, value) with each context's distinct continuations as weight of the lower order."""
    stats = levels.groupBy("k", "ctx").agg(F.sum("c").alias("total"), F.count(F.lit(1)).alias("kinds"))
    whole = F.col("total") + F.col("kinds")
    return _model(levels, stats, F.col("c") / whole, F.col("kinds") / whole)


def discounts(n1: int, n2: int, n3: int, n4: int) -> tuple[float, float, float]:
    """The three discounts of modified Kneser-Ney, from how many n-grams occur 1 to 4 times.

    Where a small sample leaves them undefined or out of order, 0.5, 1 and 1.5.
    """
    if not (n1 and n2 and n3 and n4):
        return 0.5, 1.0, 1.5
    y = n1 / (n1 + 2 * n2)
    d = 1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3
    return d if all(0 < x < i for i, x in enumerate(d, 1)) else (0.5, 1.0, 1.5)


def kneser_ney(levels: DataFrame) -> DataFrame:
    """(key, value) of an interpolated modified Kneser-Ney model."""
    found = levels.where("c <= 4").groupBy("k", "c").agg(F.count(F.lit(1)).alias("n")).collect()  # four rows an order
    few = {(r["k"], r["c"]): r["n"] for r in found}
    d = F.lit(0.0)
    for k in sorted({k for k, _ in few}):
        d1, d2, d3 = discounts(*(few.get((k, i), 0) for i in (1, 2, 3, 4)))
        d = F.when(F.col("k") == k, F.when(F.col("c") == 1, d1).when(F.col("c") == 2, d2).otherwise(d3)).otherwise(d)
    taken = levels.withColumn("d", d)
    # what is taken from the n-grams of a context goes to its lower order
    stats = taken.groupBy("k", "ctx").agg(F.sum("c").alias("total"), F.sum("d").alias("taken"))
    return _model(taken, stats, (F.col("c") - F.col("d")) / F.col("total"), F.col("taken") / F.col("total"))


# --- lookups ------------------------------------------------------------------


def window_losses(grams: DataFrame, model: DataFrame, names: list[str], size: int, order: int) -> DataFrame:
    """``gram`` and, per value column of ``model`` in ``names``, its loss -ln p.

    Every window asks for its n-grams and contexts of all orders; the questions
    are joined with the model by key.  ``size`` is that of the vocabulary.
    """
    # keys of one character at most, which all windows ask for: as many as there are characters
    low = F.length("key") <= 2
    asked = []
    for k in range(2, order + 1):
        s = _suffix(F.col("gram"), k)
        asked.append(F.struct(F.lit(2 * k).alias("slot"), F.concat(F.lit("a"), s).alias("key")))
        if k > 2:
            asked.append(F.struct(F.lit(2 * k + 1).alias("slot"), F.concat(F.lit("g"), F.substring(s, 1, k - 1)).alias("key")))
    found = grams.select("gram", F.explode(F.array(*asked)).alias("q")).select("gram", "q.*").join(model.where(~low), "key", "left")
    slot = lambda name, i, missing: F.coalesce(F.max(F.when(F.col("slot") == i, F.col(name))), F.lit(missing))
    high = [(2 * k, 0.0) for k in range(2, order + 1)] + [(2 * k + 1, 1.0) for k in range(3, order + 1)]
    found = found.groupBy("gram").agg(*[slot(name, i, missing).alias(f"{name}{i}") for name in names for i, missing in high])
    few = model.where(low)
    for i, key in ((2, F.concat(F.lit("a"), _suffix(F.col("gram"), 1))), (3, F.lit("g")), (5, F.concat(F.lit("g"), F.substring(_suffix(F.col("gram"), 2), 1, 1)))):
        part = F.broadcast(few.select(F.col("key").alias("_key"), *[F.col(n).alias(f"{n}{i}") for n in names]))
        found = found.withColumn("_asked", key).join(part, F.col("_asked") == F.col("_key"), "left").drop("_asked", "_key")
    losses = []
    for name in names:
        p = F.lit(1.0 / size)
        for k in range(1, order + 1):
            p = F.coalesce(F.col(f"{name}{2 * k}"), F.lit(0.0)) + F.coalesce(F.col(f"{name}{2 * k + 1}"), F.lit(1.0)) * p
        losses.append((-F.log(p)).alias(name))
    return found.select("gram", *losses)


def text_losses(blocks: DataFrame, model: DataFrame, names: list[str], size: int, order: int = ORDER) -> DataFrame:
    """``doc_id, tag, mark, n_tokens`` and a summed loss per name, for each row of the blocks.

    ``n_tokens`` counts the characters and the end.
    """
    asked = blocks.select("block", F.posexplode("grams").alias("at", "gram"))
    known = window_losses(asked.select("gram").distinct(), model, names, size, order)
    back = (
        asked.join(known, "gram").groupBy("block")
        .agg(F.array_sort(F.collect_list(F.struct("at", *names))).alias("v"))
        .select("block", *[F.col(f"v.{n}").alias(n) for n in names])
    )
    joined = blocks.select("block", "payload", "doc_ids", "tags", "marks").join(back, "block")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                part = {n: batch.column(n)[i] for n in batch.schema.names}
                raw = zstandard.ZstdDecompressor().decompress(part["payload"].as_py())
                texts = raw.decode("utf-8", "surrogatepass").split(END)
                values = [part[n].values.to_numpy() for n in names]
                sums = [np.zeros(len(texts)) for _ in names]
                size = np.zeros(len(texts), np.int64)
                places = Places()
                for _, _, key, own in windows(texts, order):
                    number, _, _ = places.numbers(key)
                    size += np.bincount(own, minlength=len(texts))
                    for total, value in zip(sums, values):
                        total += np.bincount(own, weights=value[number], minlength=len(texts))
                yield pa.RecordBatch.from_arrays(
                    [part["doc_ids"].values, part["tags"].values, part["marks"].values, pa.array(size), *map(pa.array, sums)],
                    ["doc_id", "tag", "mark", "n_tokens", *names],
                )
            trim()

    kind = blocks.schema["doc_ids"].dataType.elementType.simpleString()
    schema = f"doc_id {kind}, tag string, mark boolean, n_tokens bigint, " + ", ".join(f"{n} double" for n in names)
    return joined.select("payload", "doc_ids", "tags", "marks", *names).mapInArrow(run, schema)
