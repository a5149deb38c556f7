"""Source divergence audit: how far each source's words lie from the other sources and from its language.

A task takes the bytes of its texts as they lie in the Arrow buffer and keeps one
pointer per word start.  The pointers are sorted by (language, source) and the
bytes they point at, as in multikey quicksort: a slice of eight bytes is sorted,
and only runs of equal slices whose words go on are sorted by the next slice.
Runs of equal words then give occurrences and documents.  Spark adds them up by
(language, source, word), so nothing longer than a task's block is held anywhere.

Words that enough documents of a language have are kept.  Shares are whole
numbers of 10^-9 with five occurrences added to each word, so results are exact.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize
from .common import broadcast_if_small, pick, slices

LEAST_DOCUMENTS = 30
ADDED = 5
UNIT = 1_000_000_000
TOP_TERMS = 50

#: Bytes of text whose words are sorted at once.
BLOCK_BYTES = 4 << 20
#: A group of the pair sums holds about so many shares, or four terms per source where that is more.
CELL_SHARES = 1 << 15
#: Sources of a language are compared in tiles of about so many.
TILE_SOURCES = 512


# --- word-start pointers --------------------------------------------------------


def _bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of all texts with A-Z lower-cased and eight zeros after them, where each text begins and the last ends)."""
    texts = texts.cast(pa.large_string())
    _, offsets, data = texts.buffers()
    ends = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(data, np.uint8)[ends[0] : ends[-1]] if data is not None else np.empty(0, np.uint8)
    out = np.zeros(len(raw) + 8, np.uint8)
    out[: len(raw)] = raw + (((raw >= 65) & (raw <= 90)).view(np.uint8) << 5)
    return out, ends - ends[0]


def pointers(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, length, text number) of every run of letters a-z and bytes of non-ASCII characters."""
    body = data[: bounds[-1]]
    inside = np.zeros(len(body) + 1, bool)
    inside[:-1] = ((body >= 97) & (body <= 122)) | (body >= 128)
    cut = np.zeros(len(body) + 1, bool)
    cut[bounds] = True
    before = np.append(False, inside[:-2]) if len(body) else inside[:0]
    starts = np.flatnonzero(inside[:-1] & (cut[:-1] | ~before))
    ends = np.flatnonzero(inside[:-1] & (cut[1:] | ~inside[1:])) + 1
    return starts, ends - starts, np.searchsorted(bounds, starts, "right") - 1


def sorted_runs(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order of the pointers by group and word, places in it where a run of equal words begins).

    Pointers of one run keep their order.
    """
    # the eight bytes from each byte on, as one number that sorts as they do
    window = np.ndarray((len(data) - 7,), ">u8", data, strides=(1,))
    n = len(starts)

    def part(of: np.ndarray, depth: int) -> np.ndarray:
        spare = (8 * np.maximum(8 - (lengths[of] - depth), 0)).astype(np.uint64)
        return window[starts[of] + depth].astype(np.uint64) >> spare << spare

    every = np.arange(n)
    key = part(every, 0)
    order = np.lexsort((key, group))
    fresh = np.ones(n, bool)
    fresh[1:] = (key[order][1:] != key[order][:-1]) | (group[order][1:] != group[order][:-1])
    place, run, depth = every, np.cumsum(fresh) - 1, 8
    while True:
        # only runs of several pointers of which some go on; the words of such a run are at least this long
        size, longer = np.bincount(run), np.bincount(run, lengths[order[place]] > depth)
        go_on = (size[run] > 1) & (longer[run] > 0)
        place, run = place[go_on], run[go_on]
        if not len(place):
            break
        own = order[place]
        key = part(own, depth)
        inner = np.lexsort((key, run))
        order[place], key = own[inner], key[inner]
        differs = np.append(True, (key[1:] != key[:-1]) | (run[1:] != run[:-1]))
        fresh[place] |= differs
        run = np.cumsum(differs) - 1
        depth += 8
    return order, np.flatnonzero(fresh)


def block_terms(texts: pa.Array, group: np.ndarray) -> tuple[np.ndarray, pa.Array, np.ndarray, np.ndarray]:
    """(group, word, occurrences, texts that have it) of every distinct word of every group."""
    data, bounds = _bytes(texts)
    starts, lengths, text = pointers(data, bounds)
    if not len(starts):
        return np.empty(0, np.int64), pa.array([], pa.string()), np.empty(0, np.int64), np.empty(0, np.int64)
    own = group[text]
    order, at = sorted_runs(data, starts, lengths, own)
    where = text[order]
    new = np.append(True, where[1:] != where[:-1])
    new[at] = True
    n = np.diff(np.append(at, len(order)))
    first = order[at]
    size = lengths[first]
    ends = np.cumsum(size)
    chars = np.arange(ends[-1]) + np.repeat(starts[first] - (ends - size), size)
    offsets = pa.py_buffer(np.append(0, ends).astype(np.int32).tobytes())
    words = pa.StringArray.from_buffers(len(at), offsets, pa.py_buffer(data[chars].tobytes()))
    return own[first], words, n, np.add.reduceat(new.astype(np.int64), at)


def term_counts(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """``lang, source, term, n, df``: occurrences and documents of each word in each source of a language.

    Every row of ``docs`` is a document.  The empty term stands for the source
    itself, which thus has a row even without words.
    """
    rows = pick(docs, text=text, lang=lang, source=source).select(
        *[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("text", "lang", "source")]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", BLOCK_BYTES):
            pair = [batch.column(c).dictionary_encode() for c in ("lang", "source")]
            codes = [p.indices.to_numpy(zero_copy_only=False).astype(np.int64) for p in pair]
            each, group = np.unique(codes[0] * len(pair[1].dictionary) + codes[1], return_inverse=True)
            own, words, n, df = block_terms(batch.column("text"), group)
            own = np.concatenate([np.arange(len(each)), own])
            none = np.zeros(len(each), np.int64)
            names = [p.dictionary.take(pa.array(c[own])) for p, c in zip(pair, np.divmod(each, len(pair[1].dictionary)))]
            yield pa.RecordBatch.from_arrays(
                [
                    *names, pa.concat_arrays([pa.array([""] * len(each), pa.string()), words]),
                    pa.array(np.concatenate([none, n])), pa.array(np.concatenate([none, df])),
                ],
                ["lang", "source", "term", "n", "df"],
            )

    counted = rows.mapInArrow(run, "lang string, source string, term string, n bigint, df bigint")
    return counted.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("df").alias("df"))


# --- shares ---------------------------------------------------------------------


def share(n: Column, total: Column, terms: Column) -> Column:
    """1 + floor(10^9 (n + 5) / (total + 5 terms)), exact beyond 64 bits; without terms nothing asks for it."""
    wide = lambda c: c.cast("decimal(20,0)")
    high = wide(n + ADDED) * F.lit(UNIT).cast("decimal(10,0)")
    return F.call_function("div", high, wide(F.greatest(total + ADDED * terms, F.lit(1)))) + 1


def _kept(counts: DataFrame, least: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(kept terms: lang, term, lang_n), (their counts: lang, source, term, n, lang_n), (groups with totals)."""
    terms = counts.where("term <> ''").groupBy("lang", "term").agg(F.sum("n").alias("lang_n"), F.sum("df").alias("df"))
    terms = materialize(terms.where(F.col("df") >= least).drop("df"), "terms")
    small = broadcast_if_small(terms, width=F.octet_length("term") + F.octet_length("lang") + 64)
    kept = materialize(counts.select("lang", "source", "term", "n").join(small, ["lang", "term"]), "kept")
    langs = terms.groupBy("lang").agg(F.count(F.lit(1)).alias("v"), F.sum("lang_n").alias("lang_total"))
    totals = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = counts.where("term = ''").select("lang", "source").join(totals, ["lang", "source"], "left").join(
        broadcast_if_small(langs), "lang", "left"
    )
    groups = groups.na.fill(0, ["total", "v", "lang_total"])
    sources = groups.groupBy("lang").agg(F.count(F.lit(1)).alias("s"))
    per_cell = F.greatest(F.lit(CELL_SHARES) / F.col("s"), 4 * F.least("s", F.lit(TILE_SOURCES)))
    groups = groups.join(broadcast_if_small(sources), "lang").select(
        "lang", "source", "total", "v", "lang_total",
        F.greatest(F.lit(1), F.ceil(F.col("v") / per_cell)).cast("int").alias("cells"),
        F.ceil(F.col("s") / TILE_SOURCES).cast("int").alias("tiles"),
    )
    return terms, kept, materialize(groups, "groups")


def pair_distances(terms: DataFrame, shares: DataFrame, groups: DataFrame) -> DataFrame:
    """``lang, source, item, value``: for each two sources of a language the summed differences of their shares.

    Terms are dealt into cells and sources into tiles; a group holds the shares
    of two tiles in one cell and gives the sums there.  A source's share of terms
    that it lacks is the same for all of them, and travels once per group.
    """
    cell = lambda: F.pmod(F.xxhash64("term"), F.col("cells")).cast("int").alias("cell")
    plan = groups.select("lang", "cells").distinct()
    sizes = terms.join(broadcast_if_small(plan), "lang").groupBy("lang", cell()).agg(F.count(F.lit(1)).alias("m"))
    bases = groups.select(
        "lang", "source", F.explode(F.sequence(F.lit(0), F.col("cells") - 1)).alias("cell"), "tiles",
        share(F.lit(0), F.col("total"), F.col("v")).alias("p"),
    ).join(broadcast_if_small(sizes), ["lang", "cell"], "left")
    rows = bases.select("lang", "cell", "tiles", "source", F.lit("").alias("term"), "p", F.coalesce("m", F.lit(0)).alias("m")).unionByName(
        shares.select("lang", cell(), "tiles", "source", "term", "p", F.lit(0).cast("bigint").alias("m"))
    )
    tile = F.pmod(F.xxhash64("source", F.lit("tile")), F.col("tiles")).cast("int")
    rows = rows.withColumn("tile", tile).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    rows = rows.select("lang", "cell", F.least("tile", "other").alias("a"), F.greatest("tile", "other").alias("b"), "tile", "source", "term", "p", "m")

    def sums(group: pa.Table) -> pa.Table:
        codes = {c: group.column(c).combine_chunks().dictionary_encode() for c in ("source", "term")}
        source, term = (codes[c].indices.to_numpy().astype(np.int64) for c in ("source", "term"))
        p, m = (group.column(c).to_numpy() for c in ("p", "m"))
        names = codes["source"].dictionary
        base = term == codes["term"].dictionary.index("").as_py()
        rest, tiles = np.zeros(len(names), np.int64), np.zeros(len(names), np.int64)
        rest[source[base]] = p[base]
        tiles[source] = group.column("tile").to_numpy()
        # one column more than terms: the empty one, where all differ by nothing
        dense = np.repeat(rest[:, None], len(codes["term"].dictionary), axis=1)
        dense[source[~base], term[~base]] = p[~base]
        missing = int(m.max()) - (len(codes["term"].dictionary) - 1)
        a, b = group.column("a")[0].as_py(), group.column("b")[0].as_py()
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        dense[:, codes["term"].dictionary.index("").as_py()] = 0
        for i in range(len(names)):
            j = np.flatnonzero(tiles == (b if tiles[i] == a else a)) if a != b else np.arange(len(names))
            j = j[j != i]
            value = np.abs(dense[j] - dense[i]).sum(axis=1) + missing * np.abs(rest[j] - rest[i])
            out.append((np.full(len(j), i), j, value))
        i, j, value = (np.concatenate(x) for x in zip(*out))
        lang = group.column("lang")[0].as_py()
        return pa.table(
            {"lang": pa.array([lang] * len(i), pa.string()), "source": names.take(pa.array(i)), "item": names.take(pa.array(j)), "value": pa.array(value)}
        )

    parts = rows.groupBy("lang", "cell", "a", "b").applyInArrow(sums, "lang string, source string, item string, value bigint")
    return parts.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))


def source_divergence(
    docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source",
    least: int = LEAST_DOCUMENTS, top: int = TOP_TERMS,
) -> DataFrame:
    """``lang, source, part, item, value, rank`` for each source of each language.

    Part ``pair`` has each other source of the language by the summed absolute
    difference of their shares over all kept terms (0 where none is kept), part
    ``term`` the ``top`` kept terms whose share exceeds the language's.  Ranks go
    by falling value, then by the item's UTF-8 bytes.

    Null text, language or source count as empty; an empty language or source is
    one of its own.  Repeated rows are documents of their own, whatever their
    ids.  An empty table gives no row, a language of one source no pair.
    """
    counts = materialize(term_counts(docs, text, lang, source), "counts")
    terms, kept, groups = _kept(counts, least)
    shares = kept.join(broadcast_if_small(groups), ["lang", "source"]).select(
        "lang", "source", "term", "cells", "tiles",
        share(F.col("n"), F.col("total"), F.col("v")).alias("p"),
        share(F.col("lang_n"), F.col("lang_total"), F.col("v")).alias("q"),
    )
    over = shares.where("p > q").select("lang", "source", F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))
    by = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    above = over.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= top)
    pairs = pair_distances(terms, shares, groups).withColumn("rank", F.row_number().over(by))
    whole = pairs.withColumn("part", F.lit("pair")).unionByName(above.withColumn("part", F.lit("term")))
    return whole.select("lang", "source", "part", "item", "value", "rank")
