"""SimHash near-duplicates: fingerprints, links found with BK-trees, groups.

A document's fingerprint has bit b set if more than half of its shingle hashes
have it.  Documents whose fingerprints differ in at most ``radius`` bits are
linked, and links chain into groups.

The distinct fingerprints are dealt into shards so that no linked pair is
missed: 64 bits are cut into ``radius + 2`` blocks, two fingerprints within the
radius agree on at least two of them, and a shard holds the fingerprints that
agree on one choice of two blocks.  Each shard becomes one BK-tree in the task
that holds it; a query follows only edges within the radius.  A shard of more
than ``tree_size`` fingerprints is cut into several trees, and each is sent to
the queries of the others, pair by pair, so that no task holds more than two
trees' worth.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.joins import skew_join
from ..session import materialize, release
from .common import broadcast_if_small, col, pick, slices

RADIUS = 3
SHINGLE = 3
SEED = 42
TREE_SIZE = 4096


# --- fingerprints -------------------------------------------------------------


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """The fingerprint as a signed 64-bit number; 0 for a text without words.

    A-Z are lower-cased and words lie between white space; with fewer words
    than ``shingle`` the whole sequence is one shingle.
    """
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    parts = zip(*(words[i:] for i in range(shingle))) if len(words) >= shingle else [words]
    hashes = np.fromiter((xxhash.xxh64_intdigest(x, SEED) for x in map(b" ".join, parts)), np.uint64)
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        part = hashes[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.int64)[0])


def fingerprints(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE, keyed: bool = False
) -> DataFrame:
    """``doc_id, fp``, and ``text_key`` if ``keyed``: one row per row of ``docs``, in the partitions they are in."""
    rows = pick(docs, doc_id=doc_id, text=text)
    kept = ["doc_id"]
    if keyed:
        rows, kept = rows.withColumn("text_key", text_key("text")), ["doc_id", "text_key"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            found = pa.array([fingerprint(x, shingle) for x in batch.column("text").to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([*map(batch.column, kept), found], [*kept, "fp"])

    kinds = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in kept)
    return rows.mapInArrow(run, f"{kinds}, fp bigint")


# --- BK-trees -----------------------------------------------------------------


class BKTree:
    """Children are keyed by their integer Hamming distance to the parent."""

    def __init__(self, values: np.ndarray):
        self.values = values
        self.children: list[dict[int, int]] = [{} for _ in values]
        numbers = self.numbers = [int(v) for v in values]
        for i in range(1, len(numbers)):
            node = 0
            while True:
                below = self.children[node]
                step = (numbers[i] ^ numbers[node]).bit_count()
                if step not in below:
                    below[step] = i
                    break
                node = below[step]

    def within(self, query: int, radius: int) -> np.ndarray:
        """Positions of the values within the radius of one query."""
        found, stack = [], [0] if len(self.values) else []
        while stack:
            node = stack.pop()
            distance = (self.numbers[node] ^ query).bit_count()
            if distance <= radius:
                found.append(node)
            stack += [c for edge, c in self.children[node].items() if abs(edge - distance) <= radius]
        return np.array(sorted(found), np.int64)

    def near(self, queries: np.ndarray, radius: int) -> Iterator[tuple[int, np.ndarray]]:
        """(node, positions of the queries within the radius of it), all queries walking down together."""
        stack = [(0, np.arange(len(queries)))] if len(self.values) else []
        while stack:
            node, own = stack.pop()
            distance = np.bitwise_count(queries[own] ^ self.values[node]).astype(np.int64)
            hits = own[distance <= radius]
            if len(hits):
                yield node, hits
            for edge, child in self.children[node].items():
                follow = own[np.abs(distance - edge) <= radius]
                if len(follow):
                    stack.append((child, follow))


def linked(tree: np.ndarray, queries: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """(value, smallest value of its group) for all values that are not that smallest one.

    Groups are those of the links between ``tree`` and ``queries``, which hold
    distinct unsigned values each; the same array twice gives the links inside.
    """
    values = tree if queries is tree else np.concatenate([tree, queries])
    shift = 0 if queries is tree else len(tree)
    group = np.arange(len(values))
    for node, hits in BKTree(tree).near(queries, radius):
        met = np.unique(np.append(group[hits + shift], group[node]))
        if len(met) > 1:
            group[np.isin(group, met[1:])] = met[0]
    order = np.argsort(values.view(np.int64), kind="stable")
    least = np.empty(len(values), np.int64)
    # written from the largest to the smallest, so the smallest stays
    least[group[order[::-1]]] = values.view(np.int64)[order[::-1]]
    root = least[group]
    other = root != values.view(np.int64)
    return values.view(np.int64)[other], root[other]


def _masks(radius: int) -> list[int]:
    """Bit masks of all choices of two among ``radius + 2`` blocks, as signed numbers."""
    cuts = [64 * i // (radius + 2) for i in range(radius + 3)]
    blocks = [(1 << b) - (1 << a) for a, b in itertools.pairwise(cuts)]
    both = [a | b for a, b in itertools.combinations(blocks, 2)]
    return [m - (1 << 64) if m >> 63 else m for m in both]


def links(fps: DataFrame, radius: int = RADIUS, tree_size: int = TREE_SIZE) -> DataFrame:
    """``u, v``: links between distinct fingerprints (column ``fp``) that join all groups.

    Inside a shard each fingerprint is given with the smallest one of its group
    there, so a group of m takes m - 1 rows, not all its pairs.
    """
    dealt = fps.select(
        "fp", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(m)) for m in _masks(radius)])).alias("t", "key")
    )
    sizes = dealt.groupBy("t", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    trees = F.ceil(F.col("n") / tree_size).cast("int")
    own = F.pmod(F.xxhash64("fp"), trees).cast("int")
    pairs = (
        dealt.join(sizes, ["t", "key"])
        .select("t", "key", "fp", own.alias("own"), F.explode(F.sequence(F.lit(0), trees - 1)).alias("other"))
        .select("t", "key", F.least("own", "other").alias("a"), F.greatest("own", "other").alias("b"), "own", "fp")
    )
    dealt_pairs = pairs.repartition("t", "key", "a", "b").sortWithinPartitions("t", "key", "a", "b", "own", "fp")

    def search(keys: np.ndarray, fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        values = fp.view(np.uint64)
        if keys[0, 2] == keys[0, 3]:
            return linked(values, values, radius)
        inside = keys[:, 4] == keys[0, 2]
        if inside.all() or not inside.any():
            return linked(values[:0], values[:0], radius)
        return linked(values[inside], values[~inside], radius)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept_keys, kept = np.empty((0, 5), np.int64), np.empty(0, np.int64)
        out: list[tuple[np.ndarray, np.ndarray]] = []

        def flush() -> pa.RecordBatch:
            u, v = (np.concatenate(x) if x else np.empty(0, np.int64) for x in (list(zip(*out)) or ([], [])))
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])

        for batch in batches:
            columns = [batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(6)]
            keys = np.concatenate([kept_keys, np.stack(columns[:5], axis=1)])
            fp = np.concatenate([kept, columns[5]])
            starts = np.flatnonzero(np.append(True, (keys[1:, :4] != keys[:-1, :4]).any(axis=1)))
            for a, b in itertools.pairwise(starts):
                out.append(search(keys[a:b], fp[a:b]))
            kept_keys, kept = keys[starts[-1] :], fp[starts[-1] :]
            yield flush()
        if len(kept):
            out.append(search(kept_keys, kept))
        yield flush()

    return dealt_pairs.mapInArrow(run, "u bigint, v bigint").distinct()


# --- groups -------------------------------------------------------------------


def _state(edges: DataFrame) -> tuple:
    """Count and checksum of the edges: equal when a round has changed nothing."""
    mark = F.xxhash64("u", "v").cast("decimal(20,0)")
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(mark)).first())


def components(edges: DataFrame) -> DataFrame:
    """``u, v``: every node that is not the smallest of its component, with that smallest one.

    Alternates two steps until nothing changes: neighbours larger than a node
    are tied to the smallest node it knows, then the smaller ones are.  The
    edges of each round are written to the shared folder.
    """
    edges = materialize(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links")
    state = _state(edges)
    while state[0]:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        larger = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        tied = larger.groupBy("u").agg(F.min("v").alias("m"))
        smaller = (
            larger.join(tied, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
            .unionByName(tied.withColumnRenamed("m", "v"))
            .distinct()
        )
        last, edges = edges, materialize(smaller, "links")
        release(last)
        before, state = state, _state(edges)
        if state == before:
            break
    return edges


def near_duplicates(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    shingle: int = SHINGLE,
    radius: int = RADIUS,
    tree_size: int = TREE_SIZE,
) -> DataFrame:
    """``doc_id, fp, component_id``: each row of ``docs`` with its group.

    ``component_id`` is the smallest id reachable over links, the row's own id
    included; rows with equal fingerprints are linked.  A null or wordless text
    has fingerprint 0 and is linked like any other.  Repeated rows come out as
    often as they go in.  A row with a null id keeps its place in its group and
    never names it, so a group of such rows alone has a null ``component_id``.
    """
    marks = materialize(fingerprints(docs, doc_id, text, shingle), "fingerprints")
    firsts, roots = _roots(marks, radius, tree_size)
    placed = firsts.join(roots, "fp", "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    names = placed.groupBy("root").agg(F.min("first").alias("component_id"))
    named = placed.join(names, "root").select("fp", "component_id")
    # all copies of a text, and all texts without words, share a fingerprint
    return skew_join(marks, named, "fp").select("doc_id", "fp", "component_id")


def _roots(marks: DataFrame, radius: int, tree_size: int) -> tuple[DataFrame, DataFrame]:
    """(fp, first: the distinct fingerprints with their smallest id), (fp, root: those that are not the smallest of their group)."""
    firsts = materialize(marks.groupBy("fp").agg(F.min("doc_id").alias("first")), "distinct")
    found = components(links(firsts.select("fp"), radius, tree_size))
    return firsts, found.select(F.col("u").alias("fp"), F.col("v").alias("root"))


def drop_near_duplicates(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE, radius: int = RADIUS,
    tree_size: int = TREE_SIZE,
) -> DataFrame:
    """``docs`` with one row of each group, as ``firsts_of_groups`` chooses it."""
    marks = materialize(fingerprints(docs, doc_id, text, shingle, keyed=True), "fingerprints")
    _, roots = _roots(marks, radius, tree_size)
    placed = marks.join(roots, "fp", "left").select("doc_id", "text_key", F.coalesce("root", "fp").alias("group"))
    return firsts_of_groups(docs, materialize(placed, "groups"), doc_id, text)


def text_key(text: Column | str) -> Column:
    """What tells the texts under one id apart: a hash, that of the empty text for null."""
    return F.xxhash64(F.coalesce(col(text), F.lit("")))


def firsts_of_groups(docs: DataFrame, placed: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with one row of each group: the one with the smallest id.

    ``placed`` is a written table (doc_id, text_key, group) of all rows of
    ``docs``.  A null id comes after all others, so such a row stays only where
    its group has no named document.  Of rows of a group under that id the one
    with the smallest text hash stays, and of repeated rows (same id, same text)
    one; different texts under one id are judged each in its own group.  Texts
    do not move: only the keys of rows that go are joined.
    """
    own = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "text_key")
    firsts = placed.groupBy("group").agg(F.min(own).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    firsts = materialize(firsts.select("group", "first"), "firsts")
    others = placed.join(broadcast_if_small(firsts), "group").where(~own.eqNullSafe(F.col("first")))
    leave = materialize(others.select("doc_id", "text_key").distinct(), "leave")
    counts = placed.groupBy("doc_id", "text_key").agg(F.count(F.lit(1)).alias("n"))
    twice = materialize(counts.where("n > 1").select("doc_id", "text_key"), "repeated")
    release(firsts)

    def meets(rows: DataFrame, keys: DataFrame, how: str) -> DataFrame:
        keys = broadcast_if_small(keys)
        return rows.join(keys, docs[doc_id].eqNullSafe(keys["doc_id"]) & (text_key(docs[text]) == keys["text_key"]), how)

    kept = meets(docs, leave, "left_anti")
    if twice.isEmpty():
        return kept.select(*docs.columns)
    once, again = (meets(kept, twice, how) for how in ("left_anti", "left_semi"))
    one = again.groupBy(docs[doc_id].alias("id"), text_key(docs[text]).alias("key")).agg(
        F.first(F.struct(*[docs[c] for c in docs.columns])).alias("row")
    )
    return once.select(*docs.columns).unionByName(one.select("row.*"))
