"""Near copies: texts whose sets of word shingles have a Jaccard similarity of 0.8 or more.

Texts with the same shingles are one node.  A node has a fingerprint (SimHash of
its distinct shingles) and band keys, each a hash of a few min-hashes.  Nodes that
share a band key are a shard; each shard becomes BK-trees of at most
``TREE_SIZE`` fingerprints, and what the trees find within the radius is held
against the shingles themselves before it links.

Three searches follow each other.  In the first every tree gives its nodes to a
few leaders, so a large group takes one pair per node.  In the second nodes look
for the nearest of another group; a shard whose nodes are all in one group is
closed.  In the third the nodes that the trees still find near another group take
their shingles to the shards that are left, where all of them are compared at
once: what leaves a task is one link for two groups that it joins, never a list
of pairs that are merely close.

Two nodes at the limit share no band key once in ``(1 - 0.8^3)^20``, 6 in ten
million pairs; the radii lie five standard deviations above the distance expected
there.  Closer pairs are lost far more rarely still.
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
from . import simhash
from .common import broadcast_if_small, pick, slices, text_batches, trim

SHINGLE = 5
#: The similarity as a fraction, so that its limit is exact.
SHARE = (4, 5)
#: Band keys per node, and min-hashes per band key.
BANDS, ROWS = 20, 3
#: Bits that fingerprints of near copies differ by at most; few shingles leave more to chance.
RADIUS, SMALL_RADIUS, SMALL = 24, 28, 32
TREE_SIZE = 1024
#: Nodes, and bytes of their shingles, that are compared with as many others in a task of the third search.
BLOCK_SIZE, BLOCK_BYTES = 4096, 4 << 20
#: Multipliers of the min-hashes.
MULTIPLIERS = np.random.default_rng(10).integers(0, 2**63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


# --- nodes ----------------------------------------------------------------------


def shingles(text: str | None, shingle: int = SHINGLE) -> np.ndarray:
    """The distinct shingle hashes in order; words as in ``simhash.fingerprint``."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    parts = zip(*(words[i:] for i in range(shingle))) if len(words) >= shingle else [words]
    return np.unique(np.fromiter((xxhash.xxh64_intdigest(x, simhash.SEED) for x in map(b" ".join, parts)), np.uint64))


def set_fingerprint(grams: np.ndarray) -> int:
    """Bit b is set if more than half of the hashes have it."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(grams), 1 << 16):
        part = grams[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(grams), bitorder="little").view(np.int64)[0])


def band_keys(grams: np.ndarray) -> np.ndarray:
    """A key per band: a hash of the band's number and the least of the shingles by each of its min-hashes."""
    least = np.full(len(MULTIPLIERS), np.iinfo(np.uint64).max)
    for at in range(0, len(grams), 4096):
        least = np.minimum(least, (grams[at : at + 4096, None] * MULTIPLIERS).min(axis=0))
    rows = least.reshape(BANDS, ROWS)
    return np.fromiter((xxhash.xxh64_intdigest(r.tobytes(), t) for t, r in enumerate(rows)), np.uint64, BANDS).view(np.int64)


def _marks(docs: DataFrame, doc_id: str, text: str, shingle: int) -> DataFrame:
    """``doc_id, text_key, node, fp, size, keys, grams``: the node's number is a hash of its shingles, which are written as bytes."""
    text_batches(docs.sparkSession)
    rows = pick(docs, doc_id=doc_id, text=text).withColumn("text_key", simhash.text_key("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            grams = [shingles(t, shingle) for t in batch.column("text").to_pylist()]
            keys = np.concatenate([band_keys(g) if len(g) else np.zeros(0, np.int64) for g in grams] or [np.zeros(0, np.int64)])
            ends = np.cumsum([0] + [BANDS * (len(g) > 0) for g in grams])
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"), batch.column("text_key"),
                    pa.array(np.fromiter((xxhash.xxh3_64_intdigest(g.tobytes()) for g in grams), np.uint64, len(grams)).view(np.int64)),
                    pa.array([set_fingerprint(g) for g in grams], pa.int64()), pa.array([len(g) for g in grams], pa.int64()),
                    pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(keys)),
                    pa.array([g.tobytes() for g in grams], pa.binary()),
                ],
                ["doc_id", "text_key", "node", "fp", "size", "keys", "grams"],
            )
        trim()

    kind = rows.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, text_key bigint, node bigint, fp bigint, size bigint, keys array<bigint>, grams binary"
    return rows.mapInArrow(run, schema)


# --- trees of a shard ---------------------------------------------------------------


def _fit(a, b):
    """Whether sets of so many shingles can be similar enough."""
    return (SHARE[1] * a >= SHARE[0] * b) & (SHARE[1] * b >= SHARE[0] * a)


def leaders(fp: np.ndarray, size: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(leader, nodes given to it): the first free node takes all free ones that the tree finds near it."""
    tree = simhash.BKTree(fp)
    free = np.ones(len(fp), bool)
    for i in range(len(fp)):
        if free[i]:
            free[i] = False
            found = tree.within(int(fp[i]), SMALL_RADIUS)
            found = found[free[found]]
            found = found[_fit(size[found], size[i]) & _near(fp[found], fp[i], size[found], size[i])]
            free[found] = False
            if len(found):
                yield i, found


def _near(a: np.ndarray, b, size_a: np.ndarray, size_b) -> np.ndarray:
    limit = np.where(np.minimum(size_a, size_b) < SMALL, SMALL_RADIUS, RADIUS)
    return np.bitwise_count(a ^ b) <= limit


def _pairs_in_trees(entries: DataFrame, counts: DataFrame, search: str) -> DataFrame:
    """``u, v, distance``: what the trees of each shard find.

    ``entries`` (key, node, fp, size, root) are dealt into trees of about
    ``TREE_SIZE`` nodes.  Leaders are looked for inside each tree; the searches
    for other groups send each tree to the nodes of the others, two trees at a time.
    ``near`` tells only which nodes are near another group, as ``u`` and as ``v``.
    """
    sized = entries.join(broadcast_if_small(counts), "key")
    trees = F.ceil(F.col("n") / TREE_SIZE).cast("int")
    own = F.pmod(F.xxhash64("node", "key"), trees).cast("int")
    if search == "leaders":
        dealt = sized.select("key", own.alias("a"), own.alias("b"), own.alias("own"), "node", "fp", "size", "root")
    else:
        dealt = sized.select("*", own.alias("own"), F.explode(F.sequence(F.lit(0), trees - 1)).alias("other")).select(
            "key", F.least("own", "other").alias("a"), F.greatest("own", "other").alias("b"), "own", "node", "fp", "size", "root"
        )
    order = F.xxhash64("node")  # the same leader in every shard that has it
    dealt = dealt.repartition("key", "a", "b").sortWithinPartitions("key", "a", "b", "own", order)

    def shard(own: np.ndarray, first: int, node: np.ndarray, fp: np.ndarray, size: np.ndarray, root: np.ndarray, alone: bool):
        if search == "leaders":
            for i, found in leaders(fp, size):
                yield node[found], np.full(len(found), node[i]), np.bitwise_count(fp[found] ^ fp[i])
            return
        inside = own == first
        if (root == root[0]).all() or not alone and (inside.all() or not inside.any()):
            return
        asked = np.arange(len(fp)) if alone else np.flatnonzero(~inside)
        tree = np.arange(len(fp)) if alone else np.flatnonzero(inside)
        best = np.full(len(asked), 65)
        partner = np.zeros(len(asked), np.int64)
        met = np.zeros(len(fp), bool)
        for t, hits in simhash.BKTree(fp[tree]).near(fp[asked], SMALL_RADIUS):
            at, q = tree[t], asked[hits]
            good = (root[q] != root[at]) & _fit(size[q], size[at]) & _near(fp[q], fp[at], size[q], size[at])
            if alone:
                good &= q > at
            hits, q = hits[good], q[good]
            if not len(q):
                continue
            if search == "near":
                met[q] = met[at] = True
            else:
                distance = np.bitwise_count(fp[q] ^ fp[at])
                closer = distance < best[hits]
                best[hits[closer]], partner[hits[closer]] = distance[closer], node[at]
        if search == "near":
            yield node[met], node[met], np.zeros(met.sum())
            return
        some = best < 65
        if some.any():
            yield node[asked[some]], partner[some], best[some]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.empty((0, 8), np.int64)

        def flush(rows: np.ndarray, starts: np.ndarray) -> Iterator[pa.RecordBatch]:
            for a, b in itertools.pairwise(starts):
                part = rows[a:b]
                columns = part[:, 4], part[:, 5].view(np.uint64), part[:, 6], part[:, 7]
                for u, v, distance in shard(part[:, 3], part[0, 1], *columns, alone=part[0, 1] == part[0, 2]):
                    arrays = [pa.array(np.maximum(u, v)), pa.array(np.minimum(u, v)), pa.array(distance.astype(np.int64))]
                    yield pa.RecordBatch.from_arrays(arrays, ["u", "v", "distance"])

        for batch in batches:
            columns = [batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(8)]
            held = np.concatenate([held, np.stack(columns, axis=1)])
            starts = np.flatnonzero(np.append(True, (held[1:, :3] != held[:-1, :3]).any(axis=1)))
            yield from flush(held, starts)
            held = np.ascontiguousarray(held[starts[-1] :])
        if len(held):
            yield from flush(held, np.array([0, len(held)]))

    return dealt.mapInArrow(run, "u bigint, v bigint, distance bigint")


# --- links ------------------------------------------------------------------------


def verified(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Those of the written ``pairs`` (u, v) whose shingles are similar enough, written.

    Only shingles of nodes that have a pair move.
    """
    asked = materialize(pairs.select(F.explode(F.array("u", "v")).alias("node")).distinct(), "asked")
    known = nodes.join(broadcast_if_small(asked), "node", "left_semi")
    left = known.select(F.col("node").alias("u"), F.col("grams").alias("a"))
    right = known.select(F.col("node").alias("v"), F.col("grams").alias("b"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for a, b in zip(batch.column("a"), batch.column("b")):
                x, y = (np.frombuffer(c.as_buffer(), np.uint64) for c in (a, b))
                common = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(SHARE[1] * common >= SHARE[0] * (len(x) + len(y) - common))
            yield batch.select(["u", "v"]).filter(pa.array(keep, pa.bool_()))
        trim()

    both = pairs.select("u", "v").join(left, "u").join(right, "v").select("u", "v", "a", "b")
    found = materialize(both.mapInArrow(run, "u bigint, v bigint"), "similar")
    release(asked)
    return found


def similar_in_block(
    inside: np.ndarray, alone: bool, node: np.ndarray, root: np.ndarray, grams: list[np.ndarray]
) -> Iterator[tuple[int, int]]:
    """Links (u, v) that join the groups ``root`` of all similar nodes of a block, or (not ``alone``) of similar nodes
    of two blocks, the first one those ``inside``.  One link for each two groups it joins, so fewer than there are groups.
    """
    size = np.array([len(g) for g in grams])
    values, at, n = np.unique(np.concatenate(grams), return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(len(grams)), size)
    shared = n[at] > 1
    # shingles of its own alone keep a node from being similar to any other
    able = SHARE[1] * np.bincount(owner[shared], minlength=len(grams)) >= SHARE[0] * size
    use = shared & able[owner]
    at, owner = at[use], owner[use]
    if not able.any() or (root[able] == root[able][0]).all():
        return
    if alone:
        groups, members = np.unique(root[able], return_counts=True)
        asked = np.flatnonzero(able & (root != groups[members.argmax()]))
    else:
        asked = np.flatnonzero(able & ~inside)
    target = able if alone else able & inside
    # the targets that have each shingle, one after the other
    held = np.flatnonzero(target[owner])
    held = held[np.argsort(at[held], kind="stable")]
    ends = np.cumsum(np.bincount(at[held], minlength=len(values)))
    holders = owner[held]
    first = np.searchsorted(owner, np.arange(len(grams) + 1))
    up: dict[int, int] = {}

    def top(group: int) -> int:
        while group in up:
            group = up[group]
        return group

    for i in asked:
        own = at[first[i] : first[i + 1]]
        stop = ends[own]
        start = np.where(own > 0, ends[own - 1], 0)
        count = stop - start
        places = np.repeat(stop - np.cumsum(count), count) + np.arange(count.sum())
        common = np.bincount(holders[places], minlength=len(grams))
        found = np.flatnonzero((SHARE[1] * common >= SHARE[0] * (size + size[i] - common)) & (root != root[i]) & target)
        for group, j in zip(*np.unique(root[found], return_index=True)):
            a, b = top(int(group)), top(int(root[i]))
            if a != b:
                up[a] = b
                yield int(node[i]), int(node[found[j]])


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows of each (key, a, b), which follow each other."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        keys = np.stack([batch.column(c).to_numpy() for c in ("key", "a", "b")], axis=1)
        starts = np.flatnonzero(np.append(True, (keys[1:] != keys[:-1]).any(axis=1))) if len(keys) else []
        for a, b in itertools.pairwise([*starts, len(keys)]):
            if held and tuple(keys[a]) != last:
                yield pa.Table.from_batches(held)
                held = []
            last = tuple(keys[a])
            held.append(batch.slice(a, b - a))
    if held:
        yield pa.Table.from_batches(held)


def _links_in_shards(entries: DataFrame, roots: DataFrame, nodes: DataFrame) -> DataFrame:
    """``u, v``, written: links that join the groups of all similar nodes among ``entries`` (key, node, size, root).

    Each open shard is cut into blocks of bounded size, and two blocks at a time
    meet in a task with the shingles of their nodes.
    """
    span = entries.groupBy("key").agg(
        F.min("root").alias("low"), F.max("root").alias("high"), F.count(F.lit(1)).alias("n"), F.sum("size").alias("grams")
    )
    blocks = F.greatest(F.ceil(F.col("n") / BLOCK_SIZE), F.ceil(F.col("grams") * 8 / BLOCK_BYTES)).cast("int")
    counts = materialize(span.where("low <> high").select("key", blocks.alias("blocks")), "open")
    asked = entries.join(broadcast_if_small(counts), "key", "left_semi").select("node").distinct()
    asked = materialize(asked, "asked")
    known = nodes.join(broadcast_if_small(asked), "node", "left_semi")
    known = known.join(broadcast_if_small(roots.select(F.col("u").alias("node"), F.col("v").alias("root"))), "node", "left")
    own = F.pmod(F.xxhash64("node", "key"), F.col("blocks")).cast("int")
    dealt = (
        known.select("node", F.coalesce("root", "node").alias("root"), "grams", F.explode("keys").alias("key"))
        .join(broadcast_if_small(counts), "key")
        .select("*", own.alias("own"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
        .select("key", F.least("own", "other").alias("a"), F.greatest("own", "other").alias("b"), "own", "node", "root", "grams")
    )
    dealt = dealt.repartition("key", "a", "b").sortWithinPartitions("key", "a", "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in _blocks(batches):
            own, node, root = (block.column(c).to_numpy() for c in ("own", "node", "root"))
            first, last = block.column("a")[0].as_py(), block.column("b")[0].as_py()
            if (root == root[0]).all() or first != last and len({*own}) < 2:
                continue
            grams = [np.frombuffer(g.as_buffer(), np.uint64) for g in block.column("grams")]
            found = list(similar_in_block(own == first, first == last, node, root, grams))
            u, v = (pa.array([x[i] for x in found], pa.int64()) for i in (0, 1))
            yield pa.RecordBatch.from_arrays([u, v], ["u", "v"])
        trim()

    similar = materialize(dealt.mapInArrow(run, "u bigint, v bigint"), "similar")
    release(counts, asked)
    return similar


def node_links(nodes: DataFrame) -> DataFrame:
    """``u, v``: nodes (node, fp, size, keys, grams) that are not the smallest of their group, with that smallest one."""
    each = nodes.select(F.explode("keys").alias("key"), "node", "fp", "size")
    shared = materialize(each.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "keys")
    entries = materialize(each.join(broadcast_if_small(shared.select("key")), "key", "left_semi"), "entries")
    roots = None
    for search in ("leaders", "nearest", "near"):
        if roots is None:
            marked, counts = entries.withColumn("root", F.col("node")), shared
        else:
            marked = entries.join(broadcast_if_small(roots.select(F.col("u").alias("node"), F.col("v").alias("root"))), "node", "left")
            marked = materialize(marked.withColumn("root", F.coalesce("root", "node")), "marked")
            # closed shards are left out
            span = marked.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count(F.lit(1)).alias("n"))
            counts = materialize(span.where("low <> high").select("key", "n"), "open")
        found = _pairs_in_trees(marked, counts, search)
        if search == "near":
            pairs = materialize(found.select(F.col("u").alias("node")).distinct(), "near")
            similar = _links_in_shards(marked.join(broadcast_if_small(pairs), "node", "left_semi"), roots, nodes)
        else:
            # one partner per node: by rank among leaders, else the nearest
            best = F.struct(F.when(F.lit(search == "nearest"), F.col("distance")), F.xxhash64("v"), "v")
            found = found.groupBy("u").agg(F.min(best).alias("best")).select("u", "best.v")
            pairs = materialize(found.distinct(), "pairs")
            similar = verified(pairs, nodes)
        if roots is not None:
            release(marked, counts)
        last, roots = roots, simhash.components(similar if roots is None else roots.unionByName(similar))
        release(pairs, similar, *([last] if last is not None else []))
    release(shared, entries)
    return roots


def _placed(docs: DataFrame, doc_id: str, text: str, shingle: int) -> DataFrame:
    """``doc_id, text_key, group``, written."""
    # rows of the written table have numbers
    marks = materialize(_marks(docs, doc_id, text, shingle).withColumn("row", F.monotonically_increasing_id()), "marks")
    firsts = marks.groupBy("node").agg(F.min("row").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").select("node", "first")
    firsts = materialize(firsts, "copies")
    again = marks.select("node", "row").join(broadcast_if_small(firsts), "node").where("row <> first").select("row")
    again = materialize(again, "again")
    # one row of each node, read from where it was written
    nodes = marks.join(broadcast_if_small(again), "row", "left_anti").select("node", "fp", "size", "keys", "grams")
    roots = node_links(nodes.where("size > 0"))
    known = roots.select(F.col("u").alias("node"), F.col("v").alias("root"))
    placed = skew_join(marks.select("doc_id", "text_key", "node"), known, "node")
    placed = materialize(placed.select("doc_id", "text_key", F.coalesce("root", "node").alias("group")), "groups")
    release(marks, firsts, again, roots)
    return placed


def near_copies(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """``doc_id, component_id``: each row of ``docs`` with the smallest id of its group.

    Links chain.  Texts without words are copies of each other.  Null ids as in
    ``simhash.near_duplicates``.
    """
    placed = _placed(docs, doc_id, text, shingle)
    names = placed.groupBy("group").agg(F.min("doc_id").alias("component_id"))
    return placed.join(broadcast_if_small(names), "group").select("doc_id", "component_id")


def drop_near_copies(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """``docs`` with one document of each group, as ``simhash.firsts_of_groups`` chooses it."""
    return simhash.firsts_of_groups(docs, _placed(docs, doc_id, text, shingle), doc_id, text)
