"""Records of files that have no line per record, read by many tasks.

A JSON array and a CSV file with quoted line breaks can be cut anywhere only if
it is known whether a byte lies in quotes and how deep in brackets.  Both follow
from sums over what comes before, so a file is read in two steps:

1. every split tells how its bytes change the state: whether they hold an odd
   number of quotes, and how much deeper they go, once if they begin outside
   quotes and once if inside.  Sums over the splits of a file (one row each) give
   the state at the start of every split;
2. every split cuts its bytes into records.  What lies before its first and after
   its last cut belongs to records of several splits; only these pieces are put
   together by a shuffle.

Splits are those of Spark's text source with a separator of the format's own, so
any file system and size of split will do.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import materialize

#: Bytes that a task reads at most where splits are smaller.
TASK_BYTES = 32 << 20
QUOTE, BACKSLASH, OPEN, CLOSE = 34, 92, (91, 123), (93, 125)


class Scan(NamedTuple):
    """What some bytes hold: cuts between records, bytes that belong to records, and the state after them."""

    cuts: np.ndarray
    inside: np.ndarray
    quoted: bool
    depth: int


class Csv:
    """Records end with a line break outside quotes; quotes stand around fields, doubled inside them."""

    separator = "\n"

    @staticmethod
    def scan(data: np.ndarray, quoted: bool, depth: int, top: int) -> Scan:
        quotes = (np.cumsum(data == QUOTE) + quoted) % 2
        cuts = np.flatnonzero((data == 10) & (quotes == 0))
        return Scan(cuts, np.ones(len(data), bool), bool(quotes[-1]) if len(data) else quoted, depth)


class JsonArray:
    """Records are the elements of arrays: they end with a comma at depth one, outside strings, or with their array.

    A file may hold several arrays one after another.  A document that is no array is one record.
    """

    separator = ","

    @staticmethod
    def scan(data: np.ndarray, quoted: bool, depth: int, top: int) -> Scan:
        quote = data == QUOTE
        slash = np.flatnonzero(data == BACKSLASH)
        if len(slash):
            # a byte is escaped after an odd run of backslashes; commas never are, so no run goes on from before
            first = np.append(True, np.diff(slash) > 1)
            run = slash - slash[np.maximum.accumulate(np.where(first, np.arange(len(slash)), 0))] + 1
            escaped = slash[run % 2 == 1] + 1
            quote[escaped[escaped < len(data)]] = False
        within = (np.cumsum(quote) + quoted) % 2
        free = (within == 0) & ~quote
        step = np.zeros(len(data), np.int64)
        step[free & ((data == OPEN[0]) | (data == OPEN[1]))] = 1
        step[free & ((data == CLOSE[0]) | (data == CLOSE[1]))] = -1
        after = np.cumsum(step) + depth
        array = top == OPEN[0]
        inside = (after - step > 0) & (after > 0) if array else (after - step > 0) | (after > 0) | (data != ord(","))
        ends = ((after == 1) & (data == ord(","))) | ((after == 0) & (step < 0))
        cuts = np.flatnonzero(free & ends) if array else np.empty(0, np.int64)
        end = (bool(within[-1]), int(after[-1])) if len(data) else (quoted, depth)
        return Scan(cuts, inside, *end)


def fewer_tasks(scan: DataFrame) -> DataFrame:
    """A scan of files whose small splits share tasks; order inside a split stays."""
    spark = scan.sparkSession
    splits = scan.rdd.getNumPartitions()
    size = spark.sparkContext._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get("spark.sql.files.maxPartitionBytes"))
    tasks = max(4 * spark.sparkContext.defaultParallelism, -(-splits * size // TASK_BYTES))
    return scan.coalesce(tasks) if tasks < splits else scan


def _lines(spark: SparkSession, path: str | list[str], grammar) -> DataFrame:
    """``file, block, value``: text between separators, in order inside each split.

    A task takes as many splits, one after another, as make ``TASK_BYTES``, so
    that small splits and files don't cost a task each.
    """
    text = spark.read.option("lineSep", grammar.separator).text(path)
    # hashes keep what is sent to all tasks narrow
    lines = text.select(F.xxhash64(F.input_file_name()).alias("file"), F.input_file_block_start().alias("block"), "value")
    return fewer_tasks(lines)


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, bool]]:
    """Batches cut so that each is of one split, and whether it is the first of it."""
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        key = np.stack([batch.column(c).to_numpy() for c in ("file", "block")])
        starts = np.flatnonzero(np.append(True, (key[:, 1:] != key[:, :-1]).any(axis=0)))
        for a, b in zip(starts, [*starts[1:], batch.num_rows]):
            own = tuple(key[:, a].tolist())
            yield batch.slice(a, b - a), own != last
            last = own


def _bytes(batch: pa.RecordBatch, separator: str) -> bytes:
    values = batch.column("value")
    every = pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)
    return pc.binary_join(every, separator)[0].as_buffer().to_pybytes() + separator.encode()


def _changes(lines: DataFrame, grammar) -> DataFrame:
    """``file, block, odd, outside, inside, top``: how each split changes the state, and its first byte that is no blank."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state: dict | None = None

        def row() -> pa.RecordBatch:
            return pa.RecordBatch.from_pylist([state], pa.schema([
                ("file", pa.int64()), ("block", pa.int64()), ("odd", pa.int32()), ("outside", pa.int64()), ("inside", pa.int64()), ("top", pa.int32()),
            ]))

        quoted = [False, True]
        for batch, first in _runs(batches):
            if first:
                if state:
                    yield row()
                state, quoted = {"file": batch["file"][0].as_py(), "block": batch["block"][0].as_py(), "odd": 0, "outside": 0, "inside": 0, "top": 0}, [False, True]
            raw = _bytes(batch, grammar.separator)
            data = np.frombuffer(raw, np.uint8)
            for k, name in enumerate(("outside", "inside")):
                found = grammar.scan(data, quoted[k], state[name], OPEN[0])
                quoted[k], state[name] = found.quoted, found.depth
            state["odd"] = int(quoted[0])
            state["top"] = state["top"] or next(iter(raw.removeprefix(b"\xef\xbb\xbf").strip()), 0)
        if state:
            yield row()

    return lines.mapInArrow(run, "file bigint, block bigint, odd int, outside bigint, inside bigint, top int")


def split_states(changes: DataFrame) -> DataFrame:
    """``file, block, quoted, depth, top, alone``: the state at the start of each split, from sums over the splits
    before, and whether it is the only one of its file."""
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    quoted = changes.withColumn("quoted", F.coalesce(F.sum("odd").over(before), F.lit(0)) % 2 == 1)
    deeper = quoted.withColumn("deeper", F.when(F.col("quoted"), F.col("inside")).otherwise(F.col("outside")))
    every = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    top = F.first(F.when(F.col("top") > 0, F.col("top")), ignorenulls=True).over(every)
    return deeper.select(
        "file", "block", "quoted", F.coalesce(F.sum("deeper").over(before), F.lit(0)).alias("depth"),
        F.coalesce(top, F.lit(0)).alias("top"), (F.count(F.lit(1)).over(every) == 1).alias("alone"),
    )


def _pieces(stated: DataFrame, grammar) -> DataFrame:
    """``file, block, alone, at, cut, value``: texts between cuts, numbered in their split; ``cut`` tells that one follows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        quoted, depth, top, alone, at, held, key = False, 0, 0, False, 0, [], None

        def out(texts: list[str], cut: bool) -> pa.RecordBatch:
            n = len(texts)
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([key[0]] * n, pa.int64()), pa.array([key[1]] * n, pa.int64()), pa.array([alone] * n, pa.bool_()), pa.array(range(at, at + n), pa.int64()),
                    pa.array([cut] * n, pa.bool_()), pa.array(texts, pa.string()),
                ],
                ["file", "block", "alone", "at", "cut", "value"],
            )

        def text(data: np.ndarray) -> bytes:
            return data.tobytes()

        for batch, first in _runs(batches):
            if first:
                if key and any(held):
                    yield out([b"".join(held).decode("utf-8", "surrogatepass")], False)
                key = batch["file"][0].as_py(), batch["block"][0].as_py()
                quoted, depth, top, alone = (batch[c][0].as_py() for c in ("quoted", "depth", "top", "alone"))
                at, held = 0, []
            data = np.frombuffer(_bytes(batch, grammar.separator), np.uint8)
            found = grammar.scan(data, quoted, depth, top)
            quoted, depth = found.quoted, found.depth
            start, texts = 0, []
            for c in found.cuts.tolist():
                held.append(text(data[start:c][found.inside[start:c]]))
                texts.append(b"".join(held).decode("utf-8", "surrogatepass"))
                start, held = c + 1, []
            held.append(text(data[start:][found.inside[start:]]))
            if texts:
                yield out(texts, True)
                at += len(texts)
        if key and any(held):
            yield out([b"".join(held).decode("utf-8", "surrogatepass")], False)

    return stated.select("file", "block", "value", "quoted", "depth", "top", "alone").mapInArrow(run, "file bigint, block bigint, alone boolean, at bigint, cut boolean, value string")


class Splits(NamedTuple):
    """Lines of files, and how each split changes the state, from one scan that has run."""

    lines: DataFrame
    changes: DataFrame


def scan_splits(spark: SparkSession, path: str | list[str], grammar) -> Splits:
    lines = _lines(spark, path, grammar)
    return Splits(lines, materialize(_changes(lines, grammar), "splits"))


def read_records(splits: Splits, grammar, numbered: bool = False) -> DataFrame:
    """``file, first, value``, and ``ord`` if ``numbered``: one row per record of the scanned files.

    ``file`` is a hash of the file's name, ``first`` tells its first record and
    ``ord`` the place of each in it; numbering takes one more scan.  Blank records
    count as none.  Files that are not cut up take neither this nor a shuffle.
    """
    states = split_states(splits.changes)
    stated = splits.lines.join(F.broadcast(states), ["file", "block"])
    pieces = _pieces(stated, grammar)
    # a file in one split has no parts of records
    whole = pieces.where(F.col("alone") | (F.col("at") > 0) & F.col("cut"))
    every = whole.select("file", "block", "at", (F.col("at") == 0).alias("first"), "value")
    cut_up = not states.where(~F.col("alone")).isEmpty()
    if cut_up:
        parts = _pieces(stated.where(~F.col("alone")), grammar)
        # a split's first piece and its last one without a cut may be parts of a record
        edges = parts.where((F.col("at") == 0) | ~F.col("cut"))
        cut_before = Window.partitionBy("file").orderBy("block", "at").rowsBetween(Window.unboundedPreceding, -1)
        # the record goes on until a piece that a cut follows
        joined = (
            edges.withColumn("record", F.coalesce(F.sum(F.col("cut").cast("int")).over(cut_before), F.lit(0)))
            .groupBy("file", "record").agg(F.sort_array(F.collect_list(F.struct("block", "at", "value"))).alias("parts"))
            .select(
                "file", F.element_at("parts", -1)["block"].alias("block"), F.element_at("parts", -1)["at"].alias("at"),
                ((F.element_at("parts", 1)["block"] == 0) & (F.element_at("parts", 1)["at"] == 0)).alias("first"),
                F.array_join(F.transform("parts", lambda p: p["value"]), "").alias("value"),
            )
        )
        every = every.unionByName(joined)
    filled = every.where(F.btrim("value", F.lit(" \t\r\n")) != "")
    if not numbered:
        return filled.select("file", "first", "value")
    if not cut_up:
        return filled.select("file", "first", F.col("at").alias("ord"), "value")
    # records belong to the split where they end: as many as it has cuts
    counts = pieces.groupBy("file", "block").agg(F.sum(F.col("cut").cast("bigint")).alias("n"))
    earlier = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("file", "block", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("start"))
    return filled.join(F.broadcast(starts), ["file", "block"]).select(
        "file", "first", (F.col("start") + F.col("at")).cast("bigint").alias("ord"), "value"
    )


def torn_files(changes: DataFrame) -> DataFrame:
    """``file, quoted, depth`` of files that end inside quotes or brackets."""
    ends = changes.join(split_states(changes).select("file", "block", "quoted", "depth"), ["file", "block"])
    deeper: Column = F.when(F.col("quoted"), F.col("inside")).otherwise(F.col("outside"))
    total = ends.groupBy("file").agg((F.sum("odd") % 2 == 1).alias("quoted"), F.sum(deeper).alias("depth"))
    return total.where(F.col("quoted") | (F.col("depth") != 0))
