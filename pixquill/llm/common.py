"""What several of the operators share: white space, words, Arrow batches."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: White space that separates words: U+0020 and U+0009 to U+000D.
SPACE = " \t\n\x0b\f\r"
SPACE_CLASS = r"[\x20\x09-\x0D]"
WORD_CLASS = r"[^\x20\x09-\x0D]"

#: Bytes of text that one step inside a task works on at once.
SLICE_BYTES = 4 << 20
#: Rows of an Arrow batch of texts at most, four times those of a batch that is read: Spark's defaults are for narrow rows.
TEXT_ROWS = 1000


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def words(text: Column | str) -> Column:
    """Words between white space, in order; none of a null text."""
    trimmed = F.btrim(F.coalesce(col(text), F.lit("")), F.lit(SPACE))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, SPACE_CLASS + "+"))


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once, also inside nested lambdas."""
    return F.transform(F.array(value), body)[0]


def trim() -> None:
    """Give freed memory back to the system: a worker lives on from stage to stage, with what it holds."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def text_batches(spark) -> None:
    """Have the session read and send texts some hundred rows at a time, unless it takes fewer."""
    for name, rows in (("spark.sql.execution.arrow.maxRecordsPerBatch", TEXT_ROWS), ("spark.sql.parquet.columnarReaderBatchSize", TEXT_ROWS // 4)):
        if not 0 < int(spark.conf.get(name)) <= rows:
            spark.conf.set(name, str(rows))


def slices(batches: Iterator[pa.RecordBatch], text: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Arrow batches cut so that each holds about ``limit`` bytes of text, one row at least."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_pylist()
        start = held = 0
        for i, n in enumerate(sizes):
            if held and held + n > limit:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += n
        if start < len(sizes):
            yield batch.slice(start)


def pick(df: DataFrame, **columns: str) -> DataFrame:
    """Only the named columns, under the operator's own names: others cannot clash."""
    return df.select(*[F.col(f"`{have}`").alias(name) for name, have in columns.items()])


def rank_in_groups(df: DataFrame, group: list[str], cell: Column, order: list[str], name: str) -> DataFrame:
    """Add dense ranks 0..n-1 inside each group, of which there are few and large ones.

    Rows are numbered inside (group, cell) by ``order``, and the sizes of the
    cells give each cell's first rank, so no task holds a group.  ``df`` is read
    twice; one exchange by group and cell serves the numbering and the join.
    """
    keyed = df.withColumn("_cell", cell)
    sizes = keyed.groupBy(*group, "_cell").agg(F.count(F.lit(1)).alias("_rows"))
    earlier = Window.partitionBy(*group).orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(*group, "_cell", F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_start"))
    inside = F.row_number().over(Window.partitionBy(*group, "_cell").orderBy(*order)) - 1
    ranked = keyed.withColumn("_in", inside).join(starts, [*group, "_cell"])
    return ranked.select(*df.columns, (F.col("_start") + F.col("_in")).cast("bigint").alias(name))


#: Broadcasts are for tables of at most so many narrow rows, or so many bytes; beyond, the join is shuffled.
BROADCAST_ROWS = 1_000_000
BROADCAST_BYTES = 32 << 20


def broadcast_if_small(df: DataFrame, rows: int = BROADCAST_ROWS, width: Column | None = None) -> DataFrame:
    """``df`` marked for broadcast if it has at most ``rows`` rows; counts no further than that.

    Rows of no fixed width give theirs in bytes as ``width``; then all are measured.
    """
    if width is None:
        return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df
    n, size = df.agg(F.count(F.lit(1)), F.sum(width)).first()
    return F.broadcast(df) if n <= rows and (size or 0) <= BROADCAST_BYTES else df
