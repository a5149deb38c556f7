"""Dense numbering and exact-size selection without a global sort.

Both work from a small histogram over deterministic buckets: only the histogram
is ordered in one place, rows stay partitioned by bucket.  Buckets have to be
monotone with respect to the requested order, and fine enough that one bucket
fits a task; a hot group simply spreads over many buckets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.rand import HASH_RANGE, hash32


def digest_bucket(key: Column | str, hex_digits: int = 3) -> Column:
    """Bucket by the leading hex digits of the md5 of a key (16 ** digits buckets)."""
    key = F.col(key) if isinstance(key, str) else key
    return F.substring(F.md5(key.cast("string")), 1, hex_digits)


#: Buckets of a key's range, about equally full.
QUANTILES = 4096


def quantile_bucket(df: DataFrame, key: str, n: int = QUANTILES, cells: int = 1024) -> Column:
    """Bucket of a numeric key by approximate quantiles, in the order of the key.

    Far-off keys cost a bucket, not the others their evenness.  The bounds may be
    anything: they decide the sizes of the buckets, never the order.  Rows whose
    key is a bound, which may be many, are dealt into ``cells`` by a hash of the row.
    """
    shares = [i / n for i in range(1, n)]
    found = df.agg(F.percentile_approx(key, shares, 10 * n)).first()[0] or []
    bounds = sorted(set(found))
    known = F.array(*[F.lit(b) for b in bounds]) if bounds else F.array().cast("array<double>")
    value = F.col(key)
    # how many bounds lie below: a fold over halving steps
    steps = [1 << i for i in range(len(bounds).bit_length() - 1, -1, -1)] if bounds else [1]
    below = F.aggregate(
        F.array(*[F.lit(s) for s in steps]), F.lit(0),
        lambda at, step: F.when(F.get(known, at + step - 1) < value, at + step).otherwise(at),
    )
    at_bound = F.coalesce(F.get(known, below) == value, F.lit(False))
    cell = F.when(at_bound, 1 + F.pmod(F.xxhash64(*df.columns), F.lit(cells))).otherwise(F.lit(0))
    return F.struct(below.alias("quantile"), cell.alias("cell"))


def number_rows(
    df: DataFrame,
    order: list[Column | str],
    bucket: Column,
    lead: list[str] | None = None,
    lead_order: list[Column] | None = None,
    name: str = "row_id",
) -> DataFrame:
    """Add dense ids 0..n-1 in the order (lead, bucket, order).

    ``lead`` columns have few distinct values (subset names, token counts).  The
    sizes of (lead, bucket) cells are summed into offsets; inside a cell rows
    are numbered by ``order``.
    """
    lead = lead or []
    # one struct key: its parts may be null, and the window and the join below
    # share the partitioning by it
    keyed = df.withColumn("_cell", F.struct(*lead, bucket.alias("_bucket")))
    cells = keyed.groupBy("_cell").agg(F.count(F.lit(1)).alias("_n"))
    sizes = cells.select("_cell", "_cell.*", "_n")
    earlier = (Window.unboundedPreceding, -1)
    in_lead = Window.partitionBy(*lead).orderBy("_bucket").rowsBetween(*earlier)
    offsets = sizes.withColumn("_offset", F.coalesce(F.sum("_n").over(in_lead), F.lit(0)))
    if lead:
        across = Window.orderBy(*(lead_order or lead)).rowsBetween(*earlier)
        starts = (
            sizes.groupBy(*lead).agg(F.sum("_n").alias("_n"))
            .select(F.struct(*lead).alias("_lead"), F.coalesce(F.sum("_n").over(across), F.lit(0)).alias("_start"))
        )
        offsets = offsets.withColumn("_lead", F.struct(*lead)).join(starts, "_lead").withColumn(
            "_offset", F.col("_offset") + F.col("_start")
        )
    rank = F.row_number().over(Window.partitionBy("_cell").orderBy(*order))
    return (
        keyed.withColumn("_rank", rank)
        .join(offsets.select("_cell", "_offset"), "_cell")
        .select(*df.columns, (F.col("_offset") + F.col("_rank") - 1).cast("bigint").alias(name))
    )


def among_first(df: DataFrame, order: list[Column], bucket: Column, size) -> Column:
    """Boolean column: is the row among the first ``size`` rows by ``order``?

    ``size`` is an int or a function of the row count column.  The order has to
    be total (end in a unique key).  Two narrow passes over the order columns
    find the last selected row; the returned column is a plain comparison.
    """
    narrow = df.select(bucket.alias("_bucket"), F.struct(*order).alias("_order"))
    histogram = narrow.groupBy("_bucket").agg(F.count(F.lit(1)).alias("_n"))
    upto = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, 0)
    everything = Window.orderBy("_bucket").rowsBetween(
        Window.unboundedPreceding, Window.unboundedFollowing
    )
    total = F.sum("_n").over(everything)
    wanted = F.least(size(total) if callable(size) else F.lit(size), total)
    cut = (
        histogram.select("_bucket", "_n", F.sum("_n").over(upto).alias("_upto"), wanted.alias("_wanted"))
        .select("_bucket", "_n", (F.col("_wanted") - F.col("_upto") + F.col("_n")).alias("_need"))
        .where((F.col("_need") >= 1) & (F.col("_need") <= F.col("_n")))
        .select("_bucket", "_need")
    )
    # the cut is one row, or none when nothing is selected
    last = (
        narrow.join(F.broadcast(cut), "_bucket")
        .withColumn("_rank", F.row_number().over(Window.partitionBy("_bucket").orderBy("_order")))
        .where(F.col("_rank") == F.col("_need"))
        .select("_order")
    )
    return F.coalesce(F.struct(*order) <= last.scalar(), F.lit(False))


def hash_order(key: str, seed: str) -> tuple[list[Column], Column]:
    """Random but reproducible order by hash, with its 65,536 buckets."""
    h = hash32(key, seed)
    return [h.alias("h"), F.col(key).alias("k")], F.floor(h / (HASH_RANGE // 65536)).cast("int")
