"""Equi joins that stay balanced when one key holds much of the left side."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

HOT_SHARE = 10_000
#: Counters of the sketch: keys of more than 1/24,000 of the rows are among them.
TRACKED = 32_768
#: A right side is broadcast up to so many rows and bytes of its values.
BROADCAST_ROWS, BROADCAST_BYTES = 200_000, 16 << 20
SPREAD = 1021


def _hot_keys(left: DataFrame, key: str, share: int) -> tuple[DataFrame | None, bool]:
    """(keys that may hold more than 1/``share`` of the keyed rows or None, whether some rows have no key).

    One aggregate over the left side: a sketch of frequent keys of bounded size,
    whose error is a fraction of that share.
    """
    tracked = max(TRACKED, 3 * share)
    total, unkeyed, found = left.agg(
        F.count(key), F.count_if(F.col(key).isNull()), F.call_function("approx_top_k", F.col(key), F.lit(share), F.lit(tracked))
    ).first()
    # fewer than ``share`` keys can hold that much
    hot = [(r[0],) for r in found if r[0] is not None and r[1] * share > total]
    if not hot:
        return None, unkeyed > 0
    return left.sparkSession.createDataFrame(hot, T.StructType([T.StructField(key, left.schema[key].dataType)])), unkeyed > 0


def _is_small(right: DataFrame) -> bool:
    """Whether all of ``right`` may be sent to every task; counts no further than the limit."""
    width = F.lit(0)
    for field in right.schema:
        if isinstance(field.dataType, (T.StringType, T.BinaryType)):
            width = width + F.coalesce(F.octet_length(F.col(f"`{field.name}`")), F.lit(0))
        elif isinstance(field.dataType, (T.ArrayType, T.MapType, T.StructType)):
            return False
        else:
            width = width + 8
    n, size = right.limit(BROADCAST_ROWS + 1).agg(F.count(F.lit(1)), F.sum(width)).first()
    return n <= BROADCAST_ROWS and (size or 0) <= BROADCAST_BYTES


def skew_join(left: DataFrame, right: DataFrame, key: str, how: str = "left", share: int = HOT_SHARE) -> DataFrame:
    """``left.join(right, key, how)`` for left, left_semi and left_anti joins.

    A right side of a counted small size is broadcast, and nothing moves.  Else a
    key holding more than 1/``share`` of the keyed left rows is hot, so fewer
    than ``share`` keys are.  Their right rows are broadcast, and left out of the
    shuffled right side; hot and null keys of the left side are dealt over all
    tasks, as they cannot match there.  For a left join ``key`` is unique on the
    right.  Splitting by size at run time would miss hot keys made of copies,
    which compress to almost nothing.
    """
    if how not in ("left", "left_semi", "left_anti"):
        raise ValueError("how must be left, left_semi or left_anti")
    if how != "left":
        right = right.select(key)
    if _is_small(right):
        return left.join(F.broadcast(right), key, how)
    hot, unkeyed = _hot_keys(left, key, share)
    if hot is None and (not unkeyed or how == "left_semi"):
        return left.join(right, key, how)
    if how != "left":
        right = right.distinct()
    values = [c for c in right.columns if c != key]
    # one struct per side: a match with null values is still a match
    packed = right.where(F.col(key).isNotNull()).select(F.col(key).alias("_k"), F.struct(key, *values).alias("_right"))
    joined = left
    cold_key = F.col(key)
    if hot is not None:
        hot = F.broadcast(hot.select(F.col(key).alias("_k")))
        hot_right = F.broadcast(hot.join(packed, "_k", "left").select(F.col("_k").alias("_hk"), F.col("_right").alias("_hot")))
        joined = joined.join(hot_right, F.col(key) == F.col("_hk"), "left")
        cold_key = F.when(F.col("_hk").isNull(), F.col(key))
        packed = packed.join(hot, "_k", "left_anti")
    else:
        joined = joined.withColumn("_hot", F.lit(None).cast(packed.schema["_right"].dataType))
    spread = F.when(cold_key.isNull(), F.pmod(F.monotonically_increasing_id(), F.lit(SPREAD))).otherwise(F.lit(0))
    joined = joined.withColumns({"_k": cold_key, "_deal": spread})
    packed = packed.withColumn("_deal", F.lit(0).cast("bigint"))
    joined = joined.join(packed, ["_k", "_deal"], "left").withColumn("_found", F.coalesce("_hot", "_right"))
    if how == "left":
        return joined.select(key, *[c for c in left.columns if c != key], *[F.col(f"_found.{c}").alias(c) for c in values])
    match = F.col("_found").isNotNull()
    return joined.where(match if how == "left_semi" else ~match).select(*left.columns)
