"""Shards by jump consistent hashing: a stable key and the shard count decide.

No ring table is kept.  Appending a shard moves only the rows that the new
shard takes, about one in ``shards + 1``.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import col, rank_in_groups

#: Multiplier of the linear congruential generator of the published algorithm.
STEP = 2862933555777941757
SHARDS = 24
CELLS_DIGITS = 3


def stable_key(key: Column | str) -> Column:
    """An unsigned 64-bit number from any key: the first half of its md5; a null key counts as empty."""
    digest = F.md5(F.coalesce(col(key).cast("string"), F.lit("")).cast("binary"))
    return F.conv(F.substring(digest, 1, 16), 16, 10).cast("decimal(20,0)")


def jump_shard(key: Column, shards: int) -> Column:
    """Shard 0 to ``shards - 1`` of an unsigned 64-bit key.

    The jumps of the algorithm as a fold: each step that has not left the range
    goes on to the next jump, and a jump moves on by one shard at least.
    """
    step = F.lit(STEP).cast("decimal(19,0)")
    start = F.struct(key.alias("k"), F.lit(-1).cast("bigint").alias("b"), F.lit(0).cast("bigint").alias("j"))

    def jump(acc: Column, _: Column) -> Column:
        # 64-bit overflow is wanted: the product fits 38 digits and is cut to 64 bits
        k = ((acc["k"] * step + 1) % F.lit(Decimal(2**64))).cast("decimal(20,0)")
        high = F.floor(k / F.lit(Decimal(2**33))).cast("bigint")
        j = F.floor((acc["j"] + 1) * (F.lit(float(2**31)) / (high + 1).cast("double"))).cast("bigint")
        on = F.struct(k.alias("k"), acc["j"].alias("b"), j.alias("j"))
        return F.when(acc["j"] < shards, on).otherwise(acc)

    return F.aggregate(F.sequence(F.lit(1), F.lit(shards)), start, jump, lambda acc: acc["b"].cast("int"))


def shard_documents(
    docs: DataFrame, shards: int = SHARDS, doc_id: str = "doc_id", text: str = "text", overhead: int = 8
) -> DataFrame:
    """``doc_id, size, text_crc32, shard, slot, grown_shard`` for each row of ``docs``.

    ``size`` is the text's UTF-8 bytes plus ``overhead`` (a null text has none,
    and the checksum 0), ``slot`` a gapless number in the shard, ``grown_shard``
    the shard once one more is appended.  Repeated ids share a shard and take a
    slot each; null ids count as the empty key.  The id alone decides, so equal
    texts under different ids are spread over the shards as any rows are, and a
    group of copies, however large, fills none of them.
    """
    value = F.encode(F.coalesce(col(text), F.lit("")), "UTF-8")
    key = stable_key(doc_id)
    rows = docs.select(
        F.col(doc_id).alias("doc_id"),
        (F.octet_length(value) + overhead).cast("bigint").alias("size"),
        F.crc32(value).alias("text_crc32"),
        jump_shard(key, shards).alias("shard"),
        jump_shard(key, shards + 1).alias("grown_shard"),
    )
    cell = F.substring(F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), 1, CELLS_DIGITS)
    return rank_in_groups(rows, ["shard"], cell, ["doc_id", "size", "text_crc32"], "slot").select(
        "doc_id", "size", "text_crc32", "shard", "slot", "grown_shard"
    )
