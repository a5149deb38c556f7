"""Reproducible randomness: draws are functions of (seed, key), never of
partitioning, so a recomputed task yields the same rows."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

HASH_RANGE = 4294967296  # 2 ** 32


def hash32(key: Column | str, seed: str) -> Column:
    """Unsigned 32-bit integer (as bigint) derived from md5 of ``seed:key``."""
    key = F.col(key) if isinstance(key, str) else key
    digest = F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string")))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint")


def hash_uniform(key: Column | str, seed: str) -> Column:
    """Uniform double in [0, 1)."""
    return hash32(key, seed) / F.lit(float(HASH_RANGE))


def choose(u: Column, options: list[str]) -> Column:
    """Uniform choice among fixed texts, driven by a uniform draw ``u``."""
    texts = F.array(*[F.lit(o) for o in options])
    return F.element_at(texts, (F.floor(u * len(options)) + 1).cast("int"))
