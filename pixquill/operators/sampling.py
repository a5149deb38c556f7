"""Train/validation split and source sampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.rand import hash_uniform
from .numbering import among_first, hash_order


def train_valid_split(
    df: DataFrame, key: str, validation: float = 0.001, seed: str = "42", exact: bool = True
) -> DataFrame:
    """Add ``split``: "valid" or "train".

    Exact mode puts ``n - int(n * (1 - validation))`` rows into validation, the
    ones with the smallest hash; ``key`` is unique.  The other mode thresholds
    the hash uniform in a single pass, with a size right in expectation.
    """
    if not exact:
        chosen = hash_uniform(key, seed) < validation
    else:
        order, bucket = hash_order(key, seed)

        def size(n: Column) -> Column:
            return n - F.floor(n * F.lit(1.0 - validation))

        chosen = among_first(df, order, bucket, size)
    return df.withColumn("split", F.when(chosen, F.lit("valid")).otherwise(F.lit("train")))


def split_counts(df: DataFrame) -> DataFrame:
    return df.groupBy("split").agg(F.count(F.lit(1)).alias("n_rows"))


def sample_links(df: DataFrame, n: int, position: str, chunk: int = 100_000) -> DataFrame:
    """The first ``n`` rows of the source by a unique integer position."""
    order = [F.col(position).alias("p")]
    return df.where(among_first(df, order, F.floor(F.col(position) / chunk), n))


def sample_fraction(df: DataFrame, fraction: float, key: str, seed: str = "sample") -> DataFrame:
    return df.where(hash_uniform(key, seed) < fraction)


def batch_index(position: Column | str, size: int) -> Column:
    """Chunk or batch number of a dense position."""
    position = F.col(position) if isinstance(position, str) else position
    return F.floor(position / size).cast("bigint")
