"""Whitening of embeddings from an exact scatter matrix of bit planes.

Entries become whole numbers.  Each distinct vector counts once.  A block of
vectors is cut into bit planes: bit b of dimension i over 64 vectors is one word.
The product of two dimensions, summed over the block, is then the sum of
2^(a + b) times the bits that planes a and b share, counted by AND and popcount.
Blocks give their sums in parts of 24 bits, which Spark adds up by pair of
dimensions, so nothing is rounded.  The matrix is centred in whole numbers; only
the centred values are turned to doubles, for ``eigh``.  What reaches the driver
grows with the square of the dimensions, never with the vectors.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .common import pick

SCALE = 256
COMPONENTS = 4
#: Entries of a block whose planes are counted at once.
BLOCK_ENTRIES = 1 << 22
#: Sums travel in parts of so many bits.
LIMB = 24
#: Prime for the rank of the centred matrix.
PRIME = 2_147_483_629


def whole_vectors(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """``vec_id, x``: rows whose vector has only finite entries, as floor(256 * entry); beyond 64 bits the nearest."""
    rows = pick(vectors, vec_id=vec_id, c=embedding).withColumn("c", F.col("c").cast("array<double>"))
    limit = F.lit(float("inf"))
    good = F.forall("c", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < limit))
    return rows.where(F.col("c").isNotNull() & good).select("vec_id", F.transform("c", lambda v: F.floor(v * SCALE).cast("bigint")).alias("x"))


def _blocks(batches: Iterator[pa.RecordBatch], column: str = "x") -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Batches in steps, with their vectors as rows of a matrix; all vectors are equally long."""
    for batch in batches:
        if not batch.num_rows:
            continue
        dims = len(batch.column(column)[0])
        step = max(64, BLOCK_ENTRIES // max(1, dims))
        for at in range(0, batch.num_rows, step):
            part = batch.slice(at, step)
            yield part, part.column(column).flatten().to_numpy().reshape(part.num_rows, dims)


# --- scatter ----------------------------------------------------------------------


def planes(y: np.ndarray, bits: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(words of each plane, its dimension, its bit), dimension by dimension; ``y`` has unsigned rows."""
    n, dims = y.shape
    padded = -(-n // 64) * 64
    found: list[tuple[int, int, np.ndarray]] = []
    for b in range(int(bits.max(initial=0))):
        own = np.flatnonzero(bits > b)
        plane = np.zeros((len(own), padded), np.uint8)
        plane[:, :n] = (y[:, own] >> np.uint64(b) & np.uint64(1)).T
        words = np.packbits(plane, axis=1).view(np.uint64)
        found += [(int(i), b, w) for i, w in zip(own, words)]
    found.sort(key=lambda f: f[:2])
    if not found:
        return np.empty((0, padded // 64), np.uint64), np.empty(0, np.int64), np.empty(0, np.int64)
    return np.stack([f[2] for f in found]), np.array([f[0] for f in found]), np.array([f[1] for f in found])


def cross_products(y: np.ndarray, bits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(products, sums) in parts of ``LIMB`` bits: [part, i, j] for i <= j, and [part, i]."""
    words, dim, bit = planes(y, bits)
    top = int(bits.max(initial=0))
    products = np.zeros((2 * top // LIMB + 1, y.shape[1], y.shape[1]), np.int64)
    sums = np.zeros((top // LIMB + 1, y.shape[1]), np.int64)
    np.add.at(sums, (bit // LIMB, dim), np.bitwise_count(words).sum(axis=1, dtype=np.int64) << bit % LIMB)
    for k in range(len(words)):
        shared = np.bitwise_count(words[k:] & words[k]).sum(axis=1, dtype=np.int64)
        # two planes of one dimension meet twice in its square
        weight = bit[k] + bit[k:] + ((dim[k:] == dim[k]) & (bit[k:] > bit[k]))
        np.add.at(products[:, dim[k]], (weight // LIMB, dim[k:]), shared << weight % LIMB)
    return products, sums


def scatter(fit: DataFrame) -> tuple[int, list[int], list[list[int]]]:
    """(n, sum per dimension, n^2 times the covariance), all exact, of the vectors ``x`` in ``fit``."""

    def ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, x in _blocks(batches):
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(x.shape[1])), pa.array(x.min(axis=0)), pa.array(x.max(axis=0))], ["i", "low", "high"]
            )

    found = fit.select("x").mapInArrow(ranges, "i bigint, low bigint, high bigint").groupBy("i").agg(F.min("low"), F.max("high"))
    low_high = [r[1:] for r in sorted(found.collect())]  # one row per dimension
    low = np.array([a for a, _ in low_high], np.int64)
    bits = np.array([(b - a).bit_length() for a, b in low_high], np.int64)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        for part, x in _blocks(batches):
            products, sums = cross_products((x - low).view(np.uint64), bits)
            held = [products, sums] if not held else [held[0] + products, held[1] + sums]
        if held:
            upper = [a.astype(np.int64) for a in np.nonzero(held[0])], [a.astype(np.int64) for a in np.nonzero(held[1])]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.concatenate([upper[0][1], upper[1][1]])),
                    pa.array(np.concatenate([upper[0][2], np.full(len(upper[1][1]), -1)])),
                    pa.array(np.concatenate([upper[0][0], upper[1][0]])),
                    pa.array(np.concatenate([held[0][tuple(upper[0])], held[1][tuple(upper[1])]])),
                ],
                ["i", "j", "part", "value"],
            )

    n, dims = fit.count(), len(low)
    total = fit.select("x").mapInArrow(count, "i bigint, j bigint, part bigint, value bigint")
    sums, products = [0] * dims, [[0] * dims for _ in range(dims)]
    # at most a few rows per pair of dimensions
    for r in total.groupBy("i", "j", "part").agg(F.sum(F.col("value").cast("decimal(38,0)")).alias("value")).collect():
        value = int(r["value"]) << LIMB * r["part"]
        if r["j"] < 0:
            sums[r["i"]] += value
        else:
            products[r["i"]][r["j"]] += value
    centred = [[0] * dims for _ in range(dims)]
    for i in range(dims):
        for j in range(i, dims):
            centred[i][j] = centred[j][i] = n * products[i][j] - sums[i] * sums[j]
    return n, [s + n * int(a) for s, a in zip(sums, low)], centred


def rank(matrix: list[list[int]]) -> int:
    """Rank of a whole-number matrix modulo a large prime: that of the matrix but for one case in some 10^9."""
    m = np.array([[v % PRIME for v in row] for row in matrix], np.int64).reshape(len(matrix), len(matrix))
    found = 0
    for c in range(m.shape[1]):
        rows = np.flatnonzero(m[found:, c]) + found
        if len(rows):
            m[[found, rows[0]]] = m[[rows[0], found]]
            m[found] = m[found] * pow(int(m[found, c]), -1, PRIME) % PRIME
            below = m[found + 1 :, c].copy()
            m[found + 1 :] = (m[found + 1 :] - below[:, None] * m[found] % PRIME) % PRIME
            found += 1
    return found


# --- whitening ----------------------------------------------------------------------


class Whitening:
    """Components of the fit list; small, and sent to the tasks with the code.

    ``vectors`` has the unit eigenvectors as columns by falling eigenvalue, as
    many as ``components`` and the rank of the covariance allow.
    """

    def __init__(self, n: int, sums: list[int], centred: list[list[int]], components: int = COMPONENTS):
        self.n, self.sums = n, sums
        dims = len(sums)
        known = min(components, rank(centred)) if n else 0
        cov = np.array([[v / (n * n) for v in row] for row in centred], np.float64).reshape(dims, dims) if n else np.zeros((dims, dims))
        values, vectors = np.linalg.eigh(cov)
        self.values, self.vectors = values[::-1][:known], vectors[:, ::-1][:, :known]
        self.explained = self.values / (sum(centred[i][i] for i in range(dims)) / (n * n)) if known else self.values
        # the mean as a whole number and a rest
        self.whole = np.array([(2 * s + n) // (2 * n) for s in sums], np.int64) if n else np.zeros(dims, np.int64)
        self.rest = np.array([(s - int(w) * n) / n for s, w in zip(sums, self.whole)]) if n else np.zeros(dims)

    def _off(self, x: np.ndarray) -> np.ndarray:
        """x - mean; where the difference may leave 64 bits, in long doubles first."""
        far = max([abs(int(v)) for a in (x, self.whole) if a.size for v in (a.min(), a.max())], default=0) >= 2**62
        return ((x.astype(np.longdouble) if far else x) - self.whole).astype(np.float64) - self.rest

    def transform(self, x: np.ndarray) -> np.ndarray:
        """(x - mean) on the components, over the root of their eigenvalues; ``x`` has whole vectors as rows."""
        return self._off(x) @ self.vectors / np.sqrt(self.values)

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """Sum over the dimensions of (n x - sum)^2, or None where it exceeds 63 bits."""
        off = self._off(x)
        about = (off * off).sum(axis=1) * float(self.n) ** 2
        with np.errstate(over="ignore"):
            # right modulo 2^64, so right wherever the sum fits
            moved = x.view(np.uint64) * np.uint64(self.n) - np.array([s % 2**64 for s in self.sums], np.uint64)
            exact = (moved * moved).sum(axis=1, dtype=np.uint64)
        out: list[int | None] = exact.astype(object).tolist()
        for i in np.flatnonzero(about > 2.0**62):
            value = sum((self.n * int(v) - s) ** 2 for v, s in zip(x[i], self.sums))
            out[i] = value if value < 2**63 else None
        return out


def fit_whitening(rows: DataFrame, components: int = COMPONENTS) -> tuple[Whitening, DataFrame]:
    """The components of the distinct vectors of ``rows`` (``x``), and those vectors.

    The vectors of the length that most distinct vectors have (the greater of two
    such lengths) make the fit; others lie in another space.
    """
    fit = materialize(rows.select("x").distinct(), "vectors")
    lengths = fit.where(F.size("x") > 0).groupBy(F.size("x").alias("d")).agg(F.count(F.lit(1)).alias("n"))
    most = lengths.orderBy(F.desc("n"), F.desc("d")).first()
    fit = fit.where(F.size("x") == (most["d"] if most else 0)) if most else fit.where("false")
    return Whitening(*(scatter(fit) if most else (0, [], [])), components), fit


def identity_error(model: Whitening, fit: DataFrame) -> float:
    """Largest absolute entry of the covariance of the whitened vectors less the identity, measured on them."""
    k = len(model.values)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        moments = np.zeros((k + 1, k + 1))
        for _, x in _blocks(batches):
            w = np.column_stack([model.transform(x), np.ones(len(x))])
            moments += w.T @ w
        a, b = (v.ravel() for v in np.indices((k + 1, k + 1)))
        yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(moments.ravel())], ["a", "b", "value"])

    total = np.zeros((k + 1, k + 1))
    for r in fit.select("x").mapInArrow(run, "a bigint, b bigint, value double").groupBy("a", "b").agg(F.sum("value")).collect():
        total[r[0], r[1]] = r[2]  # one row per pair of components
    mean = total[:k, k] / model.n
    return float(np.abs(total[:k, :k] / model.n - np.outer(mean, mean) - np.eye(k)).max(initial=0.0))


def whiten(
    vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", components: int = COMPONENTS
) -> DataFrame:
    """``vec_id, component, n, deviation, whitened, explained, identity_error``: a row per vector and component.

    Vectors that are null or hold null or non-finite entries are left out, and so
    are empty ones and those of another length than most.  Repeated rows and rows
    with a null id come out as often as they go in; in the fit each distinct
    vector counts once.  Components without variance are left out, so equal
    vectors alone, like an empty table, give no row.  ``deviation`` is null where
    it exceeds 63 bits.
    """
    rows = whole_vectors(vectors, vec_id, embedding)
    model, fit = fit_whitening(rows, components)
    k = len(model.values)
    error = identity_error(model, fit) if k else 0.0
    own = rows.where(F.size("x") == len(model.sums)) if k else rows.where("false")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, x in _blocks(batches):
            n = len(x)
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("vec_id").take(pa.array(np.repeat(np.arange(n), k))),
                    pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), n)),
                    pa.array(model.deviations(x), pa.int64()).take(pa.array(np.repeat(np.arange(n), k))),
                    pa.array(model.transform(x).ravel()), pa.array(np.tile(model.explained, n)),
                ],
                ["vec_id", "component", "deviation", "whitened", "explained"],
            )

    kind = own.schema["vec_id"].dataType.simpleString()
    out = own.mapInArrow(run, f"vec_id {kind}, component int, deviation bigint, whitened double, explained double")
    return out.select(
        "vec_id", "component", F.lit(model.n).cast("bigint").alias("n"), "deviation", "whitened", "explained",
        F.lit(error).cast("double").alias("identity_error"),
    )
