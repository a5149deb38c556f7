"""Whitening against plain whole-number arithmetic and numpy."""

import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from pixquill.llm import whitening

SCHEMA = "vec_id bigint, embedding array<float>, label int"


def frame(spark, rows):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(i, v, 0) for i, v in rows], SCHEMA)
    return df.withColumns({c: F.lit("clash") for c in ("x", "n", "c", "component", "value", "i")})


def brute(rows, components=4):
    """{(vec_id, component): (n, deviation, |whitened|, explained)} by plain loops over the distinct whole vectors."""
    good = [(i, v) for i, v in rows if v and all(c is not None and math.isfinite(c) for c in v)]
    whole = [(i, tuple(math.floor(256 * float(np.float32(c))) for c in v)) for i, v in good]
    fit = sorted({x for _, x in whole})
    n, dims = len(fit), len(fit[0])
    s = [sum(x[d] for x in fit) for d in range(dims)]
    cov = [[sum((n * x[a] - s[a]) * (n * x[b] - s[b]) for x in fit) / n**3 for b in range(dims)] for a in range(dims)]
    values, vectors = np.linalg.eigh(np.array(cov))
    values, vectors = values[::-1], vectors[:, ::-1]
    out = {}
    for i, x in whole:
        for k in range(min(components, dims)):
            w = sum(((n * x[d] - s[d]) / n) * vectors[d, k] for d in range(dims)) / math.sqrt(values[k])
            deviation = sum((n * x[d] - s[d]) ** 2 for d in range(dims))
            out[i, k + 1] = (n, deviation, abs(w), values[k] / np.trace(cov))
    return out


def held(got, want):
    assert {(r["vec_id"], r["component"]) for r in got} == set(want)
    for r in got:
        n, deviation, w, explained = want[r["vec_id"], r["component"]]
        assert r["n"] == n and r["deviation"] == deviation and r["identity_error"] <= 1e-9
        assert abs(abs(r["whitened"]) - w) < 1e-8 and abs(r["explained"] - explained) < 1e-12


def draw(rng, n, dims=6):
    scale = np.array([3.0, 1.5, 0.7, 0.3, 0.1, 0.05, 4.0, 0.2])[:dims]
    return [[float(c) for c in v] for v in rng.normal(0, 1, (n, dims)) * scale + 2.5]


@settings(max_examples=100, deadline=None)
@given(st.integers(1, 200), st.integers(1, 5), st.sampled_from([0, 1, 3, 24, 31, 40, 63]), st.integers(0, 2**32))
def test_popcounts_give_exact_products(n, dims, bits, seed):
    rng = np.random.default_rng(seed)
    y = rng.integers(0, 2**bits, (n, dims), dtype=np.uint64, endpoint=False) if bits else np.zeros((n, dims), np.uint64)
    size = np.array([int(v).bit_length() for v in y.max(axis=0)])
    products, sums = whitening.cross_products(y, size)
    whole = [[int(v) for v in row] for row in y]
    for a in range(dims):
        assert sum(int(p) << whitening.LIMB * k for k, p in enumerate(sums[:, a])) == sum(r[a] for r in whole)
        for b in range(a, dims):
            assert sum(int(p) << whitening.LIMB * k for k, p in enumerate(products[:, a, b])) == sum(r[a] * r[b] for r in whole)


def test_query_on_given_vectors(spark):
    from pixquill.llm import queries

    sf = "/root/testdata/sf0.001"
    rows = [(r[0], list(r[1])) for r in spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding").collect()]
    held(queries.op11_embedding_whitening(spark, sf).collect(), brute(rows))


def test_odd_vectors(spark, monkeypatch):
    """Nulls, non-finite entries, empty and other lengths, copies, repeated rows, null ids, clashing columns."""
    monkeypatch.setattr(whitening, "BLOCK_ENTRIES", 700)
    rng = np.random.default_rng(7)
    rows = list(enumerate(draw(rng, 300)))
    rows += [(1000 + i, rows[3][1]) for i in range(150)]  # one vector has a third of all rows
    rows += [(rows[0][0], rows[0][1]), (5000, [c + 1e-4 for c in rows[1][1]])]
    odd = [(6000, None), (6001, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (6002, [1.0, float("nan"), 1.0, 1.0, 1.0, 1.0]), (6003, [float("inf")] * 6), (6004, []), (6005, [1.0, 2.0])]
    df = frame(spark, rows + odd + [(None, rows[5][1])]).repartition(6)
    got = whitening.whiten(df).collect()
    want = brute(rows)
    held([r for r in got if r["vec_id"] is not None], want)
    assert len(got) == 4 * (len(rows) + 1)
    signs = {}
    for r in got:
        if r["vec_id"] in (3, 1000, 1001):
            signs.setdefault(r["component"], set()).add(r["whitened"])
    assert all(len(v) == 1 for v in signs.values())


def test_means_far_from_zero_and_flat_dimensions(spark):
    rng = np.random.default_rng(8)
    rows = [(i, [1e6 + v[0], -3e5, v[1], v[2]]) for i, v in enumerate(draw(rng, 80, 3))]
    got = whitening.whiten(frame(spark, rows)).collect()
    want = {k: v for k, v in brute(rows, 3).items()}
    held(got, want)  # a dimension without variance takes one component away


def test_less_rank_than_components(spark):
    assert whitening.whiten(frame(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0])])).collect() == []
    assert whitening.whiten(frame(spark, [])).collect() == []
    assert whitening.whiten(frame(spark, [(1, None), (2, [])])).collect() == []
    line = [(i, [float(i), 2.0 * i, -float(i)]) for i in range(9)]
    got = whitening.whiten(frame(spark, line)).collect()
    assert {r["component"] for r in got} == {1} and len(got) == 9
    assert max(abs(r["explained"] - 1) for r in got) < 1e-12 and got[0]["identity_error"] < 1e-9


@pytest.mark.parametrize("big", [3e38, 1e18])
def test_entries_beyond_64_bits(spark, big):
    rows = [(0, [big, 1.0]), (1, [-big, 2.0]), (2, [0.5, 3.0]), (3, [0.25, -4.0])]
    got = whitening.whiten(frame(spark, rows)).collect()
    assert {r["vec_id"] for r in got} == {0, 1, 2, 3}
    assert all(math.isfinite(r["whitened"]) for r in got if r["component"] == 1)
    assert [r["deviation"] for r in got if r["vec_id"] == 0] == [None] * len([r for r in got if r["vec_id"] == 0])


def test_rank():
    assert whitening.rank([]) == 0 and whitening.rank([[0, 0], [0, 0]]) == 0
    assert whitening.rank([[2, 4], [4, 8]]) == 1 and whitening.rank([[2, 4], [4, 9 * 10**30]]) == 2
