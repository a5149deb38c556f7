import numpy as np
import pytest
from pyspark.sql import functions as F

from pixquill.operators import similarity


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(3)
    return rng.normal(size=(120, 16)), rng.normal(size=(37, 16))


def brute(items, labels, k):
    a = items / np.linalg.norm(items, axis=1, keepdims=True)
    b = labels / np.linalg.norm(labels, axis=1, keepdims=True)
    logits = 100 * a @ b.T
    e = np.exp(logits - logits.max(axis=1, keepdims=True))
    p = e / e.sum(axis=1, keepdims=True)
    best = np.argsort(-p, axis=1, kind="stable")[:, :k]
    return {(i, r + 1): (f"l{j:02d}", p[i, j]) for i in range(len(items)) for r, j in enumerate(best[i])}


@pytest.mark.parametrize("slices", [4096, 1, 5])
@pytest.mark.parametrize("k", [1, 3, 50])
def test_zero_shot_equals_brute_force(spark, data, slices, k, monkeypatch):
    monkeypatch.setattr(similarity, "SLICE_SCORES", 60)  # several row slices
    items = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(data[0])], "id long, embedding array<double>")
    labels = spark.createDataFrame([(f"l{j:02d}", v.tolist()) for j, v in enumerate(data[1])], "label string, embedding array<double>")
    got = similarity.zero_shot(items, labels, k=k, slice_labels=slices).collect()
    want = brute(*data, k)
    assert len(got) == len(want)
    for r in got:
        label, p = want[(r["id"], r["rank"])]
        assert r["label"] == label and r["confidence"] == pytest.approx(p, rel=1e-9, abs=1e-15)


@pytest.mark.parametrize("block", [10 * 16 * 8, 20 * 16 * 8])
def test_blocks_of_labels_give_the_same_rows(spark, data, block):
    """Nothing is refused: labels beyond the limit are met in blocks, repeated keys stay apart, ties go by label."""
    items = spark.createDataFrame([(i % 100, v.tolist()) for i, v in enumerate(data[0])], "id long, embedding array<double>")
    vectors = [*data[1], data[1][3], data[1][7]]
    labels = spark.createDataFrame([(f"l{j:02d}", v.tolist()) for j, v in enumerate(vectors)], "label string, embedding array<double>")
    rows = lambda df: sorted((r["id"], r["rank"], r["label"], round(r["confidence"], 9)) for r in df.collect())
    assert rows(similarity.zero_shot(items, labels, k=4, block_bytes=block)) == rows(similarity.zero_shot(items, labels, k=4))
    if block > 2000:
        assert len(rows(similarity.zero_shot(items, labels, k=50, block_bytes=block))) == 120 * 39


def test_vectors_without_direction_are_left_out(spark):
    items = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, None)], "id long, embedding array<double>")
    labels = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.0, 0.0]), ("c", None), ("d", [0.0, 1.0])], "label string, embedding array<double>")
    for slices, block in ((4096, None), (1, None), (4096, 1)):
        got = similarity.zero_shot(items, labels, k=5, slice_labels=slices, block_bytes=block).orderBy("rank").collect()
        assert [(r["id"], r["label"]) for r in got] == [(1, "a"), (1, "d")]
        assert got[0]["confidence"] + got[1]["confidence"] == pytest.approx(1)


def test_no_labels_no_rows(spark):
    items = spark.createDataFrame([(1, [1.0, 0.0])], "id long, embedding array<double>")
    labels = spark.createDataFrame([], "label string, embedding array<double>")
    assert similarity.zero_shot(items, labels).count() == 0


def test_pooling_leaves_out_the_rest_and_matches_numpy(spark):
    side, n = 7, 4  # stride 3, cells 2 x 2, last row and column unused
    rng = np.random.default_rng(5)
    grid = rng.normal(size=(2, side * side, 3))
    rows = [(b, i, grid[b, i].tolist()) for b in range(2) for i in range(side * side)]
    df = spark.createDataFrame(rows, "image_id int, patch_idx int, embedding array<double>")
    got = {(r["image_id"], r["cell"]): r["embedding"] for r in similarity.pool_patches(df, side, n).collect()}
    assert len(got) == 8
    for b in range(2):
        plane = grid[b].reshape(side, side, 3)
        for cell in range(4):
            r, c = divmod(cell, 2)
            want = plane[3 * r : 3 * r + 3, 3 * c : 3 * c + 3].mean(axis=(0, 1))
            assert got[(b, cell)] == pytest.approx(want.tolist())


def test_class_distribution(spark):
    df = spark.createDataFrame([("a", 0.5), ("a", 1.0), ("b", 0.2)], "label string, confidence double")
    got = {r["label"]: (r["items"], r["mean_confidence"]) for r in similarity.class_distribution(df).collect()}
    assert got == {"a": (2, 0.75), "b": (1, 0.2)}
    assert df.select(F.lit(1)).count() == 3
