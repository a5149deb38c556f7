"""The network's gradients against differences, and held-out accuracy."""

import numpy as np
import pytest

from pixquill.llm import language_id

SMALL = "/root/testdata/sf0.01"


def test_gradients_equal_differences():
    rng = np.random.default_rng(2)
    net = language_id.Network.fresh(["a", "b", "c"], 3)
    net.values = {k: v.astype(np.float32) * 0.5 for k, v in net.values.items()}
    codes = rng.integers(0, 256, (7, 5))
    target, weight = rng.integers(0, 3, 5), (rng.random((7, 5)) < 0.8).astype(np.float32)
    weight[0, 0] = 1
    _, grads = net.gradients(codes, target, weight)

    def loss():
        p, _, _ = net.label(codes)
        return float(-(np.log(p[:, target, np.arange(5)].astype(np.float64)) * weight).sum() / weight.sum())

    for name, value in net.values.items():
        flat, given = value.reshape(-1), grads[name].reshape(-1)
        for i in np.argsort(-np.abs(given))[:6]:
            old, step = flat[i], np.float32(1e-2)
            flat[i] = old + step
            up = loss()
            flat[i] = old - step
            down = loss()
            flat[i] = old
            assert abs((up - down) / (2 * step) - given[i]) < 2e-3 + 0.02 * abs(given[i]), name


def test_both_directions_reach_every_byte():
    net = language_id.Network.fresh(["a", "b"], 4)
    codes = np.full((9, 1), 97)
    base, _, _ = net.label(codes)
    for at in (0, 8):
        other = codes.copy()
        other[at] = 122
        moved, _, _ = net.label(other)
        assert (np.abs(moved - base).max(axis=(1, 2)) > 0).all()


def test_pooling_counts_every_byte_once():
    net = language_id.Network.fresh(["a", "b"], 4)
    rng = np.random.default_rng(3)
    texts = [bytes(rng.integers(32, 127, n, dtype=np.uint8)) for n in (0, 1, 63, 64, 65, 200_000)]
    pooled = language_id.probabilities(net, texts)
    for text, row in zip(texts, pooled):
        cut = language_id.segments(text)
        p, _, _ = net.label(cut.T.astype(np.intp))
        each = p.transpose(2, 0, 1).reshape(-1, 2)[: len(text)]
        assert np.allclose(row, each.mean(axis=0) if text else 0, atol=1e-5)


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    truth = {r["doc_id"]: r["lang"] for r in docs.select("doc_id", "lang").collect()}
    got = language_id.identify(docs).collect()
    import zlib

    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in got)
    judged = [r for r in got if r["held_out"] and r["lang_pred"] != "und"]
    assert len(judged) > 200 and np.mean([truth[r["doc_id"]] == r["lang_pred"] for r in judged]) > 0.97
    assert all(0 <= r["score"] <= 1 for r in got)


def test_labels_of_held_out_documents_are_not_seen(spark):
    from pyspark.sql import functions as F

    docs = spark.read.parquet(f"{SMALL}/documents.parquet").limit(300)
    swapped = docs.withColumns({
        "lang": F.when(language_id.held_out(F.col("doc_id")), F.lit("xx")).otherwise(F.col("lang")), "source": F.lit("s"),
    })
    one, two = (sorted(map(tuple, language_id.identify(d, epochs=1).collect())) for d in (docs, swapped))
    assert one == two


def test_odd_documents(spark, odd_docs, no_docs):
    got = language_id.identify(odd_docs, epochs=1).collect()
    assert len(got) == odd_docs.count()
    by = {r["doc_id"]: r for r in got}
    assert [by[i]["lang_pred"] for i in (3, 4, 5)] == ["und"] * 3 and by[3]["score"] == 0
    assert {r["lang_pred"] for r in got} <= {"en", "de", "fr", "und"} and not by[None]["held_out"]
    assert language_id.identify(no_docs).collect() == []


def test_nothing_to_learn_from(spark):
    rows = [(1, "some text", None), (2, "123", "en"), (3, None, "en")]
    got = language_id.identify(spark.createDataFrame(rows, "doc_id bigint, text string, lang string")).collect()
    assert [(r["lang_pred"], r["score"]) for r in got] == [("und", 0.0)] * 3


@pytest.mark.parametrize("copies", [1, 40])
def test_rare_language_beside_a_hot_one(spark, copies):
    """A language of few documents is learnt beside one that has most rows."""
    rng = np.random.default_rng(4)
    word = lambda letters: "".join(rng.choice(list(letters), 5))
    rows = [(i, " ".join(word("abcde") for _ in range(60)), "hot") for i in range(120 * copies)]
    rows += [(10**6 + i, " ".join(word("vwxyz") for _ in range(60)), "rare") for i in range(24)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string").repartition(4)
    got = {r["doc_id"]: r["lang_pred"] for r in language_id.identify(docs, size=50).collect()}
    assert all(got[i] == lang for i, _, lang in rows)
