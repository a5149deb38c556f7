import pytest
from pyspark.sql import functions as F

from pixquill import constants as K
from pixquill.operators import corpus, numbering, sampling, tokens


@pytest.mark.parametrize("n,p", [(1000, 0.1), (1000, 0.001), (7, 0.5), (10, 0.0), (10, 1.0), (1, 0.3)])
def test_split_is_exact_disjoint_and_complete(spark, n, p):
    got = sampling.train_valid_split(spark.range(n), "id", p).groupBy("split").count().collect()
    sizes = {r["split"]: r["count"] for r in got}
    train = int(n * (1 - p))
    assert (sizes.get("train", 0), sizes.get("valid", 0)) == (train, n - train)


def test_split_survives_repartitioning(spark):
    df = spark.range(500).withColumn("x", F.lit("x"))
    a = {tuple(r) for r in sampling.train_valid_split(df, "id", 0.2).select("id", "split").collect()}
    b = {tuple(r) for r in sampling.train_valid_split(df.repartition(5, "x"), "id", 0.2).select("id", "split").collect()}
    assert a == b


def test_threshold_split(spark):
    df = sampling.train_valid_split(spark.range(5000), "id", 0.1, exact=False)
    assert 350 < df.where(F.col("split") == "valid").count() < 650
    assert sampling.split_counts(df).agg(F.sum("n_rows")).first()[0] == 5000


@pytest.mark.parametrize("n", [0, 1, 17, 300, 5000])
def test_first_rows(spark, n):
    df = spark.range(300).withColumn("pos", F.col("id") * 3).repartition(6)
    got = sorted(r["pos"] for r in sampling.sample_links(df, n, "pos", chunk=50).collect())
    assert got == [3 * i for i in range(min(n, 300))]


def test_dense_ids_with_a_hot_subset(spark):
    rows = spark.range(3000).select(
        F.when(F.col("id") % 3 < 2, F.lit("hot")).otherwise(F.concat(F.lit("s"), (F.col("id") % 7).cast("string"))).alias("subset"),
        F.col("id").alias("position"),
    ).repartition(9)
    got = corpus.dense_image_ids(rows, chunk=64).orderBy("image_id").collect()
    want = sorted((r["subset"], r["position"]) for r in rows.collect())
    assert [(r["subset"], r["position"]) for r in got] == want
    assert [r["image_id"] for r in got] == list(range(3000))


def test_dense_ids_follow_the_given_subset_order(spark):
    df = spark.createDataFrame([("b", 0), ("a", 0), ("b", 1), ("z", 5)], "subset string, position long")
    got = corpus.dense_image_ids(df, subsets=["b", "a"]).orderBy("image_id").collect()
    assert [(r["subset"], r["position"]) for r in got] == [("b", 0), ("b", 1), ("a", 0), ("z", 5)]


def test_numbering_keeps_null_groups(spark):
    df = spark.createDataFrame([(None, 1), ("a", 2), (None, 3)], "g string, k int")
    got = numbering.number_rows(df, [F.col("k")], F.lit(0), lead=["g"])
    assert sorted(r["row_id"] for r in got.collect()) == [0, 1, 2]


def test_vocabulary(spark):
    words = ["b"] * 3 + ["a"] * 2 + ["c"] * 2 + ["<Image>"] * 4
    df = spark.createDataFrame([(w,) for w in words], "token string")
    got = {r["token"]: r["token_id"] for r in tokens.build_vocab(df).collect()}
    assert got["b"] == 0 and {got["a"], got["c"]} == {1, 2}
    assert [got[t] for _, t in K.ADDED_TOKENS] == [3, 4, 5, 6]
    fixed = {r["token"]: r["token_id"] for r in tokens.build_vocab(df, base=100).collect()}
    assert [fixed[t] for _, t in K.ADDED_TOKENS] == [100, 101, 102, 103]


def test_token_lookup_beyond_the_head(spark, monkeypatch):
    monkeypatch.setattr(tokens, "HEAD_VOCABULARY", 2)
    df = spark.createDataFrame([(w,) for w in "a a a b b c d d d d".split()], "token string")
    vocab = tokens.build_vocab(df)
    ids = {r["token"]: r["token_id"] for r in vocab.collect()}
    more = df.union(spark.createDataFrame([("never",)], "token string"))
    got = [(r["token"], r["token_id"]) for r in tokens.lookup_token_ids(more, vocab).collect()]
    assert sorted(got) == sorted([(t, ids[t]) for t in "a a a b b c d d d d".split()] + [("never", -1)])


def test_padding(spark):
    df = spark.createDataFrame([(0, [1, 2, 3]), (0, [4]), (1, [5])], "batch int, input_ids array<int>").coalesce(1)
    right = {tuple(r["input_ids"]) for r in tokens.pad_batch(df, "batch", {"input_ids": 0}).collect()}
    left = {tuple(r["input_ids"]) for r in tokens.pad_batch(df, "batch", {"input_ids": 0}, side="left").collect()}
    assert right == {(1, 2, 3), (4, 0, 0), (5,)}
    assert left == {(1, 2, 3), (0, 0, 4), (5,)}
    with pytest.raises(ValueError):
        tokens.pad_batch(df, "batch", {}, side="middle")


def test_tokenizer_hook(spark):
    @F.pandas_udf("array<array<int>>")
    def lengths(texts):
        return texts.map(lambda parts: [[len(p)] for p in parts])

    messages = "id int, messages array<struct<role: string, content: string>>"
    df = spark.createDataFrame([(1, [("system", "s"), ("user", "u"), ("assistant", "answer")])], messages)
    row = tokens.tokenize_chat(df, tokenizer=lengths).first()
    assert row["assistant_masks"] == [0, 0, 0, 0, 0, 1, 0]
    assert row["input_ids"][5] == len("answer\n")
    assert row["attention_mask"] == [1] * 7


def test_collate_function_hook(spark):
    def count(pdf):
        return pdf.assign(n=len(pdf))[["id", "n"]]

    rows = spark.range(10).withColumn("batch", F.col("id") % 3)
    for parts in (1, 7):  # batches, not partitions, reach the function
        got = tokens.collate_batches(rows.repartition(parts), count, "id long, n long").collect()
        assert {r["id"]: r["n"] for r in got} == {i: 4 if i % 3 == 0 else 3 for i in range(10)}
