import re

import pytest
from pyspark.sql import functions as F

from pixquill.operators import joins
from pixquill.operators.joins import skew_join


@pytest.mark.parametrize("how", ["left", "left_semi", "left_anti"])
@pytest.mark.parametrize("share", [1, 4, 10_000])
@pytest.mark.parametrize("hot_known", [True, False])
@pytest.mark.parametrize("small", [0, 10_000])
def test_equals_the_plain_join(spark, how, share, hot_known, small, monkeypatch):
    monkeypatch.setattr(joins, "BROADCAST_ROWS", small)
    left = spark.range(600).select(
        "id",
        F.when(F.col("id") % 3 == 0, F.lit("hot")).when(F.col("id") % 50 == 1, F.lit(None))
        .otherwise(F.concat(F.lit("k"), (F.col("id") % 40).cast("string"))).alias("k"),
    )
    right = spark.range(0, 40, 2).select(F.concat(F.lit("k"), F.col("id").cast("string")).alias("k"), F.col("id").alias("v"))
    if hot_known:
        right = right.union(spark.createDataFrame([("hot", -1)], "k string, v long"))
    got = skew_join(left, right, "k", how, share)
    want = left.join(right, "k", how)
    assert sorted(got.columns) == sorted(want.columns)
    key = lambda r: [str(x) for x in r]
    columns = sorted(want.columns)
    assert sorted(map(key, got.select(columns).collect())) == sorted(map(key, want.select(columns).collect()))


def test_other_joins_are_refused(spark):
    df = spark.range(1)
    with pytest.raises(ValueError):
        skew_join(df, df, "id", "outer")


def test_small_right_sides_are_broadcast_and_wide_ones_are_not(spark):
    left = spark.range(50).selectExpr("id", "cast(id as string) k")
    narrow = spark.range(5).selectExpr("cast(id as string) k", "id v")
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan(skew_join(left, narrow, "k"))
    wide = spark.range(5).selectExpr("cast(id as string) k", "repeat('x', 5000000) v")
    assert not joins._is_small(wide) and joins._is_small(wide.select("k"))
    assert not joins._is_small(spark.range(2).selectExpr("cast(id as string) k", "array(id) v"))


def test_hot_keys_are_found(spark):
    rows = spark.range(40_000).selectExpr("if(id % 3 = 0, 'a', if(id % 50 = 1, 'b', if(id % 9 = 1, null, cast(id as string)))) k")
    hot, unkeyed = joins._hot_keys(rows, "k", 100)
    assert {r["k"] for r in hot.collect()} == {"a", "b"} and unkeyed
    assert joins._hot_keys(rows.where("k not in ('a', 'b')"), "k", 100) == (None, False)
    assert joins._hot_keys(rows.where("false"), "k", 100) == (None, False)
    numbers, _ = joins._hot_keys(spark.range(100).selectExpr("if(id < 50, 7, id) k"), "k", 10)
    assert [r["k"] for r in numbers.collect()] == [7]


def test_semi_join_allows_copies_on_the_right(spark):
    left, right = spark.range(5), spark.createDataFrame([(1,), (1,), (2,)], "id long")
    assert sorted(r[0] for r in skew_join(left, right, "id", "left_semi").collect()) == [1, 2]
    assert sorted(r[0] for r in skew_join(left, right, "id", "left_semi", share=1).collect()) == [1, 2]


def test_copies_on_both_sides_and_few_scans(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(joins, "BROADCAST_ROWS", 0)
    spark.range(400).select(F.when(F.col("id") % 2 == 0, F.lit("hot")).otherwise(F.col("id").cast("string")).alias("k"), "id").write.parquet(f"{tmp_path}/left")
    left = spark.read.parquet(f"{tmp_path}/left")
    right = spark.createDataFrame([("hot",)] * 50 + [("1",), ("1",), ("3",)], "k string")
    for how, n in (("left_semi", 202), ("left_anti", 198)):
        df = skew_join(left, right, "k", how, share=4)
        assert df.count() == n
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert len(re.findall(r"Relation \[k#\d+,id#", plan)) == 1  # one pass came before: the sketch


def test_frequent_and_unknown_tokens(spark):
    from pixquill.operators import tokens

    rows = ["<Image_Token>"] * 300 + ["a"] * 20 + ["b"] * 3 + ["unseen"] * 200
    vocab = tokens.build_vocab(spark.createDataFrame([(t,) for t in ["a", "a", "b"]], "token string"))
    got = tokens.lookup_token_ids(spark.createDataFrame([(t,) for t in rows], "token string"), vocab)
    counts = {(r["token"], r["token_id"]): r["count"] for r in got.groupBy("token", "token_id").count().collect()}
    known = {r["token"]: r["token_id"] for r in vocab.collect()}
    assert counts == {("<Image_Token>", known["<Image_Token>"]): 300, ("a", 0): 20, ("b", 1): 3, ("unseen", -1): 200}
