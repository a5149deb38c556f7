"""User models over tables: bad rows, chunks, runs that die."""

import os

import pytest

from pixquill.operators import inference


def test_a_bad_row_costs_only_itself(spark, path):
    os.makedirs(f"{path}/loads")
    loads = f"{path}/loads"
    df = spark.range(50).selectExpr("id", "cast(id as string) name", "id * 2.0D x").repartition(3)

    def make():
        import uuid

        open(f"{loads}/{uuid.uuid4().hex}", "w").close()

        def model(rows):
            if any(n in ("7", "20") for n, _ in rows):
                raise ValueError("bad name")
            return [(x + 1, n + "!") for n, x in rows][: 1 if any(n == "31" for n, _ in rows) and len(rows) > 1 else None]

        return model

    got = {r["id"]: (r["y"], r["label"], r["error"]) for r in inference.run_model(df, make, ["name", "x"], "y double, label string", ["id"], 8).collect()}
    want = {i: (2.0 * i + 1, f"{i}!", None) for i in range(50)} | {i: (None, None, "bad name") for i in (7, 20)}
    assert got == want and len(os.listdir(loads)) == 3


def test_single_values_wrong_counts_and_empty_tables(spark):
    df = spark.range(5).selectExpr("id", "id x")
    ones = inference.run_model(df, lambda: lambda rows: [x for (x,) in rows], ["x"], "y bigint", ["id", "x"]).collect()
    assert [(r["id"], r["x"], r["y"], r["error"]) for r in ones] == [(i, i, i, None) for i in range(5)]
    none = inference.run_model(df, lambda: lambda rows: [], ["x"], "y bigint", ["id"]).collect()
    assert {r["error"] for r in none} == {"0 results for 1 rows"}
    assert inference.run_model(df.where("false"), lambda: lambda rows: [], ["x"], "y bigint", ["id"]).count() == 0


def test_inference_goes_on_after_the_last_finished_chunk(spark, path):
    os.makedirs(f"{path}/calls")
    calls = f"{path}/calls"
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    df = spark.range(60).selectExpr("id", "id * 1.0D x").coalesce(2).mapInArrow(count, "id bigint, x double")

    def make():
        def model(rows):
            for i, _ in rows:
                open(f"{calls}/{i}-{os.getpid()}-{len(os.listdir(calls))}", "w").close()
            return [x for _, x in rows]

        return model

    class Died(Exception):
        pass

    def die(begun):
        if begun == 3:
            raise Died

    how = dict(make_model=make, inputs=["id", "x"], outputs="y double", chunk=10, batch_size=4)
    with pytest.raises(Died):
        inference.infer_in_chunks(df, "id", f"{path}/out", done=die, **how)
    before = len(os.listdir(calls))
    assert 0 < before < 60
    got = inference.infer_in_chunks(df, "id", f"{path}/out", **how).collect()
    assert sorted((r["id"], r["y"]) for r in got) == [(i, float(i)) for i in range(60)]
    assert len(os.listdir(calls)) == 60 and seen.value == 60  # every row once, the table once
    assert inference.infer_in_chunks(df.where("false"), "id", f"{path}/none", **how).collect() == []


def test_many_chunks_take_a_bounded_number_of_jobs(spark, path, monkeypatch):
    from pixquill.operators import chunks

    monkeypatch.setattr(chunks, "MAX_CHUNKS", 4, raising=False)
    begun = []

    def die(n):
        begun.append(n)
        if len(begun) == 3:
            raise KeyError

    df = spark.range(120).selectExpr("id", "id * 1.0D x")
    how = dict(make_model=lambda: lambda rows: [x for (x,) in rows], inputs=["x"], outputs="y double", chunk=5, done=die)
    with pytest.raises(KeyError):
        inference.infer_in_chunks(df, "id", f"{path}/out", **how)
    got = inference.infer_in_chunks(df, "id", f"{path}/out", **how).collect()
    assert sorted((r["id"], r["y"]) for r in got) == [(i, float(i)) for i in range(120)]
    assert begun == [0, 1, 2, 0, 1]


def test_wide_rows_go_to_python_some_hundred_at_a_time(spark, path):
    from pyspark.sql import functions as F
    from pixquill.operators import tokens
    from pixquill.session import ARROW_ROWS, BATCH_ROWS
    from pixquill.sources import sinks

    wide = spark.newSession()
    images = wide.range(0, 3000, 1, 1).select(
        F.col("id").cast("string").alias("identifier"), F.lit(1).alias("width"), F.lit(1).alias("height"), F.lit(b"x").alias("data"),
    )
    os.makedirs(f"{path}/sizes")
    sizes = f"{path}/sizes"
    before = wide.conf.get(ARROW_ROWS)
    sinks.write_images(images, f"{path}/images", lambda data, w, h: data)
    sinks.write_files(images.select(F.col("identifier").alias("name"), F.col("data").alias("content")), f"{path}/files")
    assert wide.conf.get(ARROW_ROWS) == before and len([n for n in os.listdir(f"{path}/files") if n[0] != "."]) == 3000

    @F.pandas_udf("array<struct<id:int,start:int,end:int>>")
    def cut(texts):
        open(f"{sizes}/{len(texts)}", "w").close()
        return texts.map(lambda t: [])

    chats = wide.range(0, 3000, 1, 1).select("id", F.array(F.struct(F.lit("user").alias("role"), F.lit("hi").alias("content"))).alias("messages"))
    assert tokens.tokenize_offsets(chats, cut).select(F.sum(F.size("input_ids"))).first()[0] == 0
    assert inference.embed_images(images, lambda: lambda c: [None] * len(c), content="data").count() == 3000
    assert 0 < max(map(int, os.listdir(sizes))) <= BATCH_ROWS
