"""Sizes of AVIF files from their boxes."""

import struct

import pytest
from pyspark.sql import functions as F

from pixquill.functions.imagebytes import header_size


def box(kind, *parts):
    body = b"".join(parts)
    return struct.pack(">I", 8 + len(body)) + kind + body


def full(kind, *parts):
    return box(kind, bytes(4), *parts)


def ispe(w, h):
    return full(b"ispe", struct.pack(">II", w, h))


FTYP = box(b"ftyp", b"avif", bytes(4), b"mif1", b"miaf")


def avif(*properties, before=b"", after=b""):
    iprp = box(b"iprp", box(b"ipco", *properties), full(b"ipma", bytes(9)))
    return FTYP + before + full(b"meta", full(b"hdlr", bytes(24)), full(b"pitm", bytes(2)), full(b"iinf", bytes(30)), iprp) + after


CASES = {
    "plain": (avif(ispe(640, 480)), (640, 480)),
    "other properties": (avif(full(b"pixi", b"\3\x08\x08\x08"), box(b"av1C", bytes(4)), ispe(3000, 2)), (3000, 2)),
    "thumbnail first": (avif(ispe(160, 120), ispe(1600, 1200), ispe(512, 512)), (1600, 1200)),
    "data before": (avif(ispe(7, 9), before=box(b"free", bytes(100)) + struct.pack(">I", 1) + b"mdat" + struct.pack(">Q", 16 + 50) + bytes(50)), (7, 9)),
    "data to the end": (avif(ispe(8, 9), after=bytes(4) + b"mdat" + bytes(77)), (8, 9)),
    "many boxes": (avif(*[box(b"free")] * 200, ispe(11, 12)), (11, 12)),
    "sequence": (box(b"ftyp", b"avis", bytes(4), b"avif") + avif(ispe(5, 6))[len(FTYP) :], (5, 6)),
    "no size": (avif(box(b"av1C", bytes(4))), (None, None)),
    "cut off": (avif(ispe(640, 480))[:60], (None, None)),
    "another brand": (box(b"ftyp", b"heic", bytes(4), b"mif1") + avif(ispe(1, 2))[len(FTYP) :], (None, None)),
    "type alone": (FTYP, (None, None)),
    "wrong size": (FTYP + struct.pack(">I", 3) + b"free" + bytes(9), (None, None)),
    "empty": (b"", (None, None)),
    "null": (None, (None, None)),
}


def test_avif_sizes(spark):
    df = spark.createDataFrame([(k, v[0]) for k, v in CASES.items()], "name string, content binary")
    width, height = header_size("content")
    got = {r["name"]: (r["w"], r["h"]) for r in df.select("name", width.alias("w"), height.alias("h")).collect()}
    assert got == {k: v[1] for k, v in CASES.items()}


@pytest.mark.parametrize("n", [2, 7])
def test_masks_of_tokens_across_edges(spark, n):
    from pixquill.operators import tokens

    rows = [
        (1, [("system", "be good"), ("user", "hi?"), ("assistant", "yes é😀 indeed"), ("user", "more"), ("assistant", "no")]),
        (2, [("user", "only a question")]), (3, [("assistant", "")]),
    ]
    df = spark.createDataFrame(rows, "id long, messages array<struct<role: string, content: string>>")

    def pieces(text):
        @F.pandas_udf("array<struct<id:int,start:int,end:int>>")
        def run(texts):
            # a token of no characters stands first and last
            return texts.map(lambda t: [
                {"id": -1, "start": 0, "end": 0}, *[{"id": a, "start": a, "end": min(a + n, len(t))} for a in range(0, len(t), n)],
                {"id": -2, "start": len(t), "end": len(t)},
            ])
        return run(text)

    from pixquill.functions import chat

    texts = {
        r["id"]: [(s["text"], s["generated"]) for s in r["segs"]]
        for r in df.select("id", chat.segments("messages").alias("segs")).collect()
    }
    out = tokens.create_labels(tokens.tokenize_offsets(df, pieces))
    for r in out.collect():
        flags = "".join(("x" if g else ".") * len(t) for t, g in texts[r["id"]])
        want = [0] + [int("x" in flags[a : a + n]) for a in range(0, len(flags), n)] + [0]
        extended = [int(v or (i and want[i - 1])) for i, v in enumerate(want)]
        assert r["assistant_masks"] == extended and len(r["attention_mask"]) == len(want)
        assert r["labels"] == [t if m else -100 for t, m in zip(r["input_ids"], extended)]
    assert out.columns == ["id", "messages", "input_ids", "assistant_masks", "attention_mask", "labels"]


def test_far_off_keys_leave_batches_even(spark):
    from pixquill.operators import augment
    from pixquill.operators.numbering import quantile_bucket

    df = spark.range(10_000).selectExpr("if(id = 9999, 9000000000000000000, id) k")
    sizes = [r["count"] for r in df.groupBy(quantile_bucket(df, "k", 100)).count().collect()]
    assert max(sizes) < 300 and len(sizes) > 90
    batched = augment.request_batches(df, "k", 1000, buckets=100)
    found = {r["batch"]: (r["n"], r["low"], r["high"]) for r in batched.groupBy("batch").agg(F.count("k").alias("n"), F.min("k").alias("low"), F.max("k").alias("high")).collect()}
    assert {b: v[:2] for b, v in found.items()} == {b: (1000, 1000 * b) for b in range(10)}
    # one key with half of all rows is dealt into cells
    hot = spark.range(4000).selectExpr("id", "if(id % 2 = 0, 7, id) k")
    assert max(r["count"] for r in hot.groupBy(quantile_bucket(hot, "k", 50)).count().collect()) < 200
    counts = [r["count"] for r in augment.request_batches(hot, "k", 500).groupBy("batch").count().collect()]
    assert counts == [500] * 8
    order = augment.request_batches(hot, "k", 500).groupBy("batch").agg(F.min("k").alias("a"), F.max("k").alias("b")).orderBy("batch").collect()
    assert all(x["b"] <= y["a"] for x, y in zip(order, order[1:]))
    assert augment.request_batches(hot.where("false"), "k", 500).count() == 0
