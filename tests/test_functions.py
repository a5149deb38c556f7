from pyspark.sql import functions as F

from pixquill import constants as K
from pixquill.functions import chat, geometry, imagebytes, rand, text, vectors


def values(spark, column, rows, schema):
    return [r[0] for r in spark.createDataFrame(rows, schema).coalesce(1).select(column).collect()]


def test_yes_no_labels(spark):
    cases = ["I don't know", "Yes, no doubt", "eyes", "maybe", "NO."]
    assert values(spark, text.parse_yes_no("c"), [(c,) for c in cases], "c string") == [
        "no", "yes", "yes", "other", "no",
    ]


def test_error_order(spark):
    cases = [
        "HTTPSConnectionPool .. Read Timeout. (read timeout=5)",
        "Connection broken: SSLError",
        "404 Client Error",
        "bad ssl record",
        "MemoryError",
        "cannot identify image file",
    ]
    assert values(spark, text.classify_error("c"), [(c,) for c in cases], "c string") == [
        "Timeout", "Connection Error", "Not Found (404)", "SSL Error", "Memory Error", "Other",
    ]


def test_mask_extension(spark):
    rows = [([0, 0, 1, 1, 0, 0, 1],), ([1, 0, 1, 0],), ([0],), ([],)]
    assert values(spark, chat.extend_mask("m"), rows, "m array<int>") == [
        [0, 0, 1, 1, 1, 0, 1], [1, 1, 1, 1], [0], [],
    ]


def test_labels_ignore_what_is_masked(spark):
    df = spark.createDataFrame([([5, 6, 7], [0, 1, 1])], "ids array<int>, mask array<int>")
    assert df.select(chat.labels("ids", "mask")).first()[0] == [-100, 6, 7]


def test_prompt_mix_borders(spark):
    df = spark.createDataFrame(
        [("I", "x", 0.32), ("I", "x", 0.33), ("I", "x", 0.66), (None, None, 0.1)],
        "instruction string, inputs string, u double",
    ).coalesce(1)
    a, b = text.mix_prompt("instruction", "inputs", F.col("u"))
    assert [tuple(r) for r in df.select(a, b).collect()] == [("", "xI"), ("", "Ix"), ("I", "x"), ("", "")]


def test_placeholder(spark):
    rows = [("a <IMGPLH> b",), ("plain",)]
    assert values(spark, text.ensure_placeholder("c"), rows, "c string") == [
        "a <IMGPLH> b", "<IMGPLH>plain",
    ]
    grown = values(spark, text.expand_placeholder("c", 2), rows, "c string")
    assert grown == ["a <Image><Image_Token><Image_Token><Image_End> b", "plain"]


def test_reply_between_markers(spark):
    m = K.REPLY_MARKER
    rows = [(f"q{m}a",), (f"q{m}a{m}b",), ("none",)]
    assert values(spark, text.extract_reply("c"), rows, "c string") == ["a", "a", None]


def test_strip_is_unicode_aware(spark):
    rows = [("　\xa0 a b  \n",)]
    assert values(spark, text.strip("c"), rows, "c string") == ["a b"]


def test_geometry(spark):
    df = spark.createDataFrame(
        [(600, 1000), (599, 1000), (55, 10), (3000, 5), (1000, 600), (448, 448)], "w int, h int"
    ).coalesce(1)
    crop, pad = geometry.crop_geometry("w", "h"), geometry.pad_geometry("w", "h")
    rows = df.select(
        geometry.action("w", "h").alias("a"),
        *[c.alias("c_" + n) for n, c in crop.items()],
        *[c.alias("p_" + n) for n, c in pad.items()],
    ).collect()
    assert [r["a"] for r in rows] == ["crop", "pad", "pad", "pad", "crop", "crop"]
    for r, (w, h) in zip(rows, [(600, 1000), (599, 1000), (55, 10), (3000, 5), (1000, 600), (448, 448)]):
        scale = 448 / max(w, h)
        pw, ph = int(w * scale), int(h * scale)
        assert (r["p_scaled_w"], r["p_scaled_h"]) == (pw, ph)
        assert (r["p_offset_x"], r["p_offset_y"]) == ((448 - pw) // 2, (448 - ph) // 2)
        long = int(448 * max(w, h) / min(w, h))
        cw, ch = (448, long) if w <= h else (long, 448)
        assert (r["c_scaled_w"], r["c_scaled_h"]) == (cw, ch)
        assert (r["c_offset_x"], r["c_offset_y"]) == (round((cw - 448) / 2.0), round((ch - 448) / 2.0))
    assert rows[2]["p_scaled_w"] == 447
    assert rows[3]["p_scaled_h"] == 0


def test_role_map_and_both_spellings(spark):
    schema = "c array<struct<`from`: string, value: string, role: string, content: string>>"
    rows = [([("human", "<image>hi", None, None), ("gpt", "yo", "user", "no"), (None, None, "tool", "t")],)]
    df = spark.createDataFrame(rows, schema)
    names = set(df.schema["c"].dataType.elementType.fieldNames())
    got = df.select(chat.normalize_conversation(chat.unify_turns("c", names))).first()[0]
    assert [(m["role"], m["content"]) for m in got] == [
        ("system", K.DIALOG_SYSTEM_PROMPT), ("user", "<IMGPLH>hi"), ("assistant", "yo"), ("tool", "t"),
    ]


def test_render(spark):
    messages = "m array<struct<role: string, content: string>>"
    rows = [([("system", " S "), ("user", " U "), ("assistant", " A\n")],), ([("user", "U")],), ([],)]
    head = "<|begin_of_text|><|start_header_id|>system<|end_header_id|>\n\n" + K.SYSTEM_PREAMBLE
    user = "<|start_header_id|>user<|end_header_id|>\n\nU<|eot_id|>"
    answer = "<|start_header_id|>assistant<|end_header_id|>\n\n"
    assert values(spark, chat.render_chat("m"), rows, messages) == [
        head + "S<|eot_id|>" + user + answer + "A\n<|eot_id|>",
        head + "<|eot_id|>" + user,
        head + "<|eot_id|>",
    ]
    waiting = values(spark, chat.render_chat("m", True), rows, messages)
    assert waiting[1] == head + "<|eot_id|>" + user + answer + "\n"


def test_data_url_and_base64(spark):
    rows = [("data:image/png;base64,aGk=",), ("no comma",), ("data:x,###",), (None,)]
    got = values(spark, imagebytes.decode_data_url("c"), rows, "c string")
    assert got == [b"hi", None, None, None]
    rows = [(["aGk=", "zz"],), ([],), (["?"],), (None,)]
    assert values(spark, imagebytes.decode_base64("c"), rows, "c array<string>") == [b"hi", None, None, None]


def test_vectors(spark):
    df = spark.createDataFrame([([3.0, 4.0], [4.0, 3.0]), ([0.0, 0.0], [1.0, 0.0])], "a array<float>, b array<float>")
    rows = df.coalesce(1).select(vectors.l2_normalize("a"), vectors.cosine("a", "b")).collect()
    assert rows[0][0] == [0.6, 0.8] and abs(rows[0][1] - 0.96) < 1e-9
    assert rows[1][0] is None and rows[1][1] is None


def test_draws_do_not_depend_on_partitioning(spark):
    df = spark.range(1000)
    one = {r[0]: r[1] for r in df.select("id", rand.hash_uniform("id", "s")).collect()}
    many = {r[0]: r[1] for r in df.repartition(7).select("id", rand.hash_uniform("id", "s")).collect()}
    assert one == many
    assert all(0 <= u < 1 for u in one.values())
    assert 0.4 < sum(one.values()) / 1000 < 0.6
