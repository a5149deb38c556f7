import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from images import png, ramp
from pixquill.functions.imagebytes import header_size
from pixquill.operators import corpus, inference, ingest, resample
from pixquill.plans import flows
from pixquill.sources import images as source
from pixquill.sources import sinks, tables


@pytest.fixture
def folder(path):
    os.makedirs(f"{path}/img")
    files = {
        "wide.png": png(ramp(100, 40)),
        "tall.PNG.png": png(ramp(30, 45)),
        "grey.png": png(ramp(20, 20)[:, :, 0]),
        "junk.jpg": b"not an image",
        "notes.txt": b"skip me",
    }
    for name, data in files.items():
        with open(f"{path}/img/{name}", "wb") as f:
            f.write(data)
    return f"{path}/img"


def test_scan_and_sizes(spark, folder):
    names = {r["name"] for r in source.scan_images(spark, folder).collect()}
    assert names == {"wide.png", "tall.PNG.png", "grey.png", "junk.jpg"}
    sizes = {os.path.basename(r["path"]): (r["width"], r["height"]) for r in source.image_size(spark, folder).collect()}
    assert sizes == {"wide.png": (100, 40), "tall.PNG.png": (30, 45), "grey.png": (20, 20)}
    probed = source.probe_sizes(source.scan_images(spark, folder))
    got = {r["name"]: (r["original_width"], r["original_height"]) for r in probed.collect()}
    assert got == {"wide.png": (100, 40), "tall.PNG.png": (30, 45), "grey.png": (20, 20), "junk.jpg": (None, None)}


def segment(code: int, body: bytes) -> bytes:
    return bytes([0xFF, code]) + (len(body) + 2).to_bytes(2, "big") + body


def test_jpeg_and_webp_headers(spark):
    frame = b"\x08" + (480).to_bytes(2, "big") + (640).to_bytes(2, "big") + b"\x03" + b"\0" * 9
    thumbnail = b"\xff\xd8" + segment(0xC0, b"\x08" + b"\0\x10" * 2 + b"\0" * 10)
    rest = segment(0xDA, b"\0" * 10) + b"\0" * 40 + b"\xff\xd9"
    plain = b"\xff\xd8" + segment(0xE1, thumbnail) + b"\xff\xff" + segment(0xC2, frame)[1:] + rest
    many = b"\xff\xd8" + segment(0xFE, b"") * 3000 + segment(0xC0, frame) + rest
    broken = b"\xff\xd8" + segment(0xE0, b"JFIF") + rest
    cut = b"\xff\xd8\xff"

    def riff(kind: bytes, body: bytes) -> bytes:
        return b"RIFF\0\0\0\0WEBP" + kind + b"\0\0\0\0" + body

    lossy = riff(b"VP8 ", b"\0\0\0\x9d\x01\x2a" + (300).to_bytes(2, "little") + (200).to_bytes(2, "little"))
    lossless = riff(b"VP8L", b"\x2f" + ((300 - 1) | (200 - 1) << 14).to_bytes(4, "little"))
    extended = riff(b"VP8X", b"\0" * 4 + (299).to_bytes(3, "little") + (199).to_bytes(3, "little"))
    files = [plain, many, broken, cut, lossy, lossless, extended, b"", None]
    df = spark.createDataFrame([(bytearray(f) if f is not None else None,) for f in files], "d binary").coalesce(1)
    assert [tuple(r) for r in df.select(*header_size("d")).collect()] == [
        (640, 480), (640, 480), (None, None), (None, None), (300, 200), (300, 200), (300, 200), (None, None), (None, None),
    ]


def test_gif_and_bmp_headers(spark):
    gif = b"GIF89a" + (300).to_bytes(2, "little") + (7).to_bytes(2, "little") + b"\0" * 8
    bmp = b"BM" + b"\0" * 16 + (640).to_bytes(4, "little") + (480).to_bytes(4, "little") + b"\0" * 8
    df = spark.createDataFrame([(gif,), (bmp,)], "d binary").coalesce(1)
    assert [tuple(r) for r in df.select(*header_size("d")).collect()] == [(300, 7), (640, 480)]


def test_bicubic_weights_reproduce_smooth_images():
    index, w = resample.cubic_taps(90, 30)
    assert np.allclose(w.sum(axis=1), 1)
    line = np.arange(90, dtype=float)
    inner = (w * line[index]).sum(axis=1)[3:-3]
    assert np.allclose(inner, ((np.arange(30) + 0.5) * 3 - 0.5)[3:-3])
    flat = np.full((50, 70, 3), 93, dtype=np.uint8)
    assert (resample.resize(flat, 33, 21) == 93).all()


def test_resample(spark, folder):
    decoded = source.decode_image_files(spark, folder).withColumn(
        "identifier", F.element_at(F.split("path", "/"), -1)
    )
    got = {r["identifier"]: r for r in resample.resample_images(decoded, size=32).collect()}
    assert {k: r["action"] for k, r in got.items()} == {"wide.png": "pad", "tall.PNG.png": "crop", "grey.png": "crop"}
    for r in got.values():
        assert (r["width"], r["height"], len(r["data"])) == (32, 32, 32 * 32 * 3)
    wide = np.frombuffer(got["wide.png"]["data"], np.uint8).reshape(32, 32, 3)
    assert (wide[:10] == 0).all() and (wide[22:] == 0).all() and wide[10:22].any()
    row = wide[16, :, 0].astype(float)
    want = (np.arange(32) + 0.5) * 100 / 32 - 0.5
    assert np.abs(row - want)[2:-2].max() <= 1  # red runs along x: channels are RGB
    grey = np.frombuffer(got["grey.png"]["data"], np.uint8).reshape(32, 32, 3)
    assert (grey[:, :, 0] == grey[:, :, 2]).all()


def slow_resize(pixels, width, height):
    """Bicubic by plain loops: per output pixel, taps within the widened kernel."""
    def kernel(x):
        x = abs(x)
        if x < 1:
            return 1.5 * x**3 - 2.5 * x**2 + 1
        return -0.5 * x**3 + 2.5 * x**2 - 4 * x + 2 if x < 2 else 0.0

    def line(values, target):
        scale = len(values) / target
        spread = max(scale, 1.0)
        out = []
        for t in range(target):
            center = (t + 0.5) * scale
            taps = [(kernel((i + 0.5 - center) / spread), v) for i, v in enumerate(values)]
            total = sum(w for w, _ in taps)
            out.append(min(255, max(0, int(np.floor(sum(w * v for w, v in taps) / total + 0.5)))))
        return out

    rows = [[line([int(p[c]) for p in row], width) for c in range(3)] for row in pixels]
    return np.array(
        [[line([rows[y][c][x] for y in range(len(rows))], height) for x in range(width)] for c in range(3)], dtype=np.uint8
    ).transpose(2, 1, 0)


@pytest.mark.parametrize("size", [(12, 9), (5, 30), (24, 24), (13, 13)])
def test_resize_equals_plain_loops(size):
    pixels = np.random.default_rng(1).integers(0, 256, size=(17, 24, 3), dtype=np.uint8)
    got, want = resample.resize(pixels, *size), slow_resize(pixels, *size)
    assert got.shape == want.shape
    assert np.abs(got.astype(int) - want.astype(int)).max() <= 1
    assert (got != want).mean() < 0.001  # rounding of sums


def test_registered_resample_equals_plain_loops(spark):
    import hashlib

    from conftest import SMALL
    from pixquill.plans.catalog import QUERIES

    got = {r["identifier"]: r for r in QUERIES["resample_images"](spark, SMALL).collect()}
    vectors = spark.read.parquet(f"{SMALL}/embeddings.parquet").limit(5).collect()
    for v in vectors:
        r = got[str(v["vec_id"])]
        grey = np.floor((np.array(v["embedding"], dtype=np.float32).astype(float) + 1) * 127.5).astype(np.uint8)
        wide = r["action"] == "pad"
        pixels = np.repeat(grey.reshape(*((4, 16) if wide else (8, 8)))[:, :, None], 3, axis=2)
        scaled = slow_resize(pixels, 32, 8 if wide else 32)
        canvas = np.zeros((32, 32, 3), dtype=np.uint8)
        canvas[12 * wide : 12 * wide + scaled.shape[0]] = scaled
        assert r["digest"] == hashlib.md5(canvas.tobytes()).hexdigest()


def test_transform_hook_and_image_sink(spark, folder, path):
    decoded = source.decode_image_files(spark, folder).withColumn("identifier", F.md5("path"))
    flipped = resample.resample_images(decoded, size=8, transforms=[lambda a: a[::-1], lambda a: a[:8, :8]])
    assert {(r["width"], r["height"]) for r in flipped.collect()} == {(8, 8)}
    sinks.write_images(flipped, f"{path}/out", encoder=lambda data, w, h: bytes([w, h]))
    rows = spark.read.parquet(f"{path}/out").collect()
    assert len(rows) == 3 and rows[0]["encoded"] == bytes([8, 8])


def test_caption_corpus_flow(spark, folder):
    links = spark.createDataFrame(
        [(f"file://{folder}/wide.png", "wide")] * 3
        + [(f"file://{folder}/grey.png", "grey"), (f"file://{folder}/junk.jpg", "junk"), (f"file://{folder}/404.png", "gone")],
        tables.LINKS,
    )
    out = flows.caption_corpus(links, total_seconds=2.0)
    report = out.report.first()
    assert (report["total_images"], report["downloaded"], report["failed"]) == (6, 4, 2)
    assert (report["center_cropped"], report["padded"], report["images_per_second"]) == (1, 3, 2.0)
    shown = ingest.report_text(out.report, out.errors).first()["value"].split("\n")
    assert "Success rate: 66.67%" in shown and shown[-1].startswith("  - ")
    assert sinks.write_report(out.report, f"{folder}/../reports").startswith(f"{folder}/../reports/download_report_")
    assert out.errors.agg(F.sum("n_errors")).first()[0] == 2
    assert out.failures.count() == 2
    assert out.metadata.count() == 4
    sample = out.samples.first()
    assert sample["instruction"] == "Caption the image." and sample["image_path"].startswith("images/")
    assert out.images.count() == 2 and out.images.where("length(content) > 50").count() == 2

    def decoder(data):
        import struct

        width, height = struct.unpack(">II", data[16:24])
        return width, height, 1, bytes(width * height)

    decoded = source.decode_contents(out.images, decoder)
    squares = resample.resample_images(decoded, size=16)
    assert {len(r["data"]) for r in squares.collect()} == {16 * 16 * 3}
    done = out.metadata.select("identifier")
    again = corpus.not_done(corpus.assign_identifier(links), done)
    assert again.count() == 2


def test_fetch_retries_and_local_join(spark, folder):
    df = corpus.assign_identifier(spark.createDataFrame([("x", "c")], tables.LINKS))

    def flaky():
        state = {"n": 0}

        def fetch(url):
            state["n"] += 1
            if state["n"] < 3:
                raise OSError("connection reset")
            return b"ok"

        return fetch

    assert source.fetch_images(df, flaky()).first()["ok"] is False
    assert source.fetch_images(df, flaky(), max_attempts=3).first()["ok"] is True
    links = corpus.assign_identifier(spark.createDataFrame([("http://h/wide.png", "c"), ("http://h/none.png", "c")], tables.LINKS))
    local = source.join_local_images(links, source.scan_images(spark, folder), F.element_at(F.split("image_url", "/"), -1))
    assert sorted(r["ok"] for r in local.collect()) == [False, True]
    assert ingest.error_types(local).first()["error_type"] == "Not Found (404)"


def test_empty_report_has_nulls_not_errors(spark):
    schema = "ok boolean, elapsed double, original_width int, original_height int"
    row = ingest.download_report(spark.createDataFrame([], schema), 0.0).first()
    assert (row["total_images"], row["success_rate"], row["images_per_second"]) == (0, None, None)


def test_model_hooks(spark, folder):
    def make_predict():
        def predict(values):
            return values * 2

        return predict

    from pyspark.sql.types import DoubleType

    df = spark.range(40).select(F.col("id").cast("double").alias("x"))
    out = inference.batch_predict(df, make_predict, ["x"], "y", DoubleType(), batch_size=16)
    assert out.agg(F.sum("y")).first()[0] == 40 * 39

    def make_encoder():
        def encode(contents):
            return [None if c == b"not an image" else [float(len(c)), 1.0] for c in contents]

        return encode

    embedded = inference.embed_images(source.scan_images(spark, folder), make_encoder, batch_size=2)
    got = {r["name"]: r["embedding"] for r in embedded.collect()}
    assert got["junk.jpg"] is None and got["wide.png"][1] == 1.0


def test_instruction_corpus_flow(spark):
    import base64

    good = base64.b64encode(png(ramp(9, 7))).decode()
    rows = [
        ("b", 0, "I", "x", "o", [good]), ("b", 1, None, None, "o", ["???"]), ("b", 2, "I", "x", "o", [good, "more"]),
        ("a", 0, "I", "x", "o", [good]), ("a", 1, "I", "x", "o", []),
    ]
    raw = spark.createDataFrame(
        rows, "subset string, position long, instruction string, inputs string, outputs string, image_base64_str array<string>"
    )
    samples, images = flows.instruction_corpus(raw, ["b", "a"])
    got = {r["image_id"]: r for r in samples.collect()}
    assert {k: (r["subset"], r["position"], r["image_path"]) for k, r in got.items()} == {
        0: ("b", 0, "data/it_images/0.jpg"), 2: ("b", 2, "data/it_images/2.jpg"), 3: ("a", 0, "data/it_images/3.jpg"),
    }
    assert all((r["instruction"], r["inputs"]) in {("", "xI"), ("", "Ix"), ("I", "x")} for r in got.values())
    assert {(r["width"], r["height"]) for r in images.collect()} == {(9, 7)}
    rows_plan = samples._jdf.queryExecution().executedPlan().toString().split("Subquery")[0]
    assert "Exchange" not in rows_plan


def test_small_files_share_tasks(spark, path):
    fine = spark.newSession()
    for name in ("openCostInBytes", "maxPartitionBytes"):
        fine.conf.set(f"spark.sql.files.{name}", "64")
    for i in range(200):
        with open(f"{path}/{i}.png", "wb") as f:
            f.write(bytes([i]) * 64)
    most = 4 * spark.sparkContext.defaultParallelism
    found = source.scan_images(fine, path)
    assert found.rdd.getNumPartitions() <= most
    assert sorted(r["content"][0] for r in found.collect()) == list(range(200))
    assert source.decode_image_files(fine, path).rdd.getNumPartitions() <= most
