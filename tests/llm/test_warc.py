import base64
import gzip
import hashlib
import io
from collections import Counter

import pytest
import zstandard

from pixquill.llm import warc

PAGES = [
    (1, "http://a.example/x y", "<p>é😀</p>", "z"),
    (2, "http://a.example/2", "same", "z"),
    (5, None, "same", "z"),
    (3, "http://a.example/\r\nX: y", "same", "z"),
    (4, "http://a.example/4", None, "z"),
    (6, "http://a.example/6", "", "z"),
    (7, "http://a.example/7", "big " * 200_000, "z"),
    (8, "http://a.example/8", "twice", "z"),
    (8, "http://a.example/8", "twice", "z"),
    (None, "http://a.example/n", "same", "z"),
]


@pytest.fixture(scope="module")
def pages(spark):
    return spark.createDataFrame(PAGES, "page_id bigint, url string, html string, payload string").repartition(3)


@pytest.fixture(scope="module")
def bundles(pages):
    return warc.write_bundles(pages)


def test_round_trip(bundles):
    rows = warc.read_bundles(bundles).collect()
    keep = {"same": 5, "": 6, "twice": 8}
    expected = Counter()
    for page, _, html, _ in PAGES:
        data = (html or "").encode()
        target = keep.get(html or "")
        again = page is not None and target is not None and page < target
        digest = base64.b32encode(hashlib.sha1(data).digest()).decode()
        expected[page, len(data), digest, "revisit" if again else "response", target if again else None, None if again else data] += 1
    got = Counter(
        (r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"], None if r["payload"] is None else bytes(r["payload"]))
        for r in rows
    )
    assert got == expected
    assert not any("\n" in r["url"] or " " in r["url"] for r in rows)


def test_least_bytes(pages):
    rows = warc.read_bundles(warc.write_bundles(pages, least_bytes=5)).collect()
    assert all(r["record_type"] == "response" for r in rows)


def test_index_and_random_access(bundles, monkeypatch):
    index = warc.index_of(bundles)
    everything = {(r["record_id"], r["frame"], r["offset"]): r for r in warc.read_bundles(bundles).collect()}
    assert {(r["record_id"], r["frame"], r["offset"]) for r in index.collect()} == set(everything)
    wanted = index.where("page_id in (2, 7)").select("record_id")
    found = warc.fetch_records(bundles, wanted).collect()
    assert sorted(r["page_id"] for r in found) == [2, 7]
    for r in found:
        assert r["payload"] == everything[r["record_id"], r["frame"], r["offset"]]["payload"]


def test_bundles_are_plain_zstandard(bundles):
    """A reader that knows nothing of the seek table gets the records one after another."""
    for row in bundles.collect():
        raw = zstandard.ZstdDecompressor().stream_reader(io.BytesIO(bytes(row["content"])), read_across_frames=True).read()
        table = warc.seek_table(bytes(row["content"]))
        assert len(raw) == sum(r for _, _, r in table)
        at, n = 0, 0
        while at < len(raw):
            _, at = warc.parse(raw, at)
            n += 1
        assert n == len(row["index"])


def test_small_frames_and_bundles(monkeypatch):
    monkeypatch.setattr(warc, "FRAME_BYTES", 1)
    monkeypatch.setattr(warc, "BUNDLE_BYTES", 600)
    bundler, made = warc.Bundler("x"), []
    for i in range(9):
        name, data = warc.record(i, "http://e.example", b"body %d" % i, None)
        made += [b for b in [bundler.add(i, name, data)] if b]
    made += [b for b in [bundler.close()] if b]
    assert len(made) > 2 and len({b["bundle"] for b in made}) == len(made)
    got = [warc.parse(warc.frame(b["content"], place))[0]["page_id"] for b in made for place in warc.seek_table(b["content"])]
    assert got == list(range(9))


def test_damage_is_noticed():
    _, data = warc.record(1, "http://e.example", b"body", None)
    with pytest.raises(ValueError):
        warc.parse(data.replace(b"\r\n\r\nbody", b"\r\n\r\nbodx"))
    with pytest.raises(ValueError):
        warc.seek_table(gzip.compress(b"no bundle"))


def test_no_pages(pages):
    empty = warc.write_bundles(pages.where("false"))
    assert empty.count() == 0 and warc.read_bundles(empty).count() == 0
