import hashlib
import zlib
from collections import Counter

from pixquill.llm import sharding

from .conftest import texts


def jump(key, shards):
    b, j = -1, 0
    while j < shards:
        b = j
        key = (key * 2862933555777941757 + 1) % 2**64
        j = int((b + 1) * (float(1 << 31) / float((key >> 33) + 1)))
    return b


def key_of(doc_id):
    return int(hashlib.md5(b"" if doc_id is None else str(doc_id).encode()).hexdigest()[:16], 16)


def test_documents(odd_docs, no_docs):
    rows = sharding.shard_documents(odd_docs).collect()
    expected = Counter(
        (d, len((t or "").encode()) + 8, zlib.crc32((t or "").encode()), jump(key_of(d), 24), jump(key_of(d), 25))
        for d, t in texts()
    )
    assert Counter((r["doc_id"], r["size"], r["text_crc32"], r["shard"], r["grown_shard"]) for r in rows) == expected
    for shard in {r["shard"] for r in rows}:
        slots = sorted(r["slot"] for r in rows if r["shard"] == shard)
        assert slots == list(range(len(slots)))
    assert sharding.shard_documents(no_docs).count() == 0


def test_growth_moves_only_into_the_new_shard(spark):
    rows = sharding.shard_documents(spark.range(20_000).selectExpr("id doc_id", "'x' text")).collect()
    moved = [r for r in rows if r["shard"] != r["grown_shard"]]
    assert all(r["grown_shard"] == 24 for r in moved)
    assert 0.8 < len(moved) * 25 / len(rows) < 1.2
    sizes = Counter(r["shard"] for r in rows)
    assert max(sizes.values()) < 1.2 * len(rows) / 24
