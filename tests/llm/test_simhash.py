import random
from collections import Counter

import numpy as np
import xxhash
from pyspark.sql import functions as F

from pixquill.llm import simhash

from .conftest import texts


def brute_fingerprint(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    parts = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(p, 42) for p in parts]
    value = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))
    return value - (1 << 64) if value >> 63 else value


def brute_groups(values):
    """Smallest position reachable over links of at most three bits."""
    root = list(range(len(values)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(values)):
        for j in range(i):
            if ((values[i] ^ values[j]) & (2**64 - 1)).bit_count() <= 3:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return [find(i) for i in range(len(values))]


def test_spark_hash_is_the_same(spark):
    text = "an example of three"
    native = spark.range(1).select(F.xxhash64(F.lit(text))).first()[0]
    assert native % 2**64 == xxhash.xxh64_intdigest(text, 42)


def test_bk_tree_finds_what_brute_force_finds():
    rng = random.Random(3)
    centre = rng.getrandbits(64)
    values = list({centre ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 5))) for _ in range(300)})
    tree, queries = np.array(values[:200], np.uint64), np.array(values[200:], np.uint64)
    found = {(n, int(q)) for n, hits in simhash.BKTree(tree).near(queries, 3) for q in hits}
    assert found == {
        (i, j) for i, a in enumerate(tree) for j, b in enumerate(queries) if (int(a) ^ int(b)).bit_count() <= 3
    }


def test_chains_and_split_shards(spark):
    rng = random.Random(5)
    values = [rng.getrandbits(64) for _ in range(60)]
    for start in values[:6]:  # chains of single steps, and dense groups
        last = start
        for _ in range(25):
            last ^= sum(1 << b for b in rng.sample(range(64), 3))
            values.append(last)
        values += [start ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for _ in range(30)]
    signed = sorted({v - (1 << 64) if v >> 63 else v for v in values})
    fps = spark.createDataFrame([(v,) for v in signed], "fp bigint").repartition(7)
    want = brute_groups(signed)
    for tree_size in (4096, 5):
        roots = {r["u"]: r["v"] for r in simhash.components(simhash.links(fps, tree_size=tree_size)).collect()}
        got = {}
        for v, group in zip(signed, want):
            assert got.setdefault(group, roots.get(v, v)) == roots.get(v, v)
        assert len(set(got.values())) == len(set(want))


def test_documents(odd_docs, no_docs):
    rows = simhash.near_duplicates(odd_docs).collect()
    marks = [(d, brute_fingerprint(t)) for d, t in texts()]
    groups = brute_groups([m for _, m in marks])
    least = {}
    for (d, _), g in zip(marks, groups):
        if d is not None:
            least[g] = min(d, least.get(g, d))
    expected = Counter((d, m, least.get(g)) for (d, m), g in zip(marks, groups))
    assert Counter((r["doc_id"], r["fp"], r["component_id"]) for r in rows) == expected
    assert simhash.near_duplicates(no_docs).count() == 0


def test_one_of_each_group_stays(odd_docs):
    kept = simhash.drop_near_duplicates(odd_docs)
    ids = sorted(r["doc_id"] or -1 for r in kept.select("doc_id").collect())
    assert kept.columns == odd_docs.columns
    assert ids == [-1, 1, 3, 6, 7, 8, 9]  # 2 copies 1; 4 and 5 have no words, as 3; 7 was there twice
