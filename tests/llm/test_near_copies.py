"""Near copies by five-word shingles, against all pairs."""

import random

import corpus_pipeline
import numpy as np
import pytest

from pixquill.llm import near_copies, simhash

SMALL = "/root/testdata/sf0.01"


def grams(text, k=5):
    words = (text or "").encode().lower().split()
    return {tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1))} if words else set()


def brute_kept(rows):
    """Smallest id of each group of texts with similarity 0.8 or more."""
    sets = [grams(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if min(len(a), len(b)) * 5 < max(len(a), len(b)) * 4:
                continue
            common = len(a & b)
            if 5 * common >= 4 * (len(a) + len(b) - common):
                x, y = sorted((find(i), find(j)))
                root[y] = x
    least = {}
    for i, (d, _) in enumerate(rows):
        least[find(i)] = min(d, least.get(find(i), d))
    return set(least.values())


def test_stage_on_given_documents(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    kept = {r["doc_id"] for r in corpus_pipeline.near_duplicates(spark, docs, SMALL).select("doc_id").collect()}
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    assert kept == brute_kept(rows)


@pytest.mark.parametrize("tree", [1024, 8])
def test_limit_large_groups_and_common_lines(spark, monkeypatch, tree):
    monkeypatch.setattr(near_copies, "TREE_SIZE", tree)
    rng = random.Random(11)
    word = lambda: "".join(rng.choices("abcdefghij", k=6))
    texts, line = [], [word() for _ in range(12)]
    base = [word() for _ in range(60)]
    for _ in range(60):  # one group, each copy with changes of its own
        copy = list(base)
        for at in rng.sample(range(60), rng.randint(0, 2)):
            copy[at] = word()
        texts.append(copy)
    for n in (40, 44, 45, 46, 50):  # at the end of a text of 40 words, around the limit: 36 / 45 shingles
        own = [word() for _ in range(40)]
        texts += [own, own + [word() for _ in range(n - 40)]]
    texts += [line + [word() for _ in range(rng.randint(0, 20))] for _ in range(40)]
    texts += [[], [], ["One", "two"], ["one", "TWO"], ["two", "one"]]
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)
    kept = {r["doc_id"] for r in near_copies.drop_near_copies(docs).collect()}
    assert kept == brute_kept(rows) and len(kept) < len(rows) - 20


def test_chain_of_copies_is_one_group(spark):
    """Each text is like the next one only, so no leader reaches them all."""
    rng = random.Random(12)
    words = ["".join(rng.choices("abcdefghij", k=6)) for _ in range(300)]
    rows = [(i, " ".join(words[3 * i : 3 * i + 60])) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    assert brute_kept(rows) == {0}
    assert [r["doc_id"] for r in near_copies.drop_near_copies(docs).collect()] == [0]


def halo(rng, copies=150, words=120):
    """Texts of one base with few to many words changed: some are one group, many are only close to it."""
    word = lambda: "".join(rng.choices("abcdefghij", k=6))
    base = [word() for _ in range(words)]
    texts = []
    for i in range(copies):
        copy = list(base)
        for at in rng.sample(range(words), i % 12 // 2):
            copy[at] = word()
        texts.append(" ".join(copy))
    return list(enumerate(texts))


@pytest.mark.parametrize("block", [4096, 16])
def test_close_texts_that_are_no_copies_cost_no_pairs(spark, monkeypatch, block):
    """Of a large group and what is close to it, tables between the jobs hold a few rows per text, not one per pair."""
    monkeypatch.setattr(near_copies, "BLOCK_SIZE", block, raising=False)
    written, write = [], near_copies.materialize

    def counted(df, name):
        found = write(df, name)
        written.append((name, found.count()))
        return found

    monkeypatch.setattr(near_copies, "materialize", counted)
    rows = halo(random.Random(15))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    kept = {r["doc_id"] for r in near_copies.drop_near_copies(docs).collect()}
    assert kept == brute_kept(rows) and 20 < len(kept) < 100
    assert all(n <= len(rows) for name, n in written if name in ("pairs", "near", "asked")), written


@pytest.mark.parametrize("alone", [True, False])
def test_links_of_a_block_join_what_all_pairs_join(alone):
    rng = random.Random(16)
    grams = [near_copies.shingles(t) for _, t in halo(rng, 80, 90) + halo(rng, 40, 30)]
    inside = np.arange(len(grams)) % 2 == 0
    # some groups are known before
    root = np.array([0 if i % 12 == 1 and i < 40 else i for i in range(len(grams))])

    def groups(links):
        label = root.copy()
        for a, b in links:
            x, y = sorted((label[a], label[b]))
            label[label == y] = x
        return len(np.unique(label)), (label == label[:, None]).tolist()

    pairs = []
    for i, a in enumerate(grams):
        for j in range(i):
            common = len(np.intersect1d(a, grams[j], assume_unique=True))
            if (alone or inside[i] != inside[j]) and 5 * common >= 4 * (len(a) + len(grams[j]) - common):
                pairs.append((i, j))
    found = list(near_copies.similar_in_block(inside, alone, np.arange(len(grams)), root, grams))
    assert len(pairs) > 100 and groups(found) == groups(pairs)
    assert len(found) == len(np.unique(root)) - groups(found)[0]


def test_pairs_at_the_limit_are_found():
    """Recall of band keys and radii over pairs of similarity 0.8, short texts among them."""
    rng = np.random.default_rng(13)
    missed = total = 0
    for n in (4, 8, 20, 36, 100, 400):  # shared shingles; the rest is split over both sides
        for _ in range(400):
            extra = n // 4
            left = int(rng.integers(0, extra + 1))
            grams = rng.integers(0, 2**63, n + extra, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
            a, b = np.unique(grams[: n + left]), np.unique(np.append(grams[:n], grams[n + left :]))
            share = bool((near_copies.band_keys(a) == near_copies.band_keys(b)).any())
            fps = np.array([near_copies.set_fingerprint(a), near_copies.set_fingerprint(b)], np.int64).view(np.uint64)
            near = near_copies._near(fps[:1], fps[1], np.array([len(a)]), len(b))[0]
            total += 1
            missed += not (share and near)
    assert missed <= 2, (missed, total)


def test_tree_search_equals_a_scan():
    rng = np.random.default_rng(14)
    values = np.unique(rng.integers(0, 2**63, 300, dtype=np.uint64))
    tree = simhash.BKTree(values)
    for radius in (0, 3, 24, 30):
        for q in [*values[:5], *rng.integers(0, 2**63, 5, dtype=np.uint64)]:
            want = np.flatnonzero(np.bitwise_count(values ^ q) <= radius)
            assert tree.within(int(q), radius).tolist() == want.tolist()


def test_odd_rows(spark, odd_docs, no_docs):
    """Null ids go where their group is named, texts under one id are judged apart, clashing columns stay."""
    kept = near_copies.drop_near_copies(odd_docs)
    assert kept.columns == odd_docs.columns and kept.dtypes == odd_docs.dtypes
    assert sorted(r["doc_id"] or -1 for r in kept.collect()) == [-1, 1, 3, 6, 7, 8, 9]
    assert near_copies.drop_near_copies(no_docs).collect() == []
    rows = [
        (None, "one text of a few words"), (1, "one text of a few words"), (None, "another text of some more words"),
        (None, "another text of some more words"), (2, "first under two"), (2, "second under two"), (2, "second under two"),
        (3, "first under two"), (None, None), (4, ""),
    ]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    for drop in (near_copies.drop_near_copies, simhash.drop_near_duplicates):
        got = sorted(((r["doc_id"] or 0), r["text"]) for r in drop(docs).collect())
        assert got == [(0, "another text of some more words"), (1, rows[0][1]), (2, "first under two"), (2, "second under two"), (4, "")]
    groups = near_copies.near_copies(docs).collect()
    assert len(groups) == len(rows) and {r["component_id"] for r in groups if r["doc_id"] == 3} == {2}


def test_intermediate_tables_are_freed(spark):
    import glob

    from pixquill.session import scratch, shared_folder

    scratch(spark, "x")
    docs = spark.createDataFrame([(i, f"some words of text number {i % 7} and so on") for i in range(40)], "doc_id bigint, text string")
    before = set(glob.glob(f"{shared_folder(spark)}/pixquill-*/*"))
    near_copies.drop_near_copies(docs).count()
    left = {p.rsplit("/", 1)[1].split("-")[0] for p in set(glob.glob(f"{shared_folder(spark)}/pixquill-*/*")) - before}
    assert left <= {"groups", "leave", "repeated", "links"}
