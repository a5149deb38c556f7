"""Source divergence against plain Python, and the pointer sort against regular expressions."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from pixquill.llm import common, source_audit

from .conftest import ROWS

TERM = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return TERM.findall((text or "").translate(LOWER))


def brute(rows, least, top=50):
    """(lang, source, part, item, value, rank) of rows (text, lang, source)."""
    counts, df, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for text, lang, source in rows:
        lang, source = lang or "", source or ""
        groups[lang].add(source)
        found = terms(text)
        counts[lang, source].update(found)
        df[lang].update(set(found))
    out = []
    for lang, sources in groups.items():
        kept = [t for t, n in df[lang].items() if n >= least]

        def shares(names):
            n = {t: sum(counts[lang, s][t] for s in names) for t in kept}
            total = sum(n.values()) + 5 * len(kept)
            return {t: 1 + 10**9 * (n[t] + 5) // total for t in kept}

        q = shares(sources)
        p = {s: shares([s]) for s in sources}
        for s in sources:
            pairs = [(sum(abs(p[s][t] - p[o][t]) for t in kept), o) for o in sources if o != s]
            over = [(p[s][t] - q[t], t) for t in kept if counts[lang, s][t] and p[s][t] > q[t]]
            for part, found, limit in (("pair", pairs, None), ("term", over, top)):
                ordered = sorted(found, key=lambda x: (-x[0], x[1].encode()))[:limit]
                out += [(lang, s, part, item, value, r) for r, (value, item) in enumerate(ordered, 1)]
    return sorted(out)


def got(docs, **how):
    return sorted(tuple(r) for r in source_audit.source_divergence(docs, **how).collect())


WORDS = st.text(alphabet="abzAZé日😀\x00 .\n[", max_size=40)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.one_of(WORDS, st.sampled_from(["abcdefgh", "abcdefghi", "abcdefghabcdefgh", "abcdefghabcdefghi", "ABCDEFGH é"])), st.integers(0, 2)), max_size=12))
def test_runs_of_pointers_equal_words(rows):
    texts = pa.array(["x"] + [t for t, _ in rows], pa.string())[1:]  # a slice, as batches are cut
    group, words, n, df = source_audit.block_terms(texts, np.array([g for _, g in rows], np.int64))
    occurrences, documents = Counter(), Counter()
    for text, g in rows:
        occurrences.update((g, t) for t in terms(text))
        documents.update({(g, t) for t in terms(text)})
    keys = list(zip(group.tolist(), words.to_pylist()))
    assert len(set(keys)) == len(keys)
    assert dict(zip(keys, n.tolist())) == dict(occurrences) and dict(zip(keys, df.tolist())) == dict(documents)
    assert [k[1].encode() for k in keys if k[0] == 0] == sorted(k[1].encode() for k in keys if k[0] == 0)


def test_long_words_share_long_beginnings():
    stem = "q" * 5000
    texts = [f"{stem} {stem}a {stem[:-1]} {stem}", stem, stem + "b"]
    _, words, n, df = source_audit.block_terms(pa.array(texts), np.zeros(3, np.int64))
    assert dict(zip(words.to_pylist(), zip(n.tolist(), df.tolist()))) == {
        stem: (3, 2), stem + "a": (1, 1), stem[:-1]: (1, 1), stem + "b": (1, 1)
    }


def test_odd_documents(spark, odd_docs, no_docs):
    rows = [(r[1], r[2], r[3]) for r in ROWS]
    for least in (1, 2, 30):
        assert got(odd_docs, least=least) == brute(rows, least)
    assert got(no_docs) == []


@pytest.mark.parametrize("tile", [512, 2])
def test_cells_and_tiles(spark, monkeypatch, tile):
    """One source with a third of the rows, ties, sources without words, and languages cut in many cells."""
    monkeypatch.setattr(source_audit, "TILE_SOURCES", tile)
    monkeypatch.setattr(source_audit, "CELL_SHARES", 32)
    monkeypatch.setattr(common, "BROADCAST_BYTES", 0)
    monkeypatch.setattr(source_audit, "BLOCK_BYTES", 200)
    rng = random.Random(5)
    names = ["".join(rng.choices("abcdé", k=rng.randint(1, 12))) for _ in range(60)]
    rows = []
    for _ in range(200):
        text = " ".join(rng.choices(names, k=rng.randint(0, 20)))
        rows.append((text, rng.choice(["en", "de", None, ""]), "hot" if rng.random() < 0.35 else f"s{rng.randint(0, 6)}"))
    rows += [("", "fr", "a"), ("", "fr", "b"), ("same same", "it", "x"), ("same same", "it", "y"), (None, "en", "mute")]
    docs = spark.createDataFrame(rows, "text string, lang string, source string").repartition(7)
    assert got(docs, least=2) == brute(rows, 2)
    assert got(docs, least=3, top=2) == brute(rows, 3, 2)


def test_shares_beyond_64_bits(spark):
    n = 4 * 10**18
    df = spark.createDataFrame([(n, n + 9, 3)], "n bigint, total bigint, v bigint")
    assert df.select(source_audit.share(df.n, df.total, df.v).alias("p")).first()[0] == 1 + 10**9 * (n + 5) // (n + 9 + 15)
