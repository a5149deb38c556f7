import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from pixquill.llm import packing

from .conftest import texts

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
PATH = public_tokenizers.path("byte_bpe_50k.json")
LIBRARY = Tokenizer.from_file(PATH)
PARTS = ["a", "B", " ", "  ", "<|endoftext|>", "\n", "é", "日本", "'s", "\x00", "😀", "the", "tion", "'LL", "12", "!!", "\t", "\r\n", "\x1c", "\x85", "—", "ſ", "᠎", "²", "½", "à", "×", "ª", "­", " ", "“", "€"]


@settings(max_examples=300, deadline=None)
@given(st.one_of(st.text(max_size=40), st.lists(st.sampled_from(PARTS), max_size=30).map("".join)))
def test_ids_equal_the_library(text):
    for ranks in (None, RANKS):
        assert list(packing.byte_bpe(PATH, ranks).ids(text)) == LIBRARY.encode(text, add_special_tokens=False).ids


def laid_out(rows, capacity):
    """Checks that sequences are gapless and within the capacity; gives their number."""
    by = {}
    for r in rows:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in by.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by)


def cut(ids, capacity=1024):
    """(piece, start, ids): only the first piece may be shorter than the capacity."""
    rest = len(ids) % capacity
    starts = ([0] if rest else []) + list(range(rest, len(ids), capacity))
    return [(k, a, ids[a:b]) for k, (a, b) in enumerate(zip(starts, [*starts[1:], len(ids)]))]


def piece_by_piece(counts, capacity):
    """Sequences that the method needs, one piece at a time."""
    pieces = sorted((k for k, v in counts.items() for _ in range(v)), reverse=True)
    large = [n for n in pieces if 3 * n > capacity]
    gaps = []
    while large:
        n = large.pop(0)
        mate = next((m for m in large if n + m <= capacity), 0)
        if mate:
            large.remove(mate)
        gaps.append(capacity - n - mate)
    for n in (n for n in pieces if 3 * n <= capacity):
        fit = min((g for g in gaps if g >= n), default=None)
        if fit is None:
            gaps.append(capacity - n)
        else:
            gaps[gaps.index(fit)] -= n
    return len(gaps)


@settings(max_examples=200, deadline=None)
@given(st.dictionaries(st.integers(1, 30), st.integers(1, 40), max_size=12))
def test_plan_places_every_piece_once(counts):
    rows, seen = [], Counter()
    for length, low, high, first, per, offset in packing.plan(counts, 30):
        for r in range(low, high):
            seen[length] += 1
            rows.append({"sequence_id": first + (r - low) // per, "offset": offset + (r - low) % per * length, "length": length})
        assert (high - low) % per == 0
    assert seen == Counter(counts)
    assert laid_out(rows, 30) == piece_by_piece(counts, 30)


def test_large_pieces_are_matched_and_small_ones_fill_gaps():
    # 600 + 400 leave 24, 520 + 504 nothing
    plan = packing.plan({600: 1, 400: 1, 520: 1, 504: 1, 24: 1}, 1024)
    assert max(first for _, _, _, first, _, _ in plan) == 1


def test_plan_work_does_not_depend_on_counts():
    few = packing.plan({k: 3 for k in range(1, 1025)})
    many = packing.plan({k: 3_000_000_000 for k in range(1, 1025)})
    assert len(many) <= 4096 and len(few) <= 4096


def test_documents(spark, odd_docs):
    rows = packing.pack_documents(odd_docs, PATH, ranks_path=RANKS).collect()
    expected = Counter()
    for doc_id, text in texts():
        ids = [*LIBRARY.encode(text or "", add_special_tokens=False).ids, 2]
        for k, at, part in cut(ids):
            part = np.array(part, "<u4").tobytes()
            expected[doc_id, k, at, len(part) // 4, part] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], bytes(r["ids"])) for r in rows) == expected
    laid_out(rows, 1024)
    digests = packing.pack_documents(odd_docs, PATH, digest=True).collect()
    assert Counter(r["ids_crc32"] for r in digests) == Counter(zlib.crc32(bytes(r["ids"])) for r in rows)


def test_only_the_first_piece_is_shorter(spark):
    sizes = [0, 1, 1023, 1024, 1025, 2047, 3071, 5000]  # one token a word, and the end
    docs = spark.createDataFrame([(n, " the" * n) for n in sizes], "doc_id bigint, text string")
    by = {}
    for r in packing.pack_documents(docs, PATH, ranks_path=RANKS).collect():
        by.setdefault(r["doc_id"], []).append((r["piece"], r["start"], r["length"]))
    for n in sizes:
        assert sorted(by[n]) == [(k, at, len(part)) for k, at, part in cut([0] * (n + 1))]
        assert all(length == 1024 for k, _, length in by[n] if k)


def test_cache_keeps_no_long_chunks():
    model = packing.ByteBpe(PATH, RANKS)
    model.ids("short " + "x" * 10_000)
    assert max(map(len, model)) <= packing.CACHE_LENGTH


def test_cells_of_a_hot_length(spark, monkeypatch):
    monkeypatch.setattr(packing, "ROWS_PER_CELL", 7)
    pieces = spark.range(500).selectExpr("id doc_id", "0 piece", "cast(if(id % 3 = 0, 100, 1 + id % 900) as bigint) length")
    laid_out(packing.place(pieces).collect(), 1024)


def test_empty_and_bad_lengths(spark, no_docs):
    empty = packing.pack_documents(no_docs, PATH)
    assert empty.count() == 0 and {"sequence_id", "offset"} <= set(empty.columns)
    with pytest.raises(ValueError):
        packing.place(spark.createDataFrame([(1, 0, 2000)], "doc_id bigint, piece int, length bigint"))
