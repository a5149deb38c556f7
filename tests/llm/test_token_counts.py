import public_tokenizers
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from pixquill.llm import token_counts

from .conftest import texts

PATH = public_tokenizers.path("piece_bpe_32k.model")
LIBRARY = sentencepiece.SentencePieceProcessor(model_file=PATH)
PARTS = ["a", "b", " ", "    ", "<s>", "\n", "é", "日本", "▁", "\x00", "😀", "the", "tion", "</s>", "<0x41>", "\t", "        ", "aaaa"]


@settings(max_examples=400, deadline=None)
@given(st.one_of(st.text(max_size=40), st.lists(st.sampled_from(PARTS), max_size=30).map("".join)))
def test_counts_equal_the_library(text):
    assert token_counts.piece_model(PATH).count(text) == len(LIBRARY.encode(text))


def test_count_is_symbols_minus_merges():
    model = token_counts.piece_model(PATH)
    assert model.symbols("▁the") == 4 and model.merges("▁the") == 3
    assert model.symbols("𓀀") == 4 and model.merges("𓀀") == 0


def test_bounded_cache(monkeypatch):
    monkeypatch.setattr(token_counts, "CACHE_CHUNKS", 3)
    model = token_counts.PieceModel(PATH)
    text = "some words here and more of them again and again"
    assert model.count(text) == len(LIBRARY.encode(text)) and len(model.cache) <= 3


def test_documents(odd_docs, no_docs):
    rows = token_counts.count_tokens(odd_docs, PATH).collect()
    expected = sorted((d or -1, len((t or "").encode()), len(LIBRARY.encode(t or ""))) for d, t in texts())
    assert sorted((r["doc_id"] or -1, r["n_bytes"], r["n_tokens"]) for r in rows) == expected
    assert token_counts.count_tokens(no_docs, PATH).count() == 0
