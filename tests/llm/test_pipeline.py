"""Every stage of the pipeline against a plain version of it on the stage's own input."""

import re
import zlib
from collections import Counter

import corpus_pipeline
import public_tokenizers
from tokenizers import Tokenizer

from pixquill.llm import quality_classifier

from .test_decontaminate import brute
from .test_near_copies import brute_kept
from .test_packing import cut, laid_out
from .test_secret_scan import base

SMALL = "/root/testdata/sf0.001"


def rows(df):
    return {r["doc_id"]: r for r in df.collect()}


def test_stages(spark, tmp_path):
    sf, docs = SMALL, spark.read.parquet(f"{SMALL}/documents.parquet")
    columns, labels = docs.columns, spark.read.parquet(f"{SMALL}/labels.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == [
        "quality classifier", "SimHash near-dedup", "benchmark decontamination", "secret scans", "best-fit packing",
    ]
    seen = [docs]
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, seen[-1], sf)
        out.write.parquet(f"{tmp_path}/{i}")
        seen.append(spark.read.parquet(f"{tmp_path}/{i}"))
        if i < 4:
            assert out.columns == columns
    whole, good, single, clean, hidden, packed = (df if i == 5 else rows(df) for i, df in enumerate(seen))

    # the classifier's rule: its own verdicts, which labelled documents bear out
    verdicts = {r["doc_id"]: r["kept"] for r in quality_classifier.classify(docs, labels).collect()}
    assert set(good) == {d for d in whole if verdicts[d]}
    label = {r["doc_id"]: r for r in labels.collect()}
    clean_share = [d in good for d, r in label.items() if r["quality"] == 1 and not r["toxic"] and d in whole]
    junk_share = [d in good for d, r in label.items() if r["quality"] == 0 and d in whole]
    assert sum(clean_share) > 0.85 * len(clean_share) and sum(junk_share) < 0.5 * len(junk_share)

    # the near-copy rule: five-word shingles, similarity 0.8
    assert set(single) == brute_kept([(d, good[d]["text"]) for d in sorted(good)]) and len(single) < len(good)

    bench = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    words = {d: set(re.split(r"[\W_]+", r["text"].lower())) for d, r in single.items()}
    near = []  # only texts that share many words with an item can overlap with it
    for i, text in bench:
        item = set(re.split(r"[\W_]+", text.lower())) - {""}
        near += [(d, i, text) for d in single if len(item & words[d]) >= 0.3 * len(item)]
    bad = {d for d, i, text in near if brute([(d, single[d]["text"])], [(i, text)])}
    assert set(clean) == set(single) - bad and bad

    assert set(hidden) == set(clean)
    for d, r in clean.items():
        spans, text, at = base(r["text"]), "", 0
        for start, _, end in spans:
            if start >= at:
                text += r["text"][at:start] + "[secret]"
            at = max(at, end)
        assert hidden[d]["text"] == text + r["text"][at:] and hidden[d]["n_chars"] == len(hidden[d]["text"])

    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = Counter()
    for d, r in hidden.items():
        tokens = [*library.encode(r["text"], add_special_tokens=False).ids, 2]
        for k, at, part in cut(tokens):
            data = b"".join(t.to_bytes(4, "little") for t in part)
            want[d, k, at, len(data) // 4, zlib.crc32(data)] += 1
    pieces = packed.collect()
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], zlib.crc32(bytes(r["ids"]))) for r in pieces) == want
    n = laid_out(pieces, 1024)
    assert n <= 1.05 * sum(r["length"] for r in pieces) / 1024 + 2


def test_odd_documents(spark, odd_docs, no_docs):
    stages = dict(corpus_pipeline.STAGES)
    for docs in (odd_docs, no_docs):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, SMALL)
            assert out.columns == docs.columns and out.count() <= docs.count(), name
        stages["best-fit packing"](spark, docs, SMALL).count()
