import re
from collections import Counter

from pyspark.sql import functions as F

from pixquill.llm import quality_rules

from .conftest import texts

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def base(text):
    text = text or ""
    words = WORD.findall(text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    often = Counter(windows)
    covered = {i + j for i, w in enumerate(windows) if often[w] > 1 for j in range(3)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    failed = len(words) < 50 or 100 * len(covered) > 50 * len(words)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(covered), failed


def test_base_counts(spark, odd_docs, no_docs):
    more = [(20, "a b c a b c d"), (21, "x\v\fy\rz"), (22, "é\x85ü\xa0w\n\n \n#<>"), (23, "a a a a"), (24, "\n".join(["same line"] * 3))]
    both = odd_docs.select("doc_id", "text").unionByName(spark.createDataFrame(more, "doc_id bigint, text string"))
    rows = quality_rules.quality_rules(both).collect()
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    assert Counter((r["doc_id"], *[r[n] for n in names]) for r in rows) == Counter((d, *base(t)) for d, t in [*texts(), *more])
    assert quality_rules.quality_rules(no_docs).count() == 0


def test_lines(spark):
    cases = {
        "A plain sentence.": True,
        'He said "no."': True,
        "": True,
        "No end mark here": False,
        "Home | About | Contact | Blog.": False,
        "All rights reserved.": False,
        "This work is licensed under some license.": False,
        "We cook well.": True,
        "IN!! THE!! SHORT!! WORDS!! MANY!! MARKS!! EACH!!": False,
    }
    df = spark.createDataFrame([(k,) for k in cases], "line string")
    got = {r["line"]: r["ok"] for r in df.select("line", quality_rules.line_passes(F.col("line")).alias("ok")).collect()}
    assert got == cases


def test_verdict_follows_the_lines(spark):
    good = " ".join(f"Word{i} other{i}." for i in range(40))
    rows = [(1, good), (2, good + "\n" + "menu | one | two | three | " * 40), (3, good + "\nno end mark")]
    found = {r["doc_id"]: r for r in quality_rules.quality_rules(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert [found[i]["kept"] for i in (1, 2, 3)] == [True, False, True]
    assert not any(r["base_failed"] for i, r in found.items() if i != 2)
    assert found[3]["cleaned"] == good and found[3]["n_lines_removed"] == 1 and 0 < found[3]["lost"] < 0.1
