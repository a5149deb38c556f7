"""Records of files that are cut anywhere: JSON arrays and CSV with quoted line breaks."""

import csv
import io
import json
import os
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from pixquill.sources import blocks, nested, tables


@pytest.fixture(scope="module")
def fine(spark):
    session = spark.newSession()
    session.conf.set("spark.sql.files.openCostInBytes", "64")
    session.conf.set("spark.sql.files.maxPartitionBytes", "64")
    return session


JSON = st.recursive(
    st.none() | st.booleans() | st.integers() | st.text(alphabet='ab\\"[]{},: \n\té😀', max_size=12),
    lambda v: st.lists(v, max_size=4) | st.dictionaries(st.text(alphabet='k"\\,]}', max_size=4), v, max_size=3), max_leaves=12,
)


def by_scan(text, pieces):
    """Records of an array whose bytes are scanned in pieces that end after commas."""
    quoted, depth, held, out = False, 0, b"", []
    top = text.lstrip()[0]
    for piece in pieces:
        data = np.frombuffer(piece, np.uint8)
        found = blocks.JsonArray.scan(data, quoted, depth, ord(top))
        quoted, depth, start = found.quoted, found.depth, 0
        for c in [*found.cuts.tolist(), None]:
            end = len(data) if c is None else c
            held += data[start:end][found.inside[start:end]].tobytes()
            if c is not None:
                out.append(held)
                held, start = b"", c + 1
    return [r.decode() for r in [*out, held] if r.strip()], quoted, depth


@settings(max_examples=300, deadline=None)
@given(st.lists(JSON, max_size=6), st.sampled_from([None, 1]), st.booleans(), st.randoms())
def test_elements_of_any_array(value, indent, ascii_only, rng):
    text = json.dumps(value, indent=indent, ensure_ascii=ascii_only)
    parts = [p + b"," for p in text.encode().split(b",")]
    pieces = []
    for p in parts:
        if pieces and rng.random() < 0.5:
            pieces[-1] += p
        else:
            pieces.append(p)
    records, quoted, depth = by_scan(text, pieces)
    assert [json.loads(r) for r in records] == value and not quoted and depth == 0


def test_json_arrays_in_many_tasks(spark, fine, path):
    rng = random.Random(1)
    word = lambda: "".join(rng.choices('ab"\\,[]{}é\n ', k=rng.randint(0, 30)))
    want = {}
    for name, n in (("a", 60), ("b", 1), ("c", 0)):
        rows = [{"instruction": word(), "input": f"{name}{i}", "output": word() * rng.choice([1, 20])} for i in range(n)]
        with open(f"{path}/{name}.json", "w") as f:
            json.dump(rows, f, indent=rng.choice([None, 2]), ensure_ascii=False)
        want |= {r["input"]: r for r in rows}
    with open(f"{path}/object.json", "w") as f:
        json.dump({"instruction": "alone, [x", "input": "o", "output": "1, 2"}, f)
    want["o"] = {"instruction": "alone, [x", "input": "o", "output": "1, 2"}
    for session in (spark, fine):
        df = nested.read_json_array(session, path, nested.QA_DUMP)
        rows = [r.asDict() for r in df.collect()]
        assert len(rows) == len(want) and {r["input"]: r for r in rows} == want
    lines = blocks._lines(fine, path, blocks.JsonArray)
    assert lines.select("file", "block").distinct().count() > 20 and lines.rdd.getNumPartitions() > 8


def test_answers_keep_their_places(fine, path):
    rng = random.Random(2)
    rows = [[f"q{i}", "a, b]", "Yes", "]]" * rng.randint(0, 9)] for i in range(70)]
    with open(f"{path}/answers.json", "w") as f:
        json.dump(rows, f)
    got = nested.read_answers(fine, path).collect()
    assert sorted((r["ord"], r["question_id"], r["pred_ans"]) for r in got) == [(i, r[0], r[3]) for i, r in enumerate(rows)]


@pytest.mark.parametrize("document", ['[["q", "w", "Yes"', '[["q", "unclosed]', '{"a": 1}', "[1, 2]"])
def test_answers_that_are_none_are_refused(spark, path, document):
    with open(f"{path}/answers.json", "w") as f:
        f.write(document)
    with pytest.raises(Exception, match="array"):
        nested.read_answers(spark, path).collect()
    assert all(r["pred_ans"] is None for r in nested.read_answers(spark, path, strict=False).collect())


@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_csv_in_many_tasks(spark, fine, path, end):
    rng = random.Random(3)
    word = lambda: "".join(rng.choices('ab",\n é', k=rng.randint(0, 25)))
    rows = [(f"http://{i}", word() * rng.choice([1, 15]), word()) for i in range(80)]
    for name, part in (("a", rows[:50]), ("b", rows[50:]), ("c", [])):
        out = io.StringIO()
        writer = csv.writer(out, lineterminator=end)
        writer.writerow(["image_url", "capsfusion", "a \n`header`"])
        writer.writerows(part)
        with open(f"{path}/{name}.csv", "w", newline="") as f:
            f.write(out.getvalue().removesuffix(end) if name == "b" else out.getvalue())
    want = sorted((a, b or None, c or None) for a, b, c in rows)
    plain = spark.read.options(header=True, escape='"', multiLine=True).csv(path)
    if end == "\n":  # Spark's reader of one task per file leaves the other half of such a line end in the last field
        assert sorted(map(tuple, plain.collect()), key=str) == sorted(want, key=str)
    for session in (spark, fine):
        got = tables.read_csv(session, path)
        assert got.columns == ["image_url", "capsfusion", "a \n`header`"]
        assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)
    links = tables.read_links(fine, path)
    assert links.columns == ["image_url", "capsfusion"] and links.count() == 80
    assert blocks._lines(fine, path, blocks.Csv).rdd.getNumPartitions() > 8


def test_one_record_over_many_splits(fine, path):
    text = "x" * 1000 + "\n" * 50 + "y, z" * 100
    with open(f"{path}/a.csv", "w", newline="") as f:
        csv.writer(f, lineterminator="\n").writerows([["image_url", "capsfusion"], ["u", text], ["v", "w"]])
    assert sorted(map(tuple, tables.read_links(fine, path).collect())) == [("u", text), ("v", "w")]


def test_compressed_files_are_read_whole(fine, path):
    import gzip

    with gzip.open(f"{path}/a.json.gz", "wt") as f:
        json.dump([{"instruction": "a, b", "input": str(i), "output": "]"} for i in range(40)], f)
    assert nested.read_json_array(fine, path, nested.QA_DUMP).count() == 40
    assert os.listdir(path) == ["a.json.gz"]


def test_several_arrays_in_one_file(spark, fine, path):
    parts = [[{"instruction": f"{k}, ]", "input": str(i), "output": "[" * i} for i in range(n)] for k, n in (("a", 9), ("b", 1), ("c", 0), ("d", 30))]
    with open(f"{path}/arrays.json", "w") as f:
        f.write("\n".join(json.dumps(p) for p in parts) + "\n")
    want = sorted((r["instruction"], r["input"], r["output"]) for p in parts for r in p)
    for session in (spark, fine):
        assert sorted(map(tuple, nested.read_json_array(session, path, nested.QA_DUMP).collect())) == want


def test_small_splits_share_tasks(spark, fine, path):
    rows = [[f"q{i}", "w", "Yes", "x" * 90] for i in range(400)]
    for name in "ab":
        with open(f"{path}/{name}.json", "w") as f:
            json.dump(rows, f)
    lines = blocks._lines(fine, path, blocks.JsonArray)
    assert lines.select("file", "block").distinct().count() > 500
    assert lines.rdd.getNumPartitions() <= 4 * spark.sparkContext.defaultParallelism
    got = nested.read_answers(fine, path).collect()
    assert sorted((r["ord"], r["question_id"]) for r in got) == sorted((i, r[0]) for i, r in enumerate(rows) for _ in "ab")


def test_files_in_one_split_are_neither_shuffled_nor_counted(spark, path):
    for k in range(5):
        with open(f"{path}/{k}.json", "w") as f:
            json.dump([[f"{k}-{i}", "w", "Yes", "x"] for i in range(k)], f)
    got = nested.read_answers(spark, path)
    assert got._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1
    assert sorted((r["question_id"], r["ord"]) for r in got.collect()) == sorted((f"{k}-{i}", i) for k in range(5) for i in range(k))
