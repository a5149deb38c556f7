import json
import os

import pytest
from pyspark.sql import functions as F

from pixquill.operators import augment, corpus, logs, scoring
from pixquill.plans import flows
from pixquill.sources import images, nested, sinks, subsets, tables


def test_links_csv(spark, path):
    with open(f"{path}/links.csv", "w") as f:
        f.write('extra,capsfusion,image_url\n1,"two\nlines, ""quoted""",http://a\n2,NA,http://b\n3,,http://c\n')
    rows = {r["image_url"]: r["capsfusion"] for r in tables.read_links(spark, f"{path}/links.csv").collect()}
    assert rows == {"http://a": 'two\nlines, "quoted"', "http://b": "NA", "http://c": None}


def test_links_parquet_and_missing_columns(spark, path):
    spark.createDataFrame([("u", "c")], tables.LINKS).write.parquet(f"{path}/x.parquet")
    assert tables.read_links(spark, f"{path}/x.parquet").collect() == [("u", "c")]
    spark.createDataFrame([("u",)], "image_url string").write.parquet(f"{path}/y.parquet")
    with pytest.raises(ValueError, match="capsfusion"):
        tables.read_links(spark, f"{path}/y.parquet")


def test_vqa_documents(spark, path):
    q = {"questions": [{"question_id": 1, "image_id": 9, "question": "What?"}, {"question_id": 2, "image_id": 9, "question": "Is it?"}]}
    a = {"annotations": [
        {"question_id": 1, "image_id": 9, "multiple_choice_answer": "net", "answer_type": "other", "more": [1]},
        {"question_id": 3, "image_id": 9, "multiple_choice_answer": "no", "answer_type": "yes/no"},
    ]}
    for name, doc in [("q", q), ("a", a)]:
        with open(f"{path}/{name}.json", "w") as f:
            json.dump(doc, f, indent=1)
    questions, answers = nested.read_vqa(spark, f"{path}/q.json", f"{path}/a.json")
    got = corpus.vqa_prompts(corpus.vqa_join(questions, answers)).collect()
    assert [tuple(r) for r in got] == [
        (9, "VQA/9", "<sys>You are a useful Visual Assitant</sys><user>What?</user><assist>It's net</assist>")
    ]


def test_json_arrays(spark, path):
    with open(f"{path}/dump.json", "w") as f:
        json.dump([{"id": "1", "conversations": [{"from": "human", "value": "<image>?"}, {"from": "gpt", "value": "!"}]}], f)
    df = corpus.normalize_dump(nested.read_json_array(spark, f"{path}/dump.json", nested.DUMP))
    assert [(m["role"], m["content"]) for m in df.first()["messages"]][1:] == [("user", "<IMGPLH>?"), ("assistant", "!")]
    with open(f"{path}/qa.json", "w") as f:
        json.dump([{"instruction": "do", "input": "", "output": "done"}], f)
    assert nested.read_json_array(spark, f"{path}/qa.json", nested.QA_DUMP).first()["output"] == "done"


def test_answers_to_category_files_and_back(spark, path):
    answers = [
        ["color/a b.jpg ", " red? ", "Yes", "\nYes, it\nis. "],
        ["color/a b.jpg", "blue?", "No", "No\ttab"],
        ["OCR/x.png", "é?", "No", ""],
    ]
    with open(f"{path}/answers.json", "w") as f:
        json.dump(answers, f)
    raw = nested.read_answers(spark, f"{path}/answers.json")
    assert [r["ord"] for r in raw.orderBy("ord").collect()] == [0, 1, 2]
    tidy = scoring.format_answers(raw)
    for _ in range(2):  # writing twice does not double the lines
        sinks.write_mme_dir(tidy, f"{path}/out")
    got = sorted(
        (r["category"], r["img_name"], r["question"], r["gt_ans"], r["pred_ans"] or "")
        for r in sinks.read_mme_dir(spark, f"{path}/out").collect()
    )
    assert got == [
        ("OCR", "x.png", "é?", "No", ""),
        ("color", "a b.jpg", "blue?", "No", "No tab"),
        ("color", "a b.jpg", "red?", "Yes", "Yes, itis."),
    ]


def test_category_from_text_file_name(spark, path):
    with open(f"{path}/code_reasoning.txt", "w") as f:
        f.write('a.png\tIs it "x"?\tYes\na.png\tIs it y?\tNo\n')
    rows = sinks.read_mme_dir(spark, path).collect()
    assert {r["category"] for r in rows} == {"code_reasoning"}
    assert rows[0]["question"] == 'Is it "x"?' and rows[0]["pred_ans"] is None


def test_requests_written_per_batch(spark, path):
    df = spark.range(7).select(
        F.col("id").alias("k"), F.lit("q").alias("question"), F.lit("a").alias("multiple_choice_answer")
    )
    batched = augment.request_batches(df, "k", 3)
    requests = augment.llm_requests(batched, "k").join(
        batched.select(F.col("k").cast("string").alias("custom_id"), "batch"), "custom_id"
    )
    sinks.write_llm_requests(requests, f"{path}/req")
    lines = spark.read.text(f"{path}/req")
    assert {r["batch"]: r["count"] for r in lines.groupBy("batch").count().collect()} == {0: 3, 1: 3, 2: 1}
    first = json.loads(lines.where("batch = 2").first()["value"])
    assert first["custom_id"] == "6" and first["body"]["messages"][1]["content"].endswith("Question: q. Answer: a")
    assert list(first) == ["custom_id", "method", "url", "body"]


def test_responses(spark, path):
    def line(i, content):
        return json.dumps({"custom_id": i, "response": {"body": {"choices": [{"message": {"content": content}}]}}})

    with open(f"{path}/r.jsonl", "w") as f:
        f.write("\n".join([line("1", '{"a": 1}'), line("2", "not json"), "broken{", line("3", '"x"')]) + "\n")
    raw = nested.read_llm_responses(spark, f"{path}/r.jsonl")
    text = {r["custom_id"]: r["answer"] for r in augment.parse_llm_responses(raw).collect()}
    assert text == {"1": '{"a": 1}', "2": "not json", "3": '"x"'}
    structured = {r["custom_id"] for r in augment.parse_llm_responses(raw, "structured").collect()}
    assert structured == {"1", "3"}
    with pytest.raises(ValueError, match="output_type not supported"):
        augment.parse_llm_responses(raw, "xml")


def test_augment_client_with_a_failing_batch(spark, path):
    df = spark.range(5).select(F.col("id").alias("k"), F.lit("q").alias("question"), F.lit("a").alias("multiple_choice_answer"))
    batched = augment.request_batches(df, "k", 2)
    full = augment.llm_requests(batched, "k").join(
        batched.select(F.col("k").cast("string").alias("custom_id"), "batch"), "custom_id"
    )

    calls = f"{path}/calls"
    os.makedirs(calls)

    def client(requests, batch, fails=True):
        import json
        import uuid

        open(f"{calls}/{batch}-{uuid.uuid4()}", "w").close()
        if fails and batch == 1:
            raise RuntimeError("quota")
        return {json.loads(r)["custom_id"]: f"answer {batch}" for r in requests}

    answers = augment.llm_augment(full, client, f"{path}/answers")
    assert answers.count() == 4 and answers.where("batch = 1").first()["error"] == "quota"
    assert sorted(f.split("-")[0] for f in os.listdir(calls)) == ["0", "1", "2"]  # each batch once, over two actions
    again = augment.llm_augment(full, lambda r, b: client(r, b, False), f"{path}/answers")
    assert again.count() == 5 and again.where("error is not null").count() == 0
    assert sorted(f.split("-")[0] for f in os.listdir(calls)) == ["0", "1", "1", "2"]  # only the failed one again
    joined = augment.join_llm_responses(df, answers, "k")
    got = {r["k"]: r["status"] for r in joined.collect()}
    assert got == {0: "answered", 1: "answered", 2: "missing", 3: "missing", 4: "answered"}
    assert {r["status"]: r["n_samples"] for r in augment.augmentation_coverage(joined).collect()} == {"answered": 3, "missing": 2}


def test_two_answers_do_not_multiply_a_sample(spark):
    samples = spark.range(2).withColumnRenamed("id", "k")
    answers = spark.createDataFrame([("0", "a", 1), ("0", "b", 0)], "custom_id string, answer string, n int")
    got = augment.join_llm_responses(samples, answers, "k", order="n").orderBy("k").collect()
    assert [(r["k"], r["complete_answer"]) for r in got] == [(0, "a"), (1, None)]
    assert augment.join_llm_responses(samples, answers, "k").count() == 2


def test_answers_that_are_no_array(spark):
    docs = spark.createDataFrame([('[["a", "b", "c", "d"]]',), ('[["a"',)], "value string")
    assert nested.parse_answers(docs, strict=False).where("ord is null").count() == 1
    with pytest.raises(Exception, match="no array of answers"):
        nested.parse_answers(docs).collect()


def test_fetch_goes_on_after_the_last_finished_chunk(spark, path):
    links = spark.range(40).select(F.col("id").cast("string").alias("identifier"), F.concat(F.lit("u"), F.col("id")).alias("image_url"))
    os.makedirs(f"{path}/calls")

    def fetch(url, dies=()):
        import uuid

        open(f"{path}/calls/{url}-{uuid.uuid4()}", "w").close()
        return b"GIF89a\x01\x00\x01\x00"

    images.fetch_in_chunks(links, f"{path}/out", fetch, chunk=10)
    done = sorted(d for d in os.listdir(f"{path}/out") if d.startswith("chunk="))
    os.remove(f"{path}/out/{done[1]}/_SUCCESS")  # as if the run had died in this chunk
    lost = {r["image_url"] for r in spark.read.parquet(f"{path}/out/{done[1]}").collect()}
    out = images.fetch_in_chunks(links, f"{path}/out", fetch, chunk=10)
    assert out.count() == 40 and out.where("ok").count() == 40
    calls = [f.split("-")[0] for f in os.listdir(f"{path}/calls")]
    assert {u for u in calls if calls.count(u) == 2} == lost and len(calls) == 40 + len(lost)


HEADER = bytes.fromhex("89504E470D0A1A0A0000000D494844520000000300000004")


def test_links_are_read_once_whatever_the_chunks(spark, path):
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    rows = spark.range(60).selectExpr("cast(id as string) identifier", "concat('http://h', id % 5, '/', id) image_url").coalesce(2)
    links = rows.mapInArrow(count, "identifier string, image_url string")
    out = images.fetch_in_chunks(links, f"{path}/out", lambda url: HEADER, chunk=7)
    assert out.where("ok").count() == 60 and seen.value == 60
    assert images.fetch_in_chunks(links, f"{path}/out", lambda url: HEADER, chunk=7).count() == 60 and seen.value == 60
    none = images.fetch_in_chunks(links.where("identifier is null"), f"{path}/none", lambda url: HEADER)
    assert none.count() == 0 and {"ok", "content", "original_width"} <= set(none.columns)


def test_killed_fetch_goes_on_without_the_links(spark, path):
    """The worker dies in some chunk; the next run fetches only chunks that are not finished, and needs no links."""
    import shutil

    os.makedirs(f"{path}/calls")
    links = spark.range(60).selectExpr("cast(id as string) identifier", "concat('http://h/', id) image_url")
    links.write.parquet(f"{path}/source")
    stored = spark.read.parquet(f"{path}/source")
    calls = f"{path}/calls"

    def fetch(url, deadly=True):
        import os as os_
        import uuid

        name = url.rsplit("/", 1)[1]
        if deadly and name == "30":
            os_._exit(3)
        open(f"{calls}/{name}-{uuid.uuid4().hex}", "w").close()
        return HEADER

    with pytest.raises(Exception):
        images.fetch_in_chunks(stored, f"{path}/out", fetch, chunk=10)
    finished = [d for d in os.listdir(f"{path}/out") if d.startswith("chunk=") and os.path.exists(f"{path}/out/{d}/_SUCCESS")]
    before = {r["identifier"] for d in finished for r in spark.read.parquet(f"{path}/out/{d}").collect()}
    shutil.rmtree(f"{path}/source")
    shutil.rmtree(calls)
    os.makedirs(calls)
    out = images.fetch_in_chunks(stored, f"{path}/out", lambda url: fetch(url, False), chunk=10)
    assert out.where("ok").count() == 60
    again = {f.split("-")[0] for f in os.listdir(calls)}
    assert again == {str(i) for i in range(60)} - before


def test_host_lanes_bound_requests(spark, path):
    """No host gets more requests at once than it has lanes, though one host has most URLs."""
    os.makedirs(f"{path}/spans")
    spans = f"{path}/spans"

    def fetch(url):
        import time
        import uuid

        start = time.time()
        time.sleep(0.02)
        with open(f"{spans}/{uuid.uuid4().hex}", "w") as f:
            f.write(f"{url.split('/')[2]} {start} {time.time()}")
        return b""

    links = spark.range(80).selectExpr("cast(id as string) identifier", "concat('http://', if(id % 4 = 0, concat('h', id % 7), 'hot'), '/', id) image_url")
    assert images.fetch_images(links, fetch, threads=16, partitions=6, per_host=3).where("ok").count() == 80
    events = []
    for name in os.listdir(spans):
        host, a, b = open(f"{spans}/{name}").read().split()
        events += [(float(a), 1, host), (float(b), -1, host)]
    open_now, most = {}, {}
    for _, step, host in sorted(events):
        open_now[host] = open_now.get(host, 0) + step
        most[host] = max(most.get(host, 0), open_now[host])
    assert len(events) == 160 and max(most.values()) <= 3 and most["hot"] > 1


def test_files_of_rows(spark, path):
    from pixquill.functions import png

    rows = [("a.png", png.encode(bytes(range(12)), 2, 2)), ("b.png", b"no image"), ("c.jpg", None), ("d.txt", b"text")]
    df = spark.createDataFrame(rows, "name string, content binary").repartition(3)
    for target in (f"{path}/one", f"file://{path}/two"):
        assert sinks.write_files(df, target) == 3 and sinks.write_files(df, target) == 3
    for folder in ("one", "two"):
        assert sorted(os.listdir(f"{path}/{folder}")) == ["a.png", "b.png", "d.txt"]
        (size,) = images.image_size(spark, f"{path}/{folder}").collect()
        assert (size["width"], size["height"]) == (2, 2) and size["path"].endswith("a.png")
        assert {r["name"] for r in images.scan_images(spark, f"{path}/{folder}").collect()} == {"a.png", "b.png"}
    (pixels,) = images.decode_image_files(spark, f"{path}/one").collect()
    assert bytes(pixels["data"]) == bytes([2, 1, 0, 5, 4, 3, 8, 7, 6, 11, 10, 9])  # BGR
    for bad in (f"viewfs://x{path}", f"{path}/three"):
        with pytest.raises(Exception, match="no mounted folder" if "viewfs" in bad else "no name"):
            sinks.write_files(df.limit(1) if "viewfs" in bad else df.selectExpr("'../x' name", "content"), bad)


def test_status_of_many_subset_files(spark, path, monkeypatch):
    """Files without rows are opened some at a time, the others not at all: no column of a sample is read."""
    monkeypatch.setattr(subsets, "SUSPECTS", 3)
    rows = spark.range(20).selectExpr("id position", "'x' inputs")
    for name in ("full", "torn", "empty"):
        rows.repartition(4).write.parquet(f"{path}/subset={name}")
    for i in range(7):
        with open(f"{path}/subset=torn/part-{i}.parquet", "w") as f:
            f.write("no parquet")
    rows.limit(0).coalesce(1).write.mode("append").parquet(f"{path}/subset=empty")
    samples, status = subsets.read_subsets(spark, path, ["full", "torn", "empty", "none"], "position bigint, inputs string")
    assert {r["subset"]: (r["status"], r["files"], r["unreadable"]) for r in status.collect()} == {
        "full": ("loaded", 4, 0), "torn": ("partial", 11, 7), "empty": ("loaded", 5, 0), "none": ("missing", 0, 0)
    }
    assert samples.count() == 60
    names = samples.select(F.input_file_name()).distinct()._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<>" in names


def test_subsets(spark, path):
    spark.createDataFrame([("i", "x", "o", ["aGk="], 0)], subsets.SUBSET_COLUMNS).write.parquet(f"{path}/subset=coco")
    spark.createDataFrame([("o2", 1)], "outputs string, position long").write.parquet(f"{path}/subset=vqa-v2")
    with open(f"{path}/subset=coco/bad.parquet", "w") as f:
        f.write("not parquet")
    names = ["coco", "vqa-v2", "absent"]
    for schema in (subsets.SUBSET_COLUMNS, None):
        df, status = subsets.read_subsets(spark, path, names, schema)
        got = sorted((r["subset"], r["outputs"], r["instruction"]) for r in df.collect())
        assert got == [("coco", "o", "i"), ("vqa-v2", "o2", None)]
        assert {r["subset"]: r["status"] for r in status.collect()} == {"coco": "partial", "vqa-v2": "loaded", "absent": "missing"}
    os.makedirs(f"{path}/subset=gqa")
    with open(f"{path}/subset=gqa/bad.parquet", "w") as f:
        f.write("not parquet")
    df, status = subsets.read_subsets(spark, path, [*names, "gqa"])
    assert df.count() == 2 and status.where("subset = 'gqa'").first()["status"] == "failed"
    empty, _ = subsets.read_subsets(spark, path, ["absent"])
    assert empty.count() == 0 and "subset" in empty.columns


def test_scalars_round_trip_and_tag_pushdown(spark, path):
    metrics = spark.createDataFrame(
        [("r", 1, {"loss": "2.0", "eval_x": "1", "epoch": "0.5", "note": "hi"})], "run string, step long, metrics map<string,string>"
    )
    sinks.append_scalars(logs.metric_rows(metrics), f"{path}/s")
    sinks.append_scalars(logs.metric_rows(metrics, phase="eval"), f"{path}/s")
    tags = sorted(r["tag"] for r in tables.read_scalars(spark, f"{path}/s").collect())
    assert tags == ["evaluation/epoch", "evaluation/eval_x", "evaluation/loss", "other/epoch", "training/loss"]
    one = tables.read_scalars(spark, f"{path}/s", "training/loss")
    assert [r["value"] for r in one.collect()] == [2.0]
    assert "PushedFilters: [IsNotNull(tag), EqualTo(tag,training/loss)]" in one._jdf.queryExecution().executedPlan().toString()


def test_csv_keeps_empty_and_null_apart(spark, path):
    df = spark.createDataFrame([("", None, 'q "x"\ny', "p")], tables.SAMPLES)
    sinks.write_table(df, f"{path}/c", "csv")
    back = tables.read_samples(spark, f"{path}/c").first()
    assert (back["inputs"], back["outputs"]) == (None, 'q "x"\ny')
    sinks.write_table(df, f"{path}/p.parquet")
    assert tables.read_samples(spark, f"{path}/p.parquet").first()["instruction"] == ""


def test_score_benchmark_flow(spark):
    rows = [
        (0, "color/1", "q", "Yes", "user\n\nq assistant\n\nYes"),
        (1, "color/1", "q", "No", "user\n\nq assistant\n\nNo"),
        (2, "OCR/7", "q", "Yes", "no marker"),
        (3, "OCR/7", "q", "No", "assistant\n\nI know"),
    ]
    decoded = spark.createDataFrame(rows, "ord long, question_id string, question string, answer string, decoded string")
    scores, rollup, confusion = flows.score_benchmark(decoded, scoring.task_types(spark))
    assert {r["category"]: r["score"] for r in scores.collect()} == {"color": 200.0, "OCR": 50.0}
    assert {r["eval_type"]: r["score"] for r in rollup.collect()} == {"Perception": 250.0, "total": 250.0}
    assert confusion.first()["other_num"] == 1


def test_label_file(spark, path):
    with open(f"{path}/labels.csv", "w") as f:
        f.write("line_no,category,label,description\n1,a,cat,first\n2,b,dog,d\n9,b,cat,last\n")
    from pixquill.operators.similarity import last_label_wins

    got = {r["label"]: r["description"] for r in last_label_wins(tables.read_labels(spark, f"{path}/labels.csv")).collect()}
    assert got == {"cat": "last", "dog": "d"}


def test_special_tokens(spark, path):
    from pixquill.operators.tokens import special_token_map

    with open(f"{path}/tokens.json", "w") as f:
        json.dump({"added_tokens": [{"type": "Image", "token": "<I>", "value": "x"}, {"type": "End", "token": "<E>", "value": "x"}]}, f)
    got = special_token_map(nested.read_special_tokens(spark, f"{path}/tokens.json"), base=10).collect()
    assert [tuple(r) for r in got] == [("Image", "<I>", 10), ("End", "<E>", 11)]
