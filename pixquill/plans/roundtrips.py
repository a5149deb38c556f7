"""Registered queries of readers and writers: a table is written to the shared
folder by the library's writer and read back by its reader."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import png
from ..operators import augment, corpus, ingest, scoring
from ..session import materialize, scratch
from ..sources import eventlog, images, nested, sinks, subsets, tables
from . import flows, views
from .oracle import V_FETCH, V_LINKS, V_MME, V_VQA

QUERIES = {}
SQL = {}


def query(sql: str):
    def add(fn):
        QUERIES[fn.__name__] = fn
        SQL[fn.__name__] = sql
        return fn

    return add


# --- flat tables --------------------------------------------------------------


@query(f"WITH {V_LINKS} SELECT image_url, nullif(capsfusion, '') AS capsfusion FROM v_links")
def read_links(spark, sf):
    """CSV with quoted fields; an empty field is null."""
    path = scratch(spark, "links")
    sinks.write_table(views.links(spark, sf).withColumn("capsfusion", F.when(F.col("capsfusion") != "", F.col("capsfusion"))), path, "csv")
    return tables.read_links(spark, path, line_breaks=False)


@query(f"WITH {V_LINKS} SELECT image_url, 'id-' || page_id AS identifier FROM v_links")
def read_identifiers(spark, sf):
    path = scratch(spark, "identifiers")
    rows = views.links(spark, sf).select("image_url", F.concat(F.lit("id-"), F.col("page_id").cast("string")).alias("identifier"))
    sinks.write_table(rows, path, "csv")
    return tables.read_identifiers(spark, path, line_breaks=False)


@query("""SELECT lang AS instruction, CAST(doc_id AS VARCHAR) AS inputs, text AS outputs, source || '/' || doc_id AS image_path FROM documents""")
def read_samples(spark, sf):
    """CSV whose texts hold line breaks, quotes and commas."""
    path = scratch(spark, "samples")
    rows = views.table(spark, sf, "documents").select(
        F.col("lang").alias("instruction"), F.col("doc_id").cast("string").alias("inputs"), F.col("text").alias("outputs"),
        F.concat_ws("/", "source", "doc_id").alias("image_path"),
    )
    sinks.write_table(rows, path, "csv")
    return tables.read_samples(spark, path).select("instruction", "inputs", "outputs", "image_path")


@query("""SELECT item_id AS ord, 'q' || item_id AS question_id, text AS question, CASE WHEN item_id % 2 = 0 THEN 'yes' ELSE 'no' END AS answer, 'c' || (item_id % 3) AS category FROM benchmark""")
def read_benchmark(spark, sf):
    path = scratch(spark, "benchmark")
    i = F.col("item_id")
    rows = views.table(spark, sf, "benchmark").select(
        i.alias("ord"), F.concat(F.lit("q"), i.cast("string")).alias("question_id"), F.col("text").alias("question"),
        F.when(i % 2 == 0, F.lit("yes")).otherwise(F.lit("no")).alias("answer"),
        F.concat(F.lit("c"), (i % 3).cast("string")).alias("category"),
    )
    sinks.write_table(rows, path, "csv")
    return tables.read_benchmark(spark, path)


@query("SELECT event_id AS step, event_type AS tag, 'run' || (user_id % 3) AS run, value FROM events WHERE event_type = 'view'")
def scalar_table(spark, sf):
    """Scalars appended in two halves, one tag read back."""
    path = scratch(spark, "scalars")
    rows = views.scalars(spark, sf)
    for half in (0, 1):
        sinks.append_scalars(rows.where(F.col("step") % 2 == half), path)
    return tables.read_scalars(spark, path, "view").select("step", "tag", "run", "value")


def _timed(spark, sf):
    return views.scalars(spark, sf).withColumn("wall_time", F.lit(1.5e9) + F.col("step"))


@query("""SELECT 'run' || (user_id % 3) AS run, event_type AS tag, event_id AS step, CAST(CAST(value AS FLOAT) AS DOUBLE) AS value,
  1.5e9::DOUBLE + event_id AS wall_time FROM events WHERE event_type = 'click'""")
def event_files(spark, sf):
    """All scalars as event files, one tag read back."""
    path = scratch(spark, "events")
    eventlog.write_event_files(_timed(spark, sf), path, rows=2000)
    return eventlog.read_event_files(spark, path, "click")


@query("""WITH s AS (SELECT user_id % 3 AS r, event_id, event_type, count(*) OVER (PARTITION BY user_id % 3) AS n,
    min(event_id) OVER (PARTITION BY user_id % 3) AS low, max(event_id) OVER (PARTITION BY user_id % 3) AS high FROM events WHERE value IS NOT NULL),
p AS (SELECT r, CAST(floor((event_id - low) * ceil(n / 2000) / (high - low + 1)) AS INTEGER) AS part FROM s),
c AS (SELECT r, part, count(*) AS n FROM p GROUP BY ALL)
SELECT 'run' || r || '.events.out.tfevents.' || lpad(CAST(part AS VARCHAR), 6, '0') AS name,
  CASE WHEN part % 2 = 0 THEN n - 1 ELSE n END AS scalars, CASE WHEN part % 2 = 0 THEN 1 ELSE 0 END::BIGINT AS damaged FROM c""")
def damaged_event_files(spark, sf):
    """Event files of which every other one has a flipped byte in its first scalar."""
    path = scratch(spark, "events")
    files = eventlog.event_contents(_timed(spark, sf), rows=2000)
    at = len(eventlog.frame(eventlog.event(0, 0.0))) + 12 + 3  # a byte of the second record's time
    flipped = F.concat(
        F.expr(f"substring(content, 1, {at})"), F.unhex(F.lpad(F.hex(255 - F.conv(F.hex(F.expr(f"substring(content, {at + 1}, 1)")), 16, 10).cast("int")), 2, "0")),
        F.expr(f"substring(content, {at + 2})"),
    )
    content = F.when(F.substring("name", -6, 6).cast("int") % 2 == 0, flipped).otherwise(F.col("content"))
    sinks.write_files(files.select(F.concat("run", F.lit("."), "name").alias("name"), content.alias("content")), path)
    return eventlog.damaged_records(spark, path)


@query("SELECT doc_id, text, lang, source, n_chars FROM documents")
def table_formats(spark, sf):
    """Partitioned Parquet to JSON lines and back."""
    first, second = scratch(spark, "formats"), scratch(spark, "formats")
    sinks.write_table(views.table(spark, sf, "documents"), first, partition_by=["lang"])
    sinks.write_table(spark.read.parquet(first), second, "json")
    return spark.read.schema("doc_id bigint, text string, lang string, source string, n_chars bigint").json(second)


# --- nested files -------------------------------------------------------------


@query("SELECT text AS instruction, lang AS input, source AS output FROM documents")
def json_array(spark, sf):
    """Files of one top-level array each, of 64 records."""
    path = scratch(spark, "arrays")
    record = F.struct(F.col("text").alias("instruction"), F.col("lang").alias("input"), F.col("source").alias("output"))
    docs = views.table(spark, sf, "documents").groupBy(F.floor(F.col("doc_id") / 64).alias("part"))
    arrays = docs.agg(F.encode(F.to_json(F.collect_list(record)), "UTF-8").alias("content"))
    sinks.write_files(arrays.select(F.concat(F.col("part").cast("string"), F.lit(".json")).alias("name"), "content"), path)
    return nested.read_json_array(spark, path, nested.QA_DUMP)


@query(f"WITH {V_VQA} SELECT question_id, image_id, question, answer AS multiple_choice_answer, answer_type FROM v_vqa")
def vqa_files(spark, sf):
    """Question and annotation documents, one file per image."""
    paths = []
    for rows, field in ((views.vqa_questions(spark, sf), "questions"), (views.vqa_annotations(spark, sf), "annotations")):
        paths.append(scratch(spark, field))
        every = rows.withColumn("_i", F.col("image_id")).groupBy("_i").agg(F.collect_list(F.struct(*rows.columns)).alias(field))
        name = F.concat(F.col("_i").cast("string"), F.lit(".json"))
        # one folder: one per file would have to be made, committed and listed each
        sinks.write_files(every.select(name.alias("name"), F.encode(F.to_json(F.struct(field)), "UTF-8").alias("content")), paths[-1])
    return corpus.vqa_join(*nested.read_vqa(spark, *paths)).select(
        "question_id", "image_id", "question", "multiple_choice_answer", "answer_type"
    )


@query("""SELECT CAST(doc_id % 64 AS BIGINT) AS ord, source || '/' || doc_id AS question_id, lang AS question, 'Yes' AS gt_ans, text AS pred_ans FROM documents""")
def answers_file(spark, sf):
    """Answers written as arrays of four-element arrays, 64 to a file, and read back."""
    path = scratch(spark, "answers")
    docs = views.table(spark, sf, "documents").select(
        F.floor(F.col("doc_id") / 64).alias("part"), F.col("doc_id").alias("ord"), F.concat_ws("/", "source", "doc_id").alias("question_id"),
        F.col("lang").alias("question"), F.lit("Yes").alias("gt_ans"), F.col("text").alias("pred_ans"),
    )
    sinks.write_answers(docs, path, part="part")
    return nested.read_answers(spark, path)


def _fine_splits(spark):
    """A session that splits files from 64 KB on, as large ones are split by any."""
    fine = spark.newSession()
    fine.conf.set("spark.sql.session.timeZone", "UTC")
    fine.conf.set("spark.sql.files.openCostInBytes", str(64 << 10))
    fine.conf.set("spark.sql.files.maxPartitionBytes", str(64 << 10))
    return fine


@query("""SELECT CAST(doc_id AS VARCHAR) AS id, 'a "quoted", [bracketed} \\ name' AS image, 'human' AS first_role, text AS first_value,
  'é, "' || lang || '"' AS second_value, CAST(2 AS INTEGER) AS turns FROM documents""")
def large_json_array(spark, sf):
    """Dumps of 4,096 nested records in one array each, whose strings hold quotes, commas and brackets, read in splits of 64 KB."""
    path = scratch(spark, "dumps")
    turn = lambda role, value: F.struct(F.lit(role).alias("from"), value.alias("value"))
    record = F.struct(
        F.col("doc_id").cast("string").alias("id"), F.lit('a "quoted", [bracketed} \\ name').alias("image"),
        F.array(turn("human", F.col("text")), turn("gpt", F.concat(F.lit('é, "'), F.col("lang"), F.lit('"')))).alias("conversations"),
    )
    docs = views.table(spark, sf, "documents").groupBy(F.floor(F.col("doc_id") / 4096).alias("part"))
    docs.agg(F.to_json(F.collect_list(record)).alias("value")).select("value").write.text(path)
    turns = F.col("conversations")
    return nested.read_json_array(_fine_splits(spark), path, nested.DUMP).select(
        "id", "image", turns[0]["from"].alias("first_role"), turns[0]["value"].alias("first_value"),
        turns[1]["value"].alias("second_value"), F.size(turns).alias("turns"),
    )


@query("""SELECT doc_id % 4096 AS ord, source || '/' || doc_id AS question_id, lang AS question, 'No, "x"' AS gt_ans, text AS pred_ans FROM documents""")
def large_answers_file(spark, sf):
    """Answers in arrays of 4,096, read in splits of 64 KB; every answer has its place in the file."""
    path = scratch(spark, "answers")
    docs = views.table(spark, sf, "documents").select(
        F.floor(F.col("doc_id") / 4096).alias("part"), F.col("doc_id").alias("ord"), F.concat_ws("/", "source", "doc_id").alias("question_id"),
        F.col("lang").alias("question"), F.lit('No, "x"').alias("gt_ans"), F.col("text").alias("pred_ans"),
    )
    sinks.write_answers(docs, path, part="part")
    return nested.read_answers(_fine_splits(spark), path)


@query("""SELECT CAST(doc_id AS VARCHAR) AS image_url, nullif(text, '') AS capsfusion FROM documents""")
def large_csv(spark, sf):
    """CSV whose fields hold line breaks, quotes and commas, read in splits of 64 KB."""
    path = scratch(spark, "captions")
    rows = views.table(spark, sf, "documents").select(
        F.col("lang").alias("more"), F.when(F.col("text") != "", F.col("text")).alias("capsfusion"), F.col("doc_id").cast("string").alias("image_url"),
    )
    sinks.write_table(rows, path, "csv")
    return tables.read_links(_fine_splits(spark), path)


# --- subsets ------------------------------------------------------------------


def _subset_root(spark, sf) -> str:
    root = scratch(spark, "subsets")
    docs = views.table(spark, sf, "documents")
    sinks.write_table(docs.select(F.col("doc_id").alias("position"), F.col("text").alias("inputs")), f"{root}/subset=texts")
    pages = views.links(spark, sf)
    sinks.write_table(pages.select(F.col("page_id").alias("position"), F.col("capsfusion").alias("outputs")), f"{root}/subset=captions")
    # a subset with a file that is no Parquet
    sinks.write_table(pages.select(F.col("page_id").alias("position")), f"{root}/subset=broken")
    spark.range(1).select(F.lit("no parquet").alias("value")).coalesce(1).write.text(f"{root}/text")
    fs = spark.sparkContext._jvm.org.apache.hadoop.fs
    source = fs.Path(f"{root}/text")
    system = source.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    part = next(f.getPath() for f in system.listStatus(source) if f.getPath().getName().startswith("part-"))
    system.rename(part, fs.Path(f"{root}/subset=broken/part-torn.parquet"))
    return root


_NAMES = ["texts", "captions", "broken", "absent"]


@query("""SELECT 'texts' AS subset, doc_id AS position, text AS inputs, NULL AS outputs FROM documents
UNION ALL SELECT 'captions', page_id, NULL, regexp_extract(html, '<title>([^<]*)</title>', 1) FROM pages
UNION ALL SELECT 'broken', page_id, NULL, NULL FROM pages""")
def read_subsets(spark, sf):
    samples, _ = subsets.read_subsets(spark, _subset_root(spark, sf), _NAMES)
    return samples.select("subset", "position", "inputs", "outputs")


@query("""SELECT 'texts' AS subset, 'loaded' AS status, CAST(0 AS BIGINT) AS unreadable
UNION ALL SELECT 'captions', 'loaded', 0 UNION ALL SELECT 'broken', 'partial', 1 UNION ALL SELECT 'absent', 'missing', 0""")
def subset_status(spark, sf):
    _, status = subsets.read_subsets(spark, _subset_root(spark, sf), _NAMES)
    return status.select("subset", "status", "unreadable")


# --- benchmark files ----------------------------------------------------------


@query(f"""WITH {V_MME},
c AS (SELECT category, row_number() OVER (PARTITION BY category ORDER BY m.doc_id) - 1 AS line, gt, pred
  FROM v_mme m),
p AS (SELECT category, line // 2 AS pair, count(*) AS questions, count(*) FILTER (WHERE gt = pred) AS correct,
        count(*) FILTER (WHERE pred = 'other') AS other FROM c GROUP BY 1, 2)
SELECT category, pair, questions, correct, other FROM p""")
def category_files(spark, sf):
    """Answer files per category, in order; neighbouring lines make a pair."""
    path = scratch(spark, "mme")
    rows = views.mme_answers(spark, sf).withColumns(
        {"img_name": F.concat(F.col("doc_id").cast("string"), F.lit(".jpg")), "question": F.lit("Is it?")}
    )
    sinks.write_mme_dir(rows, path, order="doc_id")
    lines = sinks.number_lines(sinks.read_mme_dir(spark, path))
    pairs = scoring.mme_pairs(scoring.judge(lines), F.floor(F.col("line") / 2), strict=False)
    return pairs.select("category", "pair", "questions", "correct", "other")


# --- requests and responses ---------------------------------------------------


@query(f"""WITH {V_VQA} SELECT CAST(question_id AS VARCHAR) AS custom_id, question_id // 1000000007 % 7 AS batch FROM v_vqa""")
def request_files(spark, sf):
    """Request lines, one folder per batch."""
    path = scratch(spark, "requests")
    vqa = corpus.vqa_join(views.vqa_questions(spark, sf), views.vqa_annotations(spark, sf))
    requests = augment.llm_requests(vqa, "question_id").withColumn("batch", F.expr("cast(custom_id as bigint) div 1000000007 % 7"))
    sinks.write_llm_requests(requests, path)
    return spark.read.text(path).select(F.get_json_object("value", "$.custom_id").alias("custom_id"), F.col("batch").cast("bigint").alias("batch"))


@query("""SELECT CAST(conv_id AS VARCHAR) AS custom_id, arg_max(text, turn) AS answer FROM conversations WHERE role = 'assistant' GROUP BY conv_id""")
def response_files(spark, sf):
    """Response lines in the order of turns; the last line of an id wins."""
    path = scratch(spark, "responses")
    lines = views.repeated_response_lines(spark, sf)
    lines.repartitionByRange(8, "ord").sortWithinPartitions("ord").select("value").write.text(path)
    return augment.parse_llm_responses(nested.read_llm_responses(spark, path), order="ord")


# --- images -------------------------------------------------------------------


@query("""SELECT CAST(doc_id AS VARCHAR) AS identifier, CAST(n_chars AS INTEGER) AS width, 1 AS height, md5(text) AS digest, CAST(strlen(text) + 1 AS INTEGER) AS n_encoded FROM documents""")
def image_rows(spark, sf):
    """Processed images with a stand-in encoder that adds one byte."""
    path = scratch(spark, "images")
    rows = views.table(spark, sf, "documents").select(
        F.col("doc_id").cast("string").alias("identifier"), F.col("n_chars").cast("int").alias("width"),
        F.lit(1).alias("height"), F.encode("text", "UTF-8").alias("data"),
    )
    sinks.write_images(rows, path, lambda data, width, height: data + b"\0")
    return spark.read.parquet(path).select(
        "identifier", "width", "height", F.md5("data").alias("digest"), F.octet_length("encoded").alias("n_encoded")
    )


_BROKEN = "('0x' || substr(md5(url || 'b'), 1, 8))::BIGINT / 4294967296.0::DOUBLE"


@query(f"""SELECT page_id, CAST(('0x' || substr(md5(url), 1, 4))::INTEGER % 24 + 1 AS INTEGER) AS width,
  CAST(('0x' || substr(md5(url), 5, 4))::INTEGER % 24 + 1 AS INTEGER) AS height, {_BROKEN} >= 0.9 AS other_name
FROM pages WHERE {_BROKEN} >= 0.3""")
def decoded_files(spark, sf):
    """Image files of every page: some cut off, some no images, some named after another format.  What decodes is kept."""
    path = scratch(spark, "files")
    url, digest = F.col("url"), F.md5("url")
    side = lambda at: F.conv(F.substring(digest, at, 4), 16, 10).cast("int") % 24 + 1
    draw = F.conv(F.substring(F.md5(F.concat(url, F.lit("b"))), 1, 8), 16, 10).cast("bigint") / F.lit(4294967296.0)
    drawn = views.table(spark, sf, "pages").select(
        "page_id", F.concat(F.lit("p"), F.col("page_id").cast("string")).alias("identifier"), side(1).alias("width"), side(5).alias("height"),
        F.repeat(F.sha2(url, 512), 30).cast("binary").alias("pixels"), draw.alias("draw"),
    )
    encoded = drawn.select("page_id", "identifier", "draw", png.encoded("pixels", "width", "height").alias("png"))
    content = F.when(F.col("draw") < 0.2, F.substring("png", 1, 45)).when(
        F.col("draw") < 0.3, F.lit("no image").cast("binary")
    ).otherwise(F.col("png"))
    name = F.concat("identifier", F.when(F.col("draw") >= 0.9, F.lit(".jpg")).otherwise(F.lit(".png")))
    sinks.write_files(encoded.select(name.alias("name"), content.alias("content")), path)
    # sizes of what decodes, and those of the headers, which cut files have too
    decoded = images.image_size(spark, path).select(F.element_at(F.split("path", "/"), -1).alias("name"), "width", "height")
    # read by two joins, which look at its size first
    decoded = materialize(decoded, "decoded")
    headers = images.probe_sizes(images.scan_images(spark, path)).select("name", "original_width", "original_height")
    samples = encoded.select("page_id", name.alias("name"))
    kept = corpus.keep_valid_images(samples, decoded, "name")
    both = kept.join(decoded, "name").join(headers, "name")
    return both.where("width = original_width and height = original_height").select(
        "page_id", "width", "height", F.endswith("name", F.lit(".jpg")).alias("other_name")
    )


def _stub_fetch(url: str) -> bytes:
    """A PNG header with sizes from the url, or a failure for about a fifth of them."""
    import hashlib
    import struct

    digest = hashlib.md5(url.encode()).hexdigest()
    if int(digest[:8], 16) / 2**32 < 0.2:
        raise OSError("404 Client Error: Not Found for url")
    size = [int(digest[i : i + 4], 16) % 1500 + 64 for i in (0, 4)]
    return bytes.fromhex("89504E470D0A1A0A0000000D49484452") + struct.pack(">II", *size)


_FAILS = "('0x' || substr(md5(image_url), 1, 8))::BIGINT / 4294967296.0::DOUBLE < 0.2"


@query(f"""WITH {V_LINKS} SELECT DISTINCT md5(image_url) AS identifier, image_url, NOT {_FAILS} AS ok,
  CASE WHEN {_FAILS} THEN '404 Client Error: Not Found for url' END AS error,
  CASE WHEN {_FAILS} THEN 0 ELSE 24 END AS n_bytes FROM v_links""")
def fetch_images(spark, sf):
    identified = corpus.assign_identifier(views.links(spark, sf))
    out = images.fetch_in_chunks(identified, scratch(spark, "fetched"), _stub_fetch, chunk=200, per_host=4)
    return out.select("identifier", "image_url", "ok", "error", F.coalesce(F.octet_length("content"), F.lit(0)).alias("n_bytes"))


@query(f"""WITH {V_LINKS} SELECT image_url, capsfusion, md5(image_url) AS identifier, w AS original_width, h AS original_height
FROM v_links WHERE NOT {_FAILS}""")
def caption_corpus(spark, sf):
    """The whole caption flow, with the stub fetch; nothing was done before."""
    return flows.caption_corpus(views.links(spark, sf).select("image_url", "capsfusion"), fetch=_stub_fetch).metadata


@query(f"""WITH {V_FETCH} SELECT count(*) FILTER (WHERE ok IS NOT TRUE) AS failed,
  (SELECT count(*) FROM v_fetch WHERE ok IS NOT TRUE) AS listed FROM v_fetch""")
def failures_agree(spark, sf):
    """Report and failure table count the same outcomes, unrecorded ones included."""
    outcomes = views.fetches(spark, sf).withColumn("image_url", F.col("identifier"))
    listed = ingest.failures(outcomes).agg(F.count(F.lit(1)).alias("listed")).scalar()
    return ingest.download_report(outcomes, 1.0).select("failed", listed.alias("listed"))
