"""Registered queries on small tables with odd rows, against their SQL."""

import os
import sys

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))

import check_oracle  # noqa: E402

import __spark_entry__ as entry  # noqa: E402


def compared(spark, folder, name, **tables):
    """What differs between a query and its SQL on the given tables."""
    con = duckdb.connect()
    for table, rows in tables.items():
        pq.write_table(rows, f"{folder}/{table}.parquet")
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet'")
    got = entry.queries()[name](spark, folder).toPandas()
    return check_oracle.compare(got, con.execute(entry.oracle_sql()[name]).df())


def documents(texts):
    n = len(texts)
    return pa.table({
        "doc_id": pa.array(range(n), pa.int64()), "text": pa.array(texts, pa.string()), "lang": ["en"] * n, "source": ["s"] * n,
        "n_chars": pa.array([len(t or "") for t in texts], pa.int64()),
    })


def test_short_and_missing_texts_as_answers(spark, path):
    texts = ["", None, "a", "b\n\nc\n", 'x" [y], \\ ' * 9] * 60
    assert compared(spark, path, "answers_json", documents=documents(texts)) == ""


def test_pages_that_share_a_link_keep_their_identifiers(spark, path):
    n = 60
    pages = pa.table({
        "page_id": pa.array(range(n), pa.int64()), "url": [f"http://h/{i % 20}" for i in range(n)], "html": ["<title>t</title>"] * n,
    })
    for name in ("assign_identifier", "identifier_left_join", "resume_anti_join"):
        folder = f"{path}/{name}"
        os.makedirs(folder)
        assert compared(spark, folder, name, pages=pages) == ""


def test_grey_levels_are_of_single_precision(spark, path):
    x = np.random.default_rng(1).uniform(-1, 1, 4_000_000).astype(np.float32)
    single, double = (np.floor((x.astype(t) + t(1)).astype(np.float64) * 127.5) for t in (np.float32, np.float64))
    odd = x[single != double][:4]
    assert len(odd)
    rows = np.tile(np.resize(odd, 64), (20, 1))
    embeddings = pa.table({
        "vec_id": pa.array(range(20), pa.int64()), "embedding": pa.array(list(rows), pa.list_(pa.float32())), "label": pa.array([0] * 20, pa.int32()),
    })
    for name in ("resample_images", "resample_transforms"):
        folder = f"{path}/{name}"
        os.makedirs(folder)
        assert compared(spark, folder, name, embeddings=embeddings) == ""
