"""The registered queries: their SQL, and brute force over a whole small table."""

import os
import sys

import pytest

HERE = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(HERE)), "tools"))

import check_oracle  # noqa: E402

from pixquill.llm import queries  # noqa: E402

SMALL = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_equals_sql(spark, name):
    got = queries.QUERIES[name](spark, SMALL).toPandas()
    want = check_oracle.connect(SMALL).execute(queries.SQL[name]).df()
    assert check_oracle.compare(got, want) == "" and len(got) > 0


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.SQL)))
def test_one_row_per_input_row(spark, name):
    got = queries.QUERIES[name](spark, SMALL)
    source = {"op6_warc_bundles": "pages", "op11_embedding_whitening": "embeddings"}.get(name, "documents")
    rows = spark.read.parquet(f"{SMALL}/{source}.parquet").count()
    first = {"op1_best_fit_packing": "piece = 0", "op11_embedding_whitening": "component = 1"}
    n = got.where(first.get(name, "true")).count()
    assert n == rows


def test_native_queries_stay_out_of_python(spark):
    for name in queries.QUERIES:
        if name.startswith(("op3_", "op4_", "op5_", "op8_")):
            plan = queries.QUERIES[name](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
            assert not any(node in plan for node in ("Python", "Pandas", "ArrowEval", "MapInArrow"))
