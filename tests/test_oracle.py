"""Every registered query against its SQL."""

import os
import sys

import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))

import check_oracle  # noqa: E402
from pixquill.plans import roundtrips  # noqa: E402
from pixquill.plans.catalog import QUERIES  # noqa: E402

import __spark_entry__ as entry  # noqa: E402
from conftest import SMALL  # noqa: E402


WITHOUT_SQL: set[str] = set()
NAMES = sorted(QUERIES | roundtrips.QUERIES)


@pytest.fixture(scope="module")
def con():
    return check_oracle.connect(SMALL)


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, con, name):
    got = entry.queries()[name](spark, SMALL).toPandas()
    if name in WITHOUT_SQL:
        assert name not in entry.oracle_sql() and len(got) > 0
        return
    want = con.execute(entry.oracle_sql()[name]).df()
    assert check_oracle.compare(got, want) == ""
    assert len(got) > 0


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["sample_id", "split", "text"]
    assert df.count() > 0
