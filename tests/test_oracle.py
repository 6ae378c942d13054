"""Every registered query against its DuckDB oracle on the smallest data set
(the driver runs the same check at sf0.01)."""

import os
import sys

import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))

import __spark_entry__ as E  # noqa: E402
from guestlens.plans.registry import QUERIES  # noqa: E402
from oracle_check import TABLES, digest, duck_types, spark_types  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


@pytest.mark.skipif(not os.path.isdir(SF), reason="test data not present")
@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_oracle(spark, duck, name):
    df = E.queries()[name](spark, SF)
    rows = [tuple(r) for r in df.collect()]
    sql = E.oracle_sql().get(name)
    if sql is None:
        assert df.columns and rows is not None
        return
    rel = duck.sql(sql)
    assert spark_types(df) == duck_types(rel)
    sc, sl, sh = digest(df.columns, rows)
    oc, ol, oh = digest(list(rel.columns), rel.fetchall())
    assert sc == oc
    assert len(sl) == len(ol)
    assert sh == oh, (sorted(set(sl) - set(ol))[:3], sorted(set(ol) - set(sl))[:3])


def test_entry(spark):
    df = E.entry(spark)
    assert df.count() > 0 and "average_score" in df.columns
