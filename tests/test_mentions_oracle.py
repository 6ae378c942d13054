"""The mention rules in Spark and in the oracle SQL agree on clause splits and
negation (the stand-in texts have neither, so this covers them directly)."""

import pytest
from pyspark.sql import functions as F

from guestlens.operators import aspects as asp
from guestlens.plans import oracle as o
from guestlens.sources import standins as st

ROWS = [(1, 1, 2.0, "not new anvil. old bolt"), (1, 2, 4.0, "wasn't old bolt, never cold gear but hot ring"),
        (2, 3, 3.0, "no red rod; not large plate not small plate"), (2, 4, 1.0, "new anvil not"),
        (2, 5, 5.0, "Hot GIZMO!! new rod\nold rod"), (3, 6, 0.0, "")]


def test_mentions_sql_equals_spark(spark):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    con.execute("CREATE TABLE t(data_id BIGINT, fetch_pos BIGINT, rating DOUBLE, review_text VARCHAR, ts TIMESTAMP)")
    con.executemany("INSERT INTO t VALUES (?, ?, ?, ?, NULL)", ROWS)
    q = o.with_(o.LEXICON, o.POLARITY, o.mentions_cte("t"),
                body="SELECT fetch_pos, term, aspect, polarity, phrase FROM mentions")
    df = spark.createDataFrame(ROWS, "data_id long, review_id long, rating double, review_text string") \
        .withColumn("ts", F.lit(None).cast("timestamp_ntz"))
    got = sorted((r.review_id, r.term, r.aspect, r.polarity, r.phrase)
                 for r in asp.mentions(df, st.TEST_LEXICON, st.TEST_POLARITY).collect())
    assert got == sorted(con.execute(q).fetchall())
    assert len(got) == 11
