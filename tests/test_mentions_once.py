"""Findings F10, F12 of round 3: mentions are found once."""

from guestlens.operators import aspects as asp
from guestlens.sources import standins as st

REVIEWS = "data_id long, review_id long, rating double, ts timestamp_ntz, review_text string"


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_mentions_are_worked_out_once(spark):
    """F10, and what else reads mentions: no filter that repeats the extraction below it."""
    r = spark.createDataFrame([], REVIEWS)
    p = plan_of(asp.mentions(r, st.TEST_LEXICON, st.TEST_POLARITY))
    assert p.count("split(") == 1 and "Filter" not in p


def test_mentions_of_reviews_without_any(spark):
    r = spark.createDataFrame([(1, 1, 5.0, None, "new bolt, old bolt. new bolt"), (1, 2, 5.0, None, "nothing here"), (1, 3, 5.0, None, ""), (1, 4, 5.0, None, None)], REVIEWS)
    got = asp.mentions(r, st.TEST_LEXICON, st.TEST_POLARITY).select("review_id", "phrase", "n", "first_aspect", "first_term").collect()
    assert sorted(map(tuple, got)) == [(1, "new bolt", 2, 1, 1), (1, "old bolt", 1, 1, 1)]


def test_net_support_is_written_once(spark):
    from guestlens.operators.combine import aspect_trend
    m = spark.createDataFrame([(1, "service", 1, 0, 1), (1, "service", -1, 1, 1)], "data_id long, aspect string, pol int, batch_id long, first_aspect long")
    written = []

    def reuse(df, name):
        written.append(name)
        return spark.createDataFrame(df.collect(), df.schema)
    out = sorted(tuple(r)[2:] for r in aspect_trend(m, reuse=reuse).collect())
    assert written == ["net-support"] and out == [(0, 1, None, "first"), (1, -1, 1, "declining")]


def test_criticism_is_written_once(spark, tmp_path):
    from guestlens.streaming.incremental import IncrementalPriorities
    r = spark.createDataFrame([(1, 1, 2.0, None, "old bolt. small gear")], REVIEWS)
    parts = IncrementalPriorities(spark, str(tmp_path), st.TEST_LEXICON, st.TEST_POLARITY)._deltas(r)
    assert all("split(" not in plan_of(p) for p in parts)
