"""A1-A10, A3, W4 on hand fixtures and invariants."""

import datetime as dt

from pyspark.sql import functions as F

from guestlens.operators import aspects as asp
from guestlens.operators import combine as cmb
from guestlens.operators import select as sel
from guestlens.operators import sentiment as sen

# Ratings of the reference's 31-review sample result (fixed values).
SAMPLE_RATINGS = [5.0] * 5 + [2.0, 1.0, 1.0, 1.0, 1.0] + [5.0] * 17 + [3.0, 5.0, 5.0, 5.0]


def test_sample_sentiment(spark):
    df = spark.createDataFrame([(1, r) for r in SAMPLE_RATINGS], "data_id long, rating double")
    r = sen.overall_sentiment(df).collect()[0]
    assert r.n_reviews == 31
    assert (r.average_score, r.positive_percentage, r.neutral_percentage, r.negative_percentage) == \
        (4.3, 80.6, 3.2, 16.1)


def test_unrated_and_fractional(spark):
    df = spark.createDataFrame([(1, 0.0), (1, 0.0), (2, 2.5), (2, 3.0), (2, 3.5), (2, 4.0)],
                               "data_id long, rating double")
    r = {x.data_id: x for x in sen.overall_sentiment(df).collect()}
    assert r[1].average_score is None and r[1].n_unrated == 2 and r[1].positive_percentage is None
    assert (r[2].average_score, r[2].positive_percentage, r[2].neutral_percentage,
            r[2].negative_percentage) == (3.3, 25.0, 50.0, 25.0)


def batch_rows(spark, counts):
    rows = []
    for place, n in enumerate(counts):
        for b in range(n):
            rows.append((place, b, 1, 1, 4.0, 1, 0, 0, dt.datetime(2024, 1, 1) + dt.timedelta(days=b),
                         dt.datetime(2024, 1, 1) + dt.timedelta(days=b, hours=1)))
    return spark.createDataFrame(rows, "data_id long, batch_id long, n_reviews long, n_rated long, "
                                       "sum_rating double, n_positive long, n_neutral long, n_negative long, "
                                       "first_ts timestamp_ntz, last_ts timestamp_ntz")


def test_tree_levels(spark):
    # 1, 7, 8, 70, 71 batches with fan-in 7 then 10 -> 0, 1, 2, 2, 3 combine levels
    t = cmb.tree_combine(batch_rows(spark, [1, 7, 8, 70, 71]), 7)
    levels = {r.data_id: r.l for r in t.groupBy("data_id").agg(F.max("level").alias("l")).collect()}
    assert levels == {1: 1, 2: 2, 3: 2, 4: 3}
    roots = t.filter("is_root").collect()
    assert len(roots) == 4 and all(r.n_batches == [1, 7, 8, 70, 71][r.data_id] for r in roots)
    assert all(r.n_reviews == r.n_batches for r in roots)   # root == flat aggregate
    # level-1 nodes of the 8-batch place: 7 + 1 (the single one passes through)
    l1 = t.filter("data_id = 2 AND level = 1").orderBy("node").collect()
    assert [(r.n_children, r.combined) for r in l1] == [(7, True), (1, False)]


def test_fan_in_guard():
    import pytest
    assert [cmb.fan_in_for(b) for b in (2, 3, 15, 30)] == [1, 1, 7, 15]
    with pytest.raises(ValueError):
        cmb.fan_in_for(1)


def test_tree_with_other_fan_ins(spark):
    for fan_in, levels in ((1, {1: 2, 2: 3}), (15, {1: 1, 2: 2})):
        t = cmb.tree_combine(batch_rows(spark, [1, 10, 30]), fan_in)
        assert {r.data_id: r.l for r in t.groupBy("data_id").agg(F.max("level").alias("l")).collect()} == levels
        roots = t.filter("is_root").collect()
        assert sorted(r.n_batches for r in roots) == [10, 30] and all(r.n_reviews == r.n_batches for r in roots)
    passed = cmb.tree_combine(batch_rows(spark, [0, 10]), 1).filter("level = 1").collect()
    assert len(passed) == 10 and not any(r.combined for r in passed)


def test_recency_weights(spark):
    b = batch_rows(spark, [3]).withColumn("sum_rating", F.col("batch_id").cast("double") + 1) \
        .withColumn("n_positive", F.lit(0).cast("long")).withColumn("n_negative", F.lit(1).cast("long"))
    # A4 over state rows: avg = (1*1 + 2*2 + 3*3) / (1 + 2 + 3) = 14/6 = 2.3
    w = b.groupBy("data_id").agg(*sen.merge_aggs(F.col("batch_id") + 1))
    assert sen.scores(w).collect()[0].average_score == 2.3


def test_period_trend(spark):
    b = batch_rows(spark, [3]).withColumn(
        "sum_rating", F.when(F.col("batch_id") == 1, 4.6).when(F.col("batch_id") == 2, 4.4).otherwise(4.0))
    t = {r.batch_id: r.trend for r in cmb.period_trend(b).collect()}
    assert t == {0: "first", 1: "improving", 2: "stable"}


LEX = [("room", "accommodation"), ("staff", "service"), ("breakfast", "food_and_dining")]
POL = [("clean", 1), ("dirty", -1), ("rude", -1), ("friendly", 1)]


def test_mentions_and_priorities(spark):
    rows = [(1, 1, 2.0, "Dirty room! Rude staff."), (1, 2, 4.0, "Clean room. Friendly staff"),
            (1, 3, 1.0, "dirty room"), (1, 4, 5.0, "")]
    df = spark.createDataFrame(rows, "data_id long, review_id long, rating double, review_text string") \
        .withColumn("ts", F.lit(None).cast("timestamp_ntz"))
    m = asp.mentions(df, LEX, POL)
    got = sorted((r.review_id, r.term, r.polarity, r.phrase) for r in m.collect())
    assert got == [(1, "room", "criticism", "dirty room"), (1, "staff", "criticism", "rude staff"),
                   (2, "room", "praise", "clean room"), (2, "staff", "praise", "friendly staff"),
                   (3, "room", "criticism", "dirty room")]
    p = asp.improvement_priorities(m).orderBy("priority").collect()
    # accommodation: (5-2)+(5-1)=7 ; service: 3
    assert [(r.category, r.score, r.issue) for r in p] == [("Accommodation", 7.0, "dirty room"),
                                                            ("Service", 3.0, "rude staff")]
    fb = {(r.aspect, r.polarity): r for r in asp.aspect_feedback(m).collect()}
    assert fb[("accommodation", "criticism")].n_reviews == 2
    assert fb[("accommodation", "criticism")].top_phrases == "dirty room"


def test_aspect_trend(spark):
    rows = [(1, 1, 0, "accommodation", 1), (1, 2, 0, "accommodation", 1), (1, 3, 1, "accommodation", -1),
            (1, 4, 2, "accommodation", -1), (1, 5, 2, "accommodation", 1)]
    m = spark.createDataFrame(rows, "data_id long, review_id long, batch_id long, aspect string, pol int").withColumn("first_aspect", F.lit(1)) \
        .union(spark.createDataFrame([(1, 5, 2, "accommodation", 1, 0)], "a long, b long, c long, d string, e int, f int"))
    t = {r.batch_id: (r.net, r.trend) for r in cmb.aspect_trend(m).collect()}
    assert t == {0: (2, "first"), 1: (-1, "declining"), 2: (0, "improving")}


def test_hotel_vocabulary_clauses(spark):
    from guestlens.operators.vocabulary import HOTEL_LEXICON, HOTEL_POLARITY
    rows = [(1, 1, 4.0, "The room was clean but the staff were rude."),
            (1, 2, 2.0, "Breakfast was cold; overpriced for the price, great location!"),
            (1, 3, 5.0, "Very nice property good for family stay")]
    df = spark.createDataFrame(rows, "data_id long, review_id long, rating double, review_text string") \
        .withColumn("ts", F.lit(None).cast("timestamp_ntz"))
    got = sorted((r.review_id, r.aspect, r.polarity, r.phrase)
                 for r in asp.mentions(df, HOTEL_LEXICON, HOTEL_POLARITY).collect())
    assert got == [(1, "accommodation", "praise", "clean room"), (1, "service", "criticism", "rude staff"),
                   (2, "food_and_dining", "criticism", "cold breakfast"),
                   (2, "location_and_accessibility", "praise", "great location"),
                   (2, "value_for_money", "criticism", "overpriced price")]


def test_negation(spark):
    from guestlens.operators.vocabulary import HOTEL_LEXICON, HOTEL_POLARITY
    rows = [(1, 1, 2.0, "The room was not clean"), (1, 2, 4.0, "staff wasn't rude, never slow service"),
            (1, 3, 3.0, "not good not bad food")]
    df = spark.createDataFrame(rows, "data_id long, review_id long, rating double, review_text string") \
        .withColumn("ts", F.lit(None).cast("timestamp_ntz"))
    got = sorted((r.review_id, r.term, r.polarity, r.phrase)
                 for r in asp.mentions(df, HOTEL_LEXICON, HOTEL_POLARITY).collect())
    assert got == [(1, "room", "criticism", "not clean room"), (2, "service", "praise", "not slow service"),
                   (2, "staff", "praise", "not rude staff"), (3, "food", "neutral", "not bad not good food")]


def test_mentions_of_a_very_long_review(spark):
    """Merging is by sorting: 200,000 words are as exact as 2,000."""
    from guestlens.operators.aspects import mention_counts, mentions
    from guestlens.sources import standins as st
    words = [f"{('new', 'old', 'hot', 'cold')[i % 4]} {('anvil', 'bolt', 'rod')[i % 3]}" for i in range(12)]

    def counts(times):
        df = spark.createDataFrame([(1, 1, 3.0, ", ".join(words * times))], "data_id long, review_id long, rating double, review_text string")
        m = mention_counts(mentions(df.withColumn("ts", F.lit(None).cast("timestamp_ntz")), st.TEST_LEXICON, st.TEST_POLARITY))
        return {(r.aspect, r.pol, r.phrase): (r.n_mentions, r.support) for r in m.collect()}, m.groupBy("aspect", "pol").agg(F.sum("by_aspect"), F.sum("by_term")).collect()
    few, _ = counts(1)
    many, flags = counts(8000)
    assert many == {k: (8000 * n, s) for k, (n, s) in few.items()} and len(many) == 12
    assert all(r[2] == r[3] == 1 for r in flags) and len(flags) == 6
