"""W1-W3, W5, O1 on hand fixtures."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from guestlens.operators import select as sel
from guestlens.operators.ordering import running_total


def reviews(spark, rows):
    """rows: (data_id, fetch_pos, ts)"""
    df = spark.createDataFrame(rows, "data_id long, fetch_pos long, ts timestamp_ntz")
    return df.withColumn("page_no", F.floor((F.col("fetch_pos") - 1) / 10).cast("long"))


def test_sample_sort_order(spark):
    # Four samples: expected descending order Charlie, Alice, Diana, Bob.
    rows = [(1, 1, dt.datetime(2024, 8, 3, 15, 53)),    # Alice
            (1, 2, dt.datetime(2024, 1, 13, 9, 12)),    # Bob
            (1, 3, dt.datetime(2024, 8, 12, 18, 30)),   # Charlie
            (1, 4, dt.datetime(2024, 3, 25, 11, 0))]    # Diana
    out = sel.reviews_by_date(reviews(spark, rows)).orderBy("rank_desc").collect()
    assert [r.fetch_pos for r in out] == [3, 1, 4, 2]


def test_same_minute_ties_keep_fetch_order(spark):
    # seconds run against fetch order; minute resolution makes them ties
    rows = [(1, 1, dt.datetime(2024, 9, 1, 10, 49, 50)), (1, 2, dt.datetime(2024, 9, 1, 10, 49, 30)),
            (1, 3, dt.datetime(2024, 9, 1, 10, 49, 10)), (1, 4, dt.datetime(2024, 9, 2, 8, 0))]
    out = {r.fetch_pos: r for r in sel.reviews_by_date(reviews(spark, rows)).collect()}
    assert [out[i].rank_asc for i in (1, 2, 3, 4)] == [1, 2, 3, 4]
    assert [out[i].rank_desc for i in (4, 1, 2, 3)] == [1, 2, 3, 4]


def test_instant_select_first_n_in_fetch_order(spark):
    rows = [(1, i, dt.datetime(2024, 1, 30 - i)) for i in range(1, 26)]
    out = sel.instant_select(reviews(spark, rows), 20).collect()
    assert sorted(r.fetch_pos for r in out) == list(range(1, 21))
    by_rank = sorted(out, key=lambda r: r.date_rank)
    assert by_rank[0].fetch_pos == 20   # oldest of the chosen first


def pages_df(spark, rows):
    return spark.createDataFrame(rows, "data_id long, page_no long, n_reviews long, has_next boolean")


def test_page_cap_keeps_crossing_page(spark):
    # 7 pages of 10, cap 25 -> pages 0-2 kept (30 reviews, overshoot allowed)
    p = pages_df(spark, [(1, i, 10, i < 6) for i in range(7)])
    assert sorted(r.page_no for r in sel.full_page_cap(p, 25).collect()) == [0, 1, 2]


def test_page_cap_stops_without_next(spark):
    p = pages_df(spark, [(1, 0, 10, True), (1, 1, 10, False), (1, 2, 10, True), (1, 3, 10, False)])
    assert sorted(r.page_no for r in sel.full_page_cap(p, 100).collect()) == [0, 1]


def test_page_cap_empty_pages_do_not_count(spark):
    p = pages_df(spark, [(1, 0, 10, True), (1, 1, 0, True), (1, 2, 10, True), (1, 3, 10, False)])
    assert sorted(r.page_no for r in sel.full_page_cap(p, 15).collect()) == [0, 1, 2]


def test_batches(spark):
    rows = [(1, i, dt.datetime(2024, 1, 1) + dt.timedelta(hours=i)) for i in range(1, 34)]
    b = sel.chronological_batches(reviews(spark, rows), 15).collect()
    sizes = {}
    for r in b:
        sizes[r.batch_id] = sizes.get(r.batch_id, 0) + 1
    assert sizes == {0: 15, 1: 15, 2: 3}
    with pytest.raises(ValueError):
        sel.chronological_batches(reviews(spark, rows), 0)


def test_display_split(spark):
    rows = [(1, i, dt.datetime(2024, 1, 1) + dt.timedelta(days=i)) for i in range(1, 14)]
    out = sel.review_display_split(reviews(spark, rows)).collect()
    shown = sorted(r.fetch_pos for r in out if r.shown)
    assert shown == list(range(4, 14)) and len(out) == 13


def test_running_total_matches_window_on_skewed_data(spark):
    # one hot group with most rows, many small ones, a null group key
    rows = [(0, i, i % 7) for i in range(3000)] + [(g, i, 1) for g in range(1, 200) for i in range(3)] \
        + [(None, 1, 5), (None, 2, 6)]
    df = spark.createDataFrame(rows, "g long, o long, w long").repartition(7)
    span = F.floor(F.col("o") / 50)
    got = running_total(df, ["g"], ["o"], "rt", span, weight="w", whole="all").collect()
    exp = {}
    acc = {}
    for g, o, w in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1])):
        acc[g] = acc.get(g, 0) + w
        exp[(g, o)] = acc[g]
    assert len(got) == len(rows)
    assert all(exp[(r.g, r.o)] == r.rt for r in got)
    assert all(acc[r.g] == r.all for r in got)
    excl = running_total(df, ["g"], ["o"], "rt", span, weight="w", inclusive=False).collect()
    assert all(exp[(r.g, r.o)] - r.w == r.rt for r in excl)


def test_partition_settings():
    from guestlens.session import partition_settings
    small = partition_settings(10 * 2**20, cores=8)
    assert small["spark.sql.shuffle.partitions"] == "16"
    big = partition_settings(100 * 10**12, cores=16000)
    assert big["spark.sql.shuffle.partitions"] == "100000"
    assert int(big["spark.sql.files.maxPartitionBytes"]) <= 1024 * 2**20


def test_hot_place_has_plain_ranks(spark):
    # place 0 holds ~90 % of the rows; many same-minute ties, several days
    base = dt.datetime(2024, 1, 1)
    rows = [(0, i, base + dt.timedelta(seconds=701 * (i % 400))) for i in range(1, 1801)] + \
           [(g, i, base + dt.timedelta(minutes=i)) for g in range(1, 21) for i in range(1, 11)]
    df = reviews(spark, rows).repartition(5)
    minute = lambda r: r[2].replace(second=0)
    asc, desc = {}, {}
    for g in range(21):
        own = [r for r in rows if r[0] == g]
        asc.update({r[:2]: i for i, r in enumerate(sorted(own, key=lambda r: (minute(r), r[1])), 1)})
        desc.update({r[:2]: i for i, r in enumerate(sorted(own, key=lambda r: (-minute(r).timestamp(), r[1])), 1)})
    got = {(r.data_id, r.fetch_pos): (r.date_pos, r.batch_id) for r in sel.chronological_batches(df, 15).collect()}
    assert got == {k: (v, (v - 1) // 15) for k, v in asc.items()}
    ranks = {(r.data_id, r.fetch_pos): (r.rank_asc, r.rank_desc) for r in sel.reviews_by_date(df).collect()}
    assert ranks == {k: (asc[k], desc[k]) for k in asc}


def test_empty_page_does_not_cut_a_place(spark):
    rows = spark.createDataFrame([(1, 0), (1, 0), (1, 2)], "data_id long, page_no long")
    kept = sel.full_page_cap(sel.page_counts(rows), 150).collect()
    assert sum(r.n_reviews for r in kept) == 3
    landed = spark.createDataFrame([(1, 0, [1, 2], ("u",)), (1, 1, [], ("u",)), (1, 2, [3], None), (1, None, [4], None)],
                                   "data_id long, page_no long, reviews array<int>, serpapi_pagination struct<next:string>")
    assert sorted((r.page_no, r.n_reviews) for r in sel.full_page_cap(sel.landed_page_counts(landed), 150).collect()) == [(0, 2), (1, 0), (2, 1)]
