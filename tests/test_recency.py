"""Incremental recency-weighted scores equal A4 over all reviews, however they arrive."""

import datetime as dt
import json
import random

import pytest

from guestlens.operators import sentiment as sen
from guestlens.operators.ingest import normalize_reviews
from guestlens.operators.select import chronological_batches
from guestlens.session import work_path
from guestlens.sources.pages import scan_pages
from guestlens.streaming.recency import IncrementalRecency

SCHEMA = "data_id long, ts timestamp_ntz, fetch_pos long, rating double"
T0 = dt.datetime(2024, 1, 30)


def some_reviews(n, seed):
    rng = random.Random(seed)
    return [(rng.choice([1, 1, 1, 2, 3]), T0 + dt.timedelta(days=rng.randrange(6), minutes=rng.randrange(3)), i, float(rng.choice([0, 1, 2, 2.5, 3, 4, 5])))
            for i in range(n)]


def rows_of(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.mark.parametrize("size", [2, 7])
def test_epochs_out_of_order(spark, size):
    rows = some_reviews(150, size)
    inc = IncrementalRecency(spark, work_path(spark, "test-recency"), size)
    for tag in (2, 0, 1, 0):
        part = spark.createDataFrame([r for r in rows if r[2] % 3 == tag], SCHEMA)
        assert inc.apply(part, tag=str(tag)) == (not (tag == 0 and len(inc.table.versions()) == 3))
        seen = {int(t) for t in inc.table.tags()}
        whole = spark.createDataFrame([r for r in rows if r[2] % 3 in seen], SCHEMA)
        assert rows_of(inc.scores()) == rows_of(sen.recency_weighted_sentiment(chronological_batches(whole, size)))


def test_one_late_review_moves_all_later_ones(spark):
    inc = IncrementalRecency(spark, work_path(spark, "test-late"), 2)
    days = [(1, T0 + dt.timedelta(days=i), i, r) for i, r in enumerate([5.0, 1.0, 5.0, 1.0])]
    inc.apply(spark.createDataFrame(days, SCHEMA))
    assert rows_of(inc.scores().select("average_score")) == [(3.0,)]            # (5 + 1 + 2 * 5 + 2 * 1) / 6
    inc.apply(spark.createDataFrame([(1, T0 - dt.timedelta(days=9), 9, 5.0)], SCHEMA))
    assert rows_of(inc.scores().select("n_batches", "average_score")) == [(3, 2.8)]   # (5 + 5 + 2 * 1 + 2 * 5 + 3 * 1) / 9
    rows = inc.table.read(1, "days").select("data_id", "day").distinct().count()
    assert rows == 1                                                            # only the late review's own day was made anew


def test_only_touched_months_are_opened(spark, capsys):
    inc = IncrementalRecency(spark, work_path(spark, "test-months"), 2)
    inc.apply(spark.createDataFrame([(1, T0 + dt.timedelta(days=20 * i), i, 4.0) for i in range(6)], SCHEMA))
    import pyspark.sql.functions as F
    inc.table.read_all("rows").where(F.col("month").isin(["2024-02"])).explain("formatted")
    assert "PartitionFilters: [isnotnull(month" in capsys.readouterr().out


def test_a_lost_write_is_done_again(spark, monkeypatch):
    rows = some_reviews(40, 5)
    inc = IncrementalRecency(spark, work_path(spark, "test-lost"), 3)
    inc.apply(spark.createDataFrame(rows[:20], SCHEMA), tag="a")
    write = inc.table.write_part

    def dies(df, n, part, **more):
        if part == "days":
            raise RuntimeError("executor lost")
        return write(df, n, part, **more)
    monkeypatch.setattr(inc.table, "write_part", dies)
    with pytest.raises(RuntimeError):
        inc.apply(spark.createDataFrame(rows[20:], SCHEMA), tag="b")
    monkeypatch.undo()
    assert inc.apply(spark.createDataFrame(rows[20:], SCHEMA), tag="b")
    want = sen.recency_weighted_sentiment(chronological_batches(spark.createDataFrame(rows, SCHEMA), 3))
    assert rows_of(inc.scores()) == rows_of(want)


def test_landed_pages(spark, tmp_path):
    land = tmp_path / "landing"
    land.mkdir()
    for place in (1, 2):
        for page in range(3):
            reviews = [{"rating": float(1 + (i + page) % 5), "iso_date": "" if i == 4 else f"2024-0{1 + page % 2}-0{1 + i}T10:00:00Z", "user": {"name": "u"},
                        "extracted_snippet": {"original": "ok"}} for i in range(5)]
            (land / f"{place}-{page}.json").write_text(json.dumps({"data_id": place, "page_no": page, "reviews": reviews}) + "\n")
    inc = IncrementalRecency(spark, work_path(spark, "test-stream-recency"), 2, order=("page_no", "pos"))
    inc.start(str(land), work_path(spark, "test-stream-recency-ckpt")).awaitTermination()
    good = normalize_reviews(scan_pages(spark, str(land))).where("bad_reason is null")
    assert rows_of(inc.scores()) == rows_of(sen.recency_weighted_sentiment(chronological_batches(good, 2)))
