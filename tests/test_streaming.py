"""Streaming equals batch; replays are idempotent."""

import json

import pytest
from pyspark.sql import functions as F

from guestlens.operators.ingest import normalize_reviews
from guestlens.sources.pages import scan_pages
from guestlens.sources import standins as st
from guestlens.streaming.incremental import IncrementalPriorities, IncrementalSentiment
from guestlens.streaming.ingest import read_ingested, start_page_ingest
from guestlens.session import work_path


def page_line(data_id, page_no, ratings, day):
    revs = [{"rating": r, "iso_date": f"2024-01-{day:02d}T10:0{i}:00Z", "user": {"name": f"u{i}"},
             "extracted_snippet": {"original": "ok"}} for i, r in enumerate(ratings)]
    return json.dumps({"data_id": data_id, "page_no": page_no, "reviews": revs})


def test_stream_ingest_equals_batch(spark, tmp_path):
    land = tmp_path / "landing"
    land.mkdir()
    for i, (d, p) in enumerate([(1, 0), (1, 1), (2, 0)]):
        (land / f"f{i}.json").write_text(page_line(d, p, [5.0, 3.0], 3 + i) + "\n")
    base = work_path(spark, "test-stream")
    start_page_ingest(spark, str(land), f"{base}/sink", f"{base}/ckpt", max_files_per_trigger=1).awaitTermination()
    got = sorted((r.data_id, r.fetch_pos, r.rating, r.date) for r in read_ingested(spark, f"{base}/sink").collect())
    exp = sorted((r.data_id, r.fetch_pos, r.rating, r.date) for r in normalize_reviews(scan_pages(spark, str(land))).collect())
    assert got == exp and len(got) == 6


def test_incremental_replay_and_late_reviews(spark):
    inc = IncrementalSentiment(spark, work_path(spark, "test-state"))
    old = spark.createDataFrame([(1, 5.0), (1, 1.0)], "data_id long, rating double")
    late = spark.createDataFrame([(1, 4.0), (2, 3.0)], "data_id long, rating double")  # e.g. older-dated reviews
    assert inc.apply(old, 0)
    assert inc.apply(late, 1)
    assert not inc.apply(late, 1)            # replay of epoch 1 is a no-op
    got = {r.data_id: (r.n_reviews, r.average_score) for r in inc.scores().collect()}
    ch = {r.data_id: (r.previous_score, r.current_score, r.significant) for r in inc.changes().collect()}
    assert ch == {1: (3.0, 3.3, True), 2: (None, 3.0, True)}
    full = old.unionByName(late).groupBy("data_id").agg(F.count("*").alias("n"), F.round(F.avg("rating"), 1).alias("a"))
    assert got == {r.data_id: (r.n, r.a) for r in full.collect()}


def test_status_stream_equals_batch(spark, tmp_path):
    import datetime as dt
    from guestlens.streaming.status import StatusTable, batch_equivalent, STATUS_EVENT_SCHEMA
    t0 = dt.datetime(2024, 1, 1)
    evs = [(1, "in_progress", t0, 1, None), (1, "completed", t0 + dt.timedelta(hours=2), 2, None),
           (2, "in_progress", t0 + dt.timedelta(hours=1), 3, None), (3, "in_progress", t0, 4, None),
           (2, "failed", t0 + dt.timedelta(hours=40), 5, "no_reviews"), (4, "completed", t0 + dt.timedelta(hours=30), 6, None)]
    land = tmp_path / "status"
    land.mkdir()
    for i, e in enumerate(evs):
        (land / f"e{i}.json").write_text(json.dumps({"token": e[0], "status": e[1], "created_at": e[2].isoformat(),
                                                     "seq": e[3], "error": e[4]}) + "\n")
    table = StatusTable(spark, work_path(spark, "test-status"))
    table.start(str(land), work_path(spark, "test-status-ckpt"), max_files_per_trigger=2).awaitTermination()
    got = sorted(tuple(r) for r in table.latest().select("token", "status").collect())
    exp = sorted(tuple(r) for r in batch_equivalent(spark.createDataFrame(evs, STATUS_EVENT_SCHEMA))
                 .select("token", "status").collect())
    assert got == exp == [(2, "failed"), (4, "completed")]
    assert not table.apply(spark.createDataFrame(evs[:1], STATUS_EVENT_SCHEMA), 0)   # replay ignored


def test_rebatch_touched_places(spark):
    import datetime as dt
    from guestlens.streaming.incremental import rebatch_touched
    t0 = dt.datetime(2024, 1, 10)
    old = [(1, i, t0 + dt.timedelta(days=i)) for i in range(1, 5)] + [(2, i, t0 + dt.timedelta(days=i)) for i in range(1, 3)]
    late = [(1, 9, t0)]                                   # older than every stored review of place 1
    schema = "data_id long, fetch_pos long, ts timestamp_ntz"
    allr = spark.createDataFrame(old + late, schema)
    b = {r.fetch_pos: r.batch_id for r in rebatch_touched(allr, spark.createDataFrame(late, schema), 2).collect()}
    assert b == {9: 0, 1: 0, 2: 1, 3: 1, 4: 2}            # place 1 renumbered, place 2 untouched


def test_incremental_priorities_equal_batch(spark):
    from guestlens.operators.aspects import improvement_priorities, mentions
    from guestlens.sources import standins as st
    from guestlens.streaming.incremental import IncrementalPriorities
    r = st.normalized_reviews(spark, "/root/testdata/sf0.001", ordered=False)
    cut = F.col("ts") < F.to_timestamp_ntz(F.lit("2024-01-20 00:00:00"))
    inc = IncrementalPriorities(spark, work_path(spark, "test-prio"), st.TEST_LEXICON, st.TEST_POLARITY)
    assert inc.apply(r.filter(cut), 0)
    assert inc.apply(r.filter(~cut), 1)
    assert not inc.apply(r.filter(~cut), 1)
    got = sorted(tuple(x) for x in inc.priorities().collect())
    exp = sorted(tuple(x) for x in improvement_priorities(mentions(r, st.TEST_LEXICON, st.TEST_POLARITY)).collect())
    assert got == exp and len(got) > 0


def test_changes_with_single_version(spark):
    inc = IncrementalSentiment(spark, work_path(spark, "test-state-one"))
    inc.apply(spark.createDataFrame([(7, 4.0), (7, 2.0)], "data_id long, rating double"), 0)
    assert [tuple(r) for r in inc.changes().collect()] == [(7, None, 3.0, True)]


def _reviews(spark, rows):
    return spark.createDataFrame(rows, "data_id long, review_id long, rating double, review_text string, bad_reason string") \
        .withColumn("ts", F.lit(None).cast("timestamp_ntz"))


FIRST = [(1, 1, 1.0, "old rod", None), (1, 2, 5.0, "new bolt", None), (2, 1, 2.0, "cold gear", None)]
SECOND = [(1, 3, 2.0, "old bolt", None), (3, 1, 1.0, "small plate", None), (1, 4, 9.0, "old rod", "bad rating")]


def _ranked(df):
    return sorted((r.data_id, r.priority, r.category, r.issue, r.score, r.n_reviews) for r in df.collect())


def test_priorities_survive_a_crash_between_writes(spark, monkeypatch):
    from guestlens.operators.aspects import improvement_priorities, mentions
    inc = IncrementalPriorities(spark, work_path(spark, "test-crash"), st.TEST_LEXICON, st.TEST_POLARITY)
    assert inc.apply(_reviews(spark, FIRST), tag="a#0")
    write = inc.table.write_part

    def dies(df, n, part):
        if part == "ranking":
            raise RuntimeError("executor lost")
        return write(df, n, part)
    monkeypatch.setattr(inc.table, "write_part", dies)
    with pytest.raises(RuntimeError):
        inc.apply(_reviews(spark, SECOND), tag="a#1")
    monkeypatch.undo()
    assert inc.apply(_reviews(spark, SECOND), tag="a#1") and not inc.apply(_reviews(spark, SECOND), tag="a#1")
    whole = _reviews(spark, FIRST + [r for r in SECOND if r[4] is None])
    assert _ranked(inc.priorities()) == _ranked(improvement_priorities(mentions(whole, st.TEST_LEXICON, st.TEST_POLARITY)))


def test_sentiment_of_two_sources_and_bad_rows(spark):
    inc = IncrementalSentiment(spark, work_path(spark, "test-sources"))
    assert inc.apply(_reviews(spark, FIRST), tag="landing-a#0") and inc.apply(_reviews(spark, SECOND), tag="landing-b#0")
    assert not inc.apply(_reviews(spark, SECOND), tag="landing-b#0")
    got = {r.data_id: (r.n_reviews, r.average_score) for r in inc.scores().collect()}
    assert got == {1: (3, 2.7), 2: (1, 2.0), 3: (1, 1.0)}
    late = IncrementalSentiment(spark, work_path(spark, "test-gap"))        # an epoch builds on those below it
    assert late.apply(_reviews(spark, SECOND), epoch=5) and late.apply(_reviews(spark, FIRST), epoch=2)
    assert {r.data_id for r in late.table.read(2).collect()} == {1, 2}


def _ingest(spark, land, base, name, **more):
    start_page_ingest(spark, str(land), f"{base}/sink", f"{base}/ckpt-{name}", max_files_per_trigger=1, **more).awaitTermination()


def _ingested(spark, base):
    return sorted((r.data_id, r.page_no, r.fetch_pos, r.rating) for r in read_ingested(spark, f"{base}/sink").collect())


def test_two_sources_feed_one_sink(spark, tmp_path):
    base = work_path(spark, "test-two-sources")
    for name, place in (("a", 1), ("b", 2)):
        (tmp_path / name).mkdir()
        (tmp_path / name / "f.json").write_text(page_line(place, 0, [5.0, 3.0], 3) + "\n")
        _ingest(spark, tmp_path / name, base, name)
    assert _ingested(spark, base) == [(1, 0, 1, 5.0), (1, 0, 2, 3.0), (2, 0, 1, 5.0), (2, 0, 2, 3.0)]


@pytest.mark.parametrize("once_within", [None, "7 days"])
def test_pages_landed_again(spark, tmp_path, once_within):
    """Equal pages count once; of a page with another content the newest landing counts, late or not."""
    import os
    base = work_path(spark, "test-again")
    land = tmp_path / "landing"
    land.mkdir()
    lines = [page_line(1, 0, [5.0, 3.0], 3), page_line(1, 1, [4.0], 4), page_line(1, 0, [5.0, 3.0], 3), page_line(1, 1, [1.0, 2.0], 5), page_line(1, 1, [4.0], 4)]
    for i, line in enumerate(lines):
        f = land / f"f{i}.json"
        f.write_text(line + "\n" + (line + "\n" if i == 0 else ""))
        os.utime(f, (1_700_000_000 + 100 * min(i, 3 if i < 4 else 0),) * 2)          # the last file is older than the third
    _ingest(spark, land, base, "a", once_within=once_within)
    assert _ingested(spark, base) == [(1, 0, 1, 5.0), (1, 0, 2, 3.0), (1, 1, 3, 1.0), (1, 1, 4, 2.0)]


def test_status_of_two_sources(spark, tmp_path):
    from guestlens.streaming.status import StatusTable
    table = StatusTable(spark, work_path(spark, "test-status-two"))
    for name, token in (("a", 1), ("b", 2)):
        (tmp_path / name).mkdir()
        (tmp_path / name / "e.json").write_text(json.dumps({"token": token, "status": "completed", "created_at": "2024-01-01T00:00:00", "seq": token}) + "\n")
        for _ in range(2):                                                           # the second run finds nothing new
            table.start(str(tmp_path / name), f"{tmp_path}/ckpt-{name}").awaitTermination()
    assert sorted(r.token for r in table.latest().collect()) == [1, 2]


def test_state_of_a_stream_is_bounded_by_cores(spark, tmp_path, monkeypatch):
    """Each micro-batch opens every part of the state: at most two parts per core, and each batch goes through it once."""
    import glob
    land = tmp_path / "land"
    land.mkdir()
    (land / "a.json").write_text('{"data_id": 1, "page_no": 0, "reviews": [{"rating": "5", "iso_date": "2024-01-01T00:00:00Z", "extracted_snippet": {"original": "x"}}]}\n')
    base = str(tmp_path)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "50")
    try:
        q = start_page_ingest(spark, str(land), f"{base}/sink", f"{base}/ckpt", once_within="7 days")
        assert spark.conf.get("spark.sql.shuffle.partitions") == "50"
        q.awaitTermination()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert 0 < len(glob.glob(f"{base}/ckpt/state/0/[0-9]*")) <= 2 * spark.sparkContext.defaultParallelism
    assert read_ingested(spark, f"{base}/sink").count() == 1
    from guestlens.sources.versioned import VersionedTable
    from guestlens.streaming.ingest import work_number
    tag = f"{base}/ckpt#0"
    t = VersionedTable(spark, f"{base}/sink", key="epoch")
    assert t.committed(work_number(tag), tag) and not t.committed(work_number(tag), "other") and not t.committed(1, tag)
