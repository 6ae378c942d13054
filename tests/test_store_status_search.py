"""S2/S3/U1, J1, T3/T4, J3 on hand fixtures."""

import datetime as dt

import pytest

from pyspark.sql import functions as F

from guestlens.operators.cache import cache_decisions
from guestlens.operators.search import place_search
from guestlens.operators.status import expire, latest_status, status_reply
from guestlens.session import work_path
from guestlens.sources import store as so

T0 = dt.datetime(2024, 1, 1)


def writes(spark, rows):
    return spark.createDataFrame(rows, "data_id long, type string, analysis string, written_at timestamp_ntz, seq long")


def test_upsert_versions_and_lookup(spark):
    root = work_path(spark, "test-store")
    w1 = writes(spark, [(1, "instant", "a", T0, 1), (1, "full", "b", T0, 2), (2, "instant", "c", T0, 3),
                        (3, "other", "bad", T0, 4)])
    good, rejected = so.split_writes(w1)
    assert [(r.data_id, r.type) for r in rejected.collect()] == [(3, "other")]
    with pytest.raises(Exception, match="instant or full"):        # never dropped silently
        so.upsert(None, w1).collect()
    so.write_version(so.upsert(None, good), root)
    w2 = writes(spark, [(1, "instant", "a2", T0 + dt.timedelta(hours=1), 5), (2, "instant", "old", T0, 0)])
    so.write_version(so.upsert(so.read_latest(spark, root), w2), root)
    s = {(r.data_id, r.type): r.analysis for r in so.read_latest(spark, root).collect()}
    assert s == {(1, "instant"): "a2", (1, "full"): "b", (2, "instant"): "c"}
    req = spark.createDataFrame([(1, None), (1, "full"), (2, "full")], "data_id long, type string")
    got = sorted((r.data_id, r.requested_type or "", r.type, r.type_order)
                 for r in so.lookup(so.read_latest(spark, root), req).collect())
    assert got == [(1, "", "full", 1), (1, "", "instant", 0), (1, "full", "full", 1)]
    w3 = writes(spark, [(4, "full", '{"hotel_name": "H", "overall_sentiment": {"average_score": 4.3}}', T0, 9)])
    rep = so.lookup(w3, spark.createDataFrame([(4, "full")], "data_id long, type string"), parse=True).collect()[0]
    assert rep.report.hotel_name == "H" and rep.report.overall_sentiment.average_score == 4.3


def test_cache_split_running(spark):
    store = writes(spark, [(1, "full", "x", T0, 1)])
    ev = spark.createDataFrame([(2, "in_progress", T0, 1, None), (3, "failed", T0, 1, "e")],
                               "token long, status string, created_at timestamp_ntz, seq long, error string")
    req = spark.createDataFrame([(1, "full"), (1, "instant"), (2, "full"), (3, "full")], "data_id long, type string")
    d = {(r.data_id, r.type): r.decision for r in cache_decisions(req, store, latest_status(ev)).collect()}
    assert d == {(1, "full"): "hit", (1, "instant"): "miss", (2, "full"): "running", (3, "full"): "miss"}
    r = {(x.data_id, x.type): x.decision for x in cache_decisions(req, store, latest_status(ev), refresh=True).collect()}
    assert r == {(1, "full"): "miss", (1, "instant"): "miss", (2, "full"): "running", (3, "full"): "miss"}


def test_status_latest_reply_and_expiry(spark):
    ev = spark.createDataFrame([
        (1, "in_progress", T0, 1, None), (1, "completed", T0 + dt.timedelta(hours=1), 2, None),
        (2, "in_progress", T0, 3, None), (2, "failed", T0, 4, "no_reviews"),   # same time: seq breaks tie
        (3, "in_progress", T0 - dt.timedelta(hours=30), 5, None)],
        "token long, status string, created_at timestamp_ntz, seq long, error string")
    lat = latest_status(ev)
    stored = spark.createDataFrame([(9,)], "data_id long")
    rep = {r.token: (r.status, r.reply, r.reply_error) for r in status_reply(lat, stored).collect()}
    assert rep == {1: ("completed", "data", None), 2: ("failed", "failed", "no_reviews"),
                   3: ("in_progress", "in_progress", None), 9: ("completed", "data", None)}
    kept = sorted(r.token for r in expire(lat, T0 + dt.timedelta(hours=1)).collect())
    assert kept == [1, 2]   # token 3 is 31 h old: strictly more than 24 h -> dropped
    exact = sorted(r.token for r in expire(lat, T0 + dt.timedelta(hours=24)).collect())
    assert exact == [1, 2]  # age exactly 24 h is kept


def test_place_search(spark):
    places = spark.createDataFrame([
        (1, "Sea Shore Resort", "hotel", "Kochi", 9.92, 76.26), (2, "The Sea Shore Inn", "hotel", "Fort", 9.96, 76.24),
        (None, "Sea Shore Cafe", "cafe", "X", 9.9, 76.2), (4, "Sea Shore Cafe", "cafe", "Y", 9.0, 76.0),
        (5, "Mountain View", "hotel", "Z", 9.9, 76.25)],
        "data_id long, title string, type string, address string, latitude double, longitude double")
    q = spark.createDataFrame([(1, "sea shore", None, None), (2, "se", None, None), (3, "view", 9.9, 76.25)],
                              "query_id long, q string, latitude double, longitude double")
    r = place_search(q, places).orderBy("query_id", "rank").collect()
    assert [(x.query_id, x.data_id, x.match) for x in r] == [
        (1, 1, "prefix"), (1, 4, "prefix"), (1, 2, "contains"), (3, 5, "contains")]
    only_hotels = place_search(q, places, type_filter="hotel").filter("query_id = 1").collect()
    assert sorted(x.data_id for x in only_hotels) == [1, 2]
    assert place_search(q, places, k=1).filter("query_id = 1").count() == 1


def test_uncommitted_version_is_ignored(spark):
    from guestlens.sources.versioned import VersionedTable
    root = work_path(spark, "test-versioned")
    t = VersionedTable(spark, root)
    t.write(spark.createDataFrame([(1,)], "x long"), 1)
    # a version whose data landed but whose commit never happened (job died)
    spark.createDataFrame([(2,)], "x long").write.parquet(f"{root}/data/version=2")
    assert t.versions() == [1] and [r.x for r in t.latest().collect()] == [1]
    t.write(spark.createDataFrame([(3,)], "x long"), 2)     # the retry overwrites and commits
    assert t.versions() == [1, 2] and [r.x for r in t.latest().collect()] == [3]
