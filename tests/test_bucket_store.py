"""The bucketed store: touched buckets only, the newest write wins, redone upserts change nothing."""

import datetime as dt
import os

import pytest

from guestlens.session import work_path
from guestlens.sources import store as so
from guestlens.sources.bucket_store import BucketStore

SCHEMA = "data_id long, type string, analysis string, written_at timestamp_ntz, seq long"
T0 = dt.datetime(2024, 1, 1)


def writes(spark, rows):
    return spark.createDataFrame([(i, t, a, T0 + dt.timedelta(hours=h), s) for i, t, a, h, s in rows], SCHEMA)


def files(root):
    return {os.path.join(d, n): os.stat(os.path.join(d, n)).st_mtime_ns for d, _, names in os.walk(f"{root}/rows".removeprefix("file:")) for n in names
            if n.endswith(".parquet")}


def bucket(path):
    return int(path.split("bucket=")[1].split("/")[0])


def rows_of(df):
    return sorted((tuple(r) for r in df.select(*so.STORE_COLUMNS).collect()), key=repr)


def test_upsert_writes_touched_buckets_only(spark):
    root = work_path(spark, "test-buckets")
    store = BucketStore(spark, root, 32)
    all_rows = [(i, t, f"{i}{t}", 0, i) for i in range(400) for t in ("instant", "full")]
    assert len(store.upsert(writes(spark, all_rows))) == 32
    before = files(root)
    some = [(i, "full", "new", 1, 1000 + i) for i in (7, 107, 207, 307)]                 # 1 % of the places
    touched = store.upsert(writes(spark, some))
    after = files(root)
    assert len(touched) <= 4
    assert {bucket(p) for p in set(after) ^ set(before)} == set(touched)
    assert all(after[p] == before[p] for p in before if bucket(p) not in touched)
    want = so.upsert(writes(spark, all_rows), writes(spark, some))
    assert rows_of(store.rows()) == rows_of(want)


def test_old_and_repeated_writes(spark):
    root = work_path(spark, "test-buckets-again")
    store = BucketStore(spark, root, 4)
    first, late = [(1, "full", "b", 5, 2), (None, "full", "n", 0, 1), (2, "instant", "x", 0, 1)], [(1, "full", "a", 1, 9), (1, "full", "c", 5, 1), (3, "full", None, 0, 0)]
    for rows in (first, late, late, first):
        store.upsert(writes(spark, rows))
    assert store.upsert(writes(spark, [])) == []
    assert rows_of(store.rows()) == rows_of(so.upsert(None, writes(spark, first + late)))
    assert BucketStore(spark, root).buckets == 4
    with pytest.raises(ValueError):
        BucketStore(spark, root, 5)


def test_lookup_opens_asked_buckets_only(spark, capsys):
    store = BucketStore(spark, work_path(spark, "test-buckets-lookup"), 16)
    rows = [(i, t, f"{i}{t}", 0, i) for i in range(200) for t in ("instant", "full")]
    store.upsert(writes(spark, rows))
    asked = spark.createDataFrame([(3, None), (4, "full"), (999, None)], "data_id long, type string")
    out = store.lookup(asked)
    assert sorted((r.data_id, r.type, r.type_order) for r in out.collect()) == [(3, "full", 1), (3, "instant", 0), (4, "full", 1)]
    out.explain("formatted")
    plan = capsys.readouterr().out
    assert "PartitionFilters: [bucket" in plan
    assert len(store.touched(asked)) <= 3


def test_empty_store_and_wrong_type(spark):
    store = BucketStore(spark, work_path(spark, "test-buckets-empty"), 4)
    assert store.rows().collect() == [] and store.lookup(spark.createDataFrame([(1, None)], "data_id long, type string")).collect() == []
    with pytest.raises(Exception, match="store type must be"):
        store.upsert(writes(spark, [(1, "other", "a", 0, 0)]))
