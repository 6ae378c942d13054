"""Status sessions that close themselves: boundaries, several micro-batches, restarts, late events."""

import datetime as dt
import json
import os

from guestlens.operators.status import expire, latest_status
from guestlens.session import work_path
from guestlens.streaming.expiry import StatusSessions
from guestlens.streaming.status import STATUS_EVENT_SCHEMA

T0 = dt.datetime(2024, 1, 1)
HOUR = dt.timedelta(hours=1)


def land(folder, files, first=0):
    """Each list of events is a file; files are read in this order."""
    folder.mkdir(exist_ok=True)
    for i, events in enumerate(files, first):
        f = folder / f"e{i}.json"
        f.write_text("".join(json.dumps({"token": t, "status": s, "created_at": at.isoformat(), "seq": q, "error": e}) + "\n" for t, s, at, q, e in events))
        os.utime(f, (1_700_000_000 + 10 * i,) * 2)


def closed(sessions):
    return sorted((r.token, r.started_at, r.last_at, r.n_events, r.status, r.error) for r in sessions.expired().collect())


def test_sessions_close_by_themselves(spark, tmp_path):
    events = [(1, "in_progress", T0, 1, None), (2, "in_progress", T0, 2, None), (1, "completed", T0 + 24 * HOUR, 3, None),      # a gap of 24 h is none
              (3, "failed", T0 + 30 * HOUR, 4, "no_reviews"), (4, "completed", T0 + 36 * HOUR, 5, None), (2, "completed", T0 + 40 * HOUR, 6, None),
              (5, "in_progress", T0 + 60 * HOUR, 7, None)]
    land(tmp_path / "landing", [[e] for e in events])
    sessions = StatusSessions(spark, work_path(spark, "test-closed"))
    ckpt = work_path(spark, "test-closed-ckpt")
    for _ in range(2):                                                     # the second run has nothing to do
        sessions.start(str(tmp_path / "landing"), ckpt, max_files_per_trigger=1).awaitTermination()
    assert closed(sessions) == [(1, T0, T0 + 24 * HOUR, 2, "completed", None), (2, T0, T0, 1, "in_progress", None),
                                (3, T0 + 30 * HOUR, T0 + 30 * HOUR, 1, "failed", "no_reviews")]
    df = spark.createDataFrame(events, STATUS_EVENT_SCHEMA)
    want = expire(latest_status(df), T0 + 60 * HOUR)                       # 4 is exactly 24 h old
    assert sorted(map(tuple, sessions.live(df).select("token", "status", "created_at").collect())) == sorted(map(tuple, want.select("token", "status", "created_at").collect()))
    land(tmp_path / "landing", [[(6, "completed", T0 + 200 * HOUR, 8, None)]], first=10)
    sessions.start(str(tmp_path / "landing"), ckpt).awaitTermination()
    assert {r[0] for r in closed(sessions)} == {1, 2, 3, 4, 5} and [r.token for r in sessions.live(
        spark.createDataFrame([*events, (6, "completed", T0 + 200 * HOUR, 8, None)], STATUS_EVENT_SCHEMA)).collect()] == [6]


def test_lateness_allowed(spark, tmp_path):
    land(tmp_path / "landing", [[(1, "in_progress", T0 + 50 * HOUR, 1, None)], [(2, "completed", T0, 2, None)], [(3, "completed", T0 + 70 * HOUR, 3, None)]])
    sessions = StatusSessions(spark, work_path(spark, "test-late-closed"), late="30 hours")
    sessions.start(str(tmp_path / "landing"), work_path(spark, "test-late-ckpt"), max_files_per_trigger=1).awaitTermination()
    assert closed(sessions) == [(2, T0, T0, 1, "completed", None)]         # came 50 h late, within 24 h + 30 h
