"""P1-P4 and S1 on hand fixtures (FIXTURES.md section 3)."""

import json

from pyspark.sql import functions as F

from guestlens.operators.ingest import (no_review_places, normalize_reviews, place_header, place_status,
                                       quarantine)
from guestlens.sources.pages import page_summary, scan_pages


def page(data_id, page_no, reviews, place_info=None, nxt=True, **extra):
    p = {"data_id": data_id, "page_no": page_no, "reviews": reviews,
         "search_metadata": {"status": "Success", "created_at": f"c{page_no}"},
         "search_parameters": {"data_id": str(data_id)}}
    if place_info is not None:
        p["place_info"] = place_info
    if nxt:
        p["serpapi_pagination"] = {"next": "u", "next_page_token": "t"}
    p.update(extra)
    return json.dumps(p)


GOOD = {"rating": 4.0, "iso_date": "2024-08-03T15:53:00Z", "user": {"name": "Alice"},
        "extracted_snippet": {"original": "Great"}}


def test_defaults_and_quarantine(spark, land_lines):
    rows = [
        dict(GOOD),
        {k: v for k, v in GOOD.items() if k != "rating"},            # missing rating -> 0
        {**GOOD, "rating": None},                                     # explicit null -> 0
        {**GOOD, "rating": "x"},                                      # not a number -> quarantined
        {k: v for k, v in GOOD.items() if k != "user"},               # missing user -> ""
        {**GOOD, "iso_date": ""},                                     # empty date -> quarantined
        {**GOOD, "iso_date": "bad"},                                  # malformed -> quarantined
    ]
    path = land_lines([page(1, 0, rows, {"title": "T"}, nxt=False), '{"data_id": 2, "page_no": 0, "revi'])
    pages = scan_pages(spark, path)
    summ = {r.is_corrupt: r for r in page_summary(pages).collect()}
    assert summ[True].data_id is None and summ[False].n_reviews == 7
    r = normalize_reviews(pages).orderBy("fetch_pos").collect()
    assert [x.fetch_pos for x in r] == list(range(1, 8))
    assert r[0].date == "August 03, 2024 at 03:53 PM UTC" and r[0].rating == 4.0 and r[0].user == "Alice"
    assert r[1].rating == 0.0 and r[2].rating == 0.0 and r[4].user == ""
    assert r[5].ts is None and r[6].ts is None and r[5].date is None
    assert [x.bad_reason for x in r] == [None, None, None, "bad rating", None, "bad date", "bad date"]
    st = place_status(normalize_reviews(pages)).collect()[0]
    assert (st.n_good, st.n_quarantined, st.status) == (4, 3, "Partial")
    good, held = quarantine(normalize_reviews(pages))
    assert good.count() == 4 and sorted(r.fetch_pos for r in held.collect()) == [4, 6, 7]


def test_status_error_when_nothing_usable(spark, land_lines):
    path = land_lines([page(3, 0, [{**GOOD, "iso_date": "bad"}], nxt=False)])
    st = place_status(normalize_reviews(scan_pages(spark, path))).collect()[0]
    assert st.status == "Error" and st.n_good == 0


def test_odd_ratings_pages_and_requests(spark, land_lines):
    rows = [{**GOOD, "rating": x} for x in ("NaN", "Infinity", 9, -1, 5, 0)]
    path = land_lines([page(1, 0, rows), page(1, None, [GOOD]), '{"data_id": 2, "page_no": 0, "revi', '{"data_id": 1, "page_no": 1, "re', "garbage",
                       page(4, 0, [])])
    pages = scan_pages(spark, path).cache()
    r = normalize_reviews(pages).orderBy("fetch_pos").collect()
    assert [x.bad_reason for x in r] == ["bad rating"] * 4 + [None, None, "no page number"] and r[-1].fetch_pos == 7
    assert all(0 <= x.rating <= 5 for x in r)
    asked = spark.createDataFrame([(1,), (2,), (3,), (4,)], "data_id long")
    got = {s.data_id: (s.n_good, s.n_quarantined, s.n_bad_pages, s.status) for s in place_status(normalize_reviews(pages), pages, asked).collect()}
    assert got == {1: (2, 5, 1, "Partial"), 2: (0, 0, 1, "Error"), 3: (0, 0, 0, "Error"), 4: (0, 0, 0, "Error")}


def test_fetch_pos_spans_pages(spark, land_lines):
    lines = [page(5, p, [GOOD] * n, {"title": "T"}, nxt=p < 2) for p, n in [(0, 3), (1, 0), (2, 2)]]
    path = land_lines(lines)
    r = normalize_reviews(scan_pages(spark, path)).orderBy("fetch_pos").collect()
    assert [(x.page_no, x.pos, x.fetch_pos) for x in r] == [(0, 0, 1), (0, 1, 2), (0, 2, 3), (2, 0, 4), (2, 1, 5)]


def test_header_first_non_empty(spark, land_lines):
    info = {"type": "Hotel", "title": "Sea Shore", "rating": 4.3, "address": "A", "reviews": 126}
    path = land_lines([
        page(7, 0, [GOOD], {}),            # empty place_info on page 0
        page(7, 1, [GOOD], info, nxt=False),
        page(8, 0, [GOOD], None, nxt=False),   # no place_info anywhere
    ])
    h = {r.data_id: r for r in place_header(scan_pages(spark, path)).collect()}
    assert (h[7].title, h[7].type, h[7].rating, h[7].total_reviews) == ("Sea Shore", "Hotel", 4.3, 126)
    assert h[7].created_at == "c0" and h[7].status == "Success" and h[7].param_data_id == "7"
    assert (h[8].title, h[8].rating, h[8].total_reviews, h[8].address) == ("", 0.0, 0, "")


def test_no_review_places(spark):
    req = spark.createDataFrame([(1,), (2,), (3,)], "data_id long")
    rev = spark.createDataFrame([(2, 1)], "data_id long, fetch_pos long")
    out = sorted(r.data_id for r in no_review_places(req, rev).collect())
    assert out == [1, 3]
