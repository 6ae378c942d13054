"""Page numbers from next tokens: clean chains, lost pages, cycles, forks, repeated pages."""

import random

from guestlens.operators.page_order import chain_report, page_links, page_order
from guestlens.sources.pages import scan_pages

SCHEMA = "data_id long, token string, next_token string"


def ordered(spark, rows):
    return {(r.data_id, r.token): (r.page_no, r.state) for r in page_order(spark.createDataFrame(rows, SCHEMA)).collect()}


def test_long_clean_chains_equal_their_numbers(spark):
    rows, want = [], {}
    for place, n in ((1, 1), (2, 2), (3, 37), (4, 64), (5, 65)):
        tokens = [""] + [f"t{place}-{random.Random(place * 1000 + i).random()}" for i in range(1, n)]
        rows += [(place, t, tokens[i + 1] if i + 1 < n else None) for i, t in enumerate(tokens)]
        want |= {(place, t): (i, "ok" if i + 1 < n else "last") for i, t in enumerate(tokens)}
    random.Random(0).shuffle(rows)
    assert ordered(spark, rows) == want


def test_broken_chains_and_cycles(spark):
    rows = [(1, "", "a"), (1, "a", "b"), (1, "c", None),                       # b is lost: c is unreached
            (2, "", "a"), (2, "a", "b"), (2, "b", "a"),                        # leads back
            (3, "", ""),                                                       # its own next page
            (4, "x", "y"), (4, "y", "x"),                                      # only a cycle, no first page
            (5, "", "a"), (5, "a", "z"), (5, "b", "z"), (5, "z", None),        # two pages with one next
            (6, "", "a"), (6, "", "a"), (6, "a", None), (6, "a", None)]        # landed twice
    got = ordered(spark, rows)
    assert got == {(1, ""): (0, "ok"), (1, "a"): (1, "next missing"), (1, "c"): (None, "unreached"),
                   (2, ""): (0, "ok"), (2, "a"): (1, "ok"), (2, "b"): (2, "cycle"), (3, ""): (0, "cycle"),
                   (4, "x"): (None, "unreached"), (4, "y"): (None, "unreached"),
                   (5, ""): (0, "ok"), (5, "a"): (1, "ok"), (5, "b"): (None, "unreached"), (5, "z"): (2, "last"),
                   (6, ""): (0, "ok"), (6, "a"): (1, "last")}
    report = {r.data_id: (r.n_pages, r.n_unreached, r.ends) for r in chain_report(page_order(spark.createDataFrame(rows, SCHEMA))).collect()}
    assert report == {1: (2, 1, "next missing"), 2: (3, 0, "cycle"), 3: (1, 0, "cycle"), 4: (0, 2, "no first page"), 5: (3, 1, "last"), 6: (2, 0, "last")}


def test_long_cycle_ends(spark):
    n = 50
    rows = [(1, "" if i == 0 else f"t{i}", f"t{i + 1}" if i + 1 < n else "t5") for i in range(n)]
    assert ordered(spark, rows) == {(1, "" if i == 0 else f"t{i}"): (i, "ok" if i + 1 < n else "cycle") for i in range(n)}


def test_landed_pages(spark, land_lines):
    path = land_lines(['{"data_id": 1, "serpapi_pagination": {"next": "u", "next_page_token": "p1"}}', '{"data_id": 1, "page_token": "p1"}', '{"data_id": 1, "page_tok'])
    links = page_links(scan_pages(spark, path, "page_token string"))
    assert sorted(tuple(r) for r in page_order(links).collect()) == [(1, "", "p1", 0, "ok"), (1, "p1", None, 1, "last")]


def test_no_pages(spark):
    assert ordered(spark, []) == {}
