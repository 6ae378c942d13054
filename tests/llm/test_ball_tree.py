"""Ranked search against plain Python; bounds against the scores below them; small trees, blocks and shards."""

import math
import os
import random
import re
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from guestlens.llm import ball_tree, queries

SF = "/root/testdata/sf0.001"
TERM = re.compile(rb"[0-9A-Za-z\x80-\xff]+")


def terms_of(text):
    return [x.translate(bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))) for x in TERM.findall((text or "").encode())]


def brute(docs, items, k=20):
    own = [(i, Counter(terms_of(t)), len(terms_of(t))) for i, t in docs]
    own = [d for d in own if d[2]]
    n, length = len(own), sum(d[2] for d in own)
    df = Counter(t for _, c, _ in own for t in c)
    out = []
    for item, text in set(items):
        asked = terms_of(text)
        scored = []
        for i, c, size in own:
            m = 75 + (25 * size * n) // length
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 12 * m)) for t in asked if c[t])
            if score > 0:
                scored.append((-score, i is None, i or 0, i))
        out += [(item, rank, x[3], -x[0]) for rank, x in enumerate(sorted(scored)[:k], 1)]
    return sorted(out, key=repr)


def corpus(seed, n, vocabulary=60):
    rng = random.Random(seed)
    word = lambda: f"w{min(rng.randrange(vocabulary), rng.randrange(vocabulary))}"
    rows = [(i, rng.choice(["", ", ", " "]).join([""] + [word() + " " for _ in range(rng.randrange(1, 40))])) for i in range(n)]
    rows += [(n + i, rows[i % 7][1]) for i in range(60)] + [(5, "w1 w1 w1"), (5, "w1 w1 w1"), (None, "w2 W2 w3"), (None, None), (n + 99, None), (n + 98, " .,!\t"),
                                                          (n + 97, "w4 " * 5000), (-3, "w0"), (n + 96, "Ünder é é w5-w6_w7@w8[w9`w10{w11")]
    return rows


ITEMS = [(1, "w1 W2, w3 w3"), (2, "w59 w58 w57 w1 w0 w4"), (2, "w59 w58 w57 w1 w0 w4"), (2, "w7"), (3, None), (4, ""), (None, "w5 é"), (None, None), (5, "nowhere"),
         (6, "ünder Ünder w0 " + " ".join(f"w{i}" for i in range(60))), (7, "w4")]


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def frames(spark, docs, items):
    return (spark.createDataFrame(docs, "doc_id long, text string").withColumns({c: F.lit("x") for c in ("id", "n", "terms", "tf", "rank", "score", "item_id")}),
            spark.createDataFrame(items, "item_id long, text string").withColumns({c: F.lit(0) for c in ("no", "item", "rank", "score", "doc_id")}))


def test_awkward_rows(spark, monkeypatch):
    docs = corpus(3, 400)
    want = brute(docs, ITEMS)
    df, items = frames(spark, docs, ITEMS)
    assert rows_of(ball_tree.search(df, items)) == want
    for leaf, entries, shard in ((1, 40, 1 << 20), (3, 700, 60), (1000, 5, 200)):
        monkeypatch.setattr(ball_tree, "LEAF", leaf)
        monkeypatch.setattr(ball_tree, "BLOCK_ENTRIES", entries)
        monkeypatch.setattr(ball_tree, "SHARD_BYTES", shard)
        assert rows_of(ball_tree.search(df.repartition(3), items)) == want


def test_fewer_documents_than_k_and_none(spark):
    docs = [(1, "a b"), (2, "b c"), (3, None)]
    df, items = frames(spark, docs, [(1, "a b b"), (2, "z")])
    assert rows_of(ball_tree.search(df, items)) == brute(docs, [(1, "a b b"), (2, "z")])
    none, no_items = frames(spark, [], [])
    assert ball_tree.search(none, items).collect() == [] and ball_tree.search(df, no_items).collect() == []


def test_bounds_hold_and_prune(monkeypatch):
    monkeypatch.setattr(ball_tree, "LEAF", 4)
    rng = np.random.default_rng(2)
    size, n = 200, 600
    # Twenty groups of near copies: what a ball is good at.
    bases = [rng.choice(size, 25, replace=False) for _ in range(20)]
    rows = [np.unique(np.r_[bases[i % 20], rng.integers(0, size, 2)]) for i in range(n)]
    value = [np.random.default_rng(i % 20).integers(1, 10**10, size)[r] + rng.integers(0, 1000, len(r)) for i, r in enumerate(rows)]
    tree = ball_tree.Tree(np.r_[0, np.cumsum([len(r) for r in rows])], np.concatenate(rows), np.concatenate(value), np.arange(n), size)
    dense = np.zeros((n, size), np.int64)
    for i, (r, v) in enumerate(zip(rows, value)):
        dense[i, r] = v
    visited = []
    entries = tree.entries
    for q in range(30):
        terms = np.unique(rng.choice(bases[q % 20], 8)) if q % 3 else np.sort(rng.choice(size, 6, replace=False))
        counts = rng.integers(1, 4, len(terms))
        score = dense[:, terms] @ counts
        for node, below in enumerate(tree.rows):
            assert tree.bound(node, terms, counts) >= score[below].max()
        seen = []
        monkeypatch.setattr(tree, "entries", lambda rows: seen.append(len(rows)) or entries(rows))
        got = tree.search(terms, counts, [], 5, np.zeros(size, np.int64))
        monkeypatch.setattr(tree, "entries", entries)
        visited.append(sum(seen))
        want = sorted(zip((-score).tolist(), range(n)))[:5]
        assert got == [x for x in want if x[0] < 0]
    assert np.mean(visited) < n / 2


@pytest.mark.skipif(not os.path.isdir(SF), reason="test data not present")
def test_sql_agrees(spark):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    df = queries.op12_ranked_search(spark, SF)
    assert rows_of(df) == sorted(con.execute(f"SELECT {', '.join(df.columns)} FROM ({queries.ORACLE['op12_ranked_search']})").fetchall(), key=repr)
