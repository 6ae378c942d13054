"""Vector codes against plain Python and their SQL, on awkward vectors and over many blocks and batches of nodes."""

import hashlib
import math
import os
import random
from collections import defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from guestlens.llm import queries, vector_codes

SF = "/root/testdata/sf0.001"
SCHEMA = "vec_id long, embedding array<float>, label string"


def brute(rows, parts=16, entries=64, rounds=2):
    kept = [r for r in rows if r[1] is not None and all(x is not None and math.isfinite(x) for x in r[1])]
    if not kept:
        return []
    width = -(-max(1, max(len(r[1]) for r in kept)) // parts)
    cells = []
    for _, vector, _ in kept:
        own = [math.floor(256 * x) for x in vector] + [0] * (parts * width - len(vector))
        cells.append([tuple(own[p * width:(p + 1) * width]) for p in range(parts)])
    order = sorted(range(len(kept)), key=lambda i: (kept[i][0] is None, kept[i][0] or 0, kept[i][1]))[:entries]
    books = [[cells[i][p] for i in order] for p in range(parts)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    pick = lambda x, book: min(range(len(book)), key=lambda k: (far(x, book[k]), k))
    for _ in range(rounds):
        for p in range(parts):
            mine = defaultdict(list)
            for c in cells:
                mine[pick(c[p], books[p])].append(c[p])
            for k, own in mine.items():
                books[p][k] = tuple(sum(x[j] for x in own) // len(own) for j in range(width))
    sha = hashlib.sha256(",".join(str(x) for book in books for entry in book for x in entry).encode()).hexdigest()
    out, sums = [], defaultdict(int)
    for (i, _, label), c in zip(kept, cells):
        ks = [pick(c[p], books[p]) for p in range(parts)]
        error = sum(far(c[p], books[p][k]) for p, k in enumerate(ks))
        sums[label] += error
        out.append((i, "".join(f"{k:02x}" for k in ks), error, label))
    return sorted(((i, code, error, sums[label], sha) for i, code, error, label in out), key=repr)


def some(n, dim, seed=3, grid=None):
    rng = random.Random(seed)
    value = (lambda: rng.choice(grid)) if grid else (lambda: float(np.float32(rng.gauss(0, 0.2))))
    return [(rng.randrange(10 * n), [value() for _ in range(dim)], rng.choice(["a", "b", None])) for _ in range(n)]


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit(1) for c in ("code", "error", "of", "id", "vector", "label_error")})


def test_awkward_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = some(120, 32) + [(None, [0.5] * 32, "a"), (None, [0.25] * 32, None), (1, None, "a"), (2, [nan] + [0.0] * 31, "b"), (3, [inf] * 32, "b"),
                            (4, [None] + [0.0] * 31, None), (5, [], "a"), (6, [0.5] * 7, "b")] + [(-1, [-0.001] * 32, "c")] * 5
    assert rows_of(vector_codes.compress(frame(spark, rows))) == brute(rows)


@pytest.mark.parametrize("dim", [1, 16, 40])
def test_few_vectors(spark, dim):
    rows = some(9, dim)
    assert rows_of(vector_codes.compress(frame(spark, rows))) == brute(rows)


def test_empty_table(spark):
    assert vector_codes.compress(frame(spark, [])).collect() == []
    assert vector_codes.compress(frame(spark, [(1, None, "a")])).collect() == []


def test_blocks_and_batches_of_nodes(spark, monkeypatch):
    """Parts of few values, so that prefixes are shared; blocks and batches far smaller than the data."""
    rows = some(700, 64, grid=[-0.5, -0.01, 0.0, 0.01, 0.3])
    want = brute(rows)
    assert rows_of(vector_codes.compress(frame(spark, rows).repartition(3))) == want
    monkeypatch.setattr(vector_codes, "NODES", 3)
    monkeypatch.setattr(vector_codes, "BLOCK_VALUES", 64 * 50)
    assert rows_of(vector_codes.compress(frame(spark, rows).repartition(3))) == want


def test_trie_walk_is_the_nearest_entry(monkeypatch):
    rng = np.random.default_rng(5)
    for nodes in (1, 2, 7, 1000):
        monkeypatch.setattr(vector_codes, "NODES", nodes)
        for width in (1, 2, 5):
            parts, book = rng.integers(-4, 4, (300, width)), rng.integers(-4, 4, (9, width))
            index, error, totals = vector_codes.nearest_entries(parts, book)
            far = ((parts[:, None] - book) ** 2).sum(2)
            assert (index == far.argmin(1)).all() and (error == far.min(1)).all()
            for k in range(9):
                assert totals[k].tolist() == [*parts[index == k].sum(0).tolist(), int((index == k).sum())]


def test_large_components_stay_in_64_bits(spark):
    rows = [(1, [1e30] * 16, None), (2, [-1e30] * 16, None), (3, [0.0] * 16, None)]
    got = vector_codes.compress(frame(spark, rows)).collect()
    assert len(got) == 3 and all(r.error == 0 for r in got)


@pytest.mark.skipif(not os.path.isdir(SF), reason="test data not present")
def test_sql_agrees(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{SF}/embeddings.parquet')")
    df = queries.op13_vector_codes(spark, SF)
    assert rows_of(df) == sorted(con.execute(f"SELECT {', '.join(df.columns)} FROM ({queries.ORACLE['op13_vector_codes']})").fetchall(), key=repr)
