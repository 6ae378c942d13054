"""Approximate nearest neighbours by multiprobe p-stable hashing (operator 9).

Largest inner product becomes smallest distance by one more coordinate: a vector x gets
sqrt(M^2 - |x|^2), M the largest norm, and a query gets 0.  In each of ``TABLES`` tables a
bucket is the ``DIMS`` integers floor((a.x + b) / width) for Gaussian (2-stable) a.  A
query visits the buckets around its own in order of estimated success: perturbations
by -1, 0 or 1 per coordinate by the sum of squared distances to the boundaries crossed.

The number of probes is fitted on a bounded sample (``SAMPLE_ROWS`` rows, ``SAMPLE_QUERIES``
queries, taken by hash): the fewest that find ``RECALL`` of the true neighbours there.  In the
sample neighbours are farther apart than in the whole table, so this errs towards more.
All rows are indexed, and no bucket is capped.

A query that meets fewer than ``k`` candidates, though there are more, is searched once more, exactly,
against blocks of all rows; this costs rows times such queries.

Rows are dealt by (table, shard of the bucket); they travel as packed blocks of at most
``BLOCK_ROWS`` vectors, queries as packed bundles with their probes, and a join
brings them together, so that a shard with a third of all rows (one very common vector)
is many rows of the join, which AQE may split.  Each task keeps the best ``k`` per query;
the candidates of all tables merge in one window.  Scores are inner products of the
original vectors in double precision, added up in the same way for each pair, so that equal vectors
tie and the smaller id wins.

Defined results: vectors that are null, zero, hold null or non-finite components or have another
than the most frequent length (ties: the shorter) take no part; a query's own id is no candidate;
rows that repeat an id count once, with the best score; other columns are ignored;
an empty table gives an empty result.
"""

from __future__ import annotations

from itertools import product
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from guestlens.llm.tables import materialize

TABLES, DIMS = 8, 6
WIDTH = 1.35                # in median distances to the k-th neighbour
RECALL = 0.96               # on the sample
SAMPLE_ROWS, SAMPLE_QUERIES = 20_000, 150
BLOCK_ROWS = 4096
BUNDLE_ROWS = 16_384
SHARD_BYTES = 32 << 20
SEED = 5


class Hashing(NamedTuple):
    size: int               # coordinates of a vector
    norm: float             # M
    a: np.ndarray           # (size + 1, TABLES * DIMS)
    b: np.ndarray
    width: float
    probes: int
    shards: int


MOVES = np.array(list(product((-1, 0, 1), repeat=DIMS)))
_MIX = np.random.default_rng(1).integers(1, 2**62, DIMS) | 1


def _spread(x: np.ndarray, h: Hashing, query: bool) -> np.ndarray:
    """(a.x + b) / width, per row, table and dimension."""
    last = np.zeros(len(x)) if query else np.sqrt(np.maximum(0.0, h.norm**2 - (x * x).sum(1)))
    return ((np.c_[x, last] @ h.a + h.b) / h.width).reshape(len(x), TABLES, DIMS)


def codes(x: np.ndarray, h: Hashing) -> np.ndarray:
    """Bucket of each row in each table."""
    return (np.floor(_spread(x, h, False)).astype(np.int64) * _MIX).sum(2)


def probes(x: np.ndarray, h: Hashing, most: int | None = None) -> np.ndarray:
    """Buckets each query visits in each table, likeliest first."""
    f = _spread(x, h, True)
    base = np.floor(f).astype(np.int64)
    low = f - base
    cost = np.stack([low**2, np.zeros_like(low), (1 - low) ** 2], 3)
    most = most or h.probes
    out = np.empty((len(x), TABLES, most), np.int64)
    for t in range(TABLES):
        total = sum(cost[:, t, d, MOVES[:, d] + 1] for d in range(DIMS))
        order = np.argsort(total, 1, kind="stable")[:, :most]
        out[:, t] = ((base[:, t, None, :] + MOVES[order]) * _MIX).sum(2)
    return out


def fit(sample: np.ndarray, norm: float, k: int, shards: int) -> Hashing:
    rng = np.random.default_rng(SEED)
    size = sample.shape[1]
    a, b = rng.normal(size=(size + 1, TABLES * DIMS)), rng.uniform(0, 1, TABLES * DIMS)
    queries = sample[:SAMPLE_QUERIES]
    near = queries @ sample.T
    near[np.arange(len(queries)), np.arange(len(queries))] = -np.inf
    k = min(k, len(sample) - 1)
    if k < 1:
        return Hashing(size, norm, a, b, 1.0, len(MOVES), shards)
    top = np.argsort(-near, 1)[:, :k]
    edge = np.take_along_axis(near, top[:, -1:], 1)[:, 0]
    far = np.sqrt(np.maximum(norm**2 + (queries**2).sum(1) - 2 * edge, 1e-12))
    width = WIDTH * float(np.median(far))
    h = Hashing(size, norm, a, b * width, width, len(MOVES), shards)
    own, visits = codes(sample, h), probes(queries, h)
    found = np.full(top.shape, len(MOVES))                # probes needed to meet the neighbour
    for t in range(TABLES):
        hit = visits[:, t, None, :] == own[top, t][:, :, None]
        found = np.minimum(found, np.where(hit.any(2), hit.argmax(2), len(MOVES)))
    need = np.sort(found.ravel())[min(found.size - 1, int(np.ceil(RECALL * found.size)) - 1)]
    return h._replace(probes=int(min(len(MOVES), need + 1)))


def _matrix(column) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def _index(batches, h: Hashing):
    for batch in batches:
        if not batch.num_rows:
            continue
        ids, x = batch.column("id").to_numpy(), _matrix(batch.column("x"))
        own = codes(x, h)
        rows = []
        for t in range(TABLES):
            shard = own[:, t] % h.shards
            order = np.argsort(shard, kind="stable")
            cuts = np.flatnonzero(np.r_[True, shard[order][1:] != shard[order][:-1]])
            for a, b in zip(cuts, np.r_[cuts[1:], len(order)]):
                for c in range(a, b, BLOCK_ROWS):
                    at = order[c:min(b, c + BLOCK_ROWS)]
                    rows.append((t * h.shards + int(shard[at[0]]), ids[at].tobytes(), own[at, t].tobytes(), x[at].tobytes()))
        yield _packed(rows, ["part", "ids", "codes", "x"])


def _ask(batches, h: Hashing):
    for batch in batches:
        for start in range(0, batch.num_rows, 1024):
            some = batch.slice(start, 1024)
            ids, x = some.column("id").to_numpy(), _matrix(some.column("x"))
            visits = probes(x, h)
            rows = []
            for t in range(TABLES):
                shard = visits[:, t] % h.shards
                for s in np.unique(shard).tolist():
                    at = np.flatnonzero((shard == s).any(1))
                    rows.append((t * h.shards + s, ids[at].tobytes(), visits[at, t].tobytes(), x[at].tobytes()))
            yield _packed(rows, ["part", "q_ids", "q_codes", "q_x"])


def _blocks(batches, names: list[str], most: int):
    """Packed rows of one bucket that every query visits."""
    for batch in batches:
        for start in range(0, batch.num_rows, most):
            some = batch.slice(start, most)
            n = some.num_rows
            yield _packed([(0, some.column("id").to_numpy().tobytes(), np.zeros(n, np.int64).tobytes(), _matrix(some.column("x")).tobytes())], names)


def _packed(rows, names):
    cols = list(zip(*rows))
    return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), *(pa.array(c, pa.binary()) for c in cols[1:])], names)


def _best(ids, score, k):
    """Places of the k best: largest score, then smallest id; an id counts once."""
    order = np.lexsort((ids, -score))
    _, first = np.unique(ids[order], return_index=True)
    return order[np.sort(first)[:k]]


def _products(row: dict, size: int) -> tuple:
    """ids, vectors (by bucket), query ids, queries, and their inner products where a query visits the
    row's bucket (else -inf): only a bucket's visitors meet its rows."""
    ids, own = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["codes"], np.int64)
    order = np.argsort(own, kind="stable")
    ids, x = ids[order], np.frombuffer(row["x"], np.float64).reshape(-1, size)[order]
    q_ids = np.frombuffer(row["q_ids"], np.int64)
    q = np.frombuffer(row["q_x"], np.float64).reshape(-1, size)
    visits = np.frombuffer(row["q_codes"], np.int64).reshape(len(q_ids), -1)
    buckets, start = np.unique(own[order], return_index=True)
    at = np.minimum(np.searchsorted(buckets, visits), len(buckets) - 1)
    meets = np.zeros((len(buckets), len(q_ids)), bool)
    i, j = np.nonzero(buckets[at] == visits)
    meets[at[i, j], i] = True
    near = np.full((len(q_ids), len(ids)), -np.inf)
    for bucket, (a, b) in enumerate(zip(start, np.r_[start[1:], len(ids)])):
        who = np.flatnonzero(meets[bucket])
        if len(who):
            near[who, a:b] = q[who] @ x[a:b].T
    for column in np.flatnonzero(np.isin(ids, q_ids)):
        near[q_ids == ids[column], column] = -np.inf
    return ids, x, q_ids, q, near


def _search(batches, size: int, k: int):
    """The best candidates of a task for each query; several thousand queries at a time.  A query's k-th score
    so far goes on from block to block, so that later blocks hand over little."""
    best: dict[int, tuple] = {}
    for batch in batches:
        for row in batch.to_pylist():
            ids, x, q_ids, q, near = _products(row, size)
            least = np.array([best[i][1][-1] if i in best and len(best[i][0]) == k else -np.inf for i in q_ids.tolist()])
            open_ = np.flatnonzero(least == -np.inf)
            if near.shape[1] > k and len(open_):
                least[open_] = np.partition(near[open_], -k, axis=1)[:, -k]
            # The products of a matrix may differ in the last bits from those that count.
            least -= np.where(least > -np.inf, 1e-6 * (1 + np.abs(least)), 0)
            n, at = np.nonzero((near >= least[:, None]) & (near > -np.inf))
            score = (x[at] * q[n]).sum(1)
            cuts = np.flatnonzero(np.r_[True, n[1:] != n[:-1]]) if len(n) else []
            for a, b in zip(cuts, np.r_[cuts[1:], len(n)] if len(n) else []):
                query = int(q_ids[n[a]])
                cand, value = ids[at[a:b]], score[a:b]
                if query in best:
                    cand, value = np.r_[best[query][0], cand], np.r_[best[query][1], value]
                top = _best(cand, value, k)
                best[query] = (cand[top], value[top])
            if len(best) > 100_000:
                yield from _flush(best)
    yield from _flush(best)


def _flush(best):
    if best:
        n = [len(v[0]) for v in best.values()]
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(list(best), n)), pa.array(np.concatenate([v[0] for v in best.values()])),
                                          pa.array(np.concatenate([v[1] for v in best.values()]))], ["query_id", "vec_id", "score"])
        best.clear()


def usable(df: DataFrame, is_query: Column, id_col: str, vec_col: str) -> DataFrame:
    """(id, x, asks, norm2) of the vectors that take part."""
    x = F.col(vec_col).cast("array<double>")
    good = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
    rows = df.where(F.col(id_col).isNotNull() & F.col(vec_col).isNotNull()).select(
        F.col(id_col).cast("long").alias("id"), x.alias("x"), is_query.alias("asks"), good.alias("good"))
    rows = rows.where("good").withColumn("norm2", F.aggregate("x", F.lit(0.0), lambda s, v: s + v * v))
    return rows.where("norm2 > 0").drop("good")


def search(df: DataFrame, is_query: Column, id_col: str = "vec_id", vec_col: str = "embedding", k: int = 20) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found of every row where ``is_query`` holds."""
    spark = df.sparkSession
    out = "query_id long, vec_id long, score double"
    every = materialize(usable(df, is_query, id_col, vec_col), "vectors")
    lengths = every.groupBy(F.size("x").alias("size")).agg(F.count("*").alias("n"), F.max("norm2").alias("m")).orderBy(F.desc("n"), "size").first()
    if lengths is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    rows = every.where(F.size("x") == lengths.size)
    share = min(1.0, SAMPLE_ROWS / lengths.n)
    sample = rows.where(F.pmod(F.xxhash64("id"), F.lit(1_000_000)) < int(share * 1_000_000)).orderBy(F.xxhash64("id", F.lit(1))).limit(SAMPLE_ROWS).select("x").collect()
    shards = max(1, -(-lengths.n * lengths.size * 8 // SHARD_BYTES))
    h = fit(np.array([r[0] for r in sample]) if sample else np.zeros((0, lengths.size)), float(np.sqrt(lengths.m)), k, shards)
    sent = spark.sparkContext.broadcast(h)
    index = rows.select("id", "x").mapInArrow(lambda it: _index(it, sent.value), "part long, ids binary, codes binary, x binary")
    asked = rows.where("asks").select("id", "x").mapInArrow(lambda it: _ask(it, sent.value), "part long, q_ids binary, q_codes binary, q_x binary")
    found = index.join(asked, "part").mapInArrow(lambda it: _search(it, lengths.size, k), out)
    found = materialize(_ranked(found, k), "nearest")
    # Queries short of candidates: ``asks`` rows with fewer results than k, or than all other ids.
    most = min(k, rows.select("id").distinct().limit(k + 1).count() - 1)
    met = found.groupBy("query_id").agg(F.count("*").alias("n"))
    short = rows.where("asks").join(met.where(F.col("n") >= most), F.col("id") == F.col("query_id"), "left_anti").select("id", "x")
    short = materialize(short, "short-queries")
    n_short = short.count() if most > 0 else 0
    if not n_short:
        return found
    blocks = rows.select("id", "x").mapInArrow(lambda it: _blocks(it, ["part", "ids", "codes", "x"], BLOCK_ROWS), "part long, ids binary, codes binary, x binary")
    bundles = (short.repartition(-(-n_short // BUNDLE_ROWS))
               .mapInArrow(lambda it: _blocks(it, ["q_part", "q_ids", "q_codes", "q_x"], 1024), "q_part long, q_ids binary, q_codes binary, q_x binary"))
    exact = blocks.crossJoin(bundles).mapInArrow(lambda it: _search(it, lengths.size, k), out)
    return found.join(short.select(F.col("id").alias("query_id")), "query_id", "left_anti").union(_ranked(exact, k))


def _ranked(found: DataFrame, k: int) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best of the candidates of all tasks."""
    merged = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return merged.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
