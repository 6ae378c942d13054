"""Ranked lexical search by sparse ball trees (operator 12).

A document's score for an item is an inner product: for every occurrence of a term in the item,
its weight w = floor(1000 ln((2N + 2) / (2 df + 1))) times the document's integer
(1e9 tf) div (1000 tf + 12 m), m = 100 - 25 + ((25 n N) div L).  The search is exact:

1. One pass over the texts counts each document's terms and keeps those that some item has
   (the others meet no query): a sparse vector per document, written once.  N, L and df are
   aggregates over all documents.
2. Tasks take the vectors in blocks, grow a ball tree over each block (a node is cut at the median
   of the projection onto two documents far apart) and search it for every item, best-first: the
   node with the highest bound next, until no bound reaches the item's k-th score so far, which
   a task carries from block to block.  A node's bound is the smaller of two that hold for every
   document below it: q.c + |q| r, with centroid c, radius r and q cut to the terms that the node has, and the same
   with a radius for each term, which is q.M with M the largest component per term.  The
   first is rounded up by more than its rounding error can be; the second is in integers.  A leaf scores
   its documents in 64-bit integers.
3. A task sends at most ``k`` rows an item; a window with a partial limit merges them.

The items are a stated query set.  They are taken in shards of about ``SHARD_BYTES`` of text; each
shard is a pass over the documents, and only a shard's terms and items are sent to the tasks.

Defined results: rows of equal item id and text are one item; a null item id is an id like others;
items and documents without terms (null, empty) have no result rows; a null document id comes
after all others among equal scores; repeated document rows are documents like others; an empty
table gives no rows; other columns are ignored.  Terms are told apart by 64-bit hashes.
"""

from __future__ import annotations

import heapq
import math
from typing import Iterator, NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from guestlens.llm.blocks import buffer_of, slices, words
from guestlens.llm.tables import as_binary, materialize, text_bytes

K = 20
LEAF = 32                   # documents in a leaf
BLOCK_ENTRIES = 1 << 20     # entries of the vectors in one tree
SHARD_BYTES = 1 << 20       # item text searched in one pass
LAST = np.iinfo(np.int64).max


def separators() -> np.ndarray:
    """Bytes that are no part of a term: all but 0-9, A-Z, a-z and those above 0x7F."""
    t = np.ones(256, bool)
    t[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False
    return t


class Queries(NamedTuple):
    vocabulary: np.ndarray  # sorted hashes of all terms
    terms: list             # per item: positions in the vocabulary, ascending
    counts: list            # and how often the item has them


def queries_of(texts: list) -> Queries:
    w = words(*buffer_of(pa.array([(t or "").encode() for t in texts], pa.binary())), separators())
    vocabulary, place = np.unique(w.hash, return_inverse=True)
    ends = np.cumsum(w.count)
    parts = [np.unique(place[e - n:e], return_counts=True) for e, n in zip(ends, w.count)]
    return Queries(vocabulary, [p[0] for p in parts], [p[1].astype(np.int64) for p in parts])


def term_vectors(df: DataFrame, vocabulary: np.ndarray, id_col: str, text_col: str) -> DataFrame:
    """(id, n, terms, tf) per document: number of all terms, and those of the vocabulary with their counts."""
    empty = separators()

    def run(batches):
        for block in slices(batches, "text"):
            w = words(*buffer_of(block.column("text")), empty)
            at = np.searchsorted(vocabulary, w.hash).clip(max=max(0, len(vocabulary) - 1))
            known = vocabulary[at] == w.hash if len(vocabulary) else np.zeros(len(at), bool)
            key, tf = np.unique(w.doc[known] * max(1, len(vocabulary)) + at[known], return_counts=True)
            doc, term = np.divmod(key, max(1, len(vocabulary)))
            offsets = pa.array(np.searchsorted(doc, np.arange(block.num_rows + 1)).astype(np.int32))
            lists = [pa.ListArray.from_arrays(offsets, pa.array(x.astype(np.int32))) for x in (term, tf)]
            yield pa.RecordBatch.from_arrays([block.column("id"), pa.array(w.count.astype(np.int64)), *lists], names=["id", "n", "terms", "tf"])
    return df.select(F.col(id_col).cast("long").alias("id"), as_binary(text_col).alias("text")).mapInArrow(
        run, "id long, n long, terms array<int>, tf array<int>")


class Corpus(NamedTuple):
    documents: int          # N
    length: int             # L
    weight: np.ndarray      # per term of the vocabulary


def corpus_of(vectors: DataFrame, size: int) -> Corpus:
    n, length = vectors.agg(F.count(F.when(F.col("n") > 0, 1)), F.sum("n")).first()
    weight = np.zeros(size, np.int64)
    for r in vectors.select(F.explode("terms").alias("term")).groupBy("term").count().collect():     # one row a term of the items
        weight[r.term] = math.floor(1000 * math.log((2 * n + 2) / (2 * r["count"] + 1)))
    return Corpus(n, length or 0, weight)


def values(n: np.ndarray, tf: np.ndarray, per_row: np.ndarray, corpus: Corpus) -> np.ndarray:
    """(1e9 tf) div (1000 tf + 12 m) of each entry; ``per_row`` entries belong to each document."""
    wide = n.astype(object) if len(n) and int(n.max()) * 25 * corpus.documents > LAST else n
    m = (75 + (25 * wide * corpus.documents) // max(1, corpus.length)).astype(np.int64)
    return (1_000_000_000 * tf) // (1000 * tf + 12 * np.repeat(m, per_row))


class Tree:
    """Ball tree over sparse integer rows (``start``, ``term``, ``value``); ``key`` orders equal scores."""

    def __init__(self, start, term, value, key, size):
        self.start, self.term, self.value, self.key, self.size = start, term, value, key, size
        self.norm = np.add.reduceat(value.astype(float) ** 2, start[:-1]) if len(key) else np.zeros(0)
        self.rows, self.below, self.least, self.terms, self.centre, self.most, self.radius = [], [], [], [], [], [], []
        stack = [(np.arange(len(key)), None)] if len(key) else []
        while stack:
            rows, parent = stack.pop()
            node = self._add(rows)
            if parent is not None:
                self.below[parent].append(node)
            if len(rows) > LEAF:
                stack += [(half, node) for half in self._cut(rows)]

    def entries(self, rows):
        """Positions of the rows' entries, and where each row's begin among them."""
        n = self.start[rows + 1] - self.start[rows]
        begin = np.cumsum(n) - n
        return np.repeat(self.start[rows] - begin, n) + np.arange(n.sum()), begin

    def _add(self, rows) -> int:
        at, begin = self.entries(rows)
        term, value = self.term[at], self.value[at].astype(float)
        sums = np.bincount(term, value, self.size) / len(rows)
        most = np.zeros(self.size, np.int64)
        np.maximum.at(most, term, self.value[at])
        has = np.flatnonzero(most)
        square = float(sums @ sums)
        far = self.norm[rows] + square - 2 * np.add.reduceat(value * sums[term], begin)
        # More than the error of these sums, as a difference of squares may cancel.
        far = np.maximum(far, 0) + 1e-9 * (self.norm[rows] + square)
        for own, x in ((self.rows, rows), (self.below, []), (self.least, int(self.key[rows].min())), (self.terms, has),
                       (self.centre, sums[has]), (self.most, most[has]), (self.radius, math.sqrt(far.max()))):
            own.append(x)
        return len(self.rows) - 1

    def _cut(self, rows):
        at, begin = self.entries(rows)
        term, value = self.term[at], self.value[at].astype(float)

        def products(row):
            dense = np.zeros(self.size)
            own = slice(self.start[row], self.start[row + 1])
            dense[self.term[own]] = self.value[own]
            return np.add.reduceat(value * dense[term], begin)
        first = rows[np.argmax(self.norm[rows] - 2 * products(rows[0]))]
        to_first = products(first)
        second = rows[np.argmax(self.norm[rows] - 2 * to_first)]
        order = np.argsort(to_first - products(second), kind="stable")
        return rows[order[:len(rows) // 2]], rows[order[len(rows) // 2:]]

    def bound(self, node: int, terms, counts) -> float:
        """No document below the node scores more."""
        has = self.terms[node]
        at = np.searchsorted(has, terms)
        at[at == len(has)] = 0
        both = has[at] == terms
        if not both.any():
            return 0
        at, counts = at[both], counts[both]
        box = int(counts @ self.most[node][at])
        ball = float(counts @ self.centre[node][at]) + math.sqrt(float(counts @ counts)) * self.radius[node]
        return min(box, ball * (1 + 1e-9) + 1)

    def search(self, terms, counts, best: list, k: int, query: np.ndarray) -> list:
        """``best`` ((-score, key) ascending, at most ``k``) with this tree's documents merged in; ``query``
        is a row of zeros to work on."""
        if not self.rows or not len(terms):
            return best
        query[terms] = counts
        heap = [(-self.bound(0, terms, counts), 0)]
        while heap:
            high, node = heapq.heappop(heap)
            if not high or len(best) == k and high > best[-1][0]:
                break
            if len(best) == k and (high, self.least[node]) > best[-1]:
                continue
            if self.below[node]:
                for child in self.below[node]:
                    high = -self.bound(child, terms, counts)
                    if high and (len(best) < k or high <= best[-1][0]):
                        heapq.heappush(heap, (high, child))
                continue
            rows = self.rows[node]
            at, begin = self.entries(rows)
            score = np.add.reduceat(self.value[at] * query[self.term[at]], begin)
            good = score > 0 if len(best) < k else score >= max(1, -best[-1][0])
            if good.any():
                best = sorted(best + list(zip((-score[good]).tolist(), self.key[rows[good]].tolist())))[:k]
        query[terms] = 0
        return best


def _vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """Blocks of about ``BLOCK_ENTRIES`` entries: ids, n, entries per document, terms, tf."""
    held, n = [], 0

    def block():
        ids = np.concatenate([h[0] for h in held])
        return (ids, *(np.concatenate([h[i] for h in held]) for i in range(1, 5)))
    for batch in batches:
        ids, n_all, terms, tf = (batch.column(c) for c in ("id", "n", "terms", "tf"))
        sizes = np.diff(terms.offsets.to_numpy())
        ends, at = np.cumsum(sizes), 0
        flat, often = terms.flatten().to_numpy(), tf.flatten().to_numpy().astype(np.int64)
        id_ = ids.fill_null(int(LAST)).to_numpy()
        while at < len(sizes):
            base = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, base + BLOCK_ENTRIES - n, side="right")))
            held.append((id_[at:to], n_all.to_numpy()[at:to], sizes[at:to], flat[base:ends[to - 1]], often[base:ends[to - 1]]))
            n += int(ends[to - 1] - base)
            at = to
            if n >= BLOCK_ENTRIES or at < len(sizes):
                yield block()
                held, n = [], 0
    if held:
        yield block()


def search(df: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
           item_text: str = "text", k: int = K) -> DataFrame:
    """Each item's ``k`` documents of highest score above 0: item id, rank, document id, score."""
    spark = df.sparkSession
    asked = items.select(F.col(item_col).alias("item"), F.col(item_text).cast("string").alias("text")).distinct()
    shards = max(1, -(-text_bytes(asked, "text") // SHARD_BYTES))
    out = None
    for shard in range(shards):
        mine = asked.where(F.pmod(F.xxhash64("item", "text"), F.lit(shards)) == shard) if shards > 1 else asked
        rows = mine.collect()                                      # about SHARD_BYTES
        queries = queries_of([r.text for r in rows])
        vectors = materialize(term_vectors(df, queries.vocabulary, id_col, text_col), "term-vectors")
        found = _found(vectors, queries, corpus_of(vectors, len(queries.vocabulary)), k)
        names = spark.createDataFrame([(i, r.item) for i, r in enumerate(rows)],
                                      T.StructType([T.StructField("no", T.IntegerType()), T.StructField("item", asked.schema["item"].dataType)]))
        one = found.join(names, "no")
        out = one if out is None else out.unionByName(one)
    return out.select(F.col("item").alias(item_col), "rank", F.col("id").alias(id_col), "score")


def _found(vectors: DataFrame, queries: Queries, corpus: Corpus, k: int) -> DataFrame:
    size = max(1, len(queries.vocabulary))
    sent = vectors.sparkSession.sparkContext.broadcast((queries, corpus))

    def run(batches):
        queries, corpus = sent.value
        best: list = [[] for _ in queries.terms]
        query = np.zeros(size, np.int64)
        for ids, n, sizes, term, tf in _vectors(batches):
            held = sizes > 0                                       # the others score 0
            value = values(n, tf, sizes, corpus) * corpus.weight[term]
            tree = Tree(np.r_[0, np.cumsum(sizes[held])], term, value, ids[held], size)
            for i, (terms, counts) in enumerate(zip(queries.terms, queries.counts)):
                best[i] = tree.search(terms, counts, best[i], k, query)
        no = np.repeat(np.arange(len(best)), [len(b) for b in best])
        flat = [x for b in best for x in b]
        yield pa.RecordBatch.from_arrays([pa.array(no, pa.int32()), pa.array([None if x[1] == LAST else x[1] for x in flat], pa.int64()),
                                          pa.array([-x[0] for x in flat], pa.int64())], names=["no", "id", "score"])
    top = Window.partitionBy("no").orderBy(F.desc("score"), F.col("id").asc_nulls_last())
    found = vectors.select("id", "n", "terms", "tf").mapInArrow(run, "no int, id long, score long")
    return found.withColumn("rank", F.row_number().over(top)).where(F.col("rank") <= k)
