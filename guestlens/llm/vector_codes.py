"""Vector code compression (operator 13): product quantisation over lexicographic tries.

A vector's components become integers floor(scale * x) and the vector is cut into equal parts.
Each part position has a codebook, which starts as that part of the vectors with the smallest ids;
a round assigns every part to its nearest entry and replaces each entry by the componentwise
floor of the mean of its parts.

A task takes its vectors in blocks.  The distinct parts of a block, in lexicographic order, are
the leaves of a trie over components.  The trie is walked depth first: a node holds the squared
distances of its prefix to the same prefix of all entries, its children add one component's
squares to that, so parts with a common prefix share the sums; a leaf takes the nearest entry
and adds its component sums, times the number of vectors with that part, to the entry.  Siblings go
through numpy together, ``NODES`` at a time, so the walk's memory is bounded by the
depth times ``NODES`` times the number of entries.  A task sends one row per entry component, at the
end of its rows: what is shuffled and what the driver gets (the codebooks: ``ENTRIES`` vectors) does not
depend on the number of rows, and a vector that a third of all rows repeat is one leaf a block.

Defined results: vectors that are null or hold null or non-finite components are dropped;
shorter vectors than the longest, and all where its length is no multiple of the parts, count as
filled up with zeros; components are held to what keeps a distance in 64 bits (2^27 after scaling for 64
dimensions); a null id comes after all others for the first codebooks, equal ids by vector, and is
kept; with fewer vectors than entries the codebooks are as small; repeated rows are rows like others; null
labels are one group; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from typing import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from guestlens.llm.tables import materialize

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
BLOCK_VALUES = 4 << 20      # components in a block
NODES = 2048                # siblings of the trie taken at once


def matrix(column: pa.Array, dim: int, scale: int = SCALE) -> np.ndarray:
    """Integer vectors of an Arrow list column, filled up with zeros to ``dim``."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    size = np.diff(column.offsets.to_numpy())
    out = np.zeros((len(column), dim), np.int64)
    row = np.repeat(np.arange(len(column)), size)
    most = 2.0 ** math.floor((62 - math.log2(dim)) / 2 - 1)
    out[row, np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)] = np.clip(np.floor(scale * flat), -most, most).astype(np.int64)
    return out


def nearest_entries(parts: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each row's part: its nearest entry and squared distance; and per entry the component sums
    and, last, the number of its parts."""
    order = np.lexsort(parts.T[::-1])
    cells = parts[order]
    depth = cells.shape[1]
    new = np.zeros(len(cells), bool)
    firsts = []                                     # per level: first row of each prefix
    new[0] = True
    for level in range(depth):
        new[1:] |= cells[1:, level] != cells[:-1, level]
        firsts.append(np.flatnonzero(new))
    leaves = firsts[-1]
    weight = np.diff(np.r_[leaves, len(cells)])
    index, error = np.empty(len(leaves), np.int64), np.empty(len(leaves), np.int64)
    # A batch: level, its nodes (positions in firsts[level]), their parents' sums and which of them.
    roots = np.arange(len(firsts[0]))
    nothing = np.zeros((1, len(book)), np.int64)
    stack = [(0, roots[at:at + NODES], nothing, np.zeros(min(NODES, len(roots) - at), np.int64)) for at in range(0, len(roots), NODES)][::-1]
    while stack:
        level, nodes, above, parent = stack.pop()
        sums = above[parent] + (cells[firsts[level][nodes], level][:, None] - book[:, level]) ** 2
        if level == depth - 1:
            index[nodes] = best = sums.argmin(1)
            error[nodes] = sums[np.arange(len(nodes)), best]
            continue
        below = firsts[level + 1]
        ends = np.r_[firsts[level], len(cells)]
        low, high = np.searchsorted(below, ends[nodes[0]]), np.searchsorted(below, ends[nodes[-1] + 1])
        children = np.arange(low, high)
        owner = np.searchsorted(firsts[level][nodes], below[low:high], side="right") - 1
        for at in range(0, len(children), NODES)[::-1]:
            stack.append((level + 1, children[at:at + NODES], sums, owner[at:at + NODES]))
    totals = np.zeros((len(book), depth + 1), np.int64)
    np.add.at(totals, index, np.c_[cells[leaves] * weight[:, None], weight])
    leaf = np.empty(len(cells), np.int64)
    leaf[order] = np.repeat(np.arange(len(leaves)), weight)
    return index[leaf], error[leaf], totals


def _blocks(batches: Iterator[pa.RecordBatch], dim: int) -> Iterator[pa.RecordBatch]:
    most, held, n = max(1, BLOCK_VALUES // dim), [], 0
    for batch in batches:
        for at in range(0, batch.num_rows, most):
            held.append(batch.slice(at, most))
            n += held[-1].num_rows
            if n >= most:
                yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                held, n = [], 0
    if n:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def _plain(vector) -> pa.Array:
    return vector.cast(pa.list_(pa.float64()))


def next_books(rows: DataFrame, books: np.ndarray, scale: int = SCALE) -> np.ndarray:
    """One round: ``books`` (parts, entries, components) with each used entry replaced by the floor of the mean of its parts."""
    parts, entries, width = books.shape

    def sums(batches):
        totals = np.zeros((parts, entries, width + 1), np.int64)
        for block in _blocks(batches, parts * width):
            x = matrix(_plain(block.column("vector")), parts * width, scale)
            for p in range(parts):
                totals[p] += nearest_entries(x[:, p * width:(p + 1) * width], books[p])[2]
        part, entry = np.nonzero(totals[:, :, -1])
        at = np.tile(np.arange(width + 1), len(part))
        yield pa.RecordBatch.from_pydict({"part": np.repeat(part, width + 1), "entry": np.repeat(entry, width + 1), "at": at, "total": totals[part, entry].ravel()})

    got = rows.select("vector").mapInArrow(sums, "part long, entry long, at long, total long")
    got = got.groupBy("part", "entry", "at").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total")).collect()
    exact = {(r.part, r.entry, r["at"]): int(r.total) for r in got}
    out = books.copy()
    for (p, e, j), total in exact.items():
        if j < width:
            out[p, e, j] = total // exact[p, e, width]
    return out


def valid_vectors(df: DataFrame, id_col: str, vector_col: str, label_col: str) -> DataFrame:
    vector = F.col(vector_col).cast("array<double>")
    good = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return df.select(F.col(id_col).alias("id"), vector.alias("vector"), F.col(label_col).alias("label")).where(vector.isNotNull() & good)


def fit(rows: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> np.ndarray:
    """Codebooks (parts, entries, components) of ``rows`` (id, vector)."""
    longest = rows.agg(F.max(F.size("vector"))).first()[0] or 1
    width = -(-longest // parts)
    first = rows.orderBy(F.col("id").asc_nulls_last(), "vector").limit(entries).select("vector").collect()
    start = matrix(pa.array([r[0] for r in first], pa.list_(pa.float64())), parts * width, scale)
    books = start.reshape(len(first), parts, width).transpose(1, 0, 2).copy()
    for _ in range(rounds if len(first) else 0):
        books = next_books(rows, books, scale)
    return books


def encode(rows: DataFrame, books: np.ndarray, scale: int = SCALE) -> DataFrame:
    """``rows`` with ``code`` (two hexadecimal digits a part) and ``error``, without the vector."""
    parts, _, width = books.shape
    digits = np.array([b"%02x" % i for i in range(256)], "S2")
    schema = T.StructType([f for f in rows.schema if f.name != "vector"] + [T.StructField("code", T.StringType()), T.StructField("error", T.LongType())])
    names = schema.names[:-2]

    def run(batches):
        for block in _blocks(batches, parts * width):
            x = matrix(_plain(block.column("vector")), parts * width, scale)
            code, error = np.empty((len(x), parts), "S2"), np.zeros(len(x), np.int64)
            for p in range(parts):
                index, far, _ = nearest_entries(x[:, p * width:(p + 1) * width], books[p])
                code[:, p] = digits[index]
                error += far
            text = pa.array(code.view(f"S{2 * parts}")[:, 0].astype(str), pa.string())
            yield pa.RecordBatch.from_arrays([*(block.column(n) for n in names), text, pa.array(error)], names=schema.names)
    return rows.mapInArrow(run, schema)


def digest(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def compress(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """One row per valid vector: id, code, error, label_error (the errors of its label, added up), codebooks_sha256."""
    rows = valid_vectors(df, id_col, vector_col, label_col)
    books = fit(rows)
    # A label may hold most rows: its errors are added up by partial aggregates and joined back.
    coded = materialize(encode(rows, books), "vector-codes")
    label = F.col("label").alias("of")
    sums = coded.groupBy(label).agg(F.sum("error").alias("label_error"))
    return (coded.join(sums, F.col("label").eqNullSafe(F.col("of")))
            .select(F.col("id").alias(id_col), "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256")))
