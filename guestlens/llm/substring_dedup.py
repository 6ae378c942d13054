"""Substring dedup by De Bruijn compaction (operator 10).

A token k-mer (a window of ``k`` consecutive words) is an edge between the
(k-1)-mers of its first and last words.  An edge that starts in a document with a
smaller doc_id is repeated: all the words it covers go, so the smallest
document keeps the passage.

1. *Edges.*  Blocks of documents are hashed with numpy.  Consecutive edges with the
   same minimiser (the smallest hash of ``sub`` words inside the window, equal for
   equal windows wherever they stand) travel together as one path piece to the
   minimiser's bucket, with source coordinates (doc_id, first word).  Within a block
   only the smallest document's copies travel; the others are repeated already.
2. *Repeated edges.*  Each bucket finds the first source (smallest doc_id, then the
   first word) of every edge and compacts the repeated edges of a document into
   pieces whose first sources run on, too: nonbranching paths.
3. *Join.*  Pieces and documents meet by document bucket.  Pieces that touch in
   both coordinates are glued to maximal paths, the spans; their words are removed.

Equal edges are 96 equal bits of hash (64 of the minimiser, 32 of the window).
Volume shuffled: about 8 bytes a word and the texts once.  A passage in a third of
all documents costs one piece per block in its bucket, never a pair of documents.

Defined results: null or blank texts have no words and keep an empty text; texts
shorter than ``k`` words lose nothing; rows with a null doc_id neither remove nor
lose words; equal doc_ids do not remove each other's words; very long texts are
blocks of their own; an empty table gives an empty result; columns besides
``id_col``, ``text_col`` and ``carry`` are ignored, and carried columns named like
a result give way to it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from guestlens.llm import blocks as B
from guestlens.llm.tables import as_binary, bucket_count, text_bytes

K = 13           # words in a window
SUB = 5          # words in a minimiser
BUCKET_BYTES = 8 << 20

RESULT = ["n_words", "n_removed", "kept", "spans"]
SPAN = T.ArrayType(T.StructType([T.StructField(c, T.LongType()) for c in ("start", "end", "src_id", "src_start")]))

# What travels: pieces of edges to a bucket of minimisers (kind 0), or spans that are
# already known to a bucket of documents (kind 1).
PACKED = "bucket long, kind int, docs binary, pieces binary, edges binary"
PIECE = np.dtype([("minimiser", "u8"), ("doc", "u4"), ("pos", "u4"), ("n", "u4")])
SPANS = np.dtype([("id", "i8"), ("row", "i8"), ("start", "i8"), ("end", "i8"), ("src_id", "i8"), ("src_start", "i8")])


def remove_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K,
                   carry: list[str] | None = None) -> DataFrame:
    """One row per row of ``df``: id, text, carried columns, n_words, n_removed,
    kept (the words left, joined by one space) and spans (removed paths: first word,
    word after the last, first source's id and word)."""
    spark = df.sparkSession
    sub = min(SUB, k)
    size = text_bytes(df, text_col)
    n_buckets = bucket_count(spark, size, BUCKET_BYTES)
    rows = F.xxhash64(F.col(id_col), F.col(text_col))
    texts = df.where(F.col(id_col).isNotNull() & (F.length(text_col) >= 2 * k - 1)).select(
        F.col(id_col).cast("long").alias("id"), rows.alias("row"), as_binary(text_col).alias("text"))

    packed = texts.mapInArrow(lambda batches: _edges(batches, k, sub, n_buckets), PACKED)
    spans = packed.groupBy("bucket").applyInArrow(lambda key, table: _repeated(table, k, n_buckets), "bucket long, spans binary")

    keep = [c for c in df.columns if c in (carry or []) and c not in (id_col, text_col, *RESULT)]
    docs = df.select(F.pmod(rows, F.lit(n_buckets)).alias("bucket"), rows.alias("row"), F.col(id_col).alias("id"),
                     F.col(text_col).alias("text"), *([F.struct(*keep).alias("carried")] if keep else []))
    schema = T.StructType(docs.schema.fields[2:] + [T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()),
                                    T.StructField("kept", T.StringType()), T.StructField("spans", SPAN)])
    arrow = _arrow(schema)
    out = (docs.groupBy("bucket").cogroup(spans.groupBy("bucket"))
           .applyInArrow(lambda left, right: _cut(left, right, arrow), schema))
    return out.select(F.col("id").alias(id_col), F.col("text").alias(text_col), *(["carried.*"] if keep else []), *RESULT)


def _arrow(schema: T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    return to_arrow_schema(schema)


def _edges(batches, k, sub, n_buckets):
    for block in B.slices(batches, "text"):
        order = np.argsort(block.column("id").to_numpy(), kind="stable")
        block = block.take(pa.array(order))
        ids, rows = block.column("id").to_numpy(), block.column("row").to_numpy()
        w = B.words(*B.buffer_of(block.column("text")), B.white_space(), fold=False)
        edge, whole = B.windows(w, k)
        at = np.flatnonzero(whole)
        if not len(at):
            continue
        small, _ = B.windows(w, sub)
        least = small
        for j in range(1, k - sub + 1):
            least = np.minimum(least, np.r_[small[j:], np.full(j, np.iinfo(np.uint64).max, np.uint64)])
        edge, least, doc = edge[at], least[at], w.doc[at]
        pos = at - (np.cumsum(w.count) - w.count)[doc]
        id_ = ids[doc]
        first = _firsts(edge)                       # rows are in order of id and place
        again = id_ > id_[first]
        go = np.flatnonzero(~again)
        yield from _send(least[go], edge[go], doc[go], pos[go], ids, rows, n_buckets)
        no = np.flatnonzero(again)
        if len(no):
            out = _pieces(id_[no], rows[doc[no]], pos[no], id_[first[no]], pos[first[no]], k)
            yield from _deal(out, n_buckets, known=True)


def _firsts(edge: np.ndarray) -> np.ndarray:
    """For each edge, the first place in the block with the same edge."""
    order = np.argsort(edge)
    starts = B.groups(edge[order])
    first = np.empty(len(edge), np.int64)
    first[order] = np.repeat(np.minimum.reduceat(order, starts), np.diff(np.r_[starts, len(order)]))
    return first


def _send(least, edge, doc, pos, ids, rows, n_buckets):
    """Pieces of consecutive edges with one minimiser, packed by bucket."""
    if not len(least):
        return
    new = np.r_[True, (least[1:] != least[:-1]) | (doc[1:] != doc[:-1]) | (pos[1:] != pos[:-1] + 1)]
    start = np.flatnonzero(new)
    n = np.diff(np.r_[start, len(least)])
    bucket = (B.mix(least[start]) % np.uint64(n_buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    begins = B.groups(bucket[order])
    low = (edge >> np.uint64(32)).astype(np.uint32)
    out = []
    for a, b in zip(begins, np.r_[begins[1:], len(order)]):
        mine = order[a:b]
        here, index = np.unique(doc[start[mine]], return_inverse=True)
        piece = np.empty(b - a, PIECE)
        piece["minimiser"], piece["doc"], piece["pos"], piece["n"] = least[start[mine]], index, pos[start[mine]], n[mine]
        table = np.stack([ids[here], rows[here]])
        out.append((int(bucket[mine[0]]), 0, table.tobytes(), piece.tobytes(), low[_ranges(start[mine], n[mine])].tobytes()))
    yield _rows(out)


def _rows(out):
    cols = list(zip(*out))
    kinds = [pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], ["bucket", "kind", "docs", "pieces", "edges"])


def _ranges(start, n):
    """start[0], start[0]+1, .. for n[0] places, and so on."""
    total = int(n.sum())
    return np.arange(total) + np.repeat(start - (np.cumsum(n) - n), n)


def _pieces(id_, row, pos, src, src_pos, k):
    """Repeated edges as spans: they run on while word and first source do."""
    order = np.lexsort((pos, row, id_))
    id_, row, pos, src, src_pos = (x[order] for x in (id_, row, pos, src, src_pos))
    new = np.r_[True, (id_[1:] != id_[:-1]) | (row[1:] != row[:-1]) | (pos[1:] != pos[:-1] + 1)
                | (src[1:] != src[:-1]) | (src_pos[1:] != src_pos[:-1] + 1)]
    start = np.flatnonzero(new)
    last = np.r_[start[1:], len(pos)] - 1
    out = np.empty(len(start), SPANS)
    out["id"], out["row"], out["start"], out["end"] = id_[start], row[start], pos[start], pos[last] + k
    out["src_id"], out["src_start"] = src[start], src_pos[start]
    return out


def _deal(out, n_buckets, known):
    bucket = out["row"] % n_buckets
    order = np.argsort(bucket, kind="stable")
    begins = B.groups(bucket[order])
    packs = [(int(bucket[order[a]]), out[order[a:b]].tobytes()) for a, b in zip(begins, np.r_[begins[1:], len(order)])]
    if not packs:
        return
    if known:
        yield _rows([(b, 1, None, x, None) for b, x in packs])
    else:
        yield pa.table({"bucket": pa.array([b for b, _ in packs], pa.int64()), "spans": pa.array([x for _, x in packs], pa.binary())})


def _repeated(table: pa.Table, k: int, n_buckets: int) -> pa.Table:
    found, least, low, ids, rows, pos = [], [], [], [], [], []
    for kind, docs, pieces, edges in zip(*(table.column(c).to_pylist() for c in ("kind", "docs", "pieces", "edges"))):
        if kind:
            found.append(np.frombuffer(pieces, SPANS))
            continue
        docs = np.frombuffer(docs, np.int64).reshape(2, -1)
        piece = np.frombuffer(pieces, PIECE)
        n = piece["n"].astype(np.int64)
        doc = np.repeat(piece["doc"], n)
        least.append(np.repeat(piece["minimiser"], n))
        ids.append(docs[0][doc])
        rows.append(docs[1][doc])
        pos.append(_ranges(piece["pos"].astype(np.int64), n))
        low.append(np.frombuffer(edges, np.uint32))
    if least:
        least, low, ids, rows, pos = map(np.concatenate, (least, low, ids, rows, pos))
        key = (B.mix(least) << np.uint64(32)) | low
        order = np.argsort(key)
        same = key[order][1:] == key[order][:-1]
        if (same & (least[order][1:] != least[order][:-1])).any():   # two minimisers share 32 bits
            order = np.lexsort((low, least))
            same = (low[order][1:] == low[order][:-1]) & (least[order][1:] == least[order][:-1])
        starts = np.flatnonzero(np.r_[True, ~same])
        n = np.diff(np.r_[starts, len(order)])
        many = np.repeat(n > 1, n)
        order, starts = order[many], np.r_[0, np.cumsum(n[n > 1])][:-1]
        n = n[n > 1]
        if len(order):
            i, p = ids[order], pos[order]
            src = np.repeat(np.minimum.reduceat(i, starts), n)
            at = np.repeat(np.minimum.reduceat(np.where(i == src, p, np.iinfo(np.int64).max), starts), n)
            cut = i > src
            if cut.any():
                found.append(_pieces(i[cut], rows[order][cut], p[cut], src[cut], at[cut], k))
    out = list(_deal(np.concatenate(found), n_buckets, known=False)) if found else []
    return out[0] if out else pa.table({"bucket": pa.array([], pa.int64()), "spans": pa.array([], pa.binary())})


def glue(spans: np.ndarray) -> np.ndarray:
    """Pieces of one document that run on in both coordinates become one span."""
    s = np.unique(spans[["start", "end", "src_id", "src_start"]])
    s = s[np.lexsort((s["start"], s["start"] - s["src_start"], s["src_id"]))]
    shift = s["start"] - s["src_start"]
    new = np.r_[True, (s["src_id"][1:] != s["src_id"][:-1]) | (shift[1:] != shift[:-1]) | (s["start"][1:] > s["end"][:-1])]
    starts = np.flatnonzero(new)
    out = s[starts].copy()
    out["end"] = np.maximum.reduceat(s["end"], starts)
    return out[np.argsort(out["start"], kind="stable")]


def _cut(left: pa.Table, right: pa.Table, arrow: pa.Schema) -> pa.Table:
    """The documents of a bucket without the words that their spans cover."""
    packs = [np.frombuffer(x, SPANS) for x in right.column("spans").to_pylist()]
    spans = np.concatenate(packs) if packs else np.zeros(0, SPANS)
    spans = spans[np.argsort(spans["row"], kind="stable")]
    keys = spans["row"]
    n_words, n_removed, kept, paths = [], [], [], []
    for row, text in zip(left.column("row").to_pylist(), left.column("text").to_pylist()):
        parts = (text or "").encode().split()
        a, b = np.searchsorted(keys, row), np.searchsorted(keys, row, side="right")
        n_words.append(len(parts))
        if a == b:
            n_removed.append(0)
            paths.append([])
        else:
            own = glue(spans[a:b])
            edge = np.zeros(len(parts) + 1, np.int64)
            np.add.at(edge, own["start"], 1)
            np.add.at(edge, own["end"], -1)
            stay = np.flatnonzero(np.cumsum(edge[:-1]) == 0)
            n_removed.append(len(parts) - len(stay))
            parts = [parts[i] for i in stay.tolist()]
            paths.append([dict(zip(("start", "end", "src_id", "src_start"), x)) for x in own.tolist()])
        kept.append(b" ".join(parts).decode())
    made = {"n_words": n_words, "n_removed": n_removed, "kept": kept, "spans": paths}
    return pa.table([pa.array(made[f.name], f.type) if f.name in made else left.column(f.name).cast(f.type) for f in arrow], schema=arrow)

