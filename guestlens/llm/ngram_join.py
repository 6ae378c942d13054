"""N-gram Jaccard self-join with adaptive multi-match prefixes (operator 1).

A document's set holds the hashes of its distinct word shingles.  Two documents
link when |x and y| / |x or y| >= num / den.  The result is the class of each
document: the smallest doc_id that it reaches by links.

*Equal sets first.*  Documents with one set are one node (a partial aggregate), so
a group of exact copies of any size costs one row.

*Two passes of prefixes.*  A prefix needs one order of all shingles.  In the first pass
those whose hash is in the lowest ``SAMPLED`` (1 - t) share are counted over all nodes and come
first, rare before frequent; the others follow by hash.  Shingles that one node alone
holds make no candidates but fill its prefix, so most nodes drop out here.  The second
pass counts all shingles of the nodes that are left, and orders them rare first.

*Adaptive prefixes.*  With prefixes of n - ceil(t n) + l shingles, linked documents
share at least l prefix shingles, and documents with l and l' share min(l, l').
Each node picks the l in 1..``MOST_MATCHES`` of least estimated cost: the postings
its prefix meets, plus one verification per candidate, of which there can be at
most postings / l.

*Links without all pairs.*  First every node is verified against one node of each of
its prefix postings only, the one whose shingles are in the most nodes: a star per posting.
Verified links give components; only pairs across components can still join them.  The
postings of one centre meet in one bucket, where a pair's shared shingles are counted before
it is emitted; it must share enough, and the shingles that no other node has must leave
room for a link.  A pair inside a component changes no class, so no link between classes
is lost, while a group of near copies costs a row per member and posting rather than a
row per pair.

Candidates that share min(l, l') prefix shingles are compared by a mark of ``BITS`` bits,
which bounds their difference from below, and then verified on their whole sets.
Sets are 64-bit hashes of shingles and are told apart by a 64-bit sum and their size.

Defined results: null or blank texts have no shingles and are a class of their own;
fewer words than a shingle make one shingle of the whole sequence; rows with a
null doc_id get their n_shingles and a null component; rows that repeat a doc_id
count each, and the class is named by the smallest doc_id in it; other columns
are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from guestlens.llm import blocks as B
from guestlens.llm.tables import as_binary, bucket_count, components, materialize, text_bytes

SAMPLED = 1.7           # share of the hash range whose shingles are counted, in shares of a set outside its links
MOST_MATCHES = 8        # largest l
VERIFY_COST = 0.02      # of one candidate, per shingle, in postings
BUCKET_BYTES = 24 << 20  # text bytes per bucket of postings

BITS = 512               # of a set's parity mark: bit h counts the shingles hashed to it, modulo 2
MARKS = [f"m{i}" for i in range(BITS // 64)]


def shingle_sets(block_data, k: int, separator=None) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of all documents of a block, and each one's document."""
    w = B.words(*block_data, B.white_space() if separator is None else separator, fold=True)
    h, whole = B.windows(w, k)
    sets, docs = h[whole], w.doc[whole]
    firsts = np.cumsum(w.count) - w.count
    for size in range(1, k):
        few = np.flatnonzero(w.count == size)
        if len(few):
            sets = np.r_[sets, B.windows(w, size)[0][firsts[few]]]
            docs = np.r_[docs, few]
    order = np.argsort(sets)
    order = order[np.argsort(docs[order], kind="stable")]
    sets, docs = sets[order], docs[order]
    new = np.r_[True, (sets[1:] != sets[:-1]) | (docs[1:] != docs[:-1])][:len(sets)]
    return sets[new], docs[new]


def _prefix(n, num: int, den: int):
    """Shingles in the prefix of a set of n for l = 0."""
    return n - -(-n * num // den)


def _nodes_of(sets, docs, rows):
    """Sizes of the sets of a block's rows, where they start, and their nodes (hashes)."""
    n = np.bincount(docs, minlength=rows)
    first = np.cumsum(n) - n
    total = np.r_[np.uint64(0), np.cumsum(B.mix(sets + np.uint64(1)))]
    return n, first, B.mix(total[first + n] - total[first] + n.astype(np.uint64)).view(np.int64)


def _summaries(batches, k):
    """doc id, hash of its text, size, node."""
    for block in B.slices(batches, "text"):
        sets, docs = shingle_sets(B.buffer_of(block.column("text")), k)
        n, _, node = _nodes_of(sets, docs, block.num_rows)
        yield pa.RecordBatch.from_arrays([block.column("id"), block.column("th"), pa.array(n), pa.array(node)], ["id", "th", "n", "node"])


def _lowest(batches, k, num, den, limit):
    """node, size and lowest hashes of the sets of a block that are not empty, each once."""
    for block in B.slices(batches, "text"):
        sets, docs = shingle_sets(B.buffer_of(block.column("text")), k)
        n, first, node = _nodes_of(sets, docs, block.num_rows)
        low = np.bincount(docs[sets <= limit], minlength=block.num_rows)
        take = np.minimum(n, np.maximum(low, _prefix(n, num, den) + MOST_MATCHES))
        one = np.unique(node, return_index=True)[1]
        one = one[n[one] > 0]
        raw = sets.tobytes()
        packed = [raw[8 * a:8 * (a + t)] for a, t in zip(first[one].tolist(), take[one].tolist())]
        yield pa.RecordBatch.from_arrays([pa.array(node[one]), pa.array(n[one]), pa.array(packed, pa.binary())], ["node", "n", "low"])


def _bins(keys: np.ndarray, n: int):
    """(bucket, places): keys are hashes; shingles are mixed, as only low ones are
    dealt, and nodes go by their remainder, as ``_bucket`` has it in SQL."""
    bucket = keys % n if keys.dtype == np.int64 else (B.mix(keys) % np.uint64(n)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    begins = B.groups(bucket[order])
    return [(int(bucket[order[a]]), order[a:b]) for a, b in zip(begins, np.r_[begins[1:], len(order)])]


def _batch(names, kinds, rows):
    cols = list(zip(*rows)) if rows else [[] for _ in names]
    return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, kinds)], names)


def _distinct_nodes(table):
    """(node, n, low) of the nodes of a bucket, each once."""
    node = table.column("node").to_numpy()
    return table.take(pa.array(np.unique(node, return_index=True)[1]))


def _ask(table, n_buckets, limit):
    """The counted shingles of the nodes of a bucket, packed by bucket of shingles."""
    table = _distinct_nodes(table)
    low = table.column("low").to_pylist()
    h = np.frombuffer(b"".join(low), np.uint64)
    size = np.array([len(x) // 8 for x in low], np.int64)
    node = np.repeat(table.column("node").to_numpy(), size)
    few = h <= limit
    h, node = h[few], node[few]
    rows = []
    for b, at in _bins(h, n_buckets):                   # in the order of nodes: each node once, with its number of shingles
        starts = B.groups(node[at])
        rows.append((b, h[at].tobytes(), node[at][starts].tobytes(), np.diff(np.r_[starts, len(at)]).astype(np.uint32).tobytes()))
    return pa.Table.from_batches([_batch(["bucket", "h", "node", "times"], [pa.int64()] + [pa.binary()] * 3, rows)])


def _join(table, *names):
    return [np.frombuffer(b"".join(table.column(c).to_pylist()), t) for c, t in names]


def _count(table, n_buckets):
    """Shingles that several nodes hold, with their number of nodes, packed by bucket of nodes."""
    h, node, times = _join(table, ("h", np.uint64), ("node", np.int64), ("times", np.uint32))
    node = np.repeat(node, times)
    order = np.argsort(h)
    starts = B.groups(h[order])
    n = np.diff(np.r_[starts, len(h)])
    many = np.repeat(n > 1, n)
    at, df = order[many], np.repeat(n, n)[many].astype(np.uint32)
    h, node = h[at], node[at]
    rows = [(b, h[i].tobytes(), node[i].tobytes(), df[i].tobytes()) for b, i in _bins(node, n_buckets)] if len(at) else []
    return pa.Table.from_batches([_batch(["bucket", "h", "node", "df"], [pa.int64(), pa.binary(), pa.binary(), pa.binary()], rows)])


def choose(df: np.ndarray, alone: int, counted: int, n: int, num: int, den: int) -> tuple[int, int]:
    """The l of least cost, and how many of the shared shingles (rare first) its prefix
    reaches: ``alone`` of the ``counted`` ones are held by this node only."""
    cost = np.cumsum(df, dtype=np.float64)
    best = (np.inf, 1, 0)
    base = _prefix(n, num, den)
    for match in range(1, min(MOST_MATCHES, n - base) + 1):
        reach = base + match - alone
        met = cost[min(reach, len(df)) - 1] if reach > 0 and len(df) else 0.0
        met += max(0, base + match - counted)       # uncounted ones: at least this node
        price = met * (1 + VERIFY_COST * n / match)
        if price < best[0]:
            best = (price, match, max(0, reach))
    return best[1], best[2]


POSTING = [("h", np.uint64), ("node", np.int64), ("n", np.int64), ("own", np.int64), ("mass", np.int64), ("l", np.int8)]
POSTINGS = "bucket long, h binary, node binary, n binary, own binary, mass binary, l binary"


def _deal(columns, by, n_buckets, more=()):
    """Columns of postings (and ``more``), packed by bucket of the column ``by``."""
    names = [name for name, _ in POSTING] + list(more)
    packs = [(b, *(x[at].tobytes() for x in columns)) for b, at in _bins(columns[by], n_buckets)] if len(columns[by]) else []
    return pa.Table.from_batches([_batch(["bucket", *names], [pa.int64()] + [pa.binary()] * len(names), packs)])


def _choose_prefixes(nodes, replies, n_buckets, num, den, limit):
    """Postings of the chosen prefixes, packed by bucket of shingles."""
    h, of, df = _join(replies, ("h", np.uint64), ("node", np.int64), ("df", np.uint32))
    order = np.lexsort((h, df, of))
    h, of, df = h[order], of[order], df[order]
    hs, rows = [], []
    nodes = _distinct_nodes(nodes)
    for node, n, low in zip(*(nodes.column(c).to_pylist() for c in ("node", "n", "low"))):
        a, b = np.searchsorted(of, node), np.searchsorted(of, node, side="right")
        low = np.frombuffer(low, np.uint64)
        counted = int(np.searchsorted(low, limit, side="right"))
        own = counted - int(b - a)
        match, reach = choose(df[a:b], own, counted, n, num, den)
        prefix = h[a:min(b, a + reach)]
        rest = _prefix(n, num, den) + match - counted
        if rest > 0:
            prefix = np.r_[prefix, low[counted:counted + rest]]
        if len(prefix):
            hs.append(prefix)
            rows.append((node, n, own, int(df[a:b].sum()) // n, match, len(prefix)))
    cols = list(zip(*rows)) or [()] * 6
    times = np.array(cols[5], np.int64)
    out = [np.concatenate(hs) if hs else np.zeros(0, np.uint64)]
    out += [np.repeat(np.array(c, t), times) for c, (_, t) in zip(cols, POSTING[1:])]
    return _deal(out, 0, n_buckets)


def _meeting(table, num, den):
    """Nodes with another node of a fitting size in one of their postings."""
    h, node, n = _join(table, *POSTING[:3])
    order = np.lexsort((n, h))
    h, node, n = h[order], node[order], n[order]
    # Sorted by size, a fitting partner exists if a neighbour fits.
    fits = (h[1:] == h[:-1]) & _sizes_fit(n[1:], n[:-1], num, den)
    return pa.table({"node": pa.array(np.unique(node[np.r_[False, fits] | np.r_[fits, False]]), pa.int64())})


PAIR = ["a", "b", "shared", "least"]
PAIRS = "a long, b long, shared long, least int"


def _pair_table(a, b, least) -> pa.Table:
    """Pairs (smaller node first) with the number of shingles of this bucket they share."""
    swap = a > b
    a, b = np.where(swap, b, a), np.where(swap, a, b)
    if len(a):
        order = np.lexsort((b, a))
        a, b, least = a[order], b[order], least[order]
        starts = np.flatnonzero(np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])])
        n = np.diff(np.r_[starts, len(a)])
        a, b, least = a[starts], b[starts], least[starts]
    else:
        n = np.zeros(0, np.int64)
    return pa.table([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(n, pa.int64()), pa.array(least, pa.int32())], names=PAIR)


def _sizes_fit(n, m, num, den):
    return np.minimum(n, m) * den >= np.maximum(n, m) * num


def _room(n, own, m, other, num, den):
    """Whether a link is left by the shingles that no other node has."""
    most = np.minimum(n - own, m - other)
    return most * den >= (n + m - most) * num


def _stars(table, num, den):
    """Each node with the node of its posting whose shingles are in the most nodes."""
    h, node, n, own, mass, match = _join(table, *POSTING)
    order = np.lexsort((node, -mass, h))
    h, node, n, own, match = (x[order] for x in (h, node, n, own, match))
    starts = B.groups(h)
    first = np.repeat(starts, np.diff(np.r_[starts, len(h)]))
    ok = (node != node[first]) & _sizes_fit(n, n[first], num, den) & _room(n, own, n[first], own[first], num, den)
    return _pair_table(node[first][ok], node[ok], np.minimum(match, match[first])[ok])


def _by_centre(table, num, den, n_buckets):
    """Postings of several nodes that a link may join, packed by bucket of the posting's centre."""
    columns = _join(table, *POSTING, ("root", np.int64))
    n, own = columns[2], columns[3]
    able = (n - own) * den >= n * num                   # the best partner has the shared shingles and no other
    columns = [x[able] for x in columns]
    order = np.lexsort((columns[1], -columns[4], columns[0]))
    columns = [x[order] for x in columns]
    starts = B.groups(columns[0])
    size = np.diff(np.r_[starts, len(columns[0])])
    centre = np.repeat(columns[1][starts], size)
    many = np.repeat(size > 1, size)
    return _deal([x[many] for x in (*columns, centre)], 7, n_buckets, ["root", "centre"])


def _across(table, num, den):
    """Pairs of nodes in different components that share postings.

    All postings of a centre are here, so a pair's shared shingles are counted before
    it is emitted; it needs as many as its prefixes ask for, less those that both nodes may
    still share in postings of other centres."""
    h, node, n, own, _, match, root, _ = _join(table, *POSTING, ("root", np.int64), ("centre", np.int64))
    order = np.argsort(h, kind="stable")
    h, node, n, own, match, root = (x[order] for x in (h, node, n, own, match, root))
    # Postings of one component join nothing; they only count as no place to share.
    starts = B.groups(h)
    size = np.diff(np.r_[starts, len(h)])
    mixed = np.repeat(np.minimum.reduceat(root, starts) != np.maximum.reduceat(root, starts), size) if len(h) else np.zeros(0, bool)
    _, number, here = np.unique(node, return_inverse=True, return_counts=True)
    rest = _prefix(n, num, den) + match - own - here[number]
    h, node, n, own, match, root, rest, number = (x[mixed] for x in (h, node, n, own, match, root, rest, number))
    starts = B.groups(h)
    size = np.diff(np.r_[starts, len(h)])
    first, size = np.repeat(starts, size), np.repeat(size, size)
    order = np.argsort(number, kind="stable")           # a node's postings in a row
    ends = np.r_[B.groups(number[order])[1:], len(order)]
    todo = np.r_[0, np.cumsum(size[order])]
    tables, at = [], 0
    while at < len(order):                              # whole nodes, about two million meetings at a time
        to = int(ends[max(np.searchsorted(ends, at, side="right"), np.searchsorted(todo[ends], todo[at] + 2_000_000, side="right") - 1)])
        mine = order[at:to]
        left = np.repeat(mine, size[mine])
        right = np.arange(len(left)) + np.repeat(first[mine] - (np.cumsum(size[mine]) - size[mine]), size[mine])
        ok = (node[left] < node[right]) & (root[left] != root[right])
        left, right = left[ok], right[ok]
        ok = _sizes_fit(n[left], n[right], num, den) & _room(n[left], own[left], n[right], own[right], num, den)
        left, right = left[ok], right[ok]
        order2 = np.lexsort((node[right], node[left]))
        left, right = left[order2], right[order2]
        runs = np.flatnonzero(np.r_[True, (node[left][1:] != node[left][:-1]) | (node[right][1:] != node[right][:-1])][:len(left)])
        shared = np.diff(np.r_[runs, len(left)])
        left, right = left[runs], right[runs]
        least = np.minimum(match[left], match[right])
        ok = shared + np.minimum(rest[left], rest[right]) >= least
        tables.append(pa.table([pa.array(node[left][ok], pa.int64()), pa.array(node[right][ok], pa.int64()), pa.array(shared[ok], pa.int64()),
                                pa.array(least[ok], pa.int32())], names=PAIR))
        at = to
    return pa.concat_tables(tables) if tables else _pair_table(*[np.zeros(0, np.int64)] * 3)


def _with_roots(table, roots, n_buckets):
    """The postings of a bucket of nodes with their components, packed by bucket of shingles."""
    columns = _join(table, *POSTING)
    node = columns[1]
    known, to = roots.column("node").to_numpy(), roots.column("root").to_numpy()
    order = np.argsort(known)
    known, to = known[order], to[order]
    root = node.copy()
    if len(known):
        at = np.minimum(np.searchsorted(known, node), len(known) - 1)
        root = np.where(known[at] == node, to[at], node)
    return _deal([*columns, root], 0, n_buckets, ["root"])


def _full_sets(batches, k):
    for block in B.slices(batches, "text"):
        sets, docs = shingle_sets(B.buffer_of(block.column("text")), k)
        n, first, node = _nodes_of(sets, docs, block.num_rows)
        raw = sets.tobytes()
        packed = [raw[8 * a:8 * (a + t)] for a, t in zip(first.tolist(), n.tolist())]
        same = pa.array(node == block.column("node").to_numpy())
        odd = np.bincount(docs * BITS + (sets >> np.uint64(64 - 9)).astype(np.int64), minlength=block.num_rows * BITS) & 1
        marks = np.packbits(odd.astype(np.uint8).reshape(-1, 64), axis=1).view(np.int64).reshape(-1, len(MARKS))
        yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(n), pa.array(packed, pa.binary()), *(pa.array(np.ascontiguousarray(m)) for m in marks.T)],
                                         ["node", "n", "low", *MARKS]).filter(same)


def _verify(batches, num, den):
    for batch in batches:
        ok = []
        for x, y in zip(batch.column("x").to_pylist(), batch.column("y").to_pylist()):
            both = np.concatenate([np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)])
            n = len(both)
            both.sort()
            same = int((both[1:] == both[:-1]).sum())
            ok.append(same * den >= (n - same) * num)
        yield batch.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))


def similarity_classes(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5,
                       num: int = 4, den: int = 5) -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row of ``df``; links at similarity num / den."""
    spark = df.sparkSession
    size = text_bytes(df, text_col)
    buckets = bucket_count(spark, size, BUCKET_BYTES)
    texts = df.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text_col).alias("th"), as_binary(text_col).alias("text"))
    limit = np.uint64(int(min(0.999, SAMPLED * (1 - num / den)) * 2**64))
    summary = materialize(texts.mapInArrow(lambda it: _summaries(it, k), "id long, th long, n long, node long"), "sets")

    def prefixes(nodes, limit):
        """Prefix postings of (node, n, low): shingles up to ``limit`` are counted.  The nodes
        are dealt once: both readers share the exchange."""
        dealt = nodes.select(_bucket("node", buckets).alias("bucket"), "node", "n", "low")
        asked = dealt.groupBy("bucket").applyInArrow(lambda t: _ask(t, buckets, limit), "bucket long, h binary, node binary, times binary")
        counted = asked.groupBy("bucket").applyInArrow(lambda t: _count(t, buckets), "bucket long, h binary, node binary, df binary")
        return dealt.groupBy("bucket").cogroup(counted.groupBy("bucket")).applyInArrow(
            lambda left, right: _choose_prefixes(left, right, buckets, num, den, limit), POSTINGS)

    # Nodes: equal sets count once.
    known = summary.where("id is not null and n > 0")
    owner = known.groupBy("node").agg(F.min(F.struct("id", "th")).alias("o")).select("node", "o.id", "o.th")
    lowest = texts.where("id is not null").mapInArrow(lambda it: _lowest(it, k, num, den, limit), "node long, n long, low binary")
    left = (prefixes(lowest, limit).groupBy("bucket").applyInArrow(lambda t: _meeting(t, num, den), "node long").distinct())
    # One text per node: rows that repeat (id, text) are dropped where the join has them.
    chosen = left.join(owner, "node").join(texts, ["id", "th"]).groupBy("id", "th", "node").agg(F.first("text").alias("text"))
    sets = materialize(chosen.select("node", "text").mapInArrow(lambda it: _full_sets(it, k), f"node long, n long, low binary, {', '.join(m + ' long' for m in MARKS)}"), "sets")
    postings = materialize(prefixes(sets.select("node", "n", "low"), np.uint64(2**64 - 1)), "prefixes")

    def side(name, *columns):
        return sets.select(F.col("node").alias(name), *[F.col(c).alias(f"{name}_{c}") for c in columns])

    def verified(pairs):
        pairs = pairs.groupBy("a", "b").agg(F.sum("shared").alias("shared"), F.min("least").alias("least")).where("shared >= least").select("a", "b")
        # Bits that differ between the parity marks are at most the shingles that differ.
        differ = sum((F.bit_count(F.col(f"a_{m}").bitwiseXOR(F.col(f"b_{m}"))) for m in MARKS), F.lit(0))
        pairs = materialize(pairs.join(side("a", "n", *MARKS), "a").join(side("b", "n", *MARKS), "b")
                            .where(differ * (den + num) <= (F.col("a_n") + F.col("b_n")) * (den - num)).select("a", "b"), "pairs")
        both = pairs.join(side("a", "low"), "a").join(side("b", "low"), "b").select("a", "b", F.col("a_low").alias("x"), F.col("b_low").alias("y"))
        return materialize(both.mapInArrow(lambda it: _verify(it, num, den), "a long, b long"), "links")

    first = verified(postings.groupBy("bucket").applyInArrow(lambda t: _stars(t, num, den), PAIRS))
    roots = components(first)
    by_node = postings.mapInArrow(lambda it: (b for x in it for b in _deal(_join(x, *POSTING), 1, buckets).to_batches()), POSTINGS)
    rooted = (by_node.groupBy("bucket").cogroup(roots.withColumn("bucket", _bucket("node", buckets)).groupBy("bucket"))
              .applyInArrow(lambda left, right: _with_roots(left, right, buckets), POSTINGS + ", root binary"))
    centred = rooted.groupBy("bucket").applyInArrow(lambda t: _by_centre(t, num, den, buckets), POSTINGS + ", root binary, centre binary")
    second = verified(centred.groupBy("bucket").applyInArrow(lambda t: _across(t, num, den), PAIRS))
    roots = components(first.union(second))

    classes = owner.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    smallest = classes.groupBy("root").agg(F.min("id").alias("component_id"))
    named = classes.join(smallest, "root").select("node", "component_id")
    return (summary.select("id", "n", F.when(F.col("id").isNotNull() & (F.col("n") > 0), F.col("node")).alias("node"))
            .join(named, "node", "left")
            .select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"),
                    F.when(F.col("id").isNotNull(), F.coalesce("component_id", "id")).alias("component_id")))


def _bucket(column: str, n: int):
    """The bucket that ``_bins`` gives a node."""
    return F.pmod(F.col(column), F.lit(n))
