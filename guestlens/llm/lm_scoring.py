"""Scores of texts by a log-bilinear neural language model (operator 4).

Tokens are lower-cased words (A-Z) and one end per document.  The model's *units* are the
words with at least ``LEAST`` occurrences in the training rows, each with its own embeddings,
the hashed last three bytes of the rarer words (at most ``CODES`` endings with as many
occurrences), one unit for what is left, and the end; so the vocabulary grows with the
corpus.  It is broadcast: where more than ``VOCABULARY`` words reach ``LEAST``, the least
count rises until at most so many do, and the others go by their endings.

A unit is predicted from the two before it.  With h = q[h1] C1 + q[h2] C2 the score of a
unit is s(w | h) = h . r[w] + b[w], and that of its group is h . u[g] + a[g].  Groups are
runs of units by falling count, about half the square root of the units in number and of
equal sums of roots of counts; they only serve to normalise at a cost far below the number of units:

    P(token | h) = P(group | h) P(unit | group, h) (c+1) / (N_unit + V_unit + 1),

the last factor, the add-one share of a word inside its unit, is left out for units of one
token.  The probabilities sum to one over all words, unseen ones included.

*Counts.*  Documents meet in hash blocks; each block asks the buckets of the words'
hashes for the corpus counts of its distinct words and gets them back packed, so
the count of every word of the training rows is exact.  What travels grows with the text; a
frequent word is one entry per block.

*Fitting.*  ``ROUNDS`` passes over all training rows.  In a pass, each partition (``FIT_BYTES`` of text) starts from
the broadcast parameters and fits them to its tokens by noise-contrastive estimation in
numpy, on texts dealt by hash: noise units are drawn from the corpus unigram, ``NOISE`` per batch of ``BATCH`` tokens
and shared by them, groups likewise; steps are those of Adagrad by row.  Rows of
the parameters that a partition touched are averaged over partitions, weighted by how often
each used them, by two levels of streaming sums.

*Scoring.*  Batched matrix products over all tokens of a block, normalised over groups and
over the units of each group, give log-probabilities.

Words are told apart by 64-bit hashes.  Defined results: a null or blank text is the end
alone; rows with a null id are scored like others; repeated rows count each time; without
training rows N and V are 0 and the model is uniform over its two units; other columns are
ignored; an empty table gives an empty result.  The fit depends on how Spark splits the rows
into partitions, so scores of other layouts differ slightly; counts and base do not.
"""

from __future__ import annotations

import math
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from guestlens.llm import blocks as B
from guestlens.llm.tables import as_binary, bucket_count, materialize, text_bytes

LEAST = 50              # occurrences of a word with its own embeddings
VOCABULARY = 1 << 18    # words with their own embeddings: bounds the broadcast to about 40 MB
CODES = 4096
SIZE = 16               # of the embeddings
NOISE = 64
BATCH = 1024
ROUNDS = 1
RATE = 0.05
PIECE = 1 << 14         # rows of a parameter table that travel as one
SLICE = 1 << 18         # tokens scored at once,
CELLS = 1 << 17         # and their products with rows of a table in memory together, which fit a core's cache
REACH = 60              # scores whose exp and its sums stay far inside single precision
BLOCK_BYTES = 4 << 20
FIT_BYTES = 64 << 20    # of text that one task fits in a round
BUCKET_BYTES = 8 << 20

ENTRY = np.dtype([("h", "u8"), ("n", "u4"), ("code", "u2")])


class Units(NamedTuple):
    words: np.ndarray       # sorted hashes of the words with their own unit
    number: np.ndarray      # their units
    of_code: np.ndarray     # unit of each ending
    end: int                # the end's unit
    log_rest: np.ndarray    # log10 of N_unit + V_unit + 1; 0 for units of one token
    count: np.ndarray       # training tokens of each unit, falling
    begin: np.ndarray       # first unit of each group, and the number of units
    tokens: int             # N
    types: int              # V
    ends: int               # count of the end

    @property
    def n(self) -> int:
        return len(self.count)


def endings(data: np.ndarray, w: B.Words, at: np.ndarray | slice = slice(None)) -> np.ndarray:
    """Hashed last three bytes of words (A-Z lower-cased)."""
    start, end = w.start[at], w.end[at]
    code = np.zeros(len(start), np.uint32)
    for back in (1, 2, 3):
        byte = data[np.maximum(end - back, start)].astype(np.uint32)
        byte += np.uint32(32) * ((byte >= 65) & (byte <= 90))
        code = code * np.uint32(256) + np.where(end - back >= start, byte, np.uint32(0)).astype(np.uint32)
    return ((code * np.uint32(2654435761)) >> np.uint32(20)).astype(np.uint16)


def _distinct(w: B.Words):
    order = np.argsort(w.hash)
    return order, B.groups(w.hash[order])


def _deal(h: np.ndarray, n: int):
    """(bucket, places) of sorted hashes; in a bucket they stay sorted."""
    bucket = (h >> np.uint64(20)) % np.uint64(n)
    order = np.argsort(bucket, kind="stable")
    begins = B.groups(bucket[order])
    return [(int(bucket[order[a]]), order[a:b]) for a, b in zip(begins, np.r_[begins[1:], len(order)])]


def _block_words(table: pa.Table) -> tuple[np.ndarray, B.Words]:
    data, offsets = B.buffer_of(table.column("text").combine_chunks())
    return data, B.words(data, offsets, B.white_space())


def _ask(key, table: pa.Table, n_buckets: int) -> pa.Table:
    """The distinct words of a block with their counts in its training rows, by bucket."""
    data, w = _block_words(table)
    order, starts = _distinct(w)
    out = []
    if len(order):
        learn = table.column("learn").to_numpy().astype(bool)
        entry = np.empty(len(starts), ENTRY)
        entry["h"] = w.hash[order[starts]]
        entry["n"] = np.add.reduceat(learn[w.doc[order]].astype(np.uint32), starts)
        entry["code"] = endings(data, w, order[starts])
        out = [(key[0].as_py(), b, entry[at].tobytes()) for b, at in _deal(entry["h"], n_buckets)]
    cols = list(zip(*out)) or [[], [], []]
    return pa.table({"block": pa.array(cols[0], pa.int64()), "bucket": pa.array(cols[1], pa.int64()), "words": pa.array(cols[2], pa.binary())})


ANSWER = "block long, bucket long, counts binary, top binary, codes binary"


def _answer(key, table: pa.Table) -> pa.Table:
    """Corpus counts for each block that asked; the bucket's words of ``LEAST`` and more; sums by ending."""
    asked = [np.frombuffer(x, ENTRY) for x in table.column("words").to_pylist()]
    blocks = table.column("block").to_pylist()
    entry = np.concatenate(asked)
    order = np.argsort(entry["h"])
    starts = B.groups(entry["h"][order])
    total = np.add.reduceat(entry["n"][order].astype(np.int64), starts)
    back = np.empty(len(entry), np.int64)
    back[order] = np.repeat(total, np.diff(np.r_[starts, len(order)]))
    ends = np.cumsum([len(x) for x in asked])
    counts = [back[b - len(x):b].tobytes() for x, b in zip(asked, ends)]
    words = entry[order[starts]]
    seen = total > 0
    best = np.flatnonzero(total >= LEAST)
    most = np.empty(len(best), [("h", "u8"), ("n", "i8"), ("code", "u2")])
    most["h"], most["n"], most["code"] = words["h"][best], total[best], words["code"][best]
    codes = np.stack([np.bincount(words["code"][seen], weights=total[seen], minlength=CODES), np.bincount(words["code"][seen], minlength=CODES)])
    n = len(blocks)
    return pa.table({"block": pa.array([*blocks, None], pa.int64()), "bucket": pa.array([key[0].as_py()] * (n + 1), pa.int64()),
                     "counts": pa.array([*counts, None], pa.binary()), "top": pa.array([None] * n + [most.tobytes()], pa.binary()),
                     "codes": pa.array([None] * n + [codes.astype(np.int64).tobytes()], pa.binary())})


def _open_top(batches):
    for batch in batches:
        for raw in batch.column("top").to_pylist():
            x = np.frombuffer(raw, [("h", "u8"), ("n", "i8"), ("code", "u2")])
            yield pa.RecordBatch.from_arrays([pa.array(x["h"].view(np.int64)), pa.array(np.ascontiguousarray(x["n"])), pa.array(x["code"].astype(np.int32))], ["h", "n", "code"])


def _open_codes(batches):
    total = np.zeros((2, CODES), np.int64)
    for batch in batches:
        for raw in batch.column("codes").to_pylist():
            total += np.frombuffer(raw, np.int64).reshape(2, CODES)
    some = np.flatnonzero(total[1])
    yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(total[0][some]), pa.array(total[1][some])], ["code", "tokens", "types"])


def make_units(words, codes: list, ends: int) -> Units:
    """``words``: columns (hash, count, code) of those with their own unit; ``codes``: rows (code, tokens, types) of all."""
    h, n, code = (np.array(x, np.int64) for x in words)
    tokens, types = np.zeros(CODES, np.int64), np.zeros(CODES, np.int64)
    for at, t, v in codes:
        tokens[at], types[at] = t, v
    total, distinct = int(tokens.sum()), int(types.sum())
    tokens -= np.bincount(code, weights=n, minlength=CODES).astype(np.int64)
    types -= np.bincount(code, minlength=CODES)
    own = np.flatnonzero(tokens >= LEAST)
    k, size = len(h), len(h) + len(own) + 2
    of_code = np.full(CODES, size - 2)
    of_code[own] = k + np.arange(len(own))
    rest, held = np.bincount(of_code, weights=tokens + types, minlength=size), np.bincount(of_code, weights=tokens, minlength=size)
    rest[:k] = rest[size - 1] = 0
    held[:k], held[size - 1] = n, ends
    order = np.argsort(-held, kind="stable")
    rank = np.empty(size, np.int64)
    rank[order] = np.arange(size)
    held = held[order]
    roots = np.cumsum(np.sqrt(held + 1))
    groups = math.ceil(math.sqrt(size) / 2)
    begin = B.groups(np.minimum(roots / roots[-1] * groups, groups - 1).astype(np.int64))
    at = np.argsort(h.view(np.uint64))
    return Units(h.view(np.uint64)[at], rank[:k][at], rank[of_code], int(rank[size - 1]), np.log10(rest[order] + 1), held, np.r_[begin, size],
                 total + ends, distinct + (ends > 0), ends)


def unit_of(data: np.ndarray, w: B.Words, c: Units, at: np.ndarray | slice = slice(None)) -> tuple[np.ndarray, np.ndarray]:
    """Unit of each word, and whether the word is a unit of its own."""
    h = w.hash[at]
    out, own = np.empty(len(h), np.int64), np.zeros(len(h), bool)
    if len(c.words):
        shift = np.uint64(64 - len(c.words).bit_length())
        first = np.searchsorted(c.words, np.arange(1 << len(c.words).bit_length(), dtype=np.uint64) << shift)
        left, place = np.arange(len(h)), first[h >> shift]          # the first word that begins with the same bits,
        while len(left):                                            # then the ones after it
            inside = place < len(c.words)
            left, place = left[inside], place[inside]
            found, sought = c.words[place], h[left]
            hit = found == sought
            own[left[hit]] = True
            out[left[hit]] = c.number[place[hit]]
            on = found < sought
            left, place = left[on], place[on] + 1
    rest = np.flatnonzero(~own)
    out[rest] = c.of_code[endings(data, w, np.arange(len(w.hash))[at][rest])]
    return out, own


def sequence(unit: np.ndarray, count: np.ndarray, c: Units):
    """Units with ends, the two units before each (``c.n`` before a text), and the places of the words."""
    size = count + 1
    last = np.cumsum(size) - 1
    place = np.arange(len(unit)) + np.repeat(np.arange(len(count)), count)
    out = np.full(int(size.sum()), c.end, np.int64)
    out[place] = unit
    one = np.r_[c.n, out[:-1]][:len(out)]
    first = last - count
    one[first] = c.n
    two = np.r_[c.n, one[:-1]][:len(out)]
    two[first] = c.n
    return out, one, two, place


def first_model(c: Units, seed: int = 7) -> dict[str, np.ndarray]:
    """Parameters before fitting, the unigram model but for small noise.  The last column of ``r`` and ``u``
    is the bias; ``x+`` holds the Adagrad sums of the rows of table ``x``."""
    rng = np.random.default_rng(seed)
    p = np.log((c.count + 1) / (c.count + 1).sum())
    g = np.log(np.add.reduceat(c.count + 1, c.begin[:-1]) / (c.count + 1).sum())
    small = lambda n: rng.normal(0, 0.1, (n, SIZE))
    tables = {"q": small(c.n + 1), "r": np.column_stack([small(c.n), p]), "u": np.column_stack([small(len(g)), g]), "c": np.vstack([np.eye(SIZE)] * 2)}
    tables |= {f"{k}+": np.zeros((len(v), 1)) for k, v in tables.items()}
    return {k: np.ascontiguousarray(v, np.float32) for k, v in tables.items()}


def context(theta: dict, one: np.ndarray, two: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """h of each token, with a one for the bias, and the embeddings it comes from."""
    past = theta["q"].take(np.column_stack([one, two]), 0).reshape(len(one), 2 * SIZE)
    h = np.ones((len(one), SIZE + 1), np.float32)
    h[:, :SIZE] = past @ theta["c"]
    return h, past


def falling(x: np.ndarray) -> np.ndarray:
    """1 / (1 + exp(x)) in place; 0 where exp(x) is beyond all numbers."""
    with np.errstate(over="ignore"):
        np.exp(x, out=x)
    x += 1
    return np.divide(np.float32(1), x, out=x)


def contrast(h: np.ndarray, table: np.ndarray, unit: np.ndarray, noise: np.ndarray, log_noise: np.ndarray):
    """Gradients of the noise-contrastive likelihood of units against drawn ones, which all tokens share:
    (rows, gradients by row, gradient of the contexts).  ``log_noise`` is log(draws x noise probability)."""
    own, drawn = table.take(unit, 0), table.take(noise, 0)
    pull = falling(np.einsum("td,td->t", h, own) - log_noise[unit])[:, None]
    below = -drawn
    below[:, -1] += log_noise[noise]        # the last column of h is one
    push = falling(below @ h.T)
    own *= pull
    own -= push.T @ drawn
    grad = np.empty((len(unit) + len(noise), h.shape[1]), np.float32)
    np.multiply(pull, h, out=grad[:len(unit)])
    np.negative(push @ h, out=grad[len(unit):])
    return np.concatenate([unit, noise]), grad, own


def merge(rows: np.ndarray, grad: np.ndarray, slot: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct ``rows`` and the sums of their gradients; ``slot`` is room for a number for each row of the table."""
    each = np.arange(len(rows))
    slot[rows] = each
    kept = slot[rows]                       # one place of each distinct row, which takes in its others
    alone = kept == each
    more, width = np.flatnonzero(~alone), grad.shape[1]
    np.add.at(grad.reshape(-1), (kept[more, None] * width + np.arange(width)).ravel(), grad.take(more, 0).ravel())
    some = np.flatnonzero(alone)
    return rows[some], grad.take(some, 0)


def climb(theta: dict, name: str, at: np.ndarray, total: np.ndarray) -> None:
    """One Adagrad step of distinct rows of a table."""
    table, sums = theta[name], theta[f"{name}+"][:, 0]
    sum_at = sums[at] + np.einsum("td,td->t", total, total) / np.float32(total.shape[1])
    sums[at] = sum_at
    total *= (np.float32(RATE) / np.sqrt(sum_at + np.float32(1e-8)))[:, None]
    total += table.take(at, 0)
    table[at] = total


def draws(share: np.ndarray, n: int, rng) -> np.ndarray:
    """``n`` rows of ``NOISE`` units drawn by their shares."""
    found = np.searchsorted(np.cumsum(share), np.sort(rng.random(n * NOISE)))       # sorted numbers are found faster
    return rng.permutation(np.minimum(found, len(share) - 1)).reshape(n, NOISE)


def learn_tokens(theta: dict, used: dict, c: Units, out: np.ndarray, one: np.ndarray, two: np.ndarray, rng) -> None:
    """Fits the parameters in place to the tokens, a batch at a time in random order; ``used`` counts the uses of rows."""
    share = (c.count + 1) / (c.count + 1).sum()
    group_share = np.add.reduceat(share, c.begin[:-1])
    group = np.repeat(np.arange(len(group_share)), np.diff(c.begin))
    log_noise, group_noise = (np.log(NOISE * x).astype(np.float32) for x in (share, group_share))
    order = rng.permutation(len(out))
    out, one, two = out[order], one[order], two[order]
    group_out = group[out]
    n = -(-len(out) // BATCH)
    noise, group_drawn = draws(share, n, rng), draws(group_share, n, rng)
    for name, rows in (("q", [one, two]), ("r", [out, noise.ravel()]), ("u", [group_out, group_drawn.ravel()])):
        used[name] += sum(np.bincount(x, minlength=len(used[name])) for x in rows)
    used["c"] += n
    slot = np.empty(max(map(len, theta.values())), np.int64)
    for batch in range(n):
        at = slice(batch * BATCH, (batch + 1) * BATCH)
        h, past = context(theta, one[at], two[at])
        rows, grad, back = contrast(h, theta["r"], out[at], noise[batch], log_noise)
        group_rows, group_grad, group_back = contrast(h, theta["u"], group_out[at], group_drawn[batch], group_noise)
        back += group_back
        back = np.ascontiguousarray(back[:, :SIZE])
        down = back @ theta["c"].T
        climb(theta, "r", *merge(rows, grad, slot))
        climb(theta, "u", *merge(group_rows, group_grad, slot))
        climb(theta, "q", *merge(np.column_stack([one[at], two[at]]).ravel(), down.reshape(-1, SIZE), slot))
        climb(theta, "c", np.arange(2 * SIZE), past.T @ back)


PARTS = "name string, piece int, at binary, used binary, rows binary"


def _pieces(theta: dict, used: dict):
    """The used rows of every table, a piece of it at a time."""
    for name, table in theta.items():
        for piece in range(0, len(table), PIECE):
            uses = used[name.removesuffix("+")][piece:piece + PIECE]
            at = np.flatnonzero(uses).astype(np.uint16)
            if len(at):
                yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([piece // PIECE], pa.int32()), pa.array([at.tobytes()]),
                                                  pa.array([uses[at].astype(np.float64).tobytes()]),
                                                  pa.array([table[piece:piece + PIECE][at].tobytes()])], ["name", "piece", "at", "used", "rows"])


def _fit(batches, c: Units, start: dict, seed: int):
    theta = {k: v.copy() for k, v in start.items()}
    used = {k: np.zeros(len(v), np.int64) for k, v in theta.items() if not k.endswith("+")}
    rng = np.random.default_rng((seed, TaskContext.get().partitionId()))
    for block in B.slices(batches, "text"):
        data, offsets = B.buffer_of(block.column("text"))
        w = B.words(data, offsets, B.white_space())
        learn_tokens(theta, used, c, *sequence(unit_of(data, w, c)[0], w.count, c)[:3], rng)
    yield from _pieces(theta, used)


def _mean(batches, width: dict):
    """Weighted means of the pieces that reach a task, one piece of the table in memory for each."""
    sums: dict = {}
    for batch in batches:
        for name, piece, at, used, rows in zip(*(batch.column(x).to_pylist() for x in ("name", "piece", "at", "used", "rows"))):
            if (name, piece) not in sums:
                sums[name, piece] = np.zeros(PIECE), np.zeros((PIECE, width[name]))
            weight, total = sums[name, piece]
            at, used = np.frombuffer(at, np.uint16), np.frombuffer(used, np.float64)
            weight[at] += used
            total[at] += used[:, None] * np.frombuffer(rows, np.float32).reshape(-1, width[name])
    for (name, piece), (weight, total) in sums.items():
        at = np.flatnonzero(weight).astype(np.uint16)
        mean = (total[at] / weight[at, None]).astype(np.float32)
        yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([piece], pa.int32()), pa.array([at.tobytes()]), pa.array([weight[at].tobytes()]),
                                          pa.array([mean.tobytes()])], ["name", "piece", "at", "used", "rows"])


def put(theta: dict, parts) -> None:
    """Replaces the rows that ``parts`` (rows of ``PARTS``) hold."""
    for name, piece, at, _, new in parts:
        theta[name][piece * PIECE + np.frombuffer(at, np.uint16).astype(np.int64)] = np.frombuffer(new, np.float32).reshape(-1, theta[name].shape[1])


def train(rows: DataFrame, c: Units, size: int) -> dict[str, np.ndarray]:
    """Parameters fitted to all ``rows`` (text, block); ``size`` is about their bytes.  Texts are dealt by
    block, as means of models of unlike parts, such as one language each, learn little."""
    spark = rows.sparkSession
    theta = first_model(c)
    shared = spark.sparkContext.broadcast(c)
    width = {k: v.shape[1] for k, v in theta.items()}
    parts = math.ceil(size / FIT_BYTES) or 1
    salts = math.isqrt(parts) + 1
    for seed in range(ROUNDS):
        now = spark.sparkContext.broadcast(theta)
        fitted = rows.repartition(parts, "block").select("text").mapInArrow(lambda it: _fit(it, shared.value, now.value, seed), PARTS)     # noqa: B023
        some = (fitted.withColumn("salt", F.spark_partition_id() % salts).repartition(salts, "salt").drop("salt")
                .mapInArrow(lambda it: _mean(it, width), PARTS))
        some = materialize(some, "fit")
        put(theta, some.repartition("name", "piece").mapInArrow(lambda it: _mean(it, width), PARTS).collect())
        now.unpersist()
    return theta


def log_sums(table: np.ndarray, h: np.ndarray, room: np.ndarray, small: bool = False) -> np.ndarray:
    """log of the sum of exp(score) over the rows of ``table``, by token; ``room`` holds the scores meanwhile.
    ``small``: the greatest score of each token is known to be within ``REACH`` of 0, so that its terms need
    not be divided by the greatest."""
    s = np.matmul(table, h.T, out=room[:len(table) * len(h)].reshape(len(table), len(h)))
    top = np.float32(0) if small else s.max(0)
    if not small:
        s -= top
    np.exp(s, out=s)
    return top + np.log(np.ones(len(table), np.float32) @ s)


def reach(table: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The longest embedding and the greatest bias of the rows from each ``begin`` on."""
    square = np.einsum("td,td->t", table[:, :-1], table[:, :-1])
    return np.sqrt(np.maximum.reduceat(square, begin)), np.abs(np.maximum.reduceat(table[:, -1], begin))


def log_probabilities(theta: dict, c: Units, out: np.ndarray, one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """log10 P(unit | the two before) of tokens, normalised over groups and over the units of each group."""
    result = np.empty(len(out))
    size = np.diff(c.begin)
    group = np.repeat(np.arange(len(size)), size)
    u, r = theta["u"], theta["r"]
    (u_long, u_bias), (r_long, r_bias) = reach(u, np.zeros(1, np.int64)), reach(r, c.begin[:-1])
    room = np.empty(max(CELLS, len(u), size.max()), np.float32)
    for a in range(0, len(out), SLICE):
        w = out[a:a + SLICE]
        order = np.argsort(w, kind="stable")                    # units are numbered by group
        w = w[order]
        h = context(theta, one[a:a + SLICE][order], two[a:a + SLICE][order])[0]
        g = group[w]
        log = np.einsum("td,td->t", h, u.take(g, 0)).astype(np.float64)
        log += np.where(size[g] > 1, np.einsum("td,td->t", h, r.take(w, 0)), 0)         # a unit alone in its group is certain
        longest = np.sqrt(np.einsum("td,td->t", h[:, :-1], h[:, :-1]).max())
        step, small = max(1, CELLS // len(u)), bool(u_bias[0] + longest * u_long[0] < REACH)
        for x in range(0, len(w), step):
            log[x:x + step] -= log_sums(u, h[x:x + step], room, small)
        starts = B.groups(g)
        for x, y in zip(starts, np.append(starts[1:], len(g))):
            at = g[x]
            table = r[c.begin[at]:c.begin[at + 1]]
            step, small = max(1, CELLS // len(table)), bool(r_bias[at] + longest * r_long[at] < REACH)
            for z in range(x, y if len(table) > 1 else x, step):
                some = slice(z, min(y, z + step))
                log[some] -= log_sums(table, h[some], room, small)
        result[a:a + SLICE][order] = log / np.log(10)
    return result


def _score(left: pa.Table, right: pa.Table, c: Units, theta: dict, n_buckets: int) -> pa.Table:
    data, w = _block_words(left)
    order, starts = _distinct(w)
    known = np.zeros(len(starts), np.int64)
    answers = dict(zip(right.column("bucket").to_pylist(), right.column("counts").to_pylist()))
    for b, at in _deal(w.hash[order[starts]], n_buckets):
        known[at] = np.frombuffer(answers[b], np.int64)
    word = np.empty(len(order), np.int64)       # the number of each word among the distinct ones
    word[order] = np.repeat(np.arange(len(starts)), np.diff(np.r_[starts, len(order)]))
    unit, own = unit_of(data, w, c, order[starts])
    out, one, two, place = sequence(unit[word], w.count, c)
    doc = np.repeat(np.arange(len(w.count)), w.count + 1)
    log = log_probabilities(theta, c, out, one, two)
    log[place] += np.where(own, 0.0, np.log10(known + 1) - c.log_rest[unit])[word]
    base, seen = (np.full(len(out), x) for x in (np.log10((c.ends + 1) / (c.tokens + c.types + 1)), c.ends > 0))
    base[place], seen[place] = np.log10((known + 1) / (c.tokens + c.types + 1))[word], (known > 0)[word]
    add = lambda x: np.bincount(doc, weights=x, minlength=len(w.count))
    return pa.table({"id": left.column("id"), "learn": left.column("learn"), "n_tokens": pa.array(w.count + 1, pa.int64()),
                     "n_known": pa.array(add(seen).astype(np.int64)), "base_score": pa.array(add(base)), "score": pa.array(add(log))})


def score_texts(df: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) for every row;
    counts and model come from the rows where ``learn`` holds."""
    spark = df.sparkSession
    size = text_bytes(df, text_col)
    n_blocks, n_buckets = bucket_count(spark, size, BLOCK_BYTES), bucket_count(spark, size, BUCKET_BYTES)
    rows = df.select(F.col(id_col).alias("id"), learn.alias("learn"), as_binary(text_col).alias("text"),
                     F.pmod(F.xxhash64(F.col(id_col), F.col(text_col)), F.lit(n_blocks)).alias("block"))
    asked = rows.groupBy("block").applyInArrow(lambda key, t: _ask(key, t, n_buckets), "block long, bucket long, words binary")
    answers = materialize(asked.groupBy("bucket").applyInArrow(lambda key, t: _answer(key, t), ANSWER), "counts")
    ends = rows.where("learn").count()
    found = answers.where("block is null")
    words = found.select("top").mapInArrow(_open_top, "h long, n long, code int")
    scale = F.floor(8 * F.log2("n"))
    most, sizes = 0, words.groupBy(scale.alias("scale")).count().orderBy(F.desc("scale")).collect()
    least = min((x for x, _ in sizes), default=0)
    for x, n in sizes:
        most += n
        if most > VOCABULARY:
            least = x + 1
            break
    words = words.where(scale >= least).toArrow().sort_by([("n", "descending"), ("h", "ascending")])
    codes = (found.select("codes").mapInArrow(_open_codes, "code int, tokens long, types long")
             .groupBy("code").agg(F.sum("tokens"), F.sum("types")).collect())
    c = make_units(words.columns, [tuple(r) for r in codes], ends)
    theta = train(rows.where("learn").select("text", "block"), c, size)
    shared, model = spark.sparkContext.broadcast(c), spark.sparkContext.broadcast(theta)
    scored = (rows.groupBy("block").cogroup(answers.where("block is not null").select("block", "bucket", "counts").groupBy("block"))
              .applyInArrow(lambda left, right: _score(left, right, shared.value, model.value, n_buckets),
                            f"id {df.schema[id_col].dataType.simpleString()}, learn boolean, n_tokens long, n_known long, base_score double, score double"))
    return scored.select(F.col("id").alias("doc_id"), (~F.col("learn")).alias("held_out"), "n_tokens", "n_known",
                         F.lit(c.tokens).cast("long").alias("train_tokens"), "base_score", "score")
