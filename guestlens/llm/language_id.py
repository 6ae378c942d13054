"""Language identification of words by a linear-chain CRF (operator 8).

A document is the sequence of its words (runs of ASCII letters and non-ASCII bytes, A-Z
lower-cased).  The emission score of a word for a language is a sum of learned weights of its
features, hashed into one table: its byte bigrams and trigrams with word boundaries, its
first and last three bytes (affixes), and the word itself (lexicon).  Learned transition
scores link neighbours, so words of code-switched text are labelled in context.
Forward-backward gives each word's marginals; a document's language is the one with the
largest sum of marginals, and its score is that sum's share of the words.

Sequences are cut into pieces of ``PIECE`` words that run through forward-backward
together; the transfer matrices of the pieces carry exact messages between them, so
the marginals are those of the whole document, however long it is.

Fitting: gradient steps on the CRF's likelihood with the document's language at every word, on a
bounded sample: ``PER_LANG`` distinct texts per language, those with the smallest hashes among the
training rows.  Texts of at most ``FIT_BYTES`` bytes go first; where a language has too few of them,
windows of its longer texts, of at most as many bytes from the first letter on, fill up.

Defined results: null texts and texts without a letter are ``und`` with score 0; rows
without a language are not learned from; equal sums take the smaller language name;
without any training row every text is ``und``; an empty table gives an empty result;
other columns are ignored unless carried, and carried columns named like a result
give way to it.
"""

from __future__ import annotations

from functools import reduce
from operator import or_
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from guestlens.llm import blocks as B
from guestlens.llm.tables import materialize

PER_LANG = 300
FIT_BYTES = 20_000
STEPS = 14
RATE = 0.25
TABLE_BITS = 18
PIECE = 64
BLOCK = 1 << 20
FIT_BLOCK = 1 << 18
SPAN = 1 << 40

RESULT = ["lang_pred", "score"]


class Model(NamedTuple):
    langs: list[str]
    weights: np.ndarray     # features x languages, float32
    start: np.ndarray       # languages
    moves: np.ndarray       # from x to


def separators() -> np.ndarray:
    t = np.ones(256, bool)
    t[65:91] = t[97:123] = t[128:] = False
    return t


_LOWER = np.arange(256, dtype=np.uint32)
_LOWER[65:91] += 32


def features(data: np.ndarray, w: B.Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows of the weight table: per letter byte two n-grams (with each word's first letter),
    and per word three more (first and last bytes, the word)."""
    size = w.end - w.start
    at = np.arange(int(size.sum())) + np.repeat(w.start - (np.cumsum(size) - size), size)
    letters = _LOWER[data[at]]
    first = np.cumsum(size) - size
    before = np.r_[np.uint32(0), letters[:-1]]
    before[first] = 0
    after = np.r_[letters[1:], np.uint32(0)]
    after[first + size - 1] = 0
    pair = before << np.uint32(8) | letters
    three = pair << np.uint32(8) | after
    top = np.uint32(32 - TABLE_BITS)
    mul = np.uint32(2654435761)
    grams = np.stack([(pair + np.uint32(1 << 24)) * mul >> top, three * mul >> top], 1).astype(np.int32)
    head = first + np.minimum(size, 3) - 1                   # third byte or the last
    tail = first + size - np.minimum(size, 3)
    begin = three[np.maximum(head - 1, first)]
    end = three[np.minimum(tail + 1, first + size - 1)]
    word = (w.hash >> np.uint64(64 - TABLE_BITS)).astype(np.int32)
    affix = np.stack([((begin ^ np.uint32(0x5A000000)) * mul >> top).astype(np.int32),
                      ((end ^ np.uint32(0xA5000000)) * mul >> top).astype(np.int32), word], 1)
    return grams, first, affix


def emissions(data: np.ndarray, w: B.Words, weights: np.ndarray) -> np.ndarray:
    grams, first, affix = features(data, w)
    out = weights[affix[:, 0]] + weights[affix[:, 1]] + weights[affix[:, 2]]
    scores = weights[grams[:, 0]] + weights[grams[:, 1]]
    for label in range(weights.shape[1]):
        out[:, label] += np.add.reduceat(np.ascontiguousarray(scores[:, label]), first)
    return out


def marginals(emit: np.ndarray, count: np.ndarray, start: np.ndarray, moves: np.ndarray, pairs: bool = False):
    """P(label of word | document) for all words of documents of ``count`` words (all above 0).

    Optionally also the sums of the probabilities of first labels and of moves."""
    n_labels = emit.shape[1]
    e = np.exp(emit - emit.max(1, keepdims=True), dtype=np.float64) + 1e-30
    m = np.exp(moves)
    pieces = -(-count // PIECE)
    first_piece = np.cumsum(pieces) - pieces
    total = int(pieces.sum())
    doc = np.repeat(np.arange(len(count)), pieces)
    index = np.arange(total) - first_piece[doc]
    begin = (np.cumsum(count) - count)[doc] + index * PIECE
    length = np.minimum(PIECE, count[doc] - index * PIECE)
    width = int(length.max())
    place = begin[:, None] + np.arange(width)
    real = np.arange(width) < length[:, None]
    grid = np.where(real[:, :, None], e[np.minimum(place, len(e) - 1)], 1.0)
    # Transfer matrix of a piece: from the label before it to the label of its last word.
    move = np.broadcast_to(np.eye(n_labels), (total, n_labels, n_labels)).copy()
    for t in range(width):
        step = (move @ m) * grid[:, t, None, :]
        step /= step.sum((1, 2), keepdims=True)
        move = np.where(real[:, t, None, None], step, move)
    head = np.exp(start - start.max())
    into = np.empty((total, n_labels))          # message at the word before the piece
    back = np.ones((total, n_labels))           # message from after the piece
    # A start vector v with v @ m = head starts the chain; solving it exactly can be
    # negative, so first pieces begin with head itself (see ``forward``).
    most = int(pieces.max())
    alpha_end = np.empty((total, n_labels))
    for i in range(most):
        here = first_piece[pieces > i] + i
        if i == 0:
            a = np.broadcast_to(head, (len(here), n_labels)) * grid[here, 0]
            a = a / a.sum(1, keepdims=True)
            into[here] = 0
            lone = move_rest = None
        else:
            into[here] = alpha_end[here - 1]
        if i == 0:
            for t in range(1, width):
                nxt = (a @ m) * grid[here, t]
                nxt /= nxt.sum(1, keepdims=True)
                a = np.where(real[here, t, None], nxt, a)
            alpha_end[here] = a
        else:
            a = np.einsum("pi,pij->pj", into[here], move[here])
            alpha_end[here] = a / a.sum(1, keepdims=True)
    for i in range(most - 2, -1, -1):
        here = first_piece[pieces > i + 1] + i
        b = np.einsum("pij,pj->pi", move[here + 1], back[here + 1])
        back[here] = b / b.sum(1, keepdims=True)
    forward = np.empty((total, width, n_labels))
    a = np.where((index == 0)[:, None], head, into @ m)
    for t in range(width):
        a = (a if t == 0 else a @ m) * grid[:, t]
        a /= a.sum(1, keepdims=True)
        forward[:, t] = a
    post = np.empty((total, width, n_labels))
    b = back
    moved = np.zeros((n_labels, n_labels))
    for t in range(width - 1, -1, -1):
        p = forward[:, t] * b
        post[:, t] = p / p.sum(1, keepdims=True)
        nb = (b * grid[:, t]) @ m.T
        if pairs:
            prior = forward[:, t - 1] if t else into
            joint = prior[:, :, None] * m * (b * grid[:, t])[:, None, :]
            norm = joint.sum((1, 2), keepdims=True)
            use = real[:, t] & ((t > 0) | (index > 0)) & (norm[:, 0, 0] > 0)
            moved += (joint[use] / norm[use]).sum(0)
        nb /= nb.sum(1, keepdims=True)
        b = np.where(real[:, t, None], nb, b)
    out = np.empty((len(emit), n_labels))
    out[place[real]] = post[real]
    if pairs:
        return out, moved
    return out


def _fit_blocks(texts: list[bytes], labels: list[int]):
    """Bytes, words and label of each word, in blocks of documents of about ``FIT_BLOCK`` bytes."""
    begin = size = 0
    for i, text in enumerate(texts):
        size += len(text)
        if size >= FIT_BLOCK or i + 1 == len(texts):
            data, offsets = B.buffer_of(pa.array(texts[begin:i + 1], pa.binary()))
            w = B.words(data, offsets, separators())
            if len(w.hash):
                yield data, w, np.array(labels[begin:i + 1])[w.doc]
            begin, size = i + 1, 0


def _step(data: np.ndarray, w: B.Words, y: np.ndarray, number: np.ndarray, theta: list, weights: np.ndarray):
    """What one block of documents adds to the gradients: of the weights in use, first labels and moves."""
    k = weights.shape[1]
    count = w.count[w.count > 0]
    p, moved = marginals(emissions(data, w, weights), count, theta[1], theta[2], pairs=True)
    error = -p
    error[np.arange(len(y)), y] += 1
    same = w.doc[1:] == w.doc[:-1]
    moved_y = np.zeros((k, k))
    np.add.at(moved_y, (y[:-1][same], y[1:][same]), 1)
    grams, first, affix = features(data, w)
    where = number[np.r_[grams.ravel(), affix.ravel()]]
    each = np.arange(len(w.hash), dtype=np.int32)
    owner = np.r_[np.repeat(each, 2 * np.diff(np.r_[first, len(grams)])), np.repeat(each, 3)]
    grad = np.stack([np.bincount(where, weights=error[owner, j], minlength=len(theta[0])) for j in range(k)], 1)
    return grad, error[np.cumsum(count) - count].sum(0), moved_y - moved, len(y), len(count)


def fit(texts: list[bytes], labels: list[int], langs: list[str], steps: int = STEPS, rate: float = RATE) -> Model:
    """Gradient steps (Adam) on the CRF likelihood of documents labelled throughout.

    Each step adds up the gradients of blocks of documents, so that only one block's features and
    messages are in memory."""
    k, size = len(langs), 1 << TABLE_BITS
    seen = np.zeros(size, bool)
    for data, w, _ in _fit_blocks(texts, labels):
        grams, _, affix = features(data, w)
        seen[grams.ravel()] = seen[affix.ravel()] = True
    used = np.flatnonzero(seen)
    weights, start, moves = np.zeros((size, k)), np.zeros(k), np.zeros((k, k))
    if len(used):
        number = np.zeros(size, np.int32)
        number[used] = np.arange(len(used))
        theta = [np.zeros((len(used), k)), start, moves]
        m1, m2 = [np.zeros_like(t) for t in theta], [np.zeros_like(t) for t in theta]
        for step in range(1, steps + 1):
            weights[used] = theta[0]
            grad, firsts, moved = (np.zeros_like(t) for t in theta)
            n = docs = 0
            for data, w, y in _fit_blocks(texts, labels):
                some = _step(data, w, y, number, theta, weights)
                grad += some[0]
                firsts += some[1]
                moved += some[2]
                n, docs = n + some[3], docs + some[4]
            ups = [grad / n * 100 - 1e-3 * theta[0], firsts / docs - 1e-2 * theta[1], moved / n * 10 - 1e-2 * theta[2]]
            for i, g in enumerate(ups):
                m1[i] = 0.8 * m1[i] + 0.2 * g
                m2[i] = 0.95 * m2[i] + 0.05 * g * g
                theta[i] = theta[i] + rate * (m1[i] / (1 - 0.8**step)) / (np.sqrt(m2[i] / (1 - 0.95**step)) + 1e-6)
        weights[used], start, moves = theta
    return Model(langs, weights.astype(np.float32), start, moves)


def label_words(text: str, model: Model) -> list[tuple[str, str]]:
    """Each word of one text with its likeliest language."""
    data, offsets = B.buffer_of(pa.array([text.encode()], pa.binary()))
    w = B.words(data, offsets, separators())
    if not len(w.hash):
        return []
    p = marginals(emissions(data, w, model.weights), w.count, model.start, model.moves)
    return [(bytes(data[a:b]).decode("utf-8", "replace"), model.langs[i]) for a, b, i in zip(w.start, w.end, p.argmax(1))]


def predict(texts: pa.Array, model: Model) -> tuple[list[str], list[float]]:
    n = len(texts)
    lang, score = ["und"] * n, np.zeros(n)
    if not model.langs:
        return lang, score.tolist()
    data, offsets = B.buffer_of(texts)
    w = B.words(data, offsets, separators())
    some = np.flatnonzero(w.count > 0)
    if len(some):
        p = marginals(emissions(data, w, model.weights), w.count[some], model.start, model.moves)
        sums = np.add.reduceat(p, (np.cumsum(w.count) - w.count)[some], axis=0)
        best = sums.argmax(1)
        share = sums[np.arange(len(some)), best] / w.count[some]
        for i, j, s in zip(some.tolist(), best.tolist(), share.tolist()):
            text = bytes(data[offsets[i]:offsets[i + 1]]).decode()
            if any(map(str.isalpha, text)):
                lang[i], score[i] = model.langs[j], min(1.0, s)
    return lang, score.tolist()


def _sample(df: DataFrame, per_lang: int) -> dict[tuple[str, bool], list[int]]:
    """For each language, and whether its texts are long: the smallest hashes of distinct texts,
    ``per_lang`` per language, long ones only for want of others.

    ``df`` has lang, long and h, one row per text; hashes are evenly spread, so those under a
    threshold a little above the share wanted come to the driver."""
    distinct = materialize(df.distinct(), "lang-texts")
    counts = {(r[0], r[1]): r[2] for r in distinct.groupBy("lang", "long").count().collect()}
    want = {(lang, long): min(n, per_lang - (min(per_lang, counts.get((lang, False), 0)) if long else 0)) for (lang, long), n in counts.items()}
    got: dict[tuple[str, bool], list[int]] = {}
    short, slack = {key: n for key, n in want.items() if n > 0}, 1
    while short:
        under = [(F.col("lang") == lang) & (F.col("long") == long) & (F.col("at") < int(min(1.0, slack * (n + 6 * n**0.5 + 10) / counts[lang, long]) * SPAN))
                 for (lang, long), n in short.items()]
        seen: dict[tuple[str, bool], list] = {}
        for lang, long, at, h in distinct.withColumn("at", F.pmod("h", F.lit(SPAN))).where(reduce(or_, under)).select("lang", "long", "at", "h").collect():
            seen.setdefault((lang, long), []).append((at, h))
        got |= {key: [h for _, h in sorted(seen[key])[:n]] for key, n in short.items() if len(seen.get(key, [])) >= n}
        short, slack = {key: n for key, n in short.items() if key not in got}, slack * 8
    return got


def train(df: DataFrame, learn: Column, text_col: str = "text", lang_col: str = "lang", per_lang: int = PER_LANG) -> Model:
    """Fit on ``per_lang`` distinct texts per language, or all if fewer, out of the rows where ``learn`` holds."""
    rows = df.where(learn & F.col(lang_col).isNotNull() & F.col(text_col).rlike(r"\p{L}")).select(
        F.col(lang_col).alias("lang"), (F.octet_length(text_col) > FIT_BYTES).alias("long"), F.xxhash64(text_col).alias("h"), F.col(text_col).alias("text"))
    picked = _sample(rows.select("lang", "long", "h"), per_lang)
    langs = sorted({lang for lang, _ in picked})
    if not langs:
        return Model([], np.zeros((1 << TABLE_BITS, 0), np.float32), np.zeros(0), np.zeros((0, 0)))
    keys = df.sparkSession.createDataFrame([(lang, long, h) for (lang, long), some in picked.items() for h in some], "lang string, long boolean, h long")
    from_letter = F.substring(F.regexp_replace("text", r"^\P{L}+", ""), 1, FIT_BYTES)
    texts = rows.join(F.broadcast(keys), ["lang", "long", "h"]).withColumn("text", F.when(F.col("long"), from_letter).otherwise(F.col("text")))
    got = texts.groupBy("lang", "long", "h").agg(F.min("text")).collect()
    number = {lang: i for i, lang in enumerate(langs)}
    got = sorted((number[r[0]], window(r[3].encode()) if r[1] else r[3].encode()) for r in got)
    return fit([text for _, text in got], [i for i, _ in got], langs)


def window(text: bytes) -> bytes:
    """The first ``FIT_BYTES`` bytes, up to the end of a word unless it is longer."""
    if len(text) <= FIT_BYTES:
        return text
    cut = text[:FIT_BYTES + 1]
    head = cut[:max(cut.rfind(c) for c in b" \n\t")] if any(c in cut for c in b" \n\t") else cut[:-1]
    return head.decode("utf-8", "ignore").encode()


def identify(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", carry: list[str] | None = None) -> DataFrame:
    """One row per row of ``df``: id, text, carried columns, lang_pred, score."""
    from pyspark.sql.pandas.types import to_arrow_schema
    keep = [c for c in df.columns if c in (carry or []) and c not in (id_col, text_col, *RESULT)]
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), *([F.struct(*keep).alias("carried")] if keep else []))
    schema = T.StructType(rows.schema.fields + [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    arrow = to_arrow_schema(schema)
    sent = df.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for block in B.slices(batches, "text", BLOCK):
            lang, score = predict(block.column("text").cast(pa.binary()), sent.value)
            made = {"lang_pred": pa.array(lang, pa.string()), "score": pa.array(score, pa.float64())}
            yield pa.RecordBatch.from_arrays([made[f.name] if f.name in made else block.column(f.name).cast(f.type) for f in arrow], schema=arrow)
    return rows.mapInArrow(run, schema).select(F.col("id").alias(id_col), F.col("text").alias(text_col), *(["carried.*"] if keep else []), *RESULT)
