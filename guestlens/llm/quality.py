"""Quality classifier on document statistics (operator 7).

Every text becomes a vector of statistics of its bytes and words (shares of kinds of
characters, word lengths, repetition, sentence ends, size), taken with numpy for a block
of texts at once.  Random Fourier features, cos(z W + u), approximate a Gaussian kernel
over the standardised statistics.  Each partition sums its part of the normal equations;
Spark adds the parts, and their solution is a ridge regression on the labels.
Isotonic regression (pool adjacent violators) over sums by score bin calibrates
the ridge scores to probabilities.

Learning uses all labelled rows that ``learn`` admits; nothing is sampled.  Sizes of
what reaches the driver depend on the number of features and bins only.

Defined results: a null or blank text has the statistics of no words and is scored;
a doc_id with several labels counts once with their mean; labels that are null or of no
document are left out; without any label every score is 0.5; rows with a null id are
scored; repeated rows are scored alike; other columns are ignored; an empty table gives
an empty result.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from guestlens.llm import blocks as B
from guestlens.llm.tables import as_binary, materialize

FEATURES = 256          # random Fourier features
WIDTH = 0.8             # kernel width, in square roots of the number of statistics
RIDGE = 1e-3            # per row
BINS = 2000
THRESHOLD = 0.3
SEED = 11

KINDS = ["lower", "upper", "digit", "high", "blank", "line", "bang", "bar", "sign", "stop", "other"]
STATS = [*KINDS, "words", "length", "length_sd", "short", "long", "repeat", "distinct", "wordless", "ends_sign", "starts_upper", "top"]


def _kinds() -> np.ndarray:
    t = np.full(256, KINDS.index("other"), np.uint8)
    t[97:123], t[65:91], t[48:58], t[128:] = (KINDS.index(x) for x in ("lower", "upper", "digit", "high"))
    for chars, kind in ((b" \t\r\x0b\x0c", "blank"), (b"\n", "line"), (b"!?", "bang"), (b"|", "bar"), (b"#$%&*@^~=+<>{}[]\\/_", "sign"), (b".,;:", "stop")):
        t[list(chars)] = KINDS.index(kind)
    return t


def statistics(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One row of ``STATS`` for each text of a block."""
    n = len(offsets) - 1
    kinds = _kinds()
    kind = kinds[data]
    size = np.diff(offsets)
    doc = np.repeat(np.arange(n, dtype=np.int64), size)
    count = np.bincount(doc * len(KINDS) + kind, minlength=n * len(KINDS)).reshape(n, -1)
    out = np.zeros((n, len(STATS)))
    out[:, :len(KINDS)] = count / np.maximum(1, size)[:, None]
    w = B.words(data, offsets, B.white_space())
    words = np.maximum(1, w.count)
    length = (w.end - w.start).astype(float)
    add = lambda x: np.bincount(w.doc, weights=x, minlength=n) / words
    mean = add(length)
    same = np.zeros(len(w.hash), bool)
    same[1:] = (w.hash[1:] == w.hash[:-1]) & (w.doc[1:] == w.doc[:-1])
    key = np.sort(B.mix(w.hash + w.doc.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(24)
                  | (w.doc.astype(np.uint64) << np.uint64(40)))
    starts = B.groups(key)
    runs = np.diff(np.r_[starts, len(key)])
    owner = (key[starts] >> np.uint64(40)).astype(np.int64)
    most = np.zeros(n)
    np.maximum.at(most, owner, runs)
    # Letters of words, from running sums over the block.
    letters = np.r_[0, np.cumsum(np.isin(kind, [KINDS.index(x) for x in ("lower", "upper", "high")]))]
    last = kind[w.end - 1] if len(w.end) else np.zeros(0, np.uint8)
    first = kind[w.start] if len(w.start) else np.zeros(0, np.uint8)
    odd = np.isin(last, [KINDS.index(x) for x in ("bang", "sign", "bar", "other")])
    for name, x in (("words", np.log1p(w.count)), ("length", mean), ("length_sd", np.sqrt(np.maximum(0, add(length**2) - mean**2))),
                    ("short", add(length <= 3)), ("long", add(length >= 14)), ("repeat", add(same)),
                    ("distinct", np.bincount(owner, minlength=n) / words), ("wordless", add(letters[w.end] == letters[w.start])),
                    ("ends_sign", add(odd)), ("starts_upper", add(first == KINDS.index("upper"))), ("top", most / words)):
        out[:, STATS.index(name)] = x
    return out


class Model(NamedTuple):
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray     # of the random features, after the intercept
    bins: np.ndarray        # ridge scores, rising
    chance: np.ndarray      # calibrated at each


def directions() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(SEED)
    width = WIDTH * np.sqrt(len(STATS))
    return rng.normal(0, 1 / width, (len(STATS), FEATURES)), rng.uniform(0, 2 * np.pi, FEATURES)


def fourier(stats: np.ndarray, mean: np.ndarray, scale: np.ndarray) -> np.ndarray:
    """Intercept and random Fourier features of standardised statistics."""
    w, u = directions()
    z = np.clip((stats - mean) / scale, -6, 6)
    return np.c_[np.ones(len(z)), np.sqrt(2 / FEATURES) * np.cos(z @ w + u)]


def isotonic(x: np.ndarray, n: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators over points x (rising) with n rows and y positives:
    the centres and means of the pools."""
    pools: list[list[float]] = []
    for xi, ni, yi in zip(x, n, y):
        pools.append([xi * ni, ni, yi])
        while len(pools) > 1 and pools[-2][2] * pools[-1][1] >= pools[-1][2] * pools[-2][1]:
            last = pools.pop()
            pools[-1] = [a + b for a, b in zip(pools[-1], last)]
    return np.array([p[0] / p[1] for p in pools]), np.array([p[2] / p[1] for p in pools])


def _unpack(column) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.float64).reshape(-1, len(STATS))


def _moments(batches):
    """Count, sums and sums of squares of the statistics of a partition, one row per statistic."""
    total = np.zeros((len(STATS), 2))
    n = 0
    for batch in batches:
        x = _unpack(batch.column("stats"))
        total += np.stack([x.sum(0), (x * x).sum(0)], 1)
        n += len(x)
    yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(STATS))), pa.array([n] * len(STATS), pa.int64()), pa.array(total[:, 0]), pa.array(total[:, 1])], ["i", "n", "s", "q"])


def _normal(batches, mean, scale):
    """A partition's part of the normal equations, a row of the matrix at a time."""
    total = np.zeros((FEATURES + 1, FEATURES + 2))
    for batch in batches:
        z = fourier(_unpack(batch.column("stats")), mean, scale)
        total += z.T @ np.c_[z, batch.column("label").to_numpy()]
    yield pa.RecordBatch.from_arrays([pa.array(np.arange(FEATURES + 1)), pa.array([r.tobytes() for r in total], pa.binary())], ["i", "part"])


def _add(key, table: pa.Table) -> pa.Table:
    total = sum(np.frombuffer(x, np.float64) for x in table.column("part").to_pylist())
    return pa.table({"i": pa.array([key[0].as_py()], pa.int64()), "part": pa.array([total.tobytes()], pa.binary())})


def _bins(batches, model: Model):
    for batch in batches:
        raw = ridge(_unpack(batch.column("stats")), model)
        yield pa.RecordBatch.from_arrays([pa.array(np.clip(np.floor((raw + 0.5) / 2 * BINS), 0, BINS - 1).astype(np.int64)), batch.column("label")], ["bin", "label"])


def ridge(stats: np.ndarray, model: Model) -> np.ndarray:
    return fourier(stats, model.mean, model.scale) @ model.weights


def chances(stats: np.ndarray, model: Model | None) -> np.ndarray:
    if model is None:
        return np.full(len(stats), 0.5)
    return np.clip(np.interp(ridge(stats, model), model.bins, model.chance), 0, 1)


def describe(df: DataFrame, learn: Column, id_col: str, text_col: str) -> DataFrame:
    """(id, learn, stats) of every row, written once: all later steps read it."""
    def run(batches):
        for block in B.slices(batches, "text"):
            x = statistics(*B.buffer_of(block.column("text")))
            yield pa.RecordBatch.from_arrays([block.column("id"), block.column("learn"), pa.array([r.tobytes() for r in x], pa.binary())], ["id", "learn", "stats"])
    rows = df.select(F.col(id_col).alias("id"), learn.alias("learn"), as_binary(text_col).alias("text"))
    return materialize(rows.mapInArrow(run, f"id {df.schema[id_col].dataType.simpleString()}, learn boolean, stats binary"), "stats")


def train(stats: DataFrame, labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality") -> Model | None:
    """Fit on the rows of ``stats`` that may be learned from and have a label."""
    one = labels.where(F.col(label_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.avg(label_col).cast("double").alias("label"))
    known = materialize(stats.where("learn").join(one, "id").select("stats", "label"), "labelled")
    sums = stats.select("stats").mapInArrow(_moments, "i long, n long, s double, q double").groupBy("i").agg(F.sum("n"), F.sum("s"), F.sum("q")).orderBy("i").collect()
    n = known.count()
    if not n:
        return None
    m = np.array([r[2] / max(1, r[1]) for r in sums])
    scale = np.sqrt(np.maximum(np.array([r[3] / max(1, r[1]) for r in sums]) - m * m, 1e-8))
    parts = (known.mapInArrow(lambda it: _normal(it, m, scale), "i long, part binary").groupBy("i").applyInArrow(lambda key, t: _add(key, t), "i long, part binary")
             .orderBy("i").collect())
    system = np.stack([np.frombuffer(r[1], np.float64) for r in parts])
    penalty = RIDGE * n * np.eye(FEATURES + 1)
    penalty[0, 0] = 0
    weights = np.linalg.solve(system[:, :-1] + penalty, system[:, -1])
    model = Model(m, scale, weights, np.zeros(1), np.zeros(1))
    bins = (known.mapInArrow(lambda it: _bins(it, model), "bin long, label double").groupBy("bin").agg(F.count("*"), F.sum("label")).orderBy("bin").collect())
    x, chance = isotonic(np.array([(r[0] + 0.5) / BINS * 2 - 0.5 for r in bins]), np.array([r[1] for r in bins], float), np.array([r[2] for r in bins]))
    return model._replace(bins=x, chance=chance)


def score(stats: DataFrame, model: Model | None) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of ``stats``."""
    sent = stats.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            p = chances(_unpack(batch.column("stats")), sent.value)
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("learn"), pa.array(p)], ["id", "learn", "score"])
    out = stats.mapInArrow(run, f"id {stats.schema['id'].dataType.simpleString()}, learn boolean, score double")
    return out.select(F.col("id").alias("doc_id"), (~F.col("learn")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
