"""Benchmark decontamination (operator 2).

Texts are normalised to words (A-Z lower-cased; a word is a run of a-z, 0-9 and
non-ASCII bytes) joined by single spaces.  Every window of ``n`` consecutive item
words (an item of fewer words is one window) becomes a pattern of one Aho-Corasick
automaton; each document's normalised text runs through it once, and the ends of
the matches are mapped back to words and to characters of the original text.

The benchmark is a fixed test set.  Its patterns are broadcast only up to
``SHARD_BYTES`` of item text; a larger benchmark is split by item into so many
automatons, and the hits of a document are joined afterwards.

Defined results: null texts have no words and no hits; items without words match
nothing, nor do items without an id; equal windows of several items count for each;
repeated items count once by item_id; an empty benchmark or table gives no hits or no rows; other columns are
ignored, and carried columns named like a result give way to it.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from guestlens.llm.tables import text_bytes

N = 10                      # words in a window
SHARD_BYTES = 1 << 20       # item text per automaton, which takes some 400 times as much memory

RESULT = ["n_words", "n_hit", "n_items", "items", "spans", "contaminated"]
_KEEP = {*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)}
# Every byte to itself, its lower case, or the space that ends a word.
NORMAL = bytes(b + 32 if 65 <= b <= 90 else b if b in _KEEP else 32 for b in range(256))
WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]+")


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(NORMAL).split()


def patterns(items: list[tuple], n: int = N) -> dict[bytes, tuple[int, list[str]]]:
    """Window (words between single spaces) -> its number of words and the items it is in."""
    out: dict[bytes, tuple[int, list[str]]] = {}
    for item, text in items:
        ws = words_of(text)
        for i in range(max(1, len(ws) - n + 1) if ws else 0):
            part = ws[i:i + n]
            own = out.setdefault(b" " + b" ".join(part) + b" ", (len(part), []))[1]
            if str(item) not in own:
                own.append(str(item))
    return out


_AUTOMATON: dict[str, object] = {}


def automaton(name: str, found: dict):
    """Built once per worker and kept for its next tasks."""
    if name not in _AUTOMATON:
        import ahocorasick
        a = ahocorasick.Automaton()
        for pattern, what in found.items():
            a.add_word(pattern.decode("latin-1"), what)
        if found:
            a.make_automaton()
        _AUTOMATON.clear()
        _AUTOMATON[name] = a
    return _AUTOMATON[name]


def scan(text: str | None, machine) -> tuple[int, list[tuple[int, int]], set]:
    """Number of words, hit ranges of words (merged), items."""
    ws = words_of(text)
    if not ws or not len(machine):
        return len(ws), [], set()
    line = " " + b" ".join(ws).decode("latin-1") + " "
    ranges: list[list[int]] = []
    items: set = set()
    done = at = 0                                       # spaces before ``done``
    for end, (size, own) in machine.iter(line):
        at += line.count(" ", done, end + 1)
        done = end + 1
        last = at - 1                                   # words that end before this space
        items.update(own)
        if ranges and last - size <= ranges[-1][1]:
            ranges[-1] = [min(ranges[-1][0], last - size), last]
            while len(ranges) > 1 and ranges[-1][0] <= ranges[-2][1]:
                ranges[-2:] = [[min(ranges[-2][0], ranges[-1][0]), ranges[-1][1]]]
        else:
            ranges.append([last - size, last])
    return len(ws), [tuple(r) for r in ranges], items


def merge(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(ranges):
        if out and a <= out[-1][1]:
            out[-1][1] = max(b, out[-1][1])
        else:
            out.append([a, b])
    return [tuple(r) for r in out]


def characters(text: str, ranges: list[tuple[int, int]]) -> list[dict]:
    """Ranges of words as ranges of characters of the original text."""
    raw = text.encode()
    spans = [m.span() for m in WORD.finditer(raw)]
    at = lambda byte: len(raw[:byte].decode())
    return [{"start": at(spans[a][0]), "end": at(spans[b - 1][1])} for a, b in ranges]


def decontaminate(df: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  item_col: str = "item_id", item_text: str = "text", n: int = N,
                  carry: list[str] | None = None) -> DataFrame:
    """One row per row of ``df``: id, text, carried columns, n_words, n_hit, n_items, items
    (sorted as strings), spans (characters of the original), contaminated."""
    from pyspark.sql.pandas.types import to_arrow_schema
    spark = df.sparkSession
    shards = max(1, -(-text_bytes(benchmark, item_text) // SHARD_BYTES))
    keep = [c for c in df.columns if c in (carry or []) and c not in (id_col, text_col, *RESULT)]
    span = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), *([F.struct(*keep).alias("carried")] if keep else []))
    base = rows.schema
    raw = T.StructType(base.fields + [T.StructField("__n", T.LongType()), T.StructField("__items", T.ArrayType(T.StringType())), T.StructField("__ranges", T.ArrayType(T.ArrayType(T.LongType())))])
    full = T.StructType(base.fields + [
        T.StructField("n_words", T.LongType()), T.StructField("n_hit", T.LongType()), T.StructField("n_items", T.LongType()),
        T.StructField("items", T.ArrayType(T.StringType())), T.StructField("spans", span), T.StructField("contaminated", T.BooleanType())])
    arrow_raw, arrow_full = to_arrow_schema(raw), to_arrow_schema(full)

    def finish(batch, found):
        texts = batch.column("text").to_pylist()
        made = {"n_words": [x[0] for x in found], "n_hit": [sum(b - a for a, b in x[1]) for x in found],
                "n_items": [len(x[2]) for x in found], "items": [sorted(x[2]) for x in found],
                "spans": [characters(t, x[1]) if x[1] else [] for t, x in zip(texts, found)],
                "contaminated": [bool(x[1]) for x in found]}
        return pa.RecordBatch.from_arrays([pa.array(made[f.name], f.type) if f.name in made else batch.column(f.name).cast(f.type) for f in arrow_full], schema=arrow_full)

    def scanner(shard):
        mine = benchmark.where(F.pmod(F.xxhash64(F.col(item_col)), F.lit(shards)) == shard) if shards > 1 else benchmark
        found = patterns([tuple(r) for r in mine.where(F.col(item_col).isNotNull()).select(item_col, item_text).collect()], n)
        name = hashlib.sha256(repr(sorted(found.items())).encode()).hexdigest()
        sent = spark.sparkContext.broadcast(found)

        def run(batches):
            machine = automaton(name, sent.value)
            for batch in batches:
                found = [scan(t, machine) for t in batch.column("text").to_pylist()]
                if shards == 1:
                    yield finish(batch, found)
                else:
                    made = {"__n": [x[0] for x in found], "__items": [sorted(x[2]) for x in found], "__ranges": [[list(r) for r in x[1]] for x in found]}
                    yield pa.RecordBatch.from_arrays([pa.array(made[f.name], f.type) if f.name in made else batch.column(f.name).cast(f.type) for f in arrow_raw], schema=arrow_raw)
        return run

    def named(out):
        return out.select(F.col("id").alias(id_col), F.col("text").alias(text_col), *(["carried.*"] if keep else []), *RESULT)

    if shards == 1:
        return named(rows.mapInArrow(scanner(0), full))
    numbered = rows.withColumn("__row", F.xxhash64(*[F.col(c) for c in rows.columns]))
    hits = None
    for shard in range(shards):
        one = rows.mapInArrow(scanner(shard), raw)
        one = one.withColumn("__row", F.xxhash64(*[F.col(c) for c in rows.columns])).where(F.size("__ranges") > 0).select("__row", "__items", "__ranges").dropDuplicates(["__row"])
        hits = one if hits is None else hits.union(one)
    joined = numbered.join(hits.groupBy("__row").agg(F.array_distinct(F.flatten(F.collect_list("__items"))).alias("__items"),
                                                     F.flatten(F.collect_list("__ranges")).alias("__ranges")), "__row", "left").drop("__row")

    def combine(batches):
        for batch in batches:
            found = [(len(words_of(t)), merge([tuple(x) for x in r or []]), set(i or []))
                     for t, r, i in zip(*(batch.column(c).to_pylist() for c in ("text", "__ranges", "__items")))]
            yield finish(batch, found)
    return named(joined.mapInArrow(combine, full))
