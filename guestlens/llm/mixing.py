"""Mixing sources to target weights (operator 5); DataFrame functions only.

Every document gets a hash-random key.  Its high bits are its range: the ranges cut
each source into equal shares in key order without sampling, so a source with a
third of all rows is as many ranges as the rows need.  Prefix sums of the sizes
are taken in two steps, over the ranges of a source and inside a range, and the
mix takes documents in key order up to the source's exact budget.  A budget above
the source's size takes the whole source as often as it fits (epochs), then the rest;
the document at the cut is taken in part.

Targets: sources in code point order (null last) weigh ``weights`` in turn and share
the total size; no target passes ``most`` times its source's size, and what is above is
reshared by weight until nothing is.

Defined results: a null text has size 0; sources of size 0 get target 0; rows with equal
keys (equal id and text) are interchangeable and in any order; a null doc_id is kept; an
empty table gives an empty result; other columns are ignored unless carried, and
carried columns named like a result give way to it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from guestlens.llm.tables import materialize

WEIGHTS = (5, 2, 1)
MOST = 3
ROWS_PER_RANGE = 20_000
KEY_BITS = 60

RESULT = ["size", "source_size", "target", "taken"]


def word_count(text: str) -> Column:
    return F.coalesce(F.regexp_count(F.col(text).cast("string"), F.lit("[^ \\t-\\r]+")), F.lit(0)).cast("long")


def random_key(id_col: str, text_col: str) -> Column:
    """60 bits of the MD5 of the id and the text's MD5 (the same in any engine)."""
    word = F.concat(F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.lit(":"),
                    F.md5(F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary")))
    return F.conv(F.substring(F.md5(word.cast("binary")), 1, KEY_BITS // 4), 16, 10).cast("long")


def targets(sizes: DataFrame, weights=WEIGHTS, most=MOST) -> DataFrame:
    """(source, source_size, target) of (source, source_size)."""
    # Numbered in order by rows of sorted partitions, written before the offsets are
    # taken: any number of sources, and no single task for all of them.
    sorted_ = materialize(sizes.orderBy(F.col("source").asc_nulls_last()).withColumn("at", F.monotonically_increasing_id()), "sources")
    part = F.shiftright("at", 33)
    counts = sorted_.groupBy(part.alias("part")).agg(F.count("*").alias("n"))
    offsets = counts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("offset"))
    turn = F.pmod(F.col("offset") + F.col("at").bitwiseAND(F.lit((1 << 33) - 1)), F.lit(len(weights)))
    weighed = materialize(sorted_.withColumn("part", part).join(F.broadcast(offsets), "part").select(
        "source", "source_size", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (turn + 1).cast("int")).alias("weight")), "sources")
    full = F.col("source_size") * F.lit(float(most))
    total = weighed.agg(F.sum("source_size")).first()[0] or 0
    level = 0.0
    while True:                                     # each pass caps one more source at least
        above = F.lit(level) * F.col("weight") >= full
        capped, open_ = weighed.agg(F.sum(F.when(above, full)), F.sum(F.when(~above, F.col("weight")))).first()
        new = (total - (capped or 0.0)) / open_ if open_ else level
        if not open_ or new <= level:
            break
        level = new
    return weighed.select("source", "source_size", F.least(full, F.lit(level) * F.col("weight")).alias("target"))


def mix(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
        weights=WEIGHTS, most=MOST, carry: list[str] | None = None) -> DataFrame:
    """One row per row of ``df``: id, carried columns, size, source_size, target, taken."""
    keep = [c for c in df.columns if c in (carry or []) and c not in (id_col, *RESULT)]
    sized = df.select(F.col(id_col).alias("__id"), F.col(source_col).cast("string").alias("__source"), word_count(text_col).alias("__size"),
                      random_key(id_col, text_col).alias("__key"), *[F.col(c).alias(f"__c_{c}") for c in keep])
    slim = materialize(sized, "sizes")
    bits = max(0, (slim.count() // ROWS_PER_RANGE).bit_length())
    slim = slim.withColumn("__range", F.shiftright("__key", KEY_BITS - bits) if bits else F.lit(0).cast("long"))
    # A missing source is a source of its own and must meet itself in joins.
    slim = slim.withColumn("__missing", F.col("__source").isNull()).withColumn("__source", F.coalesce("__source", F.lit("")))
    by = ["__missing", "__source"]
    ranges = slim.groupBy(*by, "__range").agg(F.sum("__size").alias("sum"))
    sources = ranges.groupBy(*by).agg(F.sum("sum").alias("source_size"))
    plan = targets(sources.select(F.when(~F.col("__missing"), F.col("__source")).alias("source"), "source_size"), weights, most)
    plan = plan.select(F.col("source").isNull().alias("__missing"), F.coalesce("source", F.lit("")).alias("__source"), "source_size", "target")
    budget = F.round("target").cast("long")
    before = ranges.select(*by, "__range", (F.sum("sum").over(Window.partitionBy(*by).orderBy("__range")) - F.col("sum")).alias("before"))
    offsets = before.join(plan, by)
    inside = Window.partitionBy(*by, "__range").orderBy("__key", "__id", "__size")
    placed = (slim.join(offsets, [*by, "__range"])
              .withColumn("__start", F.col("before") + F.sum("__size").over(inside.rowsBetween(Window.unboundedPreceding, 0)) - F.col("__size")))
    safe = F.greatest("source_size", F.lit(1))
    epochs = F.floor(budget / safe)
    epochs = F.when(epochs * safe > budget, epochs - 1).otherwise(epochs).cast("long")
    rest = budget - epochs * safe
    taken = epochs * F.col("__size") + F.least(F.greatest(rest - F.col("__start"), F.lit(0)), F.col("__size"))
    return placed.select(F.col("__id").alias(id_col), *[F.col(f"__c_{c}").alias(c) for c in keep], F.col("__size").alias("size"), "source_size",
                         "target", F.when(F.col("source_size") > 0, taken).otherwise(F.lit(0)).cast("long").alias("taken"))
