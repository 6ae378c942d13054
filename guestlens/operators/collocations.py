"""A6 without a list: themes that the texts themselves show, as pairs of adjacent words.

A pair is a *collocation* if its words stand next to each other far more often than their own counts
explain (Dunning's log-likelihood ratio).  All counts come from one aggregate of pairs with partial
sums: a word's count as first or second word is the sum over its pairs.  Nothing is counted per
text on the driver; the total number of pairs is the only value that reaches it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from guestlens.functions.text import words
from guestlens.operators.aspects import CLAUSE_SPLIT
from guestlens.sources.scratch import materialize

MIN_COUNT = 5
MIN_LLR = 10.83             # fixed value: chi-square with one degree of freedom at 0.001


def pairs_of(text: str) -> Column:
    """"first second" for all adjacent words of a clause, in text order."""
    clauses = F.transform(F.split(F.lower(F.coalesce(F.col(text), F.lit(""))), CLAUSE_SPLIT), words)
    return F.flatten(F.transform(clauses, lambda w: F.zip_with(
        F.slice(w, 1, F.greatest(F.size(w) - 1, F.lit(0))), F.slice(w, 2, F.greatest(F.size(w) - 1, F.lit(0))), lambda a, b: F.concat_ws(" ", a, b))))


def _part(k: Column, row: Column, column: Column, total: Column) -> Column:
    """k ln(k total / (row column)); 0 for none."""
    return F.when(k > 0, k * F.log(k * total / (row * column))).otherwise(0.0)


def pair_counts(texts: DataFrame, keys: Sequence[str] = (), text: str = "review_text") -> DataFrame:
    """Per ``keys`` and pair: n (occurrences) and n_texts (texts that say it).  Sorted, a text's equal pairs stand
    together, so that its first of each is known in its row; texts are dealt to tasks, as a file's row group is one task's work."""
    said = texts.repartition(*texts.columns).select(*keys, F.sort_array(pairs_of(text)).alias("_p"))
    before = F.concat(F.array(F.lit("")), F.slice("_p", 1, F.greatest(F.size("_p") - 1, F.lit(0))))
    # No filter on the pairs: the planner would work them out once more for it, before the texts are dealt.
    each = said.select(*keys, F.inline(F.arrays_zip(F.col("_p").alias("pair"), before.alias("before")))).where(F.col("pair").isNotNull())
    return each.groupBy(*keys, "pair").agg(F.count(F.lit(1)).cast("long").alias("n"), F.sum((F.col("pair") != F.col("before")).cast("long")).alias("n_texts"))


def collocations(texts: DataFrame, text: str = "review_text", min_count: int = MIN_COUNT, min_llr: float = MIN_LLR) -> DataFrame:
    """All collocations of the texts: first, second, n (occurrences of the pair), n_first and n_second (pairs
    with that first, second word), llr (3 decimals).

    Pairs seen fewer than ``min_count`` times, less often than by chance, or with a ratio under ``min_llr`` are none."""
    return counted_collocations(pair_counts(texts, text=text), min_count, min_llr)


def counted_collocations(pair: DataFrame, min_count: int = MIN_COUNT, min_llr: float = MIN_LLR) -> DataFrame:
    """The same from counts (pair, n)."""
    pair = materialize(pair.select(F.substring_index("pair", " ", 1).alias("first"), F.substring_index("pair", " ", -1).alias("second"), "n"), "pairs")
    total = F.lit(pair.agg(F.sum("n")).first()[0] or 0).cast("double")
    firsts = pair.groupBy("first").agg(F.sum("n").alias("n_first"))
    seconds = pair.groupBy("second").agg(F.sum("n").alias("n_second"))
    often = pair.where(F.col("n") >= min_count).join(firsts, "first").join(seconds, "second")
    n, a, b = (F.col(c).cast("double") for c in ("n", "n_first", "n_second"))
    llr = 2 * (_part(n, a, b, total) + _part(a - n, a, total - b, total) + _part(b - n, total - a, b, total)
               + _part(total - a - b + n, total - a, total - b, total))
    return (often.withColumn("llr", F.round(llr, 3)).where((n * total > a * b) & (F.col("llr") >= min_llr))
            .select("first", "second", "n", "n_first", "n_second", "llr"))


def mined_themes(reviews: DataFrame, known: Sequence[str] = (), min_support: int = 2, min_count: int = MIN_COUNT,
                 min_llr: float = MIN_LLR) -> DataFrame:
    """A6 over collocations: per place the pairs that at least ``min_support`` of its reviews say: data_id,
    theme, n_reviews, llr.  Pairs with a word of ``known`` (terms that a list covers) are left out."""
    # One pass over the texts: the pairs of all texts are those of the places, summed.
    counts = materialize(pair_counts(reviews, ["data_id"]), "place-pairs")
    found = counted_collocations(counts.groupBy("pair").agg(F.sum("n").alias("n")), min_count, min_llr)
    if known:
        found = found.where(~F.col("first").isin(*known) & ~F.col("second").isin(*known))
    found = found.select(F.concat_ws(" ", "first", "second").alias("theme"), "llr")
    per = counts.where(F.col("n_texts") >= min_support).select("data_id", F.col("pair").alias("theme"), F.col("n_texts").alias("n_reviews"))
    return per.join(found, "theme").select("data_id", "theme", "n_reviews", "llr")
