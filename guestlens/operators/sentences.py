"""A5 / A10: sentences that stand for what a place's reviews say about an aspect.

Per place, aspect and polarity, the sentences that mention it are weighed by tf-idf; those
nearest to their centroid are candidates, and of the candidates ``k`` are taken one after the other, each as
relevant and as unlike those already taken as possible (maximal marginal relevance).

Centroids and norms are aggregates with partial sums.  The sentences meet their words' counts in one
equi-join on (group, word).  Only the ``CANDIDATES`` best of a group ever stand in one row: a window
with a partial limit keeps them.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from guestlens.functions.text import words
from guestlens.operators.aspects import mentions
from guestlens.sources.scratch import materialize

GROUP = ["data_id", "aspect", "polarity"]
SENTENCE_SPLIT = r"[.!?\n]+"
CANDIDATES = 10
RELEVANCE = 0.7             # weight of relevance against likeness to the taken ones


def group_sentences(reviews: DataFrame, lexicon: Sequence[tuple], polarity: Sequence[tuple]) -> DataFrame:
    """Per group its different sentences (by their lower-cased words, ``key``): sentence (least spelling), support (reviews)."""
    # Dealt by review, a file's row group is not one task's work and what a review says meets without another shuffle.
    said = reviews.repartition("data_id", "review_id").select("data_id", "review_id", "rating", "ts", F.explode(F.split(F.coalesce("review_text", F.lit("")), SENTENCE_SPLIT)).alias("sentence"))
    said = said.withColumn("sentence", F.trim("sentence")).where(F.col("sentence") != "").withColumn("review_text", F.col("sentence"))
    m = mentions(said, lexicon, polarity, extra=["sentence"])
    m = m.withColumn("key", F.array_join(words(F.lower("sentence")), " "))
    one = m.groupBy(*GROUP, "key", "review_id").agg(F.min("sentence").alias("sentence"))
    return one.groupBy(*GROUP, "key").agg(F.min("sentence").alias("sentence"), F.count(F.lit(1)).cast("long").alias("support"))


def sentence_vectors(sentences: DataFrame) -> DataFrame:
    """group, key, sentence, support, relevance (cosine with the group's centroid, 6 decimals), norm and weights (word -> tf-idf)."""
    # Written once, with a number for each: its words travel without its text.
    sentences = materialize(sentences.withColumn("_id", F.monotonically_increasing_id()), "sentences")
    # Sorted, equal words stand together: a word's count is the way to where the next one begins.
    w = sentences.select(*GROUP, "_id", "support", F.sort_array(F.split("key", " ")).alias("_w"))
    w = w.withColumn("_at", F.filter(F.sequence(F.lit(0), F.size("_w") - 1), lambda i: ~F.get("_w", i).eqNullSafe(F.get("_w", i - 1))))
    tf = w.select(*GROUP, "_id", "support", F.inline(F.transform("_at", lambda i, j: F.struct(
        F.get("_w", i).alias("word"), (F.coalesce(F.get("_at", j + 1), F.size("_w")) - i).cast("long").alias("tf")))))
    n = sentences.groupBy(*GROUP).agg(F.count(F.lit(1)).alias("n"))
    per_word = (tf.groupBy(*GROUP, "word").agg(F.count(F.lit(1)).alias("df"), F.sum(F.col("support") * F.col("tf")).alias("mass")).join(n, GROUP)
                .withColumn("idf", F.log(1 + F.col("n") / F.col("df"))).select(*GROUP, "word", "idf", (F.col("mass") * F.col("idf")).alias("centre")))
    per_word = materialize(per_word, "group-words")
    centre = per_word.groupBy(*GROUP).agg(F.sqrt(F.sum(F.col("centre") * F.col("centre"))).alias("_length"))
    w = F.col("tf") * F.col("idf")
    each = tf.join(per_word, [*GROUP, "word"]).groupBy("_id").agg(
        F.sqrt(F.sum(w * w)).alias("norm"), F.sum(w * F.col("centre")).alias("_dot"), F.map_from_entries(F.collect_list(F.struct("word", w))).alias("weights"))
    whole = sentences.join(each, "_id").join(centre, GROUP)
    return whole.withColumn("relevance", F.round(F.col("_dot") / (F.col("norm") * F.col("_length")), 6)).drop("_id", "_dot", "_length")


def representative_sentences(reviews: DataFrame, lexicon: Sequence[tuple], polarity: Sequence[tuple], k: int = 3) -> DataFrame:
    """group, pick (1..k), sentence, support, relevance; ties go to the better supported, then to the smaller sentence."""
    best = Window.partitionBy(*GROUP).orderBy(F.desc("relevance"), F.desc("support"), "key")
    top = sentence_vectors(group_sentences(reviews, lexicon, polarity)).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= CANDIDATES)
    # Maps have no order, so the candidates are put at their ranks by entries.
    c = top.groupBy(*GROUP).agg(F.map_from_entries(F.collect_list(F.struct("rank", F.struct("sentence", "support", "relevance", "norm", "weights")))).alias("_c"))
    c = c.withColumn("_taken", F.array(F.lit(1)))

    def like(a, b):
        dot = F.aggregate(F.map_entries(a["weights"]), F.lit(0.0), lambda s, e: s + e["value"] * F.coalesce(F.try_element_at(b["weights"], e["key"]), F.lit(0.0)))
        return F.round(dot / (a["norm"] * b["norm"]), 6)

    def score(rank):
        own = F.element_at("_c", rank)
        nearest = F.array_max(F.transform("_taken", lambda t: like(own, F.element_at("_c", t))))
        return F.round(RELEVANCE * own["relevance"] - (1 - RELEVANCE) * nearest, 6)
    for _ in range(k - 1):
        c = c.withColumn("_rest", F.filter(F.map_keys("_c"), lambda r: ~F.array_contains("_taken", r)))
        new = F.array_min(F.transform("_rest", lambda r: F.struct((-score(r)).alias("s"), r.alias("rank"))))["rank"]
        new = F.when(F.size("_rest") > 1, new).otherwise(F.get("_rest", 0))      # the only one left needs no score
        c = c.withColumn("_taken", F.when(F.size("_taken") < F.size("_c"), F.concat("_taken", F.array(new))).otherwise(F.col("_taken")))
    out = c.select(*GROUP, "_c", F.posexplode("_taken").alias("_i", "_t"))
    own = F.element_at("_c", F.col("_t"))
    return out.select(*GROUP, (F.col("_i") + 1).cast("long").alias("pick"), own["sentence"].alias("sentence"), own["support"].alias("support"), own["relevance"].alias("relevance"))
