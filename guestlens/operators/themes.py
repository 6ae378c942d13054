"""A7 / W4 over time: the history of an issue, and whether a theme is said more of late.

Both read mentions with ``batch_id`` (the period) and ``n_place_batches``.  A theme of a very
large place has a row per batch; its order is taken by prefix sums over ranges of
``BATCHES_PER_RANGE`` batches (``ordering``), and its rows meet by equi-joins and aggregates,
so no theme is one task.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from guestlens.operators.ordering import running_total
from guestlens.sources.scratch import identity

THEME = ["data_id", "aspect", "term", "polarity"]
BATCHES_PER_RANGE = 4096


def _range() -> Column:
    return F.floor(F.col("batch_id") / BATCHES_PER_RANGE)


def theme_batches(m_batched: DataFrame) -> DataFrame:
    """(theme, batch_id): reviews of the batch that say the theme."""
    return (m_batched.groupBy(*THEME, "batch_id")
            .agg(F.sum("first_term").cast("long").alias("n_reviews"), F.max("n_place_batches").alias("n_place_batches"))
            .filter(F.col("n_reviews") > 0))


def issue_history(m_batched: DataFrame, quiet: int = 1, reuse=identity) -> DataFrame:
    """When each criticised theme was an issue: one row per run of batches that say it, cut where
    ``quiet`` or more batches in a row do not.

    Columns: data_id, aspect, term, spell (1, 2, ..), event ("opened" for the first spell, "reopened"
    for later ones), first_batch, last_batch, n_batches (first to last), n_saying (batches that
    say it), n_reviews, state ("open" if fewer than ``quiet`` batches follow, else "resolved") and
    resolved_batch (the first silent one; NULL while open).

    Gaps and islands without a window over the theme: a batch starts a spell if none of the ``quiet``
    batches before it says the theme (an anti-join with the batches that follow a saying one);
    the number of starts so far is the spell.  The theme's batches and their starts are read by several
    branches: ``reuse`` writes each once."""
    if quiet < 1:
        raise ValueError("quiet must be >= 1")
    said = reuse(theme_batches(m_batched.filter(F.col("pol") < 0)).drop("polarity"), "theme-batches")
    key = ["data_id", "aspect", "term"]
    after = said.select(*[F.col(k).alias(f"_{k}") for k in key], F.explode(F.sequence(F.col("batch_id") + 1, F.col("batch_id") + quiet)).alias("_batch")).distinct()
    meet = F.col("batch_id") == F.col("_batch")
    for k in key:
        meet = meet & (F.col(k) == F.col(f"_{k}"))
    flagged = said.join(after, meet, "left").select(*said.columns, F.when(F.col("_batch").isNull(), 1).otherwise(0).alias("_start"))
    spells = running_total(reuse(flagged, "starts"), key, ["batch_id"], "spell", _range(), weight="_start")
    out = spells.groupBy(*key, "spell").agg(
        F.min("batch_id").alias("first_batch"), F.max("batch_id").alias("last_batch"), F.count(F.lit(1)).cast("long").alias("n_saying"),
        F.sum("n_reviews").alias("n_reviews"), F.max("n_place_batches").alias("_nb"))
    is_open = F.col("_nb") - 1 - F.col("last_batch") < quiet
    return out.select(
        *key, "spell", F.when(F.col("spell") == 1, "opened").otherwise("reopened").alias("event"), "first_batch", "last_batch",
        (F.col("last_batch") - F.col("first_batch") + 1).alias("n_batches"), "n_saying", "n_reviews",
        F.when(is_open, "open").otherwise("resolved").alias("state"), F.when(~is_open, F.col("last_batch") + 1).alias("resolved_batch"))


def theme_trend(m_batched: DataFrame, batch_sizes: DataFrame, batch_size: int, critical: float = 1.96, reuse=identity) -> DataFrame:
    """Mann-Kendall trend of a theme's share of reviews over all batches of its place, silent ones included.

    ``batch_sizes``: data_id, batch_id, n (reviews of the batch, at most ``batch_size``).  Columns: theme, n_saying,
    n_place_batches, s, z (3 decimals, with the correction for ties), sign (-1, 0, 1) and label: "rising" if z >=
    ``critical``, "falling" if z <= -``critical``, else "steady"; z is NULL if all shares are equal.

    S = pairs of batches whose later share is larger - pairs whose later share is smaller, without making pairs:

    * a saying batch is above every silent one, so it counts its earlier silent ones up and its later ones down.  Over
      the theme's batches that is 2 sum(b) - m (n - 1): what saying batches take from each other cancels;
    * pairs of saying batches are counted by the highest bit in which their shares differ.  A share is
      read as floor(share * 2^bits), which keeps the order of fractions with denominators up to the batch
      size; each batch appears once per bit, in the group of its bits above; there it counts the
      earlier batches with a 0 if it has a 1 itself.  That is ``bits`` running counts, not n^2 pairs.

    The theme's batches are dealt once, by theme and range.  All pairs inside a range are counted where they lie, and a
    row per range remains, with how often it has each share.  Those counts (at most 2^bits + 1 of a range, whatever its
    batches) give the ties, and the pairs across ranges by running sums over the ranges.  Parts meet by a union and
    one sum per theme: there is no table to broadcast.  ``reuse`` writes the batches and the ranges once."""
    bits = max(1, math.ceil(math.log2(max(2, batch_size * (batch_size - 1)))) + 1)
    down = lambda by: F.call_function("shiftright", F.col("_share"), by)
    by_bit = F.explode(F.sequence(F.lit(0), F.lit(bits))).alias("_bit")
    split = [down(F.col("_bit") + 1).alias("_above"), (down(F.col("_bit")) % 2).alias("_one")]
    # The sizes are as many as the batches, but compressed they look small: sorted and merged, not broadcast.
    size = batch_sizes.select("data_id", "batch_id", F.col("n").alias("_n")).hint("merge")
    said = theme_batches(m_batched.select(*THEME, "batch_id", "first_term", "n_place_batches").repartition("data_id", "batch_id"))
    share = F.floor(F.col("n_reviews") * (1 << bits) / F.col("_n")).cast("long").alias("_share")
    said = reuse(said.join(size, ["data_id", "batch_id"]).select(*THEME, "batch_id", "n_place_batches", share), "theme-batches")

    key = [*THEME, "_range"]
    dealt = said.withColumn("_range", _range()).repartition(*key)
    levels = dealt.select(*key, "batch_id", "n_place_batches", "_share", by_bit).select(*key, "batch_id", "n_place_batches", "_bit", *split)
    earlier = Window.partitionBy(*key, "_bit", "_above").orderBy("batch_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    levels = levels.withColumn("_zeros", F.sum(1 - F.col("_one")).over(earlier))
    groups = levels.groupBy(*key, "_bit", "_above").agg(
        F.sum(F.col("_one") * F.col("_zeros")).alias("_up"), F.sum("_one").alias("_ones"), F.sum(1 - F.col("_one")).alias("_nil"),
        F.sum("batch_id").alias("_batches"), F.max("n_place_batches").alias("n_place_batches"))
    last = F.col("_bit") == 0          # a group of the last bit has two shares, each group of batches once
    ranges = reuse(groups.groupBy(*key).agg(
        F.max("n_place_batches").alias("n_place_batches"), F.sum(F.when(last, F.col("_ones") + F.col("_nil"))).alias("_m"),
        F.sum(F.when(last, F.col("_batches"))).alias("_batches"), F.sum(2 * F.col("_up") - F.col("_ones") * F.col("_nil")).alias("_among"),
        F.collect_list(F.when(last, F.struct("_above", "_ones", "_nil"))).alias("_last")), "theme-places")

    shares = ranges.select(*key, "n_place_batches", F.inline("_last")).select(*key, "n_place_batches", F.inline(F.array(
        F.struct((2 * F.col("_above") + 1).alias("_share"), F.col("_ones").alias("_t")), F.struct((2 * F.col("_above")).alias("_share"), F.col("_nil").alias("_t")))))
    shares = shares.where(F.col("_t") > 0)
    ties = shares.groupBy(*THEME, "_share").agg(F.sum("_t").alias("_t")).select(*THEME, _tied(F.col("_t")).alias("_tied"))
    # Places of one range have no pairs across ranges.
    far = shares.where(F.col("n_place_batches") > BATCHES_PER_RANGE).select(*key, "_t", "_share", by_bit).select(*key, "_t", "_bit", *split)
    far = far.groupBy(*key, "_bit", "_above").agg(F.sum(F.col("_t") * F.col("_one")).alias("_ones"), F.sum(F.col("_t") * (1 - F.col("_one"))).alias("_nil"))
    before = Window.partitionBy(*THEME, "_bit", "_above").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    across = far.select(*THEME, (F.col("_ones") * F.coalesce(F.sum("_nil").over(before), F.lit(0))
                                 - F.col("_nil") * F.coalesce(F.sum("_ones").over(before), F.lit(0))).alias("_among"))

    parts = ranges.drop("_range", "_last").unionByName(ties, allowMissingColumns=True).unionByName(across, allowMissingColumns=True)
    n, m = F.col("n_place_batches"), F.col("n_saying")
    out = parts.groupBy(*THEME).agg(
        F.sum("_m").cast("long").alias("n_saying"), F.max("n_place_batches").alias("n_place_batches"),
        F.sum("_batches").alias("_batches"), F.sum("_among").alias("_among"), F.sum("_tied").alias("_tied"))
    out = out.withColumn("s", (2 * F.col("_batches") - m * (n - 1) + F.col("_among")).cast("long"))
    var = (_tied(n) - F.col("_tied") - _tied(n - m)) / 18.0
    out = out.withColumn("_z", F.when(var > 0, (F.col("s") - F.signum("s")) / F.sqrt(var)))
    return out.select(*THEME, "n_saying", "n_place_batches", "s", F.round("_z", 3).alias("z"), F.signum("s").cast("int").alias("sign"),
                      F.when(F.col("_z") >= critical, "rising").when(F.col("_z") <= -critical, "falling").otherwise("steady").alias("label"))


def _tied(t: Column) -> Column:
    """t (t - 1) (2 t + 5): what t equal values take from 18 times the variance (and n values add)."""
    return t.cast("double") * (t - 1) * (2 * t + 5)
