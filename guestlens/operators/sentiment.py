"""A1, A2, A4: sentiment from ratings, kept as mergeable state.

Definitions (the report contract gives only prose):
* rating 0 means "missing" and is excluded from scores (counted as unrated);
* positive: rating >= 4; neutral: 3 <= rating < 4; negative: 0 < rating < 3;
* average_score and the three percentages are rounded to one decimal at the
  very end; all intermediate state is sums and counts, so merges are exact.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from guestlens.functions.dates import display_date

STATE = ["n_reviews", "n_rated", "sum_rating", "n_positive", "n_neutral", "n_negative"]


def state_aggs(rating: str = "rating") -> list[Column]:
    r = F.col(rating)
    rated = r > 0
    return [
        F.count(F.lit(1)).cast("long").alias("n_reviews"),
        F.count_if(rated).cast("long").alias("n_rated"),
        F.coalesce(F.sum(F.when(rated, r)), F.lit(0.0)).cast("double").alias("sum_rating"),
        F.count_if(r >= 4).cast("long").alias("n_positive"),
        F.count_if((r >= 3) & (r < 4)).cast("long").alias("n_neutral"),
        F.count_if(rated & (r < 3)).cast("long").alias("n_negative"),
    ]


def merge_aggs(weight: Column | None = None) -> list[Column]:
    """Aggregations that merge state rows (optionally weighted)."""
    w = F.lit(1) if weight is None else weight
    out = []
    for c in STATE:
        e = F.sum(F.col(c) * w)
        out.append((e.cast("double") if c == "sum_rating" else e.cast("long")).alias(c))
    return out


def _pct(n: str, d: str) -> Column:
    return F.when(F.col(d) > 0, F.round(F.col(n).cast("double") * 100 / F.col(d), 1))


def scores(df: DataFrame) -> DataFrame:
    """State columns -> average_score and percentages (NULL when nothing rated)."""
    return (df.withColumn("average_score",
                          F.when(F.col("n_rated") > 0, F.round(F.col("sum_rating") / F.col("n_rated"), 1)))
              .withColumn("positive_percentage", _pct("n_positive", "n_rated"))
              .withColumn("neutral_percentage", _pct("n_neutral", "n_rated"))
              .withColumn("negative_percentage", _pct("n_negative", "n_rated")))


SCORE_COLUMNS = ["average_score", "positive_percentage", "neutral_percentage", "negative_percentage"]


def overall_sentiment(reviews: DataFrame) -> DataFrame:
    """A1: per place review count, unrated count, average score and shares.
    A plain groupBy: partial aggregation before the shuffle, so a huge place
    costs one small row per map task."""
    s = reviews.groupBy("data_id").agg(*state_aggs())
    return (scores(s).withColumn("n_unrated", F.col("n_reviews") - F.col("n_rated"))
            .select("data_id", "n_reviews", "n_unrated", *SCORE_COLUMNS))


def batch_state(batched: DataFrame) -> DataFrame:
    """State per (place, batch) plus the batch's first and last review time."""
    return batched.groupBy("data_id", "batch_id").agg(
        *state_aggs(), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


def batch_analysis(batched: DataFrame) -> DataFrame:
    """A2: one analysis per batch: counts, scores and the date range
    ``[first .. last]`` in display form."""
    s = scores(batch_state(batched))
    return s.select("data_id", "batch_id", "n_reviews", *SCORE_COLUMNS,
                    display_date("first_ts").alias("first_date"),
                    display_date("last_ts").alias("last_date"))


def recency_weighted_sentiment(batched: DataFrame) -> DataFrame:
    """A4: whole-history scores weighing recent batches more: the k-th oldest
    batch (k = batch_id + 1) has weight k."""
    s = batch_state(batched)
    w = s.groupBy("data_id").agg(*merge_aggs(F.col("batch_id") + 1),
                                 F.count(F.lit(1)).cast("long").alias("n_batches"))
    return scores(w).select("data_id", "n_batches", *SCORE_COLUMNS)
