"""Instant analysis for all requested places in one job (reference flow (a)):
stored? -> reviews -> first N in fetch order -> analysis -> reviews newest
first -> store."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from guestlens.functions.dates import minute_key
from guestlens.operators import select as sel
from guestlens.operators.report import assemble_analysis
from guestlens.sources.scratch import identity

RESULT_REVIEW = "array<struct<user:string,date:string,rating:double,review_text:string>>"


def instant_analysis(reviews: DataFrame, header: DataFrame, lexicon: Sequence[tuple],
                     polarity: Sequence[tuple], num_reviews: int = sel.DEFAULT_NUM_REVIEWS,
                     k: int | None = None, reuse=identity) -> DataFrame:
    """reviews: normalised (data_id, fetch_pos, user, rating, ts, date,
    review_text); header: data_id, type, title, rating, address, status,
    total_reviews, created_at.  One nested result row per place with reviews."""
    chosen = sel.instant_select(reviews, num_reviews)
    # <= num_reviews rows per place here, so a plain window is bounded.
    newest = Window.partitionBy("data_id").orderBy(minute_key("ts").desc(), F.col("fetch_pos").asc())
    chosen = reuse(chosen.withColumn("rank_desc", F.row_number().over(newest)), "instant-selection")
    # Phrase counts are written once too: all lists of the report are made from them.
    report = assemble_analysis(chosen, header.select("data_id", "title"), lexicon, polarity, k, reuse=reuse)
    nested = sel.nested_bundle(header, chosen, order_col="rank_desc")
    return (nested.join(report, "data_id", "inner")
            .withColumn("total_reviews", F.col("total_reviews").cast("long")))
