"""Full analysis for all requested places in one job (reference flow (b)):
whole pages up to the review cap -> date-ordered batches -> per-batch state
-> combine tree -> recency-weighted scores -> report -> reviews newest first.

After the page cap a place has at most ``max_reviews`` + one page of rows, so
every per-place window below works on a bounded group.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from guestlens.functions.dates import minute_key
from guestlens.operators import aspects as asp
from guestlens.operators import combine as cmb
from guestlens.operators import select as sel
from guestlens.operators import sentiment as sen
from guestlens.operators.report import assemble_counts
from guestlens.sources.scratch import identity


def full_selection(reviews: DataFrame, max_reviews: int = sel.DEFAULT_MAX_REVIEWS,
                   pages: DataFrame | None = None, reuse=identity) -> DataFrame:
    """Reviews on the pages kept by the page-granular cap."""
    pages = pages if pages is not None else reuse(sel.page_counts(reviews), "pages")
    kept = sel.full_page_cap(pages, max_reviews)
    return reviews.join(kept.select("data_id", "page_no"), ["data_id", "page_no"], "left_semi")


def full_analysis(reviews: DataFrame, header: DataFrame, lexicon: Sequence[tuple], polarity: Sequence[tuple],
                  max_reviews: int = sel.DEFAULT_MAX_REVIEWS, batch_size: int = sel.DEFAULT_BATCH_SIZE,
                  k: int | None = None, reuse=identity, pages: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """``pages`` (``select.landed_page_counts``) brings the landed pages' own ``next`` links and empty pages; without
    it every page but a place's last one has a next.  Returns (results, tree): one nested result per place whose overall_sentiment and
    priorities weigh recent periods more and whose summary tells the latest trend and how
    many themes persist, and every combine node with its merged themes."""
    chosen = reuse(full_selection(reviews, max_reviews, pages, reuse), "full-selection")
    batched = reuse(sel.chronological_batches(chosen, batch_size), "full-batches")
    state = reuse(sen.batch_state(batched), "full-state")
    # One extraction: phrase counts per batch, merged for the lists, weighted by recency for
    # the priorities, and counted over batches for what persists.
    counts = reuse(asp.mention_counts(asp.mentions(batched, lexicon, polarity, extra=["batch_id"]), ("data_id", "batch_id")), "full-counts")
    tree = cmb.tree_combine(state, cmb.fan_in_for(batch_size), counts)
    weighted = sen.recency_weighted_sentiment(batched)
    n_batches = state.groupBy("data_id").agg((F.max("batch_id") + 1).alias("n_place_batches"))
    themes = asp.persistent_themes(counts.join(n_batches, "data_id"))
    lasting = themes.groupBy("data_id").agg(F.count_if("persistent").cast("long").alias("n_persistent"))
    latest = cmb.period_trend(state).groupBy("data_id").agg(F.max_by("trend", "batch_id").alias("trend"))
    report = assemble_counts(cmb.merged_counts(counts), sen.overall_sentiment(chosen), header.select("data_id", "title"), chosen, k,
                             weighted=cmb.merged_counts(counts, recent=True))
    overall = F.struct(*[F.col(f"w.{c}").alias(c) for c in sen.SCORE_COLUMNS])
    n_persistent = F.coalesce("n_persistent", F.lit(0).cast("long"))
    summary = F.concat(F.col("r.hotel_analysis.summary"), F.lit(" Latest period: "), F.col("trend"), F.lit(". Persistent themes: "),
                       n_persistent.cast("string"), F.lit("."))
    report = (report.alias("r").join(weighted.alias("w"), "data_id", "left").join(latest, "data_id", "left").join(lasting, "data_id", "left")
              .select("data_id", F.col("n_batches"), "trend", n_persistent.alias("n_persistent"),
                      F.col("r.hotel_analysis").withField("overall_sentiment", overall).withField("summary", summary).alias("hotel_analysis")))
    newest = Window.partitionBy("data_id").orderBy(minute_key("ts").desc(), F.col("fetch_pos").asc())
    nested = sel.nested_bundle(header, chosen.withColumn("rank_desc", F.row_number().over(newest)))
    return nested.join(report, "data_id", "inner"), tree
