"""Recency-weighted scores kept while reviews arrive in any order.

A review in the k-th oldest batch of its place weighs k, so one late review moves all later
reviews of its place up by one position, and some of them into the next batch.  What is kept
is an *ordered mergeable summary* per (place, day): with the day's reviews in date order at
positions i = 0, 1, .., the sums of every count by residue r = i mod size, plain and times
c = floor(i / size).  If ``o`` = size a + b reviews of the place come before the day, review i
weighs a + c + 1, and one more if b + r >= size; so the day's weighted sums follow from its summary
and ``o`` alone, and ``o`` is a prefix sum over the place's days.  Late reviews shift the days after
theirs without any of those days being read again.

An epoch stores its reviews (order and rating only, by month) and new summaries of the days that it
touches, which are made from those days' reviews; nothing else is read or written.  Readers take each
day's newest summary.  Epochs are committed by tag, so a replayed micro-batch changes nothing.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from guestlens.functions.dates import minute_key
from guestlens.operators import sentiment as sen
from guestlens.operators.ingest import explode_pages
from guestlens.sources.versioned import VersionedTable
from guestlens.streaming.incremental import good_reviews, next_epoch
from guestlens.streaming.ingest import page_stream

DAY = ["data_id", "day"]


def review_rows(reviews: DataFrame, order: Sequence[str]) -> DataFrame:
    """What the summary needs of a review; those without a date come last."""
    minute = minute_key("ts")
    return reviews.select("data_id", F.coalesce(F.to_date("ts"), F.lit("9999-12-31").cast("date")).alias("day"),
                          minute.alias("minute"), *order, "rating").withColumn("month", F.date_format("day", "yyyy-MM"))


def day_summary(rows: DataFrame, size: int, order: Sequence[str]) -> DataFrame:
    """Per (place, day, residue): the state of its reviews, and the same times floor(i / size) (``late_*``)."""
    at = F.row_number().over(Window.partitionBy(*DAY).orderBy("minute", *order)) - 1
    r = F.col("rating")
    rated = F.coalesce(r > 0, F.lit(False))
    one = lambda c: F.when(c, 1).otherwise(0)
    counts = {"n_reviews": F.lit(1), "n_rated": one(rated), "sum_rating": F.when(rated, r).otherwise(0.0), "n_positive": one(r >= 4),
              "n_neutral": one((r >= 3) & (r < 4)), "n_negative": one(rated & (r < 3))}
    placed = rows.withColumn("_i", at).select(*DAY, (F.col("_i") % size).cast("long").alias("residue"), F.floor(F.col("_i") / size).alias("_c"),
                                              *[c.alias(n) for n, c in counts.items()])
    kind = {n: "double" if n == "sum_rating" else "long" for n in counts}
    return placed.groupBy(*DAY, "residue").agg(*[F.sum(n).cast(kind[n]).alias(n) for n in counts],
                                               *[F.sum(F.col(n) * F.col("_c")).cast(kind[n]).alias(f"late_{n}") for n in counts])


def weighted_scores(summary: DataFrame, size: int) -> DataFrame:
    """A4 from day summaries.  The window runs over the days of a place, which the calendar bounds."""
    days = summary.groupBy(*DAY).agg(F.sum("n_reviews").alias("n"))
    along = Window.partitionBy("data_id").orderBy("day")
    before = days.select(*DAY, (F.sum("n").over(along) - F.col("n")).alias("before"))
    s = summary.join(before, DAY)
    w = F.floor(F.col("before") / size) + 1 + F.when(F.col("before") % size + F.col("residue") >= size, 1).otherwise(0)
    sums = s.groupBy("data_id").agg(
        *[F.sum(F.col(c) * w + F.col(f"late_{c}")).cast("double" if c == "sum_rating" else "long").alias(c) for c in sen.STATE],
        F.sum("n_reviews").alias("_all"))
    return (sen.scores(sums).withColumn("n_batches", (F.floor((F.col("_all") - 1) / size) + 1).cast("long"))
            .select("data_id", "n_batches", *sen.SCORE_COLUMNS))


class IncrementalRecency:
    def __init__(self, spark: SparkSession, root: str, batch_size: int = 15, order: Sequence[str] = ("fetch_pos",)):
        """``order``: the columns that order reviews of one minute."""
        self.spark, self.size, self.order = spark, batch_size, tuple(order)
        self.table = VersionedTable(spark, root, key="epoch")          # parts: rows, days

    def apply(self, new_reviews: DataFrame, tag: str | None = None) -> bool:
        """Add the good reviews of one epoch; False when the work that ``tag`` names is applied."""
        epoch = next_epoch(self.table, None, tag)
        if epoch is None:
            return False
        stored = self.table.read_all("rows")
        new = self.table.write_part(review_rows(good_reviews(new_reviews), self.order), epoch, "rows", partition_by=("month",))
        rows = new
        if stored is not None:
            # Months bound what is opened (a calendar's worth of values), days what is kept of it.
            months = [r.month for r in new.select("month").distinct().collect()]
            again = stored.where(F.col("month").isin(months)).join(new.select(*DAY).distinct(), DAY, "left_semi")
            rows = new.unionByName(again)
        self.table.write_part(day_summary(rows, self.size, self.order).withColumn("made", F.lit(epoch)), epoch, "days")
        self.table.commit(epoch, tag)
        return True

    def summary(self) -> DataFrame:
        """The newest summary of every (place, day)."""
        days = self.table.read_all("days")
        newest = days.groupBy(*DAY).agg(F.max("made").alias("made"))
        return days.join(newest, [*DAY, "made"]).drop("made")

    def scores(self) -> DataFrame:
        return weighted_scores(self.summary(), self.size)

    def start(self, landing: str, checkpoint: str) -> StreamingQuery:
        """Stream landed pages into the state (made with ``order=("page_no", "pos")``), one epoch per micro-batch."""
        def on_batch(batch: DataFrame, batch_id: int) -> None:
            self.apply(explode_pages(batch), tag=f"{checkpoint}#{batch_id}")
        return (page_stream(self.spark, landing).writeStream.foreachBatch(on_batch)
                .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
