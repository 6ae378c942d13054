"""Update stored analyses with new reviews without recomputing history.

Per-place sentiment state (sums and counts) is additive, so the state after
new reviews is ``old + delta``.  State is kept in committed versions
(``VersionedTable`` keyed by epoch).  An epoch adds to the newest version *below* it,
and its manifest entry names the micro-batch it came from (checkpoint and batch id):
a replayed micro-batch is a no-op, a write that died before its commit is redone on
the old state, and another source or checkpoint gets an epoch of its own.  Reviews that
the batch path quarantines are set aside here as well.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from guestlens.operators import sentiment as sen
from guestlens.operators.ingest import explode_pages
from guestlens.sources.scratch import materialize
from guestlens.sources.versioned import VersionedTable
from guestlens.streaming.ingest import page_stream


def sentiment_state(reviews: DataFrame) -> DataFrame:
    return reviews.groupBy("data_id").agg(*sen.state_aggs())


def merge_state(old: DataFrame | None, delta: DataFrame) -> DataFrame:
    """old + delta per place (union + groupBy: one row per place per side)."""
    both = delta if old is None else old.select("data_id", *sen.STATE).unionByName(delta.select("data_id", *sen.STATE))
    return both.groupBy("data_id").agg(*sen.merge_aggs())


class IncrementalSentiment:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.table = VersionedTable(spark, root, key="epoch")

    def latest(self) -> DataFrame | None:
        return self.table.latest()

    def has_epoch(self, epoch: int) -> bool:
        return self.table.has(epoch)

    def apply(self, new_reviews: DataFrame, epoch: int | None = None, tag: str | None = None) -> bool:
        """Add the good reviews of one epoch (default: the next one); returns False when
        the epoch or the work that ``tag`` names is already applied."""
        epoch = next_epoch(self.table, epoch, tag)
        if epoch is None:
            return False
        merged = merge_state(self.table.latest(below=epoch), sentiment_state(good_reviews(new_reviews)))
        self.table.write(merged, epoch, tag=tag)
        return True

    def scores(self) -> DataFrame:
        s = self.latest()
        return (sen.scores(s).withColumn("n_unrated", F.col("n_reviews") - F.col("n_rated"))
                .select("data_id", "n_reviews", "n_unrated", *sen.SCORE_COLUMNS))

    def changes(self, threshold: float = 0.3) -> DataFrame:
        """Places whose average score moved by at least ``threshold`` between
        the two newest versions (new places count as changed)."""
        top = list(reversed(self.table.versions()[-2:]))

        def avg(e):
            return self.table.read(e).select("data_id", F.when(F.col("n_rated") > 0, F.col("sum_rating") / F.col("n_rated"))
                            .alias("a"), "n_reviews")
        cur = avg(top[0]).alias("c")
        if len(top) < 2:
            return cur.select("data_id", F.lit(None).cast("double").alias("previous_score"),
                              F.round("a", 1).alias("current_score"), F.lit(True).alias("significant"))
        prev = avg(top[1]).alias("p")
        j = cur.join(prev, "data_id", "left")
        d = F.col("c.a") - F.col("p.a")
        return j.select("data_id", F.round("p.a", 1).alias("previous_score"), F.round("c.a", 1).alias("current_score"),
                        (F.col("p.a").isNull() | (F.abs(d) >= threshold)).alias("significant"))

    def start(self, landing: str, checkpoint: str) -> StreamingQuery:
        """Stream landed pages of new reviews into the state, one epoch per micro-batch."""
        def on_batch(batch: DataFrame, batch_id: int) -> None:
            self.apply(explode_pages(batch), tag=f"{checkpoint}#{batch_id}")
        return (page_stream(self.spark, landing).writeStream.foreachBatch(on_batch)
                .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())


def good_reviews(reviews: DataFrame) -> DataFrame:
    return reviews.filter(F.col("bad_reason").isNull()) if "bad_reason" in reviews.columns else reviews


def next_epoch(table: VersionedTable, epoch: int | None, tag: str | None) -> int | None:
    """The epoch to write, or None when its work is committed."""
    if tag is not None and tag in table.tags():
        return None
    if epoch is None:
        newest = table.latest_version()
        return 0 if newest is None else newest + 1
    return None if table.has(epoch) else epoch


def touched_places(new_reviews: DataFrame, table: DataFrame) -> DataFrame:
    """Rows of ``table`` for places that received new reviews, so ranking jobs
    (priorities, trends) are re-run for those places only."""
    return table.join(new_reviews.select("data_id").distinct(), "data_id", "left_semi")


def rebatch_touched(all_reviews: DataFrame, new_reviews: DataFrame, batch_size: int) -> DataFrame:
    """Batch numbers of the places that received new reviews, recomputed over
    all their reviews: an old-dated late review shifts every later batch of
    its place, places without new reviews keep their batches."""
    from guestlens.operators.select import chronological_batches
    return chronological_batches(touched_places(new_reviews, all_reviews), batch_size)


class IncrementalPriorities:
    """T2, priorities: keep additive criticism state and re-rank touched places.

    Two states add up over disjoint review sets: per (place, aspect) the
    criticising reviews and their rating shortfall, and per (place, aspect,
    phrase) the criticising reviews.  The top-k ranking is recomputed only for
    places that received new reviews; the others keep their stored ranking."""

    def __init__(self, spark: SparkSession, root: str, lexicon, polarity, k: int = 5):
        self.spark, self.k = spark, k
        self.lexicon, self.polarity = lexicon, polarity
        self.table = VersionedTable(spark, root, key="epoch")      # parts: aspects, phrases, ranking

    def _deltas(self, reviews: DataFrame):
        from guestlens.operators import aspects as asp
        # Written once: both states add it up.
        crit = materialize(asp.mention_counts(asp.mentions(reviews, self.lexicon, self.polarity)).filter(F.col("pol") < 0), "criticism")
        a = crit.groupBy("data_id", "aspect").agg(F.sum("by_aspect").alias("n_reviews"), F.sum("short_aspect").alias("score"))
        p = crit.groupBy("data_id", "aspect", "phrase").agg(F.sum("support").alias("n"))
        return a, p

    @staticmethod
    def _add(old: DataFrame | None, delta: DataFrame, keys: list[str]) -> DataFrame:
        both = delta if old is None else old.unionByName(delta)
        vals = [c for c in delta.columns if c not in keys]
        return both.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in vals]).select(*delta.columns)

    def rank(self, aspects: DataFrame, phrases: DataFrame) -> DataFrame:
        from pyspark.sql import Window
        from guestlens.operators import aspects as asp
        issue = phrases.groupBy("data_id", "aspect").agg(
            F.min_by("phrase", F.struct(-F.col("n"), F.col("phrase"))).alias("issue"))
        w = Window.partitionBy("data_id").orderBy(F.desc("score"), asp.aspect_order())
        top = (aspects.withColumn("priority", F.row_number().over(w).cast("long"))
               .filter(F.col("priority") <= self.k).join(issue, ["data_id", "aspect"]))
        sug, imp = asp.playbook_columns(F.col("issue"))
        return top.select("data_id", "priority", asp.category_name().alias("category"), "issue",
                          sug.alias("suggestion"), imp.alias("potential_impact"), "score", "n_reviews")

    def apply(self, new_reviews: DataFrame, epoch: int | None = None, tag: str | None = None) -> bool:
        """Add the good reviews of one epoch and re-rank their places.  All parts are
        written before the one manifest entry that commits them."""
        epoch = next_epoch(self.table, epoch, tag)
        if epoch is None:
            return False
        new_reviews = good_reviews(new_reviews)
        da, dp = self._deltas(new_reviews)
        before = self.table.latest_version(below=epoch)

        def old(part):
            return None if before is None else self.table.read(before, part)
        a = self.table.write_part(self._add(old("aspects"), da, ["data_id", "aspect"]), epoch, "aspects")
        p = self.table.write_part(self._add(old("phrases"), dp, ["data_id", "aspect", "phrase"]), epoch, "phrases")
        touched = new_reviews.select("data_id").distinct()
        fresh = self.rank(a.join(touched, "data_id", "left_semi"), p.join(touched, "data_id", "left_semi"))
        if before is not None:
            fresh = old("ranking").join(touched, "data_id", "left_anti").unionByName(fresh)
        self.table.write_part(fresh, epoch, "ranking")
        self.table.commit(epoch, tag)
        return True

    def priorities(self) -> DataFrame:
        return self.table.latest(part="ranking")
