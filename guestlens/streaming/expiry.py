"""T3 / T4 by state: status events stream through sessions that close themselves.

A token's events belong to one session as long as no gap between them is longer than the time to live
(``session_window``); the watermark, the newest event time less the lateness allowed, closes a session
that is older than that, emits it once and drops its state.  So what is held is the live tokens only,
however long the stream runs, and nothing is rewritten per micro-batch.  State lives in Spark's
own file-backed store under the checkpoint; no server or port is needed.

Event times count in milliseconds here (the watermark's unit).  An event later than the lateness
allowed is dropped by the watermark.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from guestlens.operators.status import TTL_HOURS, latest_status
from guestlens.sources.versioned import VersionedTable
from guestlens.streaming.ingest import work_number
from guestlens.streaming.status import STATUS_EVENT_SCHEMA


def status_sessions(events: DataFrame, ttl_hours: int = TTL_HOURS, late: str = "0 seconds") -> DataFrame:
    """Closed sessions of (token, status, created_at, seq, error) events: token, started_at, last_at, n_events, status and
    error of the last event.  An age of exactly ``ttl_hours`` is still live (T4), so a gap is a millisecond longer."""
    gap = f"{ttl_hours * 3_600_000 + 1} milliseconds"
    last = F.max_by(F.struct("created_at", "status", "error"), F.struct("created_at", "seq"))
    # Event time must be an instant; the session's time zone is UTC.
    s = events.withColumn("_at", F.col("created_at").cast("timestamp")).withWatermark("_at", late)
    s = s.groupBy("token", F.session_window("_at", gap)).agg(F.min("created_at").alias("started_at"), F.count(F.lit(1)).alias("n_events"), last.alias("_l"))
    return s.select("token", "started_at", F.col("_l.created_at").alias("last_at"), "n_events", "_l.status", "_l.error")


class StatusSessions:
    """Closed sessions in a table of committed versions, one per micro-batch, numbered by its work."""

    def __init__(self, spark: SparkSession, root: str, ttl_hours: int = TTL_HOURS, late: str = "0 seconds"):
        self.spark, self.ttl, self.late = spark, ttl_hours, late
        self.table = VersionedTable(spark, root, key="epoch")

    def start(self, landing: str, checkpoint: str, max_files_per_trigger: int = 1000) -> StreamingQuery:
        events = (self.spark.readStream.schema(STATUS_EVENT_SCHEMA).option("maxFilesPerTrigger", max_files_per_trigger).json(landing))

        def on_batch(batch: DataFrame, batch_id: int) -> None:
            tag = f"{checkpoint}#{batch_id}"
            if tag not in self.table.tags():
                self.table.write(batch, work_number(tag), tag=tag)
        return (status_sessions(events, self.ttl, self.late).writeStream.outputMode("append").foreachBatch(on_batch)
                .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())

    def expired(self) -> DataFrame:
        return self.table.read_all()

    def live(self, events: DataFrame) -> DataFrame:
        """T4: the latest status of every token whose last session is not closed."""
        closed = self.expired().select("token", F.col("last_at").alias("created_at"))
        return latest_status(events).join(closed, ["token", "created_at"], "left_anti")
