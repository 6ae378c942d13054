"""T3 / T4 as a stream: status events arrive as files; each micro-batch is
merged into the latest-status table (one row per token) and entries older
than the TTL at the newest seen time are dropped.

The table is kept in committed versions keyed by epoch (``VersionedTable``), whose manifest
entry names the micro-batch (checkpoint and batch id): a replayed micro-batch changes nothing,
and several sources may feed one table.  No state server or port is needed
(``foreachBatch`` only).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from guestlens.operators.status import TTL_HOURS, latest_status
from guestlens.sources.versioned import VersionedTable
from guestlens.streaming.incremental import next_epoch

STATUS_EVENT_SCHEMA = "token long, status string, created_at timestamp_ntz, seq long, error string"


class StatusTable:
    def __init__(self, spark: SparkSession, root: str, ttl_hours: int = TTL_HOURS, as_of=None):
        """``as_of``: fixed reference time for expiry; default the newest
        status time seen so far."""
        self.spark, self.ttl, self.as_of = spark, ttl_hours, as_of
        self.table = VersionedTable(spark, root, key="epoch")

    def latest(self) -> DataFrame | None:
        return self.table.latest()

    def apply(self, events: DataFrame, epoch: int | None = None, tag: str | None = None) -> bool:
        """Merge one epoch (default: the next one); False when it or the work that ``tag`` names is applied."""
        epoch = next_epoch(self.table, epoch, tag)
        if epoch is None:
            return False
        cur = self.table.latest(below=epoch)
        ev = events.select("token", "status", "created_at", "seq", "error")
        both = ev if cur is None else cur.select("token", "status", "created_at", "seq", "error").unionByName(ev)
        order = F.struct(F.col("created_at"), F.col("seq"))
        merged = (both.groupBy("token")
                  .agg(F.max_by(F.struct("status", "created_at", "seq", "error"), order).alias("_s"))
                  .select("token", "_s.*"))
        # TTL at the newest time seen so far: a window-free filter against one scalar.
        newest = self.as_of or merged.agg(F.max("created_at")).first()[0]
        kept = merged.filter(F.col("created_at") >= F.lit(newest) - F.expr(f"INTERVAL {self.ttl} HOURS"))
        self.table.write(kept, epoch, tag=tag)
        return True

    def start(self, landing: str, checkpoint: str, max_files_per_trigger: int = 100) -> StreamingQuery:
        stream = (self.spark.readStream.schema(STATUS_EVENT_SCHEMA)
                  .option("maxFilesPerTrigger", max_files_per_trigger).json(landing))
        return (stream.writeStream.foreachBatch(lambda df, batch_id: bool(self.apply(df, tag=f"{checkpoint}#{batch_id}")))
                .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())


def batch_equivalent(events: DataFrame, ttl_hours: int = TTL_HOURS) -> DataFrame:
    """What the streamed table must equal: latest status per token, expired
    at the newest event time."""
    lat = latest_status(events)
    newest = events.agg(F.max("created_at")).first()[0]
    return lat.filter(F.col("created_at") >= F.lit(newest) - F.expr(f"INTERVAL {ttl_hours} HOURS"))
