"""Latest job status per token and its expiry."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TTL_HOURS = 24


def latest_status(events: DataFrame) -> DataFrame:
    """Latest (created_at, seq) status row per token; an aggregate, so a token
    with many events is combined map-side."""
    order = F.struct(F.col("created_at"), F.col("seq"))
    out = events.groupBy("token").agg(F.max_by(F.struct("status", "created_at", "error"), order).alias("_s"))
    return out.select("token", "_s.status", "_s.created_at", "_s.error")


def status_reply(latest: DataFrame, stored_full: DataFrame | None = None) -> DataFrame:
    """The reply for each token: completed -> data, in_progress ->
    in_progress, failed -> failed with its error.  Tokens without status but
    with a stored full report are answered from the store."""
    out = latest.select(
        "token", "status", "created_at", "error",
        F.when(F.col("status") == "completed", "data")
         .when(F.col("status") == "in_progress", "in_progress").otherwise("failed").alias("reply"),
        F.when(F.col("status") == "failed", F.coalesce(F.col("error"), F.lit("unknown error")))
         .alias("reply_error"))
    if stored_full is None:
        return out
    orphans = (stored_full.select(F.col("data_id").alias("token")).distinct()
               .join(latest.select("token"), "token", "left_anti"))
    return out.unionByName(orphans.select(
        "token", F.lit("completed").alias("status"), F.lit(None).cast(latest.schema["created_at"].dataType)
        .alias("created_at"), F.lit(None).cast("string").alias("error"), F.lit("data").alias("reply"),
        F.lit(None).cast("string").alias("reply_error")))


def expire(latest: DataFrame, as_of: dt.datetime, ttl_hours: int = TTL_HOURS) -> DataFrame:
    """T4: drop entries whose age is strictly more than ``ttl_hours``."""
    cutoff = as_of - dt.timedelta(hours=ttl_hours)
    return latest.filter(F.col("created_at") >= F.lit(cutoff))


def latest_time(events: DataFrame, col: str = "created_at") -> dt.datetime:
    """The newest event time (one scalar to the driver) - used as ``as_of``
    when the caller gives none."""
    return events.agg(F.max(col)).first()[0]
