"""Skip work that is already stored (or already running)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def cache_split(requests: DataFrame, store: DataFrame, latest_status: DataFrame | None = None,
                refresh: bool = False):
    """Split requests ``(data_id, type)`` into hits (stored), running (a full
    job for the token is in progress) and misses (work to do).  With
    ``refresh`` stored reports are ignored (recomputed), running jobs are
    still not started twice.

    Semi / anti joins on the request keys; requests are usually the small side
    and the planner broadcasts them after its size check."""
    keys = store.select("data_id", "type").distinct()
    if refresh:
        keys = keys.limit(0)
    hits = requests.join(keys, ["data_id", "type"], "left_semi")
    rest = requests.join(keys, ["data_id", "type"], "left_anti")
    if latest_status is None:
        return hits, rest.limit(0), rest
    busy = (latest_status.filter(F.col("status") == "in_progress")
            .select(F.col("token").alias("data_id"), F.lit("full").alias("type")))
    running = rest.join(busy, ["data_id", "type"], "left_semi")
    misses = rest.join(busy, ["data_id", "type"], "left_anti")
    return hits, running, misses


def cache_decisions(requests: DataFrame, store: DataFrame, latest_status: DataFrame | None = None,
                    refresh: bool = False) -> DataFrame:
    """The same as a flag per request: one left join to the stored keys and one to the
    tokens that are running."""
    keys = store.select("data_id", "type").distinct().withColumn("_hit", F.lit(not refresh))
    out = requests.join(keys, ["data_id", "type"], "left")
    if latest_status is None:
        out = out.withColumn("_busy", F.lit(False))
    else:
        busy = (latest_status.filter(F.col("status") == "in_progress")
                .select(F.col("token").alias("data_id"), F.lit("full").alias("type"), F.lit(True).alias("_busy")))
        out = out.join(busy, ["data_id", "type"], "left")
    return out.withColumn("decision", F.when(F.col("_hit"), "hit").when(F.col("_busy"), "running").otherwise("miss")).drop("_hit", "_busy")
