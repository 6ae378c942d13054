"""The result store.

The store is a Parquet table ``data_id, type, analysis, written_at, seq``
partitioned by ``type`` and kept in committed versions (``VersionedTable``).
An upsert never rewrites files in place: it writes the merged table as a new
version and commits it in the manifest, so readers see either the old or the
new version, and a failed write leaves the old one in use.
"""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from guestlens.schemas import HOTEL_ANALYSIS, STORE_TYPES
from guestlens.sources.versioned import VersionedTable

STORE_COLUMNS = ["data_id", "type", "analysis", "written_at", "seq"]


def validate_types(writes: DataFrame) -> DataFrame:
    """Writes must be of type instant or full; a write of another type fails the job."""
    known = F.coalesce(F.col("type").isin(*STORE_TYPES), F.lit(False))
    return writes.withColumn("type", F.when(known, F.col("type")).otherwise(
        F.raise_error(F.concat(F.lit("store type must be instant or full, not "), F.coalesce("type", F.lit("null")))).cast("string")))


def split_writes(writes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(writes of a known type, rejected rows with a reason), for callers that go on."""
    known = F.coalesce(F.col("type").isin(*STORE_TYPES), F.lit(False))
    return writes.filter(known), writes.filter(~known).withColumn("reason", F.lit("type must be instant or full"))


def last_write(log: DataFrame, keys=("data_id", "type")) -> DataFrame:
    """Latest row per key by (written_at, seq).  ``max_by`` is an aggregate,
    so a key with very many writes is combined map-side."""
    order = F.struct(F.col("written_at"), F.col("seq"))
    payload = F.struct(*[F.col(c) for c in log.columns if c not in keys])
    out = log.groupBy(*keys).agg(F.max_by(payload, order).alias("_w"))
    return out.select(*keys, "_w.*").select(*log.columns)


def upsert(store: DataFrame | None, writes: DataFrame) -> DataFrame:
    """Insert-or-replace by (data_id, type): the newest write wins."""
    w = validate_types(writes.select(*STORE_COLUMNS))
    allrows = w if store is None else store.select(*STORE_COLUMNS).unionByName(w)
    return last_write(allrows)


def write_version(df: DataFrame, root: str) -> int:
    """Write ``df`` as a new committed store version and return its number."""
    table = VersionedTable(df.sparkSession, root)
    version = max(time.time_ns() // 1000, (table.latest_version() or 0) + 1)
    table.write(df.select(*STORE_COLUMNS), version, partition_by=("type",))
    return version


def read_latest(spark: SparkSession, root: str) -> DataFrame | None:
    """The newest committed version (None when the store is empty)."""
    latest = VersionedTable(spark, root).latest()
    return None if latest is None else latest.select(*STORE_COLUMNS)


def lookup(store: DataFrame, requests: DataFrame, parse: bool = False) -> DataFrame:
    """S3: stored reports for each request ``(data_id, type)``; a NULL type
    asks for both, instant first (type_order 0) then full (1).  ``parse`` adds
    ``report``: the stored JSON read with the report schema."""
    s = store.select(F.col("data_id").alias("_sd"), F.col("type").alias("_st"), "analysis", "written_at")
    cond = (requests.data_id == s._sd) & (requests.type.isNull() | (requests.type == s._st))
    j = requests.join(s, cond, "inner")
    out = j.select(F.col("data_id"), F.col("type").alias("requested_type"), F.col("_st").alias("type"),
                   F.when(F.col("_st") == "instant", 0).otherwise(1).alias("type_order"),
                   "analysis", "written_at")
    if parse:
        out = out.withColumn("report", F.from_json("analysis", HOTEL_ANALYSIS))
    return out


def stored_union(instant: DataFrame, full: DataFrame) -> DataFrame:
    """Both stores in one list, each row tagged with its type."""
    return (instant.withColumn("type", F.lit("instant"))
            .unionByName(full.withColumn("type", F.lit("full"))))
