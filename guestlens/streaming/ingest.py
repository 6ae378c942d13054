"""Landed page files -> review rows, incrementally."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from guestlens.operators.ingest import assign_fetch_pos, explode_pages
from guestlens.schemas import PAGE_WITH_CORRUPT
from guestlens.sources.versioned import VersionedTable


def page_stream(spark: SparkSession, landing: str, max_files_per_trigger: int = 1000) -> DataFrame:
    return (spark.readStream.schema(PAGE_WITH_CORRUPT)
            .option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt")
            .option("maxFilesPerTrigger", max_files_per_trigger)
            .json(landing))


def start_page_ingest(spark: SparkSession, landing: str, sink: str, checkpoint: str,
                      available_now: bool = True, max_files_per_trigger: int = 1000,
                      once_within: str | None = None) -> StreamingQuery:
    """Stream landed pages into ``sink`` (review rows) and ``sink + '_corrupt'``
    (unreadable lines), one committed version per micro-batch.  A version is numbered by its
    work (checkpoint and batch id): a replayed micro-batch overwrites its own uncommitted output, and
    several landing folders may feed one sink.  Readers see committed versions only.

    ``once_within`` (a time such as "7 days"): a page that lands again with the same content within that
    time of its landing is dropped on the way (Spark's ``dropDuplicatesWithinWatermark``, whose state
    is as long).  A page that lands again with another content is kept and ``read_ingested`` takes the newest."""
    rows_table = VersionedTable(spark, sink, key="epoch")
    bad_table = VersionedTable(spark, f"{sink}_corrupt", key="epoch")

    def write_batch(batch: DataFrame, batch_id: int) -> None:
        tag = f"{checkpoint}#{batch_id}"
        if rows_table.committed(work_number(tag), tag):
            return
        # Two tables read the batch: kept, its pages are parsed and go through the state once.
        batch.persist()
        try:
            bad_table.write(batch.filter(F.col("_corrupt").isNotNull()).select("_corrupt"), work_number(tag), tag=tag)
            rows_table.write(explode_pages(batch), work_number(tag), tag=tag)
        finally:
            batch.unpersist()

    pages = landed_pages(page_stream(spark, landing, max_files_per_trigger))
    if once_within is not None:
        pages = pages.withWatermark("_landed_at", once_within).dropDuplicatesWithinWatermark(["data_id", "page_no", "_content"])
    w = pages.writeStream.foreachBatch(write_batch).option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="30 seconds")
    before = spark.conf.get(PARTITIONS)
    spark.conf.set(PARTITIONS, state_partitions(spark))
    try:
        return w.start()            # a stream keeps the settings it started with
    finally:
        spark.conf.set(PARTITIONS, before)


PARTITIONS = "spark.sql.shuffle.partitions"


def state_partitions(spark: SparkSession) -> str:
    """The session's shuffle partitions, at most two per core: every micro-batch opens and commits the state of each, however
    few pages it has.  A stream that goes on from a checkpoint keeps the number that stands there."""
    return str(min(int(spark.conf.get(PARTITIONS)), 2 * spark.sparkContext.defaultParallelism))


def work_number(tag: str) -> int:
    """The version of a piece of work: the same for a retry, another for other work."""
    return int.from_bytes(hashlib.sha256(tag.encode()).digest()[:7], "big")


def landed_pages(pages: DataFrame) -> DataFrame:
    """Pages with the time their file landed and a digest of their content."""
    content = F.to_json(F.struct(*[c for c in pages.columns if c not in ("data_id", "page_no")]))
    return pages.withColumn("_landed_at", F.col("_metadata.file_modification_time")).withColumn("_content", F.sha2(content, 256))


def newest_pages(rows: DataFrame) -> DataFrame:
    """Of each (place, page) the reviews of the page that landed last (ties: by digest), once."""
    key = ["data_id", "page_no"]
    newest = rows.groupBy(*[F.col(k).alias(f"_{k}") for k in key]).agg(F.max(F.struct("_landed_at", "_content")).alias("_last"))
    same = F.struct("_landed_at", "_content") == F.col("_last")
    kept = rows.join(newest, F.col("data_id").eqNullSafe(F.col("_data_id")) & F.col("page_no").eqNullSafe(F.col("_page_no")) & same)
    # A page of the same content that landed in one file listing twice has equal rows.
    return kept.drop("_data_id", "_page_no", "_last").dropDuplicates([*key, "pos"]).drop("_landed_at", "_content")


def read_ingested(spark: SparkSession, sink: str) -> DataFrame | None:
    """The ingested reviews with fetch positions (same rows as batch P1 over the newest landing of every page)."""
    rows = VersionedTable(spark, sink, key="epoch").read_all()
    return None if rows is None else assign_fetch_pos(newest_pages(rows))
