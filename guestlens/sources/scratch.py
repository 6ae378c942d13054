"""Written intermediate tables in the shared checkpoint folder.

A plan that reads one intermediate result from several branches (mentions
feeding lists, counts, priorities and the summary) would recompute it per
branch.  ``materialize`` writes it once as Parquet under
``spark.checkpoint.dir`` and reads it back: the lineage is cut, a lost
executor costs a re-read instead of a recompute, and every branch scans
columnar files with pruning.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from guestlens.session import work_path


_WRITTEN: list[str] = []


# Shuffle files of a written intermediate are of no use once it is written.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def materialize(df: DataFrame, name: str = "intermediate") -> DataFrame:
    spark = df.sparkSession
    path = work_path(spark, "tmp", name)
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.mode("overwrite").parquet(path)
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)
    _WRITTEN.append(path)
    return spark.read.parquet(path)


def release(spark: SparkSession) -> int:
    """Delete the intermediates written by this process; call it when the results that
    read them are written.  Returns how many were deleted."""
    n = 0
    while _WRITTEN:
        path = spark._jvm.org.apache.hadoop.fs.Path(_WRITTEN.pop())
        n += path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    return n


def identity(df: DataFrame, name: str = "") -> DataFrame:
    return df
