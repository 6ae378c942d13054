"""S2, S3 at scale: the result store dealt by key, so that work follows what is written or asked.

Layout: ``<root>/rows/bucket=<b>/..`` with b = xxhash64(data_id) modulo the number of buckets, which
``<root>/layout`` records once.  An upsert reads and writes the buckets of its own keys only: it
merges them and puts them back with dynamic partition overwrite.  A lookup opens the buckets of the asked keys
only.  The buckets that a job touches are at most as many as there are, so they are a plain list.

Rows are kept by (written_at, seq), the newest wins, so an upsert that died half-way is simply
done again: buckets that it had replaced already give the same rows.  One writer at a time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from guestlens.sources import store as so
from guestlens.sources.scratch import materialize

BUCKETS = 64
SCHEMA = "data_id long, type string, analysis string, written_at timestamp_ntz, seq long, bucket int"


class BucketStore:
    def __init__(self, spark: SparkSession, root: str, buckets: int | None = None):
        """``buckets`` counts for a new store; an old one keeps its own number."""
        self.spark, self.root = spark, root.rstrip("/")
        try:
            self.buckets = spark.read.parquet(f"{self.root}/layout").first()[0]
        except AnalysisException:
            self.buckets = buckets or BUCKETS
            spark.createDataFrame([(self.buckets,)], "buckets int").write.mode("overwrite").parquet(f"{self.root}/layout")
        if buckets not in (None, self.buckets):
            raise ValueError(f"the store has {self.buckets} buckets, not {buckets}")

    def bucket_of(self, key: str = "data_id") -> Column:
        return F.pmod(F.xxhash64(key), F.lit(self.buckets)).cast("int")

    def rows(self, buckets: list[int] | None = None) -> DataFrame:
        """The stored rows, of some buckets only if given (the others' files are not listed in the scan)."""
        try:
            out = self.spark.read.schema(SCHEMA).parquet(f"{self.root}/rows")
        except AnalysisException:
            out = self.spark.createDataFrame([], SCHEMA)
        return out if buckets is None else out.where(F.col("bucket").isin(buckets))

    def touched(self, keys: DataFrame) -> list[int]:
        return sorted(r[0] for r in keys.select(self.bucket_of().alias("b")).distinct().collect())

    def upsert(self, writes: DataFrame) -> list[int]:
        """Insert or replace by (data_id, type); returns the buckets that were written."""
        new = materialize(so.validate_types(writes.select(*so.STORE_COLUMNS)).withColumn("bucket", self.bucket_of()), "store-writes")
        buckets = sorted(r[0] for r in new.select("bucket").distinct().collect())
        if not buckets:
            return []
        both = self.rows(buckets).select(new.columns).unionByName(new)
        merged = materialize(so.last_write(both, keys=("data_id", "type", "bucket")), "store-merged")     # the rows are read where they are then replaced
        (merged.repartition(len(buckets), "bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
         .partitionBy("bucket").parquet(f"{self.root}/rows"))
        return buckets

    def lookup(self, requests: DataFrame) -> DataFrame:
        """S3 (see ``store.lookup``) over the buckets of the requests."""
        return so.lookup(self.rows(self.touched(requests)).select(*so.STORE_COLUMNS), requests)
