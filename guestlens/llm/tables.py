"""Shared steps of the operators: inputs, sizes, written intermediates, components."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from guestlens.sources.scratch import materialize
from guestlens.sources.tables import table

__all__ = ["as_binary", "bucket_count", "components", "materialize", "table", "text_bytes"]


def as_binary(column: str) -> Column:
    return F.col(column).cast("string").cast("binary")


def text_bytes(df: DataFrame, text: str) -> int:
    return df.agg(F.sum(F.octet_length(F.col(text).cast("string")))).first()[0] or 0


def bucket_count(spark: SparkSession, size: int, per_bucket: int) -> int:
    """Buckets of about ``per_bucket`` bytes, one per shuffle partition at least, so
    a bucket stays in a task's memory at every input size."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(size / per_bucket))


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root) for every node of the undirected ``edges`` (a, b): root is the
    smallest node it reaches.

    Large-star and small-star steps (Kiveris et al., 2014) in turn, each one
    aggregation with partial sums and one join that AQE may split; the edges are
    written after each round, until a round changes nothing."""
    e = materialize(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
                    .where("u <> v").distinct(), "cc")
    last = None
    for _ in range(rounds):
        both = e.union(e.select(F.col("v"), F.col("u")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u")
        e = materialize(small.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
                        .union(low).distinct(), "cc")
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == last:
            break
        last = now
    else:
        raise RuntimeError("components did not settle")
    return e.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("root"))
