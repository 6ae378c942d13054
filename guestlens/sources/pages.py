"""Landed review pages (JSON lines, one page per line).

``build_pages`` turns review rows into the search API's page shape so tests and
registered queries have page files derived from the given tables;
``land_pages`` writes them; ``scan_pages`` reads any landed folder with the
fixed page schema, keeping malformed lines in ``_corrupt``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from guestlens.functions.dates import to_iso
from guestlens.schemas import PAGE_WITH_CORRUPT


def build_pages(reviews: DataFrame, places: DataFrame) -> DataFrame:
    """reviews (data_id, page_no, fetch_pos, reviewer, rating, ts, review_text)
    + places (place_key, title, type, address) -> one row per page in PAGE shape.

    Page 0 of places of type BUILDING carries no ``place_info`` (the header then
    comes from the next page); the last page of a place has no ``next`` link.
    """
    item = F.struct(
        F.col("rating").cast("double").alias("rating"),
        to_iso("ts").alias("iso_date"),
        F.struct(F.col("reviewer").alias("name")).alias("user"),
        F.struct(F.col("review_text").alias("original")).alias("extracted_snippet"))
    # collect_list per page is bounded by the page size.
    pages = (reviews.groupBy("data_id", "page_no")
             .agg(F.array_sort(F.collect_list(F.struct(F.col("fetch_pos"), item.alias("r")))).alias("_items"),
                  F.max("ts").alias("_last_ts"), F.count(F.lit(1)).alias("_n")))
    nxt = pages.select(F.col("data_id").alias("_nd"), (F.col("page_no") - 1).alias("_np"))
    pages = pages.join(nxt, (pages.data_id == nxt._nd) & (pages.page_no == nxt._np), "left")
    totals = reviews.groupBy("data_id").agg(F.count(F.lit(1)).alias("_total"))
    header = (places.join(totals, places.place_key == totals.data_id)
              .select(F.col("place_key").alias("_pk"), "title", "type", "address", "_total",
                      F.col("rating").alias("_prating")))
    p = pages.join(header, pages.data_id == header._pk, "left")
    no_info = (F.col("page_no") == 0) & (F.col("type") == "BUILDING")
    return p.select(
        F.col("data_id").cast("long").alias("data_id"),
        F.col("page_no").cast("long").alias("page_no"),
        F.when(no_info | F.col("_pk").isNull(), F.lit(None)).otherwise(
            F.struct(F.col("type"), F.col("title"), F.col("_prating").alias("rating"),
                     F.col("address"), F.col("_total").alias("reviews"))).alias("place_info"),
        F.struct(F.lit("Success").alias("status"),
                 F.date_format("_last_ts", "yyyy-MM-dd HH:mm:ss 'UTC'").alias("created_at"))
         .alias("search_metadata"),
        F.struct(F.col("data_id").cast("string").alias("data_id")).alias("search_parameters"),
        F.transform("_items", lambda x: x["r"]).alias("reviews"),
        F.when(F.col("_nd").isNull(), F.lit(None)).otherwise(F.struct(
            F.format_string("page:%d:%d", F.col("data_id"), F.col("page_no") + 1).alias("next"),
            F.format_string("%d-%d", F.col("data_id"), F.col("page_no") + 1).alias("next_page_token")))
         .alias("serpapi_pagination"))


def land_pages(pages: DataFrame, path: str, broken: Column | None = None) -> str:
    """Write pages as JSON lines (missing / null fields are left out).  Lines where
    ``broken`` holds are cut in the middle, as a failed fetch leaves them."""
    if broken is None:
        pages.write.mode("overwrite").json(path)
    else:
        line = F.to_json(F.struct(*pages.columns))
        pages.select(F.when(broken, F.substring(line, 1, 60)).otherwise(line).alias("value")).write.mode("overwrite").text(path)
    return path


def scan_pages(spark: SparkSession, path: str, more: str | None = None) -> DataFrame:
    """Read landed pages with the fixed schema (and ``more`` fields, as DDL); bad lines land in ``_corrupt``."""
    schema = StructType([*PAGE_WITH_CORRUPT.fields, *(StructType.fromDDL(more).fields if more else [])])
    return (spark.read.schema(schema)
            .option("mode", "PERMISSIVE")
            .option("columnNameOfCorruptRecord", "_corrupt")
            .json(path))


def page_summary(pages: DataFrame) -> DataFrame:
    """One row per landed page: what was fetched and whether a next page exists."""
    return pages.select(
        "data_id", "page_no",
        F.coalesce(F.size("reviews"), F.lit(0)).cast("long").alias("n_reviews"),
        F.col("serpapi_pagination.next").isNotNull().alias("has_next"),
        F.col("place_info.title").alias("title"),
        F.col("_corrupt").isNotNull().alias("is_corrupt"))
