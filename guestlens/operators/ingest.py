"""Landed pages -> normalised reviews, place headers, quarantine, no-review places."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from guestlens.functions.dates import display_date, parse_iso
from guestlens.operators.ordering import running_total


MAX_RATING = 5
PAGES_PER_RANGE = 1024


def explode_pages(pages: DataFrame) -> DataFrame:
    """P1 (row part): every review of every readable page with defaults for
    missing fields (rating 0, user "", text "") and the display date.
    Output: data_id, page_no, pos, user, rating, iso_date, ts, date,
    review_text, bad_reason (NULL for a usable row).  A rating that is no number of
    0..5 and a page without its number make bad rows."""
    good = pages.filter(F.col("_corrupt").isNull() & F.col("data_id").isNotNull())
    more = [c for c in ("_page_off", "_landed_at", "_content") if c in pages.columns]
    rows = good.select("data_id", "page_no", *more, F.posexplode("reviews").alias("pos", "r"))
    ts = parse_iso(F.col("r.iso_date"))
    rating = F.col("r.rating").try_cast("double")
    usable = rating.between(0, MAX_RATING) & ~F.isnan(rating)
    return rows.select(
        "data_id", "page_no", *more, F.col("pos").cast("long").alias("pos"),
        F.coalesce(F.col("r.user.name"), F.lit("")).alias("user"),
        F.when(usable, rating).otherwise(F.lit(0.0)).alias("rating"),
        F.col("r.iso_date").alias("iso_date"),
        ts.alias("ts"), display_date(ts).alias("date"),
        F.coalesce(F.col("r.extracted_snippet.original"), F.lit("")).alias("review_text"),
        F.when(ts.isNull(), "bad date")
         .when(F.col("r.rating").isNotNull() & ~F.coalesce(usable, F.lit(False)), "bad rating")
         .when(F.col("page_no").isNull(), "no page number").alias("bad_reason"))


def _numbered(rows: DataFrame) -> DataFrame:
    return (rows.withColumn("fetch_pos", (F.col("_page_off") + F.col("pos") + 1).cast("long"))
            .withColumn("review_id", F.col("fetch_pos")).drop("_page_off"))


def _offsets(sizes: DataFrame) -> DataFrame:
    """Reviews on earlier pages of the place (pages without a number come last)."""
    return running_total(sizes, ["data_id"], [F.col("page_no").asc_nulls_last()], "_page_off",
                         F.floor(F.col("page_no") / PAGES_PER_RANGE), weight="_n", inclusive=False)


def assign_fetch_pos(rows: DataFrame) -> DataFrame:
    """P1 (order part) for rows that are exploded already: ``fetch_pos`` = 1-based position
    in fetch order, i.e. reviews on earlier pages of the place + position on the page + 1."""
    sizes = rows.groupBy("data_id", "page_no").agg(F.count(F.lit(1)).cast("long").alias("_n"))
    offsets = _offsets(sizes).select(F.col("data_id").alias("_od"), F.col("page_no").alias("_op"), "_page_off")
    j = rows.join(offsets, (rows.data_id == offsets._od) & rows.page_no.eqNullSafe(offsets._op))
    return _numbered(j.drop("_od", "_op"))


def normalize_reviews(pages: DataFrame) -> DataFrame:
    """Concatenate each place's pages in page order and project every
    review (see ``explode_pages``) with its fetch position.  The offsets are
    taken over pages, before their reviews are exploded."""
    good = pages.filter(F.col("_corrupt").isNull() & F.col("data_id").isNotNull())
    counted = good.withColumn("_n", F.coalesce(F.size("reviews"), F.lit(0)))
    return _numbered(explode_pages(_offsets(counted)))


def _non_empty(struct_col: str, fields: list[str]) -> F.Column:
    c = F.col(struct_col)
    return c.isNotNull() & F.coalesce(*[c[f].cast("string") for f in fields]).isNotNull()


def place_header(pages: DataFrame) -> DataFrame:
    """Per place, the first non-empty place_info, search_metadata and
    search_parameters over its pages (each block chosen independently), with
    defaults: strings "", rating 0.0, total 0."""
    good = pages.filter(F.col("_corrupt").isNull() & F.col("data_id").isNotNull())

    def first(block, fields):
        return F.min_by(F.col(block), F.when(_non_empty(block, fields), F.col("page_no")))

    h = good.groupBy("data_id").agg(
        first("place_info", ["type", "title", "rating", "address", "reviews"]).alias("pi"),
        first("search_metadata", ["status", "created_at"]).alias("sm"),
        first("search_parameters", ["data_id"]).alias("sp"))
    return h.select(
        "data_id",
        F.coalesce(F.col("pi.type"), F.lit("")).alias("type"),
        F.coalesce(F.col("pi.title"), F.lit("")).alias("title"),
        F.coalesce(F.col("pi.rating").try_cast("double"), F.lit(0.0)).alias("rating"),
        F.coalesce(F.col("pi.address"), F.lit("")).alias("address"),
        F.coalesce(F.col("sm.status"), F.lit("")).alias("status"),
        F.coalesce(F.col("pi.reviews"), F.lit(0)).cast("long").alias("total_reviews"),
        F.coalesce(F.col("sm.created_at"), F.lit("")).alias("created_at"),
        F.coalesce(F.col("sp.data_id"), F.lit("")).alias("param_data_id"))


def quarantine(reviews: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Split normalised reviews into good rows and quarantined rows (date
    missing or malformed, rating no number of 0..5, page without a number).  A bad
    row is set aside, not the whole place."""
    bad = F.col("bad_reason").isNotNull()
    return reviews.filter(~bad), reviews.filter(bad)


def bad_pages(pages: DataFrame) -> DataFrame:
    """Unreadable pages per place; the place is read from the broken line where it still
    stands there (else data_id is NULL)."""
    bad = pages.filter(F.col("_corrupt").isNotNull() | F.col("data_id").isNull())
    place = F.coalesce(F.col("data_id"), F.regexp_extract("_corrupt", r'"data_id"\s*:\s*"?(\d+)', 1).try_cast("long"))
    return bad.groupBy(place.alias("data_id")).agg(F.count(F.lit(1)).cast("long").alias("n_bad_pages"))


def place_status(reviews: DataFrame, pages: DataFrame | None = None, requests: DataFrame | None = None) -> DataFrame:
    """Per place Success (all rows and pages good) / Partial (some are not) /
    Error (nothing usable), with the counts.  ``pages`` adds unreadable pages,
    ``requests`` (data_id) the places that were asked for and gave nothing."""
    bad = F.col("bad_reason").isNotNull()
    zero = F.lit(0).cast("long")
    parts = reviews.select("data_id", F.when(bad, 0).otherwise(1).alias("g"), F.when(bad, 1).otherwise(0).alias("q"), F.lit(0).alias("p"))
    if pages is not None:
        broken = bad_pages(pages).filter(F.col("data_id").isNotNull())
        parts = parts.unionByName(broken.select("data_id", zero.alias("g"), zero.alias("q"), F.col("n_bad_pages").alias("p")))
    if requests is not None:
        parts = parts.unionByName(requests.select("data_id", zero.alias("g"), zero.alias("q"), zero.alias("p")))
    s = parts.groupBy("data_id").agg(F.sum("g").cast("long").alias("n_good"), F.sum("q").cast("long").alias("n_quarantined"),
                                     F.sum("p").cast("long").alias("n_bad_pages"))
    return s.withColumn("status", F.when(F.col("n_good") == 0, "Error")
                        .when((F.col("n_quarantined") > 0) | (F.col("n_bad_pages") > 0), "Partial").otherwise("Success"))


def no_review_places(requests: DataFrame, reviews: DataFrame, key: str = "data_id") -> DataFrame:
    """Requested places without any review.  The instant reply is
    ``no_reviews``; a full job fails with error ``no_reviews``."""
    have = reviews.select(F.col("data_id").alias("_rk")).filter(F.col("_rk").isNotNull())
    miss = requests.join(have, requests[key] == have._rk, "left_anti")
    return miss.select(F.col(key).alias("data_id"),
                       F.lit("no_reviews").alias("instant_status"),
                       F.lit("failed").alias("full_status"),
                       F.lit("no_reviews").alias("full_error"))
