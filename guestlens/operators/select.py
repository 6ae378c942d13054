"""Which reviews count, their order, their batches."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from guestlens.functions.dates import minute_key
from guestlens.operators.ordering import position

DEFAULT_NUM_REVIEWS = 20      # instant analysis
DEFAULT_MAX_REVIEWS = 150     # full analysis (page-granular)
DEFAULT_BATCH_SIZE = 15
DEFAULT_SHOWN = 10


def instant_select(reviews: DataFrame, num_reviews: int = DEFAULT_NUM_REVIEWS) -> DataFrame:
    """The first ``num_reviews`` of each place in fetch order, then numbered
    by date (ascending, ties in fetch order).  ``row_number() <= n`` is planned
    as a partial + final WindowGroupLimit, so at most n rows per place leave
    each map task; the second window sees <= n rows per place."""
    first = Window.partitionBy("data_id").orderBy("fetch_pos")
    top = reviews.withColumn("_rn", F.row_number().over(first)).filter(F.col("_rn") <= num_reviews)
    by_date = Window.partitionBy("data_id").orderBy(minute_key("ts"), "fetch_pos")
    return top.drop("_rn").withColumn("date_rank", F.row_number().over(by_date).cast("long"))


def page_counts(reviews: DataFrame) -> DataFrame:
    """Pages seen in the review table: (data_id, page_no, n_reviews, has_next).  A review
    table does not know empty pages; every page before the place's last one has a next."""
    pages = reviews.groupBy("data_id", "page_no").agg(F.count(F.lit(1)).cast("long").alias("n_reviews"))
    last = reviews.groupBy(F.col("data_id").alias("_nd")).agg(F.max("page_no").alias("_np"))
    return (pages.join(last, pages.data_id == last._nd)
            .select("data_id", "page_no", "n_reviews", (F.col("page_no") < F.col("_np")).alias("has_next")))


def landed_page_counts(pages: DataFrame) -> DataFrame:
    """The same from landed pages: empty pages count as pages, and a page has a next page
    if it says so."""
    return pages.filter(F.col("data_id").isNotNull() & F.col("page_no").isNotNull()).select(
        "data_id", "page_no", F.coalesce(F.size("reviews"), F.lit(0)).cast("long").alias("n_reviews"),
        F.col("serpapi_pagination.next").isNotNull().alias("has_next"))


def full_page_cap(pages: DataFrame, max_reviews: int = DEFAULT_MAX_REVIEWS) -> DataFrame:
    """Keep whole pages in page order while fewer than ``max_reviews`` were
    collected before the page (the crossing page is kept whole), and stop after
    the first page without a next link.

    Every non-empty page adds >= 1 review, so the crossing page is among the
    first ``max_reviews`` non-empty pages: a WindowGroupLimit keeps those, the
    running count runs over <= max_reviews rows per place, and the stop page
    without next is a plain min() aggregate.  Output: the kept pages.
    """
    first = Window.partitionBy("data_id").orderBy("page_no")
    head = (pages.filter(F.col("n_reviews") > 0)
            .withColumn("_rn", F.row_number().over(first)).filter(F.col("_rn") <= max_reviews))
    run = Window.partitionBy("data_id").orderBy("page_no").rowsBetween(Window.unboundedPreceding, 0)
    crossing = (head.withColumn("_cum", F.sum("n_reviews").over(run))
                .filter(F.col("_cum") >= max_reviews)
                .groupBy("data_id").agg(F.min("page_no").alias("_cross")))
    stop = (pages.groupBy("data_id")
            .agg(F.min(F.when(~F.col("has_next"), F.col("page_no"))).alias("_stop")))
    ends = (stop.join(crossing, "data_id", "left")
            .select(F.col("data_id").alias("_ed"), F.least("_cross", "_stop").alias("_end")))
    kept = pages.join(ends, pages.data_id == ends._ed, "left")
    return (kept.filter(F.col("_end").isNull() | (F.col("page_no") <= F.col("_end")))
            .drop("_ed", "_end"))


def day_of(c: str) -> F.Column:
    """The range of a date order: the day as a number."""
    return F.unix_date(F.to_date(c)).cast("long")


def chronological_batches(reviews: DataFrame, batch_size: int = DEFAULT_BATCH_SIZE) -> DataFrame:
    """Number reviews by date ascending (minute resolution, ties in fetch
    order) and cut them into consecutive batches of ``batch_size``.  Adds
    date_pos (1-based), batch_id (0-based) and batch_pos."""
    if batch_size < 1:
        raise ValueError("batch_size must be >= 1")
    r = position(reviews.withColumn("_minute", minute_key("ts")), ["data_id"],
                 ["_minute", "fetch_pos"], "date_pos", day_of("_minute"))
    return (r.drop("_minute")
            .withColumn("batch_id", F.floor((F.col("date_pos") - 1) / batch_size).cast("long"))
            .withColumn("batch_pos", ((F.col("date_pos") - 1) % batch_size + 1).cast("long")))


def reviews_by_date(reviews: DataFrame) -> DataFrame:
    """O1: date order at minute resolution in both directions; equal minutes
    keep fetch order in both (a stable sort, also when reversed).  Adds
    rank_asc and rank_desc (1-based, per place).  The second rank follows from the first,
    the place's size and the row's place within its minute: one sort serves both."""
    r = position(reviews.withColumn("_minute", minute_key("ts")).withColumn("_day", day_of("_minute")), ["data_id"],
                 [F.col("_minute").asc(), F.col("fetch_pos").asc()], "rank_asc", F.col("_day"), whole="_all")
    minute = Window.partitionBy("data_id", "_day", "_minute")
    within = F.row_number().over(minute.orderBy("fetch_pos"))
    r = r.withColumn("_within", within).withColumn("_same", F.count(F.lit(1)).over(minute))
    later = F.col("_all") - (F.col("rank_asc") - F.col("_within")) - F.col("_same")
    return r.withColumn("rank_desc", (later + F.col("_within")).cast("long")).drop("_minute", "_day", "_all", "_within", "_same")


def review_display_split(reviews: DataFrame, shown: int = DEFAULT_SHOWN) -> DataFrame:
    """The first ``shown`` reviews in date-descending order are shown, the
    rest are held back.  The top-k is a WindowGroupLimit; the flag is joined
    back on the review key (data_id, fetch_pos), which does not skew."""
    desc = Window.partitionBy("data_id").orderBy(minute_key("ts").desc(), F.col("fetch_pos").asc())
    top = (reviews.select("data_id", "fetch_pos", "ts")
           .withColumn("display_rank", F.row_number().over(desc))
           .filter(F.col("display_rank") <= shown)
           .select(F.col("data_id").alias("_d"), F.col("fetch_pos").alias("_f"),
                   F.col("display_rank").cast("long").alias("display_rank")))
    out = reviews.join(top, (reviews.data_id == top._d) & (reviews.fetch_pos == top._f), "left")
    return out.drop("_d", "_f").withColumn("shown", F.col("display_rank").isNotNull())


def place_review_bundle(header: DataFrame, reviews: DataFrame, key: str = "place_key") -> DataFrame:
    """J2 (flat form): every place header with each of its reviews; places
    without reviews keep one row with null review fields."""
    r = reviews.withColumnRenamed("data_id", "_rd")
    return header.join(r, header[key] == r._rd, "left").drop("_rd")


def nested_bundle(header: DataFrame, reviews: DataFrame, order_col: str = "rank_desc",
                  key: str = "data_id") -> DataFrame:
    """J2 (nested edge form): one row per place with its reviews as an ordered
    array.  Use on bounded selections only (instant or capped full analysis):
    the array of one place is built in one task."""
    items = (reviews.groupBy("data_id").agg(F.array_sort(F.collect_list(F.struct(
        F.col(order_col).alias("k"), F.col("user"), F.col("date"), F.col("rating"),
        F.col("review_text")))).alias("_items")))
    items = items.select(F.col("data_id").alias("_rd"), F.transform("_items", lambda x: F.struct(
        x["user"].alias("user"), x["date"].alias("date"), x["rating"].alias("rating"),
        x["review_text"].alias("review_text"))).alias("reviews"))
    return (header.join(items, header[key] == items._rd, "left").drop("_rd")
            .withColumn("reviews", F.coalesce("reviews", F.array().cast(
                "array<struct<user:string,date:string,rating:double,review_text:string>>"))))
