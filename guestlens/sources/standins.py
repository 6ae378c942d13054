"""Stand-in views over the driver's tables.

The driver ships no review data, so review-shaped tables are derived from its
tables with fixed rules (the same rules as the oracle SQL in
``guestlens.plans.oracle``):

* ``reviews``  - one review per event: reviewer from ``supplier``, rating from
  the event type, text from two ``part`` names (as sentences, with "but", commas and
  negators); the fetch (quality) order is value descending, pages hold 10 reviews;
* ``prose_reviews`` - the documents as reviews of their sources, for the clause and
  negation rules on long prose;
* ``places``   - one place per customer, every 13th is "not a place";
* ``search_queries``, ``store_writes``, ``status_events`` - request, store and
  status logs derived from ``nation`` and ``events``;
* ``TEST_LEXICON``, ``TEST_POLARITY`` - the test vocabulary for the part-name texts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from guestlens.functions.dates import display_date
from guestlens.operators.ordering import position
from guestlens.sources.scratch import identity
from guestlens.sources.tables import table

PAGE_SIZE = 10

# Fixed test vocabulary (stand-in texts are "adjective noun" part names).
TEST_LEXICON = [
    ("anvil", "accommodation"), ("bolt", "service"), ("gear", "amenities"),
    ("gizmo", "food_and_dining"), ("plate", "location_and_accessibility"),
    ("ring", "value_for_money"), ("rod", "online_presence"),
]
TEST_POLARITY = [
    ("new", 1), ("large", 1), ("hot", 1), ("old", -1), ("small", -1), ("cold", -1),
    ("red", 0), ("blue", 0),
]


def _rating_of(event_type):
    return (F.when(event_type == "error", 1).when(event_type == "signup", 2)
            .when(event_type == "view", 3).when(event_type == "click", 4)
            .otherwise(5).cast("long"))


def reviews(spark: SparkSession, sf_dir: str, ordered: bool = True, reuse=identity) -> DataFrame:
    """data_id, event_id, ts, reviewer, rating, review_text, fetch_pos, page_no.

    ``ordered=False`` leaves out the fetch order (fetch_pos, page_no NULL) for
    jobs that only aggregate, so no numbering is planned at all.  ``reuse`` writes the rows that
    the numbering reads twice."""
    e = table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type", "value")
    s = table(spark, sf_dir, "supplier").select("s_suppkey", "s_name")
    p = table(spark, sf_dir, "part").select("p_partkey", "p_name")
    # Names come from the whole tables: keys run from 0 to their number of rows.
    n_s, n_p = s.select(F.count("*")).scalar(), p.select(F.count("*")).scalar()
    i = F.col("event_id")
    e = e.select("*", (i % n_s).alias("s_key"), (i % n_p).alias("p_key"), ((i * 7 + 3) % n_p).alias("q_key"))
    p1, p2 = p.alias("p1"), p.alias("p2")
    one, two = F.col("p1.p_name"), F.col("p2.p_name")
    said = (F.when(i % 10 == 0, F.lit("")).when(i % 10 == 3, F.concat(F.lit("Not "), one, F.lit(", but "), two, F.lit("!")))
            .when(i % 10 == 4, F.concat(one, F.lit(" but never "), two))
            .when(i % 10 == 6, F.concat(F.lit("The "), one, F.lit("; it wasn't "), two, F.lit("?")))
            .otherwise(F.concat(one, F.lit(". "), two)))
    r = (e.join(s, s.s_suppkey == F.col("s_key"))
          .join(p1, F.col("p1.p_partkey") == F.col("p_key"))
          .join(p2, F.col("p2.p_partkey") == F.col("q_key"))
          .select(F.col("user_id").alias("data_id"), "event_id", "ts",
                  F.col("s_name").alias("reviewer"),
                  _rating_of(F.col("event_type")).alias("rating"), said.alias("review_text"),
                  "value"))
    if not ordered:
        return (r.drop("value").withColumn("fetch_pos", F.lit(None).cast("long"))
                .withColumn("page_no", F.lit(None).cast("long")))
    r = position(reuse(r, "unnumbered"), ["data_id"], [F.col("value").desc(), F.col("event_id").asc()], "fetch_pos",
                 -F.floor(F.col("value")).cast("long"))
    return (r.drop("value")
             .withColumn("page_no", F.floor((F.col("fetch_pos") - 1) / PAGE_SIZE).cast("long")))


def with_defects(r: DataFrame) -> DataFrame:
    """The reviews with planted defects, by event: no date, and ratings that are no
    number or out of range."""
    e = F.col("event_id")
    return (r.withColumn("rating", F.when(e % 83 == 11, F.lit(float("nan"))).when(e % 89 == 7, 9.0).otherwise(F.col("rating").cast("double")))
            .withColumn("ts", F.when(e % 97 != 5, F.col("ts"))))


def cut_links(pages: DataFrame) -> DataFrame:
    """Built pages of which some in the middle have no ``next``."""
    return pages.withColumn("serpapi_pagination", F.when((F.col("data_id") + F.col("page_no")) % 7 != 2, F.col("serpapi_pagination")))


def tokened_pages(pages: DataFrame) -> DataFrame:
    """Built pages with the token they were fetched with instead of their number; some pages are lost, and the last
    pages of some places lead back to their third page."""
    token = lambda no: F.concat_ws("-", F.col("data_id").cast("string"), no.cast("string"))
    link = F.struct(F.lit("again").alias("next"), token(F.lit(2)).alias("next_page_token"))
    back = F.col("serpapi_pagination").isNull() & (F.col("data_id") % 11 == 3)
    return (pages.withColumn("serpapi_pagination", F.when(back, link).otherwise(F.col("serpapi_pagination")))
            .withColumn("page_token", F.when(F.col("page_no") > 0, token(F.col("page_no"))))
            .where((F.col("data_id") * 7 + F.col("page_no")) % 29 != 4).drop("page_no"))


def broken_page() -> F.Column:
    return (F.col("data_id") + F.col("page_no")) % 41 == 3


def normalized_reviews(spark: SparkSession, sf_dir: str, ordered: bool = True, reuse=identity) -> DataFrame:
    """The stand-in reviews in the normalised review shape (what P1 yields
    from landed pages): data_id, fetch_pos, page_no, user, rating, ts, date,
    review_text, review_id (the event id: unique per review)."""
    r = reviews(spark, sf_dir, ordered, reuse)
    return r.select("data_id", "fetch_pos", "page_no", F.col("reviewer").alias("user"),
                    F.col("rating").cast("double").alias("rating"), "ts",
                    display_date("ts").alias("date"), "review_text",
                    F.col("event_id").alias("review_id"))


# Fixed test vocabulary for the prose: words that are frequent in some of its languages.
PROSE_LEXICON = [("that", "service"), ("with", "amenities"), ("for", "accommodation"), ("para", "food_and_dining"),
                 ("dans", "location_and_accessibility"), ("mit", "value_for_money"), ("breakfast", "food_and_dining")]
PROSE_POLARITY = [("was", 1), ("una", 1), ("und", 1), ("pour", 1), ("are", -1), ("las", -1), ("der", -1), ("est", -1), ("it", 0)]


def prose_reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as a review of its source (numbered as its name says)."""
    d = table(spark, sf_dir, "documents")
    return d.select(F.regexp_extract("source", r"(\d+)$", 1).try_cast("long").alias("data_id"), F.col("doc_id").alias("review_id"),
                    (F.col("n_chars") % 5 + 1).cast("double").alias("rating"), F.lit(None).cast("timestamp_ntz").alias("ts"),
                    F.col("text").alias("review_text"))


def prose_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A large vocabulary (phrase, aspect, sign) for the prose: every run of one to four words of the
    benchmark texts, with an aspect by its length (some have none) and a sign by its first letter."""
    from guestlens.operators.aspects import ASPECTS
    from guestlens.operators.phrases import runs
    b = table(spark, sf_dir, "benchmark").select(F.lit(0).alias("data_id"), F.col("item_id").alias("review_id"), F.col("text").alias("review_text"))
    names = F.array(*[F.lit(a) for a, _ in ASPECTS])
    return (runs(b, [1, 2, 3, 4]).select("phrase").distinct()
            .select("phrase", F.get(names, F.length("phrase") % 8).alias("aspect"), (F.ascii("phrase") % 3 - 1).alias("sign")))


def places(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment", "c_nationkey",
                                                 "c_acctbal")
    n = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    k = F.col("c_custkey")
    return (c.join(n, n.n_nationkey == c.c_nationkey)
             .select(F.when(k % 13 == 0, F.lit(None).cast("long")).otherwise(k).alias("data_id"),
                     k.alias("place_key"), F.col("c_name").alias("title"),
                     F.col("c_mktsegment").alias("type"), F.col("n_name").alias("address"),
                     (F.lit(9.0) + (k % 200).cast("double") / 100.0).alias("latitude"),
                     (F.lit(76.0) + (k % 150).cast("double") / 100.0).alias("longitude"),
                     F.round(F.least(F.lit(5.0), F.greatest(F.lit(1.0), F.col("c_acctbal") / 2000.0)), 1)
                      .alias("rating")))


def search_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation").select("n_nationkey")
    k = F.col("n_nationkey")
    return n.select(k.cast("long").alias("query_id"),
                    F.concat(F.lit("000"), F.lpad(k.cast("string"), 2, "0")).alias("q"),
                    F.when(k % 3 == 0, F.lit(None).cast("double")).otherwise(F.lit(10.0)).alias("latitude"),
                    F.when(k % 3 == 0, F.lit(None).cast("double")).otherwise(F.lit(76.5)).alias("longitude"))


def store_writes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Upsert log: every event writes a report for its user."""
    e = table(spark, sf_dir, "events")
    return (e.select(F.col("user_id").alias("data_id"),
                     F.when(F.col("event_id") % 2 == 0, F.lit("instant")).otherwise(F.lit("full")).alias("type"),
                     F.col("props").alias("analysis"), F.col("ts").alias("written_at"),
                     F.col("event_id").alias("seq")))


def status_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    t = F.col("event_type")
    return e.select(F.col("user_id").alias("token"),
                    F.when(t == "purchase", "completed").when(t == "error", "failed")
                     .otherwise("in_progress").alias("status"),
                    F.col("ts").alias("created_at"), F.col("event_id").alias("seq"),
                    F.when(t == "error", F.concat(F.lit("analysis failed: "), F.col("props")))
                     .alias("error"))
