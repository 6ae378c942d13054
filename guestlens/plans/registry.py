"""Registered queries: name -> (spark, sf_dir) -> DataFrame.

Each reads the driver's tables (through the stand-in views) and runs one
operator from the inventory over all of it.  Parameters are the reference's
defaults unless noted.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from guestlens.operators import select as sel
from guestlens.operators import sentiment as sen
from guestlens.session import configure
from guestlens.sources import standins as st

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(name: str):
    def deco(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            configure(spark)
            return fn(spark, sf_dir)
        run.__name__ = name
        run.__doc__ = fn.__doc__
        QUERIES[name] = run
        return run
    return deco


def _reviews(spark, d):
    """The review view, written once: every numbering reads its input twice (ranges and rows)."""
    from guestlens.sources.scratch import materialize
    return materialize(st.normalized_reviews(spark, d, reuse=materialize), "reviews")


def _unordered(spark, d):
    """Reviews for jobs that only aggregate: no fetch-order numbering planned."""
    return st.normalized_reviews(spark, d, ordered=False)


@query("sentiment_overview")
def sentiment_overview(spark, d):
    """Flagship: reviews -> date order -> batches of 15 -> per-batch state ->
    per-place sentiment with batch count and date range."""
    b = sel.chronological_batches(_reviews(spark, d))
    per_batch = sen.batch_state(b)
    s = per_batch.groupBy("data_id").agg(
        *sen.merge_aggs(), F.count(F.lit(1)).cast("long").alias("n_batches"),
        F.min("first_ts").alias("first_ts"), F.max("last_ts").alias("last_ts"))
    from guestlens.functions.dates import display_date
    return sen.scores(s).select("data_id", "n_reviews", "n_batches", *sen.SCORE_COLUMNS,
                                display_date("first_ts").alias("first_date"),
                                display_date("last_ts").alias("last_date"))


@query("overall_sentiment")
def overall_sentiment(spark, d):
    """A1 over every review of every place."""
    return sen.overall_sentiment(_unordered(spark, d))


# --- ingest ------------------------------------------------------------------

def _landed_pages(spark, d, defects=False):
    """Build page files from the stand-in reviews, land them under the shared
    checkpoint folder and scan them back (S1).  The scan is written once, so the JSON is
    parsed once however many branches read the pages."""
    from guestlens.session import work_path
    from guestlens.sources import pages as pg
    from guestlens.sources.scratch import materialize
    path = work_path(spark, "landed-pages")
    r = st.reviews(spark, d)
    if defects:
        pg.land_pages(pg.build_pages(st.with_defects(r), st.places(spark, d)), path, broken=st.broken_page())
    else:
        pg.land_pages(pg.build_pages(r, st.places(spark, d)), path)
    return materialize(pg.scan_pages(spark, path), "pages")


@query("review_pages_scan")
def review_pages_scan(spark, d):
    """Landed page files read with the fixed page schema."""
    from guestlens.sources.pages import page_summary
    return page_summary(_landed_pages(spark, d))


@query("review_normalize")
def review_normalize(spark, d):
    """Pages -> one row per review with defaults and display date."""
    from guestlens.operators.ingest import normalize_reviews
    return normalize_reviews(_landed_pages(spark, d)).select(
        "data_id", "fetch_pos", "page_no", "user", "rating", "date", "review_text", "iso_date")


@query("place_header")
def place_header(spark, d):
    """First non-empty header blocks per place."""
    from guestlens.operators.ingest import place_header as ph
    return ph(_landed_pages(spark, d))


@query("review_quarantine")
def review_quarantine(spark, d):
    """Success / Partial / Error of every requested place, with its good and
    quarantined reviews and unreadable pages; the landed pages hold planted defects."""
    from guestlens.operators.ingest import normalize_reviews, place_status
    pages = _landed_pages(spark, d, defects=True)
    asked = st.places(spark, d).select(F.col("place_key").alias("data_id"))
    return place_status(normalize_reviews(pages), pages, asked)


@query("no_reviews_places")
def no_reviews_places(spark, d):
    """Requested places (every place) that have no reviews."""
    from guestlens.operators.ingest import no_review_places
    return no_review_places(st.places(spark, d).select("place_key"),
                            st.reviews(spark, d, ordered=False), key="place_key")


# --- selection / order -------------------------------------------------------

@query("instant_select")
def instant_select(spark, d):
    """First 20 reviews per place in fetch order, numbered by date."""
    return sel.instant_select(_reviews(spark, d)).select("data_id", "fetch_pos", "date_rank", "date")


@query("full_page_cap")
def full_page_cap(spark, d):
    """Whole landed pages until 40 reviews are reached (crossing page kept) or a
    page has no next link."""
    return sel.full_page_cap(sel.landed_page_counts(_landed_pages(spark, d)), max_reviews=40)


@query("chronological_batches")
def chronological_batches(spark, d):
    """Batches of 15 in date order."""
    return sel.chronological_batches(_reviews(spark, d)).select(
        "data_id", "fetch_pos", "date_pos", "batch_id", "batch_pos")


@query("reviews_by_date")
def reviews_by_date(spark, d):
    """O1: date ranks in both directions, ties in fetch order."""
    return sel.reviews_by_date(_reviews(spark, d)).select(
        "data_id", "fetch_pos", "date", "rank_asc", "rank_desc")


@query("review_display_split")
def review_display_split(spark, d):
    """First 10 by date descending are shown (the review table is read by
    the top-k branch and the flag join)."""
    return sel.review_display_split(_reviews(spark, d)).select(
        "data_id", "fetch_pos", "display_rank", "shown")


@query("place_review_bundle")
def place_review_bundle(spark, d):
    """Place headers with their reviews (flat)."""
    h = st.places(spark, d).select("place_key", "title", "address")
    r = _reviews(spark, d).select("data_id", "fetch_pos", "user", "rating")
    return sel.place_review_bundle(h, r)


# --- batch aggregates --------------------------------------------------------

@query("batch_analysis")
def batch_analysis(spark, d):
    """A2: per batch of 15: counts, scores, date range."""
    return sen.batch_analysis(sel.chronological_batches(_reviews(spark, d)))


@query("recency_weighted_sentiment")
def recency_weighted_sentiment(spark, d):
    """A4: scores with batch k (oldest = 1) weighted k; batches of 15."""
    return sen.recency_weighted_sentiment(sel.chronological_batches(_reviews(spark, d)))


# --- aspects, themes, priorities ---------------------------------------------

def _mentions(spark, d, reviews=None, extra=()):
    from guestlens.operators.aspects import mentions
    r = reviews if reviews is not None else _unordered(spark, d)
    return mentions(r, st.TEST_LEXICON, st.TEST_POLARITY, extra=extra)


@query("aspect_feedback")
def aspect_feedback(spark, d):
    """A5: praise / criticism / neutral support per place and aspect."""
    from guestlens.operators.aspects import aspect_feedback as af
    return af(_mentions(spark, d))


@query("prose_feedback")
def prose_feedback(spark, d):
    """A5 over long prose: every document as a review of its source."""
    from guestlens.operators.aspects import aspect_feedback as af, mentions
    return af(mentions(st.prose_reviews(spark, d), st.PROSE_LEXICON, st.PROSE_POLARITY))


@query("recurring_themes")
def recurring_themes(spark, d):
    """Themes with >= 2 supporting reviews."""
    from guestlens.operators.aspects import recurring_themes as rt
    return rt(_mentions(spark, d))


def _batch_state_once(spark, d, batch_size):
    """Per-batch state written once: the combine tree, trends and requests read
    it from several branches."""
    from guestlens.sources.scratch import materialize
    return materialize(sen.batch_state(sel.chronological_batches(_reviews(spark, d), batch_size)), "batch-state")


def _mentions_batched(spark, d, batch_size):
    from guestlens.sources.scratch import materialize
    b = materialize(sel.chronological_batches(_reviews(spark, d), batch_size), "batches")
    nb = b.groupBy("data_id").agg((F.max("batch_id") + 1).cast("long").alias("n_place_batches"))
    return _mentions(spark, d, reviews=b, extra=["batch_id"]).join(nb, "data_id")


@query("persistent_themes")
def persistent_themes(spark, d):
    """Themes across batches of 5 (persistent: >= 2 batches and >= 50 %)."""
    from guestlens.operators.aspects import persistent_themes as pt
    return pt(_mentions_batched(spark, d, 5))


@query("improvement_priorities")
def improvement_priorities(spark, d):
    """Top 5 aspects per place by criticism x rating shortfall."""
    from guestlens.operators.aspects import improvement_priorities as ip
    return ip(_mentions(spark, d))


@query("aspect_suggestions")
def aspect_suggestions(spark, d):
    """Criticised terms per place and aspect with a suggestion."""
    from guestlens.operators.aspects import aspect_suggestions as asg
    return asg(_mentions(spark, d))


@query("analysis_summary")
def analysis_summary(spark, d):
    """A10: summary and verdict strings per place."""
    from guestlens.operators.aspects import analysis_summary as summ
    from guestlens.sources.scratch import materialize
    r = materialize(_unordered(spark, d), "reviews")
    m = _mentions(spark, d, reviews=r)
    return summ(st.places(spark, d), sen.overall_sentiment(r), m, r, key="place_key")


# --- combine / trend -----------------------------------------------------------

def _batch_reports(spark, d, batch_size):
    """(batch state, phrase counts per batch, breakfast reviews per batch), written once."""
    from guestlens.operators import aspects as asp
    from guestlens.sources.scratch import materialize
    b = materialize(sel.chronological_batches(_reviews(spark, d), batch_size), "batches")
    keys = ("data_id", "batch_id")
    counts = materialize(asp.mention_counts(_mentions(spark, d, reviews=b, extra=["batch_id"]), keys), "batch-counts")
    return materialize(sen.batch_state(b), "batch-state"), counts, asp.breakfast_reviews(b, keys)


@query("tree_combine")
def tree_combine(spark, d):
    """A3: batches of 5, fan-in 2 then 10: every combine node with its merged themes."""
    from guestlens.operators.combine import fan_in_for, tree_combine as tc
    state, counts, _ = _batch_reports(spark, d, 5)
    return tc(state, fan_in_for(5), counts)


@query("period_trend")
def period_trend(spark, d):
    """Batch-to-batch score change over batches of 5."""
    from guestlens.operators.combine import period_trend as pt
    return pt(_batch_state_once(spark, d, 5))


# --- store, cache, status, search ------------------------------------------------

def _ts_text(c):
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS")


def _stored(spark, d):
    """Upsert the whole write log into a fresh store, write it as a version and
    read the latest version back (S2 end to end)."""
    from guestlens.session import work_path
    from guestlens.sources import store as so
    root = work_path(spark, "store")
    so.write_version(so.upsert(None, st.store_writes(spark, d)), root)
    return so.read_latest(spark, root)


@query("analysis_upsert")
def analysis_upsert(spark, d):
    """Last write per (data_id, type) after upserting every write."""
    s = _stored(spark, d)
    return s.select("data_id", "type", "analysis", _ts_text("written_at").alias("written_at"), "seq")


def _lookup_requests(spark, d):
    p = st.places(spark, d).filter(F.col("data_id").isNotNull())
    k = F.col("place_key") % 3
    return p.select("data_id", F.when(k == 0, "instant").when(k == 1, "full").alias("type"))


@query("analysis_lookup")
def analysis_lookup(spark, d):
    """S3: stored reports per request; NULL type -> both, instant first."""
    from guestlens.sources.store import lookup
    out = lookup(_stored(spark, d), _lookup_requests(spark, d))
    return out.withColumn("written_at", _ts_text("written_at"))


@query("stored_union")
def stored_union(spark, d):
    """Instant and full stores as one tagged list."""
    from guestlens.sources.store import last_write, stored_union as su
    w = st.store_writes(spark, d)
    one = lambda t: last_write(w.filter(F.col("type") == t).drop("type"), keys=("data_id",))
    return su(one("instant"), one("full")).select(
        "data_id", "type", "analysis", _ts_text("written_at").alias("written_at"), "seq")


@query("cache_split")
def cache_split(spark, d):
    """Every place x {instant, full}: hit / running / miss."""
    from guestlens.operators.cache import cache_decisions
    from guestlens.operators.status import latest_status
    req = (st.places(spark, d).filter(F.col("data_id").isNotNull())
           .select("data_id", F.explode(F.array(F.lit("instant"), F.lit("full"))).alias("type")))
    return cache_decisions(req, _stored(spark, d), latest_status(st.status_events(spark, d)))


@query("job_status_latest")
def job_status_latest(spark, d):
    """Latest status per token and its reply."""
    from guestlens.operators.status import latest_status, status_reply
    r = status_reply(latest_status(st.status_events(spark, d)))
    return r.withColumn("created_at", _ts_text("created_at"))


@query("status_ttl_expire")
def status_ttl_expire(spark, d):
    """T4: statuses no older than 24 h at as_of = newest status time."""
    from guestlens.operators.status import expire, latest_status, latest_time
    ev = st.status_events(spark, d)
    out = expire(latest_status(ev), latest_time(ev))
    return out.select("token", "status", _ts_text("created_at").alias("created_at"))


@query("place_search")
def place_search(spark, d):
    """Top 5 places per search query."""
    from guestlens.operators.search import place_search as ps
    return ps(st.search_queries(spark, d), st.places(spark, d))


# --- model-call path, report -------------------------------------------------------

def _header(spark, d):
    """Place header for requests: title, address, rating, total_reviews."""
    counts = (st.reviews(spark, d, ordered=False).groupBy("data_id")
              .agg(F.count(F.lit(1)).cast("long").alias("total_reviews")))
    p = st.places(spark, d)
    return (p.join(counts, p.place_key == counts.data_id)
            .select(counts.data_id, "title", "address", "rating", "total_reviews", "type"))


def _as_of(spark, d):
    from guestlens.operators.status import latest_time
    from guestlens.sources.tables import table
    return latest_time(table(spark, d, "events"), "ts").strftime("%Y-%m-%d")


@query("analysis_requests")
def analysis_requests(spark, d):
    """L1: one model request per batch of 15."""
    from guestlens.operators.model_calls import analysis_requests as ar
    b = sel.chronological_batches(_reviews(spark, d))
    return ar(b, _header(spark, d), _as_of(spark, d))


def _nodes(spark, d, batch_size, header):
    """Every batch and combine node with its dates and whole report."""
    from guestlens.functions.dates import display_date
    from guestlens.operators.combine import fan_in_for, node_reports, tree_combine
    from guestlens.sources.scratch import materialize
    state, counts, breakfast = _batch_reports(spark, d, batch_size)
    fan_in = fan_in_for(batch_size)
    leaves = state.select(
        "data_id", F.lit(0).cast("long").alias("level"), F.col("batch_id").alias("node"),
        F.lit(1).cast("long").alias("n_children"), display_date("first_ts").alias("first_date"), display_date("last_ts").alias("last_date"))
    nodes = leaves.unionByName(tree_combine(state, fan_in).select(*leaves.columns))
    return nodes.join(node_reports(state, counts, breakfast, header, fan_in, reuse=materialize), ["data_id", "level", "node"], "left")


@query("combine_requests")
def combine_requests(spark, d):
    """L2: one request per combine node (batches of 5, fan-in 2 then 10).  The blocks are
    read back from the prompt: the children's periods, and from their reports the average
    score, the first issue and the number of praised things."""
    from guestlens.operators.combine import fan_in_for
    from guestlens.operators.model_calls import BLOCK_SEPARATOR, combine_requests as cr
    from guestlens.schemas import HOTEL_ANALYSIS
    shown = StructType([f for f in HOTEL_ANALYSIS if f.name in ("overall_sentiment", "top_improvement_priorities", "accommodation")])
    h = _header(spark, d)
    req = cr(_nodes(spark, d, 5, h), h, fan_in_for(5), _as_of(spark, d))
    # Columns of their own, so that a prompt is split once and a report parsed once.
    req = req.withColumn("_blocks", F.split("user_prompt", BLOCK_SEPARATOR))
    period = F.array_join(F.transform("_blocks", lambda b: F.substring_index(b, "\n", 1)), " ")
    req = req.withColumn("_child", F.transform("_blocks", lambda b: F.from_json(F.substring_index(b, "\n", -1), shown)))
    child = F.col("_child")
    text = lambda f: F.array_join(F.transform(child, lambda r: F.coalesce(f(r).cast("string"), F.lit("-"))), " | ")
    return req.select("data_id", "level", "node", "n_children", "system_prompt", period.alias("periods"),
                      text(lambda r: r["overall_sentiment"]["average_score"]).alias("child_scores"),
                      text(lambda r: F.get(r["top_improvement_priorities"], F.lit(0))["issue"]).alias("child_issues"),
                      text(lambda r: F.size(r["accommodation"]["common_praises"])).alias("child_praises"))


@query("response_validate")
def response_validate(spark, d):
    """L3: schema and range checks of replies.  The replies are the native reports of all
    places as JSON, some of them spoilt by rule."""
    from guestlens.operators.model_calls import validate_responses
    good = _instant_results(spark, d).select("data_id", F.to_json("hotel_analysis").alias("reply"))
    r = F.col("reply")
    spoilt = (F.when(F.col("data_id") % 11 == 1, F.lit(None).cast("string")).when(F.col("data_id") % 11 == 2, F.substring(r, 1, 40))
              .when(F.col("data_id") % 11 == 3, F.lit("[1, 2]"))
              .when(F.col("data_id") % 11 == 4, F.regexp_replace(r, '"summary"', '"other"'))
              .when(F.col("data_id") % 11 == 5, F.regexp_replace(r, '"average_score":[0-9.]+', '"average_score":7.5'))
              .when(F.col("data_id") % 11 == 6, F.regexp_replace(r, '"positive_percentage":[0-9.]+', '"positive_percentage":250.0')).otherwise(r))
    responses = good.select("data_id", F.lit(0).cast("long").alias("batch_id"), spoilt.alias("response"),
                            F.when(F.col("data_id") % 11 == 7, "TimeoutError: no answer").alias("error"))
    return validate_responses(responses).select("data_id", "batch_id", "valid", "reason")


def _instant_results(spark, d):
    from guestlens.plans.instant import instant_analysis
    h = _header(spark, d).select("data_id", "type", "title", "rating", "address",
                                 F.lit("Success").alias("status"), "total_reviews",
                                 F.lit("").alias("created_at"))
    from guestlens.sources.scratch import materialize
    return instant_analysis(_reviews(spark, d), h, st.TEST_LEXICON, st.TEST_POLARITY, reuse=materialize)


@query("report_export")
def report_export(spark, d):
    """Instant results exported as JSON and read back; scalar checks."""
    from guestlens.operators.report import export_reports
    from guestlens.session import work_path
    res = _instant_results(spark, d)
    path = export_reports(res, work_path(spark, "reports"))
    back = spark.read.schema(res.schema).json(path)
    a = F.col("hotel_analysis")
    return back.select(
        "data_id", "title", F.size("reviews").cast("long").alias("n_reviews"),
        F.element_at("reviews", 1)["date"].alias("newest_date"),
        F.element_at("reviews", -1)["date"].alias("oldest_date"),
        *[a["overall_sentiment"][c].alias(c) for c in sen.SCORE_COLUMNS],
        F.size(a["top_improvement_priorities"]).cast("long").alias("n_priorities"))


@query("report_flatten")
def report_flatten(spark, d):
    """Instant results as ordered display rows."""
    from guestlens.operators.report import flatten_report
    return flatten_report(_instant_results(spark, d))


# --- streaming ---------------------------------------------------------------------

@query("stream_page_ingest")
def stream_page_ingest(spark, d):
    """Landed pages streamed (availableNow) into the review table, then read
    back with fetch positions; equals batch P1."""
    from guestlens.session import work_path
    from guestlens.sources import pages as pg
    from guestlens.streaming.ingest import read_ingested, start_page_ingest
    base = work_path(spark, "stream-ingest")
    landing = pg.land_pages(pg.build_pages(st.reviews(spark, d), st.places(spark, d)), f"{base}/landing")
    q = start_page_ingest(spark, landing, f"{base}/sink", f"{base}/checkpoint", max_files_per_trigger=4)
    q.awaitTermination()
    return read_ingested(spark, f"{base}/sink").select(
        "data_id", "fetch_pos", "page_no", "user", "rating", "date", "review_text", "iso_date")


INCREMENTAL_CUTOFF = "2024-01-21 00:00:00"


@query("incremental_integration")
def incremental_integration(spark, d):
    """State of reviews before the cutoff (epoch 0), reviews from the
    cutoff on streamed in as page files and added per epoch; equals A1 over
    all reviews."""
    from guestlens.session import work_path
    from guestlens.sources import pages as pg
    from guestlens.streaming.incremental import IncrementalSentiment
    base = work_path(spark, "incremental")
    r = st.reviews(spark, d)
    cut = F.col("ts") < F.to_timestamp_ntz(F.lit(INCREMENTAL_CUTOFF))
    inc = IncrementalSentiment(spark, f"{base}/state")
    old = _unordered(spark, d).filter(cut)
    inc.apply(old, 0)
    landing = pg.land_pages(pg.build_pages(r.filter(~cut), st.places(spark, d)), f"{base}/landing")
    inc.start(landing, f"{base}/checkpoint").awaitTermination()
    return inc.scores()


@query("full_analysis")
def full_analysis(spark, d):
    """Reference flow (b) end to end: cap 150, batches of 15, combine tree,
    recency-weighted scores; scalar view of each place's result."""
    from guestlens.plans.full import full_analysis as fa
    from guestlens.sources.scratch import materialize
    h = _header(spark, d).select("data_id", "type", "title", "rating", "address",
                                 F.lit("Success").alias("status"), "total_reviews", F.lit("").alias("created_at"))
    res, tree = fa(_reviews(spark, d), h, st.TEST_LEXICON, st.TEST_POLARITY, reuse=materialize)
    levels = tree.groupBy("data_id").agg(F.max("level").cast("long").alias("n_levels"))
    a = F.col("hotel_analysis")
    return res.join(levels, "data_id", "left").select(
        "data_id", F.size("reviews").cast("long").alias("n_reviews"), "n_batches",
        F.coalesce("n_levels", F.lit(0).cast("long")).alias("n_levels"),
        *[a["overall_sentiment"][c].alias(c) for c in sen.SCORE_COLUMNS],
        F.size(a["top_improvement_priorities"]).cast("long").alias("n_priorities"),
        F.get(a["top_improvement_priorities"], F.lit(0))["issue"].alias("top_issue"), "trend", "n_persistent", a["summary"].alias("summary"))


@query("incremental_priorities")
def incremental_priorities(spark, d):
    """T2, priorities: criticism of the reviews before the cutoff, then the later ones
    added (and offered once more, which changes nothing); equals A8 over all reviews."""
    from guestlens.session import work_path
    from guestlens.streaming.incremental import IncrementalPriorities
    r, cut = _unordered(spark, d), F.col("ts") < F.to_timestamp_ntz(F.lit(INCREMENTAL_CUTOFF))
    inc = IncrementalPriorities(spark, work_path(spark, "priorities"), st.TEST_LEXICON, st.TEST_POLARITY)
    inc.apply(r.filter(cut), tag="history")
    for _ in range(2):
        inc.apply(r.filter(~cut), tag="new#0")
    return inc.priorities()


@query("incremental_changes")
def incremental_changes(spark, d):
    """T2, significant changes: places whose score moved by 0.3 or more with the reviews
    after the cutoff."""
    from guestlens.session import work_path
    from guestlens.streaming.incremental import IncrementalSentiment
    r, cut = _unordered(spark, d), F.col("ts") < F.to_timestamp_ntz(F.lit(INCREMENTAL_CUTOFF))
    inc = IncrementalSentiment(spark, work_path(spark, "changes"))
    inc.apply(r.filter(cut), tag="history")
    inc.apply(r.filter(~cut), tag="new#0")
    return inc.changes()


@query("aspect_period_trend")
def aspect_period_trend(spark, d):
    """W4 per aspect: net praising minus criticising reviews per batch of 5
    against the previous batch."""
    from guestlens.operators.combine import aspect_trend
    from guestlens.sources.scratch import materialize
    return aspect_trend(_mentions_batched(spark, d, 5), reuse=materialize)


@query("incremental_recency")
def incremental_recency(spark, d):
    """Recency-weighted scores of reviews that arrive in three epochs out of order
    (newer ones, older ones, then late ones of all days; the second is offered twice);
    equals A4 over all reviews."""
    from guestlens.session import work_path
    from guestlens.streaming.recency import IncrementalRecency
    r, cut, late = _reviews(spark, d), F.col("ts") < F.to_timestamp_ntz(F.lit(INCREMENTAL_CUTOFF)), F.col("review_id") % 4 == 0
    inc = IncrementalRecency(spark, work_path(spark, "recency"))
    for tag, part in (("new#0", ~cut & ~late), ("old#0", cut & ~late), ("old#0", cut & ~late), ("late#0", late)):
        inc.apply(r.filter(part), tag=tag)
    return inc.scores()


@query("issue_history")
def issue_history(spark, d):
    """When each criticised theme was an issue (batches of 5): opened, resolved, reopened;
    two silent batches in a row resolve it."""
    from guestlens.operators.themes import issue_history as ih
    from guestlens.sources.scratch import materialize
    return ih(_mentions_batched(spark, d, 5), quiet=2, reuse=materialize)


@query("theme_trend")
def theme_trend(spark, d):
    """Whether a theme's share of reviews rises or falls over the batches of 5 (Mann-Kendall)."""
    from guestlens.operators.themes import theme_trend as tt
    from guestlens.sources.scratch import materialize
    b = materialize(sel.chronological_batches(_reviews(spark, d), 5), "batches")
    sizes = b.groupBy("data_id", "batch_id").agg(F.count(F.lit(1)).cast("long").alias("n"))
    nb = b.groupBy("data_id").agg((F.max("batch_id") + 1).cast("long").alias("n_place_batches"))
    return tt(_mentions(spark, d, reviews=b, extra=["batch_id"]).join(nb, "data_id"), sizes, 5, reuse=materialize)


@query("document_collocations")
def document_collocations(spark, d):
    """A6, mined: all collocations of the documents."""
    from guestlens.operators.collocations import collocations
    return collocations(st.prose_reviews(spark, d))


@query("mined_themes")
def mined_themes(spark, d):
    """A6, mined: per place the word pairs of its reviews that no list names."""
    from guestlens.operators.collocations import mined_themes as mt
    return mt(_unordered(spark, d), known=[t for t, _ in st.TEST_LEXICON])


@query("mined_prose_themes")
def mined_prose_themes(spark, d):
    """A6, mined: the same over long prose, every document as a review of its source."""
    from guestlens.operators.collocations import mined_themes as mt
    return mt(st.prose_reviews(spark, d), known=[t for t, _ in st.PROSE_LEXICON])


@query("phrase_feedback")
def phrase_feedback(spark, d):
    """A5 with a large vocabulary of phrases (runs of benchmark words), over long prose."""
    from guestlens.operators import phrases as ph
    from guestlens.sources.scratch import materialize
    vocab = materialize(ph.vocabulary(st.prose_phrases(spark, d)), "vocabulary")
    return ph.phrase_feedback(ph.phrase_matches(st.prose_reviews(spark, d), vocab))


def _bucket_store(spark, d):
    """The write log applied to a bucketed store in two upserts, the later writes first."""
    from guestlens.session import work_path
    from guestlens.sources.bucket_store import BucketStore
    store = BucketStore(spark, work_path(spark, "bucket-store"))
    w, cut = st.store_writes(spark, d), F.col("written_at") < F.to_timestamp_ntz(F.lit(INCREMENTAL_CUTOFF))
    store.upsert(w.filter(~cut))
    store.upsert(w.filter(cut))
    return store


@query("bucket_store_upsert")
def bucket_store_upsert(spark, d):
    """S2 by key buckets: last write per (data_id, type) after two upserts."""
    return _bucket_store(spark, d).rows().select("data_id", "type", "analysis", _ts_text("written_at").alias("written_at"), "seq")


@query("bucket_store_lookup")
def bucket_store_lookup(spark, d):
    """S3 by key buckets: stored reports per request."""
    return _bucket_store(spark, d).lookup(_lookup_requests(spark, d)).withColumn("written_at", _ts_text("written_at"))


@query("stream_pages_landed_twice")
def stream_pages_landed_twice(spark, d):
    """T1, pages fetched anew: all pages land in two folders, each streamed by a checkpoint of its own into
    one sink, the first folder holding everything twice; equals batch P1."""
    from guestlens.session import work_path
    from guestlens.sources import pages as pg
    from guestlens.streaming.ingest import read_ingested, start_page_ingest
    from guestlens.sources.scratch import materialize
    base = work_path(spark, "stream-twice")
    pages = materialize(pg.build_pages(st.reviews(spark, d, reuse=materialize), st.places(spark, d)), "pages")
    once = pg.land_pages(pages, f"{base}/landing-b")
    again = pg.land_pages(pages.unionByName(pages), f"{base}/landing-a")
    for name, landing in (("a", again), ("b", once)):
        start_page_ingest(spark, landing, f"{base}/sink", f"{base}/checkpoint-{name}", max_files_per_trigger=4, once_within="7 days").awaitTermination()
    return read_ingested(spark, f"{base}/sink").select(
        "data_id", "fetch_pos", "page_no", "user", "rating", "date", "review_text", "iso_date")


@query("page_order")
def page_order(spark, d):
    """Page numbers from the landed pages' next tokens, with planted lost pages and cycles."""
    from guestlens.operators.page_order import page_links, page_order as po
    from guestlens.session import work_path
    from guestlens.sources import pages as pg
    path = pg.land_pages(st.tokened_pages(pg.build_pages(st.reviews(spark, d), st.places(spark, d))), work_path(spark, "tokened-pages"))
    return po(page_links(pg.scan_pages(spark, path, "page_token string")))


@query("page_chains")
def page_chains(spark, d):
    """Per place the pages in order, the unreached ones and how its chain ends."""
    from guestlens.operators.page_order import chain_report
    return chain_report(QUERIES["page_order"](spark, d))


def _cut_pages(spark, d):
    from guestlens.session import work_path
    from guestlens.sources import pages as pg
    from guestlens.sources.scratch import materialize
    pages = st.cut_links(pg.build_pages(st.reviews(spark, d), st.places(spark, d)))
    return materialize(pg.scan_pages(spark, pg.land_pages(pages, work_path(spark, "cut-pages"))), "pages")


@query("full_selection_landed")
def full_selection_landed(spark, d):
    """W2 on landed pages: the reviews that a full analysis (cap 60) takes where some pages in the
    middle have no next."""
    from guestlens.operators.ingest import normalize_reviews
    from guestlens.plans.full import full_selection
    pages = _cut_pages(spark, d)
    return full_selection(normalize_reviews(pages), 60, sel.landed_page_counts(pages)).select("data_id", "page_no", "fetch_pos", "user", "rating")


@query("full_analysis_landed")
def full_analysis_landed(spark, d):
    """Reference flow (b) on landed pages with their own next links (cap 60): reviews, batches and scores per place."""
    from guestlens.operators.ingest import normalize_reviews
    from guestlens.plans.full import full_analysis as fa
    from guestlens.sources.scratch import materialize
    pages = _cut_pages(spark, d)
    h = _header(spark, d).select("data_id", "type", "title", "rating", "address", F.lit("Success").alias("status"), "total_reviews", F.lit("").alias("created_at"))
    res, _ = fa(normalize_reviews(pages), h, st.TEST_LEXICON, st.TEST_POLARITY, max_reviews=60, reuse=materialize, pages=sel.landed_page_counts(pages))
    return res.select("data_id", F.size("reviews").cast("long").alias("n_reviews"), "n_batches",
                      *[F.col("hotel_analysis.overall_sentiment")[c].alias(c) for c in sen.SCORE_COLUMNS])


@query("representative_sentences")
def representative_sentences(spark, d):
    """A5 / A10: three sentences per place, aspect and polarity that stand for the others."""
    from guestlens.operators.sentences import representative_sentences as rs
    return rs(_unordered(spark, d), st.TEST_LEXICON, st.TEST_POLARITY)


def _status_sessions(spark, d):
    """The status events landed as files and streamed through self-closing sessions."""
    from guestlens.session import work_path
    from guestlens.streaming.expiry import StatusSessions
    base = work_path(spark, "status-sessions")
    st.status_events(spark, d).write.option("timestampNTZFormat", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").json(f"{base}/landing")
    sessions = StatusSessions(spark, f"{base}/closed")
    sessions.start(f"{base}/landing", f"{base}/checkpoint").awaitTermination()
    return sessions


@query("status_sessions_expired")
def status_sessions_expired(spark, d):
    """T4 by state: sessions of status events (gaps of 24 h) that the newest event time has closed."""
    return _status_sessions(spark, d).expired().select(
        "token", _ts_text("started_at").alias("started_at"), _ts_text("last_at").alias("last_at"), "n_events", "status", "error")


@query("status_expire_stream")
def status_expire_stream(spark, d):
    """T4 by state: the tokens that no closed session has dropped; equals T4 in batch."""
    out = _status_sessions(spark, d).live(st.status_events(spark, d))
    return out.select("token", "status", _ts_text("created_at").alias("created_at"))
