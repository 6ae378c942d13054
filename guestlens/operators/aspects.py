"""A5-A10: aspect-level praise and criticism, themes, priorities, summary.

A *mention* is a lexicon term inside a clause of a review (sentences split
further at commas, semicolons and "but").  Its polarity is the sign of the
summed polarity words of that clause (+ praise, - criticism, 0 neutral) and
its phrase is the clause's polarity words (sorted) followed by the term.

All mentions of a review are found in its own row (vocabularies are map literals:
no join), so equal ones are merged there and flagged as the review's first of their
aspect and of their term: no shuffle is needed to count reviews.  One aggregate per
place and phrase (``mention_counts``) is all that A5, A6, A8, A9 and A10 read.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from guestlens.functions.text import words

# The seven report sections, in report order, with the category
# names used for improvement priorities.
ASPECTS = [
    ("accommodation", "Accommodation"),
    ("service", "Service"),
    ("amenities", "Amenities"),
    ("food_and_dining", "Food and Dining"),
    ("location_and_accessibility", "Location"),
    ("value_for_money", "Value for Money"),
    ("online_presence", "Online Presence"),
]

# Our playbook: what to suggest for a criticised issue of each aspect and the
# impact to expect (%s is the issue phrase).
PLAYBOOK = {
    "accommodation": ("Inspect and fix rooms where guests report '%s'; add it to the housekeeping checklist.",
                      "Better room scores and fewer complaints at check-out."),
    "service": ("Retrain front-line staff on '%s' and track it in shift handovers.",
                "Warmer service ratings and more repeat stays."),
    "amenities": ("Repair or upgrade the facilities guests describe as '%s'.",
                  "Higher amenity satisfaction and fewer refund requests."),
    "food_and_dining": ("Review the menu and kitchen routine behind '%s' comments.",
                        "Better dining feedback and more on-site spend."),
    "location_and_accessibility": ("Publish clearer directions and transport options addressing '%s'.",
                                   "Fewer arrival complaints and smoother stays."),
    "value_for_money": ("Revisit pricing or bundle extras where guests mention '%s'.",
                        "Higher value-for-money scores and conversion."),
    "online_presence": ("Correct the online listing and reply to reviews about '%s'.",
                        "Better booking conversion and public reputation."),
}

# Mentions are taken per clause: sentences, then commas, semicolons and "but".
CLAUSE_SPLIT = r"[.!?;,\n]+|\s+but\s+"
# Fixed values (ours): a polarity word right after one of these flips its sign.
NEGATORS = ["not", "no", "never", "hardly", "isn't", "wasn't", "aren't", "weren't", "don't", "didn't"]


def _polarity_label() -> Column:
    return F.when(F.col("pol") > 0, "praise").when(F.col("pol") < 0, "criticism").otherwise("neutral")


def _map(pairs: Sequence[tuple]) -> Column:
    flat = []
    for k, v in pairs:
        flat += [F.lit(k), F.lit(v)]
    return F.create_map(*flat)


def aspect_order() -> Column:
    m = _map([(a, i) for i, (a, _) in enumerate(ASPECTS)])
    return F.try_element_at(m, F.col("aspect"))


def category_name() -> Column:
    return F.try_element_at(_map(ASPECTS), F.col("aspect"))


def mentions(reviews: DataFrame, lexicon: Sequence[tuple[str, str]],
             polarity: Sequence[tuple[str, int]], extra: Sequence[str] = ()) -> DataFrame:
    """One row per (review, lexicon term, polarity, phrase):
    data_id, review_id, rating, ts (+ the ``extra`` review columns, e.g. batch_id),
    term, aspect, pol, polarity, phrase, n (clauses of the review that say it),
    first_aspect / first_term (1 on the review's first row of the aspect / term and
    polarity, else 0, so that sums count reviews).

    Terms come from ``array_intersect`` with the lexicon per clause; a polarity word right
    after a negator counts negatively and shows as "not <word>"."""
    lex, pol = _map(lexicon), _map([(t, int(p)) for t, p in polarity])
    lex_terms = F.array(*[F.lit(t) for t, _ in lexicon])
    pol_terms = F.array(*[F.lit(t) for t, _ in polarity])
    negators = F.array(*[F.lit(x) for x in NEGATORS])
    keep = ["data_id", "review_id", "rating", "ts", *extra]

    def sign_of(w):
        return F.coalesce(F.try_element_at(pol, w), F.lit(0))

    def clause(w):
        """Terms, polarity and polarity words of a clause's words."""
        prev = F.concat(F.array(F.lit("")), F.slice(w, 1, F.greatest(F.size(w) - 1, F.lit(0))))
        after_no = lambda p: F.array_contains(negators, p)
        # Only clauses that contain a negator take the slower path.
        has_no = F.arrays_overlap(w, negators)
        plain = F.aggregate(w, F.lit(0), lambda a, x: a + sign_of(x))
        negated = F.aggregate(F.zip_with(w, prev, lambda x, p: sign_of(x) * F.when(after_no(p), -1).otherwise(1)), F.lit(0), lambda a, b: a + b)
        words_said = F.array_distinct(F.filter(F.zip_with(w, prev, lambda x, p: F.when(
            F.array_contains(pol_terms, x), F.concat(F.when(after_no(p), F.lit("not ")).otherwise(F.lit("")), x))), lambda x: x.isNotNull()))
        mods = F.array_sort(F.when(has_no, words_said).otherwise(F.array_intersect(w, pol_terms)))
        return F.struct(F.array_intersect(w, lex_terms).alias("terms"), F.signum(F.when(has_no, negated).otherwise(plain)).cast("int").alias("pol"),
                        F.array_join(mods, " ").alias("mods"))

    # No filter stands between these steps: the planner would move it below them and work out all of
    # them once more for it.  The explosion drops reviews without mentions.
    said = F.split(F.lower(F.coalesce(F.col("review_text"), F.lit(""))), CLAUSE_SPLIT)
    s = reviews.select(*keep, F.filter(F.transform(said, words), lambda w: F.arrays_overlap(w, lex_terms)).alias("_clauses"))
    s = s.select(*keep, F.transform("_clauses", clause).alias("_clauses"))
    s = s.select(*keep, F.sort_array(F.flatten(F.transform("_clauses", lambda c: F.transform(c["terms"], lambda t: F.struct(
        F.try_element_at(lex, t).alias("aspect"), c["pol"].alias("pol"), t.alias("term"),
        F.trim(F.concat_ws(" ", c["mods"], t)).alias("phrase")))))).alias("_all"))
    # Sorted, equal mentions and those of one aspect or term stand together: each step looks one back.
    one_back = lambda i: F.get("_all", i - 1)
    s = s.select(*keep, "_all", F.when(F.size("_all") > 0, F.filter(
        F.sequence(F.lit(0), F.size("_all") - 1), lambda i: ~F.get("_all", i).eqNullSafe(one_back(i)))).alias("_at"))

    def merged(i, j):
        m = F.get("_all", i)
        new = lambda *names: (~reduce(Column.__and__, [m[n].eqNullSafe(one_back(i)[n]) for n in names])).cast("long")
        return F.struct(m.alias("m"), (F.coalesce(F.get("_at", j + 1), F.size("_all")) - i).cast("long").alias("n"),
                        new("aspect", "pol").alias("first_aspect"), new("aspect", "pol", "term").alias("first_term"))

    m = s.select(*keep, F.explode(F.transform("_at", merged)).alias("_m"))
    return m.select(*keep, "_m.m.term", "_m.m.aspect", "_m.m.pol", "_m.n", "_m.first_aspect", "_m.first_term", F.col("_m.m.phrase").alias("phrase")).select(
        *keep, "term", "aspect", "pol", _polarity_label().alias("polarity"), "phrase", "n", "first_aspect", "first_term")


PRIORITIES = 5              # fixed value: improvement priorities of a report
VERDICTS = ["food_and_dining", "value_for_money"]    # aspects with a verdict of their own
COUNTS = ["support", "n_mentions", "by_aspect", "by_term", "short_aspect", "short_term"]
PHRASE = ["aspect", "pol", "polarity", "term", "phrase"]


def mention_counts(m: DataFrame, keys: Sequence[str] = ("data_id",)) -> DataFrame:
    """Per (place, aspect, polarity, term, phrase): support (reviews), n_mentions, and the
    additive shares of reviews and rating shortfall by aspect and by term, so that counts
    of batches (``keys`` with batch_id) sum to those of their union.  A table that has
    these counts already is returned as it is."""
    if "support" in m.columns:
        return m
    short = F.when(F.col("rating") > 0, 5 - F.col("rating")).otherwise(0)
    return m.groupBy(*keys, *PHRASE).agg(
        F.count(F.lit(1)).cast("long").alias("support"), F.sum("n").alias("n_mentions"),
        F.sum("first_aspect").alias("by_aspect"), F.sum("first_term").alias("by_term"),
        F.sum(short * F.col("first_aspect")).cast("double").alias("short_aspect"),
        F.sum(short * F.col("first_term")).cast("double").alias("short_term"))


def _phrases(k: int | None) -> Column:
    """The group's phrases, best supported first (ties: phrase); ``k`` is a display choice."""
    ranked = F.transform(F.array_sort(F.collect_list(F.struct((-F.col("support")).alias("s"), F.col("phrase")))), lambda x: x["phrase"])
    return ranked if k is None else F.slice(ranked, 1, k)


def top_phrases(m: DataFrame, k: int | None = None) -> DataFrame:
    """Per (place, aspect, polarity): all phrases, best supported first, as an array."""
    return mention_counts(m).groupBy("data_id", "aspect", "polarity").agg(_phrases(k).alias("phrases"))


def aspect_feedback(m: DataFrame, k: int | None = None) -> DataFrame:
    """A5: per (place, aspect, polarity): supporting reviews, mentions and the
    phrases, best supported first, joined by '; '."""
    return (mention_counts(m).groupBy("data_id", "aspect", "polarity")
            .agg(F.sum("by_aspect").alias("n_reviews"), F.sum("n_mentions").alias("n_mentions"),
                 F.array_join(_phrases(k), "; ").alias("top_phrases")))


def recurring_themes(m: DataFrame, min_support: int = 2) -> DataFrame:
    """(aspect, term, polarity) themes supported by >= min_support reviews."""
    return (mention_counts(m).groupBy("data_id", "aspect", "term", "polarity")
            .agg(F.sum("by_term").alias("n_reviews"))
            .filter(F.col("n_reviews") >= min_support))


def persistent_themes(m_batched: DataFrame, min_batches: int = 2, min_share: float = 0.5) -> DataFrame:
    """Themes seen across batches (time periods).  ``m_batched`` is the
    mention table with ``batch_id`` and ``n_place_batches``.  A theme is persistent when it
    appears in >= min_batches batches and in >= min_share of the place's batches; recent
    when it appears in the place's latest batch."""
    t = (m_batched.groupBy("data_id", "aspect", "term", "polarity", "batch_id").agg(F.max("n_place_batches").alias("nb"))
         .groupBy("data_id", "aspect", "term", "polarity")
         .agg(F.count(F.lit(1)).cast("long").alias("n_batches"), F.min("batch_id").alias("first_batch"),
              F.max("batch_id").alias("last_batch"), F.max("nb").alias("n_place_batches")))
    return t.select(
        "data_id", "aspect", "term", "polarity", "n_batches", "first_batch", "last_batch",
        F.round(F.col("n_batches").cast("double") / F.col("n_place_batches"), 3).alias("share"),
        ((F.col("n_batches") >= min_batches)
         & (F.col("n_batches").cast("double") >= F.lit(min_share) * F.col("n_place_batches"))).alias("persistent"),
        (F.col("last_batch") == F.col("n_place_batches") - 1).alias("recent"))


def playbook_columns(issue: Column) -> tuple[Column, Column]:
    sug = _map([(a, s) for a, (s, _) in PLAYBOOK.items()])
    imp = _map([(a, i) for a, (_, i) in PLAYBOOK.items()])
    return (F.replace(F.try_element_at(sug, F.col("aspect")), F.lit("%s"), issue),
            F.try_element_at(imp, F.col("aspect")))


def criticised_terms(m: DataFrame) -> DataFrame:
    """(place, aspect, term): reviews criticising it and their rating shortfall."""
    return (mention_counts(m).filter(F.col("pol") < 0).groupBy("data_id", "aspect", "term")
            .agg(F.sum("by_term").alias("n_reviews"), F.sum("short_term").alias("shortfall")))


def aspect_suggestions(m: DataFrame, k: int | None = None) -> DataFrame:
    """Per place and aspect its criticised terms, most criticised first, with a suggestion."""
    w = Window.partitionBy("data_id", "aspect").orderBy(F.desc("n_reviews"), "term")
    top = criticised_terms(m).withColumn("rank", F.row_number().over(w).cast("long"))
    if k is not None:
        top = top.filter(F.col("rank") <= k)
    sug, _ = playbook_columns(F.col("term"))
    return top.select("data_id", "aspect", "rank", "term", "n_reviews", sug.alias("suggestion"))


def improvement_priorities(m: DataFrame, k: int = PRIORITIES) -> DataFrame:
    """Top-k aspects per place by score = sum over criticising reviews of
    (5 - rating), i.e. frequency x mean shortfall; ties in report order.  The
    issue is the aspect's most-supported criticised phrase."""
    per = (mention_counts(m).filter(F.col("pol") < 0).groupBy("data_id", "aspect")
           .agg(F.sum("by_aspect").alias("n_reviews"), F.sum("short_aspect").alias("score"),
                F.min_by("phrase", F.struct(-F.col("support"), F.col("phrase"))).alias("issue")))
    w = Window.partitionBy("data_id").orderBy(F.desc("score"), aspect_order())
    top = per.withColumn("priority", F.row_number().over(w).cast("long")).filter(F.col("priority") <= k)
    sug, imp = playbook_columns(F.col("issue"))
    return top.select("data_id", "priority", category_name().alias("category"), "issue",
                      sug.alias("suggestion"), imp.alias("potential_impact"), "score", "n_reviews")


def _verdict(p: Column, c: Column, none_text: str, pos: str, neg: str, mixed: str) -> Column:
    p, c = F.coalesce(p, F.lit(0)), F.coalesce(c, F.lit(0))
    detail = F.concat(F.lit(" ("), p.cast("string"), F.lit(" praising / "), c.cast("string"),
                      F.lit(" criticising reviews)"))
    return (F.when((p + c) == 0, F.lit(none_text))
            .when(p > c, F.concat(F.lit(pos), detail))
            .when(p < c, F.concat(F.lit(neg), detail))
            .otherwise(F.concat(F.lit(mixed), detail)))


def breakfast_reviews(reviews: DataFrame, keys: Sequence[str] = ("data_id",)) -> DataFrame:
    """Reviews that name breakfast."""
    return (reviews.select(*keys, words(F.lower("review_text")).alias("_w"))
            .filter(F.array_contains("_w", "breakfast")).groupBy(*keys)
            .agg(F.count(F.lit(1)).cast("long").alias("_breakfast")))


def feedback_counts(m: DataFrame) -> DataFrame:
    """Per place the most praised and most criticised aspect, and the praising and criticising reviews of ``VERDICTS``."""
    fb = (mention_counts(m).groupBy("data_id", "aspect", "polarity").agg(F.sum("by_aspect").alias("n_reviews"))
          .withColumn("_o", aspect_order()))
    return fb.groupBy("data_id").agg(
        F.min_by(F.col("aspect"), F.when(F.col("polarity") == "praise",
                                          F.struct(-F.col("n_reviews"), F.col("_o")))).alias("_best"),
        F.min_by(F.col("aspect"), F.when(F.col("polarity") == "criticism",
                                          F.struct(-F.col("n_reviews"), F.col("_o")))).alias("_worst"),
        *[F.sum(F.when((F.col("aspect") == a) & (F.col("polarity") == p), F.col("n_reviews")))
          .alias(f"_{a}_{p}") for a in VERDICTS
          for p in ("praise", "criticism")])


def analysis_summary(places: DataFrame, sentiment: DataFrame, m: DataFrame,
                     reviews: DataFrame, key: str = "data_id") -> DataFrame:
    """A10: per place the summary and verdict strings.

    ``places`` (key, title), ``sentiment`` (A1), ``m`` (mentions, their counts or a table with the places'
    ``feedback_counts``, whose other columns are kept), ``reviews`` (or their ``breakfast_reviews``)."""
    per = m if "_best" in m.columns else feedback_counts(m)
    used = ["data_id", "_best", "_worst", *[f"_{a}_{p}" for a in VERDICTS for p in ("praise", "criticism")]]
    bf = reviews if "_breakfast" in reviews.columns else breakfast_reviews(reviews)
    names = _map(ASPECTS)
    s = (sentiment.join(per, "data_id", "left").join(bf, "data_id", "left")
         .join(places.select(F.col(key).alias("data_id"), F.col("title").alias("hotel_name")),
               "data_id", "left"))
    best = F.coalesce(F.try_element_at(names, F.col("_best")), F.lit("none"))
    worst = F.coalesce(F.try_element_at(names, F.col("_worst")), F.lit("none"))
    summary = F.concat(
        F.coalesce(F.col("hotel_name"), F.lit("This place")), F.lit(": "),
        F.col("n_reviews").cast("string"), F.lit(" reviews, average score "),
        F.coalesce(F.col("average_score").cast("string"), F.lit("n/a")), F.lit("/5 ("),
        F.coalesce(F.col("positive_percentage").cast("string"), F.lit("n/a")), F.lit("% positive, "),
        F.coalesce(F.col("negative_percentage").cast("string"), F.lit("n/a")),
        F.lit("% negative). Most praised: "), best, F.lit(". Most criticised: "), worst, F.lit("."))
    return s.select(
        "data_id", F.coalesce("hotel_name", F.lit("")).alias("hotel_name"), summary.alias("summary"),
        _verdict(F.col("_food_and_dining_praise"), F.col("_food_and_dining_criticism"),
                 "No dining feedback", "Mostly positive", "Mostly negative", "Mixed").alias("restaurant_quality"),
        F.when(F.coalesce(F.col("_breakfast"), F.lit(0)) == 0, F.lit("No breakfast feedback"))
         .otherwise(F.concat(F.lit("Breakfast mentioned in "), F.col("_breakfast").cast("string"),
                             F.lit(" reviews"))).alias("breakfast_feedback"),
        _verdict(F.col("_value_for_money_praise"), F.col("_value_for_money_criticism"),
                 "No value feedback", "Good value", "Poor value", "Mixed value").alias("perceived_value"),
        "average_score", "positive_percentage", "neutral_percentage", "negative_percentage", *[c for c in per.columns if c not in used])
