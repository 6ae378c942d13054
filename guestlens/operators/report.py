"""A10 assembly, S4 export and R1 flatten of the per-place report.

``assemble_analysis`` builds the nested HOTEL_ANALYSIS struct per place from
the aspect tables; a place's lists hold its distinct phrases (bounded by the
vocabulary), at most 5 priorities.  ``flatten_report`` turns a nested result
into ordered display rows (data_id, section_no, section, field, ordinal, text, shown).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from guestlens.functions.text import star_bar
from guestlens.operators import aspects as asp
from guestlens.operators import sentiment as sen
from guestlens.sources.scratch import identity

EMPTY = "array<string>"
PRIORITY = ["category", "issue", "suggestion", "potential_impact"]


def _arr(c: str) -> Column:
    return F.coalesce(F.col(c), F.array().cast(EMPTY))


def assemble_analysis(reviews: DataFrame, header: DataFrame, lexicon: Sequence[tuple],
                      polarity: Sequence[tuple], k: int | None = None, key: str = "data_id",
                      reuse=identity) -> DataFrame:
    """Per place: data_id + ``hotel_analysis`` struct in the report schema.
    ``reuse`` may materialise the phrase counts, which all lists are made from;
    ``k`` limits the lists for display (default: whole lists)."""
    c = reuse(asp.mention_counts(asp.mentions(reviews, lexicon, polarity)), "mention-counts")
    return assemble_counts(c, sen.overall_sentiment(reviews), header, reviews, k, key)


def place_lists(m: DataFrame, k: int | None = None) -> DataFrame:
    """One row per place with all that its report needs of the phrase counts ``m``, from one aggregate: per aspect the
    phrases of each polarity and the suggestions (``<aspect>__<list>``), the priorities by ``m``, the
    most praised and most criticised aspect and the counts that ``asp.analysis_summary`` reads.

    The same results as ``asp.top_phrases``, ``asp.aspect_suggestions`` and ``asp.improvement_priorities``, without their shuffles and
    sorts: a place's phrases stand in one row, as they do in its report."""
    said = F.sort_array(F.collect_list(F.struct((-F.col("support")).alias("s"), "phrase", asp.aspect_order().alias("a"), F.col("pol"), "term",
                                                F.col("by_aspect").alias("n"), F.col("by_term").alias("t"), F.col("short_aspect").alias("short"))))
    # A partial aggregate would collect rows that are apart still, so they are brought together first.
    c = asp.mention_counts(m).repartition("data_id").groupBy("data_id").agg(said.alias("_said"))
    kinds = {"praise": 1, "criticism": -1, "neutral": 0}
    # Each step works out columns that the next one reads several times.
    of = lambda i, pol: F.filter("_said", lambda x: (x["a"] == i) & (x["pol"] == pol))
    c = c.select("data_id", *[of(i, pol).alias(f"{a}_{p}") for i, (a, _) in enumerate(asp.ASPECTS) for p, pol in kinds.items()])
    shown = lambda x: x if k is None else F.slice(x, 1, k)
    total = lambda x, f: F.aggregate(x, F.lit(0).cast("long"), lambda s, y: s + y[f])

    def suggestions(a):
        bad = F.col(f"{a}_criticism")
        terms = F.sort_array(F.transform(F.array_distinct(F.transform(bad, lambda x: x["term"])), lambda t: F.struct(
            (-total(F.filter(bad, lambda x: x["term"] == t), "t")).alias("n"), t.alias("term"))))
        return F.transform(shown(terms), lambda t: F.replace(F.lit(asp.PLAYBOOK[a][0]), F.lit("%s"), t["term"]))

    def priority(i, a, name):
        bad = F.col(f"{a}_criticism")
        score = F.aggregate(bad, F.lit(0.0), lambda s, x: s + x["short"])
        issue = F.get(bad, 0)["phrase"]
        return F.when(F.size(bad) > 0, F.struct((-score).alias("s"), F.lit(i).alias("i"), F.lit(name).alias("category"), issue.alias("issue"),
                                                F.replace(F.lit(asp.PLAYBOOK[a][0]), F.lit("%s"), issue).alias("suggestion"),
                                                F.lit(asp.PLAYBOOK[a][1]).alias("potential_impact")))
    n = {(a, p): F.when(F.size(f"{a}_{p}") > 0, total(F.col(f"{a}_{p}"), "n")) for a, _ in asp.ASPECTS for p in kinds}
    most = lambda p: F.array_min(F.array_compact(F.array(*[
        F.when(n[a, p].isNotNull(), F.struct((-n[a, p]).alias("n"), F.lit(i).alias("i"), F.lit(a).alias("a"))) for i, (a, _) in enumerate(asp.ASPECTS)])))["a"]
    first = F.sort_array(F.array_compact(F.array(*[priority(i, a, name) for i, (a, name) in enumerate(asp.ASPECTS)])))
    return c.select(
        "data_id", *[F.transform(shown(F.col(f"{a}_{p}")), lambda x: x["phrase"]).alias(f"{a}__{p}") for a, _ in asp.ASPECTS for p in kinds],
        *[suggestions(a).alias(f"{a}__suggest") for a, _ in asp.ASPECTS],
        F.transform(F.slice(first, 1, asp.PRIORITIES), lambda x: F.struct(*[x[f].alias(f) for f in PRIORITY])).alias("priorities"),
        most("praise").alias("_best"), most("criticism").alias("_worst"),
        *[n[a, p].alias(f"_{a}_{p}") for a in asp.VERDICTS for p in ("praise", "criticism")])


def assemble_counts(m: DataFrame, sentiment: DataFrame, header: DataFrame, reviews: DataFrame,
                    k: int | None = None, key: str = "data_id", weighted: DataFrame | None = None) -> DataFrame:
    """The same from phrase counts and sentiment, whatever ``data_id`` identifies: a place,
    or a node of its combine tree.  ``weighted`` counts, if given, rank the priorities."""
    lists = place_lists(m, k)
    if weighted is not None:
        lists = lists.drop("priorities").join(place_lists(weighted).select("data_id", "priorities"), "data_id", "left")
    j = asp.analysis_summary(header, sentiment, lists, reviews, key=key)

    def L(a, p):
        return _arr(f"{a}__{p}")

    report = F.struct(
        F.col("hotel_name"), F.col("summary"),
        F.struct(*[F.col(c) for c in sen.SCORE_COLUMNS]).alias("overall_sentiment"),
        F.struct(L("accommodation", "neutral").alias("room_quality"),
                 L("accommodation", "praise").alias("common_praises"),
                 L("accommodation", "criticism").alias("common_criticisms"),
                 L("accommodation", "suggest").alias("suggestions")).alias("accommodation"),
        F.struct(L("service", "praise").alias("strengths"), L("service", "criticism").alias("weaknesses"),
                 L("service", "suggest").alias("suggestions")).alias("service"),
        F.struct(L("amenities", "praise").alias("praised_features"),
                 L("amenities", "criticism").alias("criticized_features"),
                 L("amenities", "suggest").alias("suggestions")).alias("amenities"),
        F.struct(F.col("restaurant_quality"), F.col("breakfast_feedback"),
                 L("food_and_dining", "praise").alias("praised_items"),
                 L("food_and_dining", "criticism").alias("criticized_items"),
                 L("food_and_dining", "suggest").alias("suggestions")).alias("food_and_dining"),
        F.struct(L("location_and_accessibility", "praise").alias("positive_aspects"),
                 L("location_and_accessibility", "criticism").alias("negative_aspects"),
                 L("location_and_accessibility", "suggest").alias("suggestions")).alias("location_and_accessibility"),
        F.struct(F.col("perceived_value"), L("value_for_money", "praise").alias("positive_factors"),
                 L("value_for_money", "criticism").alias("negative_factors"),
                 L("value_for_money", "suggest").alias("suggestions")).alias("value_for_money"),
        F.struct(F.concat(L("online_presence", "praise"), L("online_presence", "criticism")).alias("website_feedback"),
                 L("online_presence", "neutral").alias("social_media_feedback"),
                 L("online_presence", "suggest").alias("suggestions")).alias("online_presence"),
        F.coalesce(F.col("priorities"), F.array().cast(
            "array<struct<category:string,issue:string,suggestion:string,potential_impact:string>>"))
        .alias("top_improvement_priorities"))
    return j.select("data_id", report.alias("hotel_analysis"))


def export_reports(results: DataFrame, path: str) -> str:
    """One JSON object per place (the stored / returned form)."""
    results.write.mode("overwrite").json(path)
    return path


# Report layout: sections in display order with the (field, list path) pairs.  Fixed
# values: titles and fields as the report page shows them.
SECTIONS = [
    ("Accommodation", "accommodation", [("Room Quality", "room_quality"), ("Common Praises", "common_praises"),
                                        ("Common Criticisms", "common_criticisms"),
                                        ("Suggestions for Improvement", "suggestions")]),
    ("Service", "service", [("Strengths", "strengths"), ("Weaknesses", "weaknesses"),
                            ("Suggestions for Improvement", "suggestions")]),
    ("Amenities", "amenities", [("Praised Features", "praised_features"),
                                ("Criticized Features", "criticized_features"),
                                ("Suggestions for Improvement", "suggestions")]),
    ("Food and Dining", "food_and_dining", [("Praised Items", "praised_items"),
                                            ("Criticized Items", "criticized_items"),
                                            ("Suggestions for Improvement", "suggestions")]),
    ("Location and Accessibility", "location_and_accessibility", [
        ("Positive Aspects", "positive_aspects"), ("Negative Aspects", "negative_aspects"),
        ("Suggestions for Improvement", "suggestions")]),
    ("Value for Money", "value_for_money", [("Positive Factors", "positive_factors"),
                                            ("Negative Factors", "negative_factors"),
                                            ("Suggestions for Improvement", "suggestions")]),
    ("Online Presence", "online_presence", [("Website Feedback", "website_feedback"),
                                            ("Social Media Feedback", "social_media_feedback"),
                                            ("Suggestions for Improvement", "suggestions")]),
]


def _entry(section_no: int, section: str, field: str, items: Column) -> Column:
    return F.struct(F.lit(section_no).alias("section_no"), F.lit(section).alias("section"),
                    F.lit(field).alias("field"), items.alias("items"))


def flatten_report(results: DataFrame, shown: int = 10) -> DataFrame:
    """Nested result (data_id, title, rating, reviews[], hotel_analysis) ->
    rows (data_id, section_no, section, field, ordinal, text, shown) in display order.
    All reviews are rows; those after the first ``shown`` wait for "more" (shown false).
    Null lists render as empty; ratings outside 0..5 are clamped in star bars."""
    a = F.col("hotel_analysis")
    s = a["overall_sentiment"]

    def num(c):
        return F.coalesce(c.cast("string"), F.lit("n/a"))

    def optional(name, kind):
        return (F.col(name) if name in results.columns else F.lit(None)).cast(kind)

    entries = [
        _entry(0, "Header", "Title", F.array(F.coalesce(F.col("title"), F.lit("")))),
        _entry(0, "Header", "Rating", F.array(F.concat(star_bar(F.col("rating")), F.lit(" "),
                                                       num(F.col("rating"))))),
        _entry(0, "Header", "Address", F.array(F.coalesce(optional("address", "string"), F.lit("")))),
        _entry(0, "Header", "Total Reviews", F.array(F.coalesce(optional("total_reviews", "long"), F.lit(0)).cast("string"))),
        _entry(1, "Summary", "Summary", F.array(F.coalesce(a["summary"], F.lit("")))),
        _entry(2, "Overall Sentiment", "Average Score", F.array(F.concat(num(s["average_score"]), F.lit("/5")))),
        _entry(2, "Overall Sentiment", "Sentiment Distribution", F.array(
            F.concat(F.lit("Positive: "), num(s["positive_percentage"]), F.lit("%")),
            F.concat(F.lit("Neutral: "), num(s["neutral_percentage"]), F.lit("%")),
            F.concat(F.lit("Negative: "), num(s["negative_percentage"]), F.lit("%")))),
    ]
    for i, (title, sec, fields) in enumerate(SECTIONS, start=3):
        for label, f in fields:
            entries.append(_entry(i, title, label, F.coalesce(a[sec][f], F.array().cast(EMPTY))))
    entries.append(_entry(3 + len(SECTIONS), "Top Improvement Priorities", "Priorities", F.flatten(F.transform(
        F.coalesce(a["top_improvement_priorities"], F.array().cast(
            "array<struct<category:string,issue:string,suggestion:string,potential_impact:string>>")),
        lambda p, i: F.array(
            F.concat(F.lit("Priority "), (i + 1).cast("string"), F.lit(": "), F.coalesce(p["category"], F.lit(""))),
            F.concat(F.lit("Issue: "), F.coalesce(p["issue"], F.lit(""))),
            F.concat(F.lit("Suggestion: "), F.coalesce(p["suggestion"], F.lit(""))),
            F.concat(F.lit("Potential Impact: "), F.coalesce(p["potential_impact"], F.lit(""))))))))
    entries.append(_entry(4 + len(SECTIONS), "Reviews", "Reviews", F.transform(
        F.coalesce(F.col("reviews"), F.array()),
        lambda r: F.concat(F.coalesce(r["user"], F.lit("")), F.lit(" | "), star_bar(r["rating"]), F.lit(" | "),
                           F.coalesce(r["date"], F.lit("")), F.lit(" | "), F.coalesce(r["review_text"], F.lit(""))))))
    e = results.select("data_id", F.explode(F.array(*entries)).alias("e"))
    return e.select("data_id", F.col("e.section_no").cast("long").alias("section_no"), "e.section", "e.field",
                    F.posexplode("e.items").alias("ordinal", "text")).select(
        "data_id", "section_no", "section", "field", F.col("ordinal").cast("long").alias("ordinal"), "text",
        ((F.col("field") != "Reviews") | (F.col("ordinal") < shown)).alias("shown"))
