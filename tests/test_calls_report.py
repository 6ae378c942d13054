"""L1-L4, R1 on hand fixtures."""

import datetime as dt
import json
import re
from decimal import ROUND_HALF_UP, Decimal

import pandas as pd
from pyspark.sql import functions as F

from guestlens.operators.model_calls import analysis_requests, run_analyzer, validate_responses
from guestlens.operators.report import flatten_report
from guestlens.functions.text import star_bar
from guestlens.schemas import HOTEL_ANALYSIS


def good_report():
    def lists(*ks):
        return {k: ["x"] for k in ks}
    return {"hotel_name": "H", "summary": "s",
            "overall_sentiment": {"average_score": 4.3, "positive_percentage": 80.6,
                                  "neutral_percentage": 3.2, "negative_percentage": 16.1},
            "accommodation": lists("room_quality", "common_praises", "common_criticisms", "suggestions"),
            "service": {"strengths": None, "weaknesses": [], "suggestions": []},
            "amenities": lists("praised_features", "criticized_features", "suggestions"),
            "food_and_dining": {"restaurant_quality": "ok", "breakfast_feedback": "ok",
                                **lists("praised_items", "criticized_items", "suggestions")},
            "location_and_accessibility": lists("positive_aspects", "negative_aspects", "suggestions"),
            "value_for_money": {"perceived_value": "ok", **lists("positive_factors", "negative_factors",
                                                                 "suggestions")},
            "online_presence": lists("website_feedback", "social_media_feedback", "suggestions"),
            "top_improvement_priorities": [{"category": "Service", "issue": "i", "suggestion": "s",
                                            "potential_impact": "p"}]}


def test_validate_replies(spark):
    ok = good_report()
    no_summary = {k: v for k, v in ok.items() if k != "summary"}
    score7 = json.loads(json.dumps(ok))
    score7["overall_sentiment"]["average_score"] = 7
    pct90 = json.loads(json.dumps(ok))
    pct90["overall_sentiment"]["positive_percentage"] = 70.6
    rows = [(1, 0, json.dumps(ok), None), (1, 1, json.dumps(no_summary), None), (1, 2, json.dumps(score7), None),
            (1, 3, json.dumps(pct90), None), (1, 4, "this is not json", None), (1, 5, None, "Timeout: x"),
            (1, 6, "[1, 2]", None)]
    df = spark.createDataFrame(rows, "data_id long, batch_id long, response string, error string")
    v = {r.batch_id: r for r in validate_responses(df).collect()}
    assert v[0].valid and v[0].reason is None
    assert v[1].reason == "missing: summary"
    assert v[2].reason == "average_score out of range"
    assert v[3].reason == "percentages do not sum to 100"
    assert not v[4].valid and v[4].reason == "not JSON"
    assert v[5].reason == "call failed: Timeout: x"
    assert v[6].reason == "not a JSON object"


def test_analyzer_map(spark):
    def rating_analyzer():          # nested: workers cannot import this module
        """Stands for a model: reads the ratings back out of the review lines and answers with a
        schema-complete report (scores only)."""
        rating = re.compile(r"^\* ([0-9.]+) of 5 \|", re.M)
        place = re.compile(r"Place: (.*?)\. Address:")

        def r1(x):
            return float(Decimal(repr(x)).quantize(Decimal("0.1"), rounding=ROUND_HALF_UP))

        def one(system: str, user: str) -> str:
            rs = [float(v) for v in rating.findall(user or "")]
            rated = [v for v in rs if v > 0]
            n = len(rated)
            def pct(c):
                return r1(c * 100 / n) if n else None
            name = place.search(system or "")
            lists = lambda *ks: {k: [] for k in ks}
            return json.dumps({
                "hotel_name": name.group(1) if name else "",
                "summary": f"{len(rs)} reviews",
                "overall_sentiment": {
                    "average_score": r1(sum(rated) / n) if n else None,
                    "positive_percentage": pct(sum(v >= 4 for v in rated)),
                    "neutral_percentage": pct(sum(3 <= v < 4 for v in rated)),
                    "negative_percentage": pct(sum(v < 3 for v in rated))},
                "accommodation": lists("room_quality", "common_praises", "common_criticisms", "suggestions"),
                "service": lists("strengths", "weaknesses", "suggestions"),
                "amenities": lists("praised_features", "criticized_features", "suggestions"),
                "food_and_dining": {"restaurant_quality": "", "breakfast_feedback": "",
                                    **lists("praised_items", "criticized_items", "suggestions")},
                "location_and_accessibility": lists("positive_aspects", "negative_aspects", "suggestions"),
                "value_for_money": {"perceived_value": "", **lists("positive_factors", "negative_factors",
                                                                   "suggestions")},
                "online_presence": lists("website_feedback", "social_media_feedback", "suggestions"),
                "top_improvement_priorities": []})

        def fn(pdf):
            return pd.Series([one(s, u) for s, u in zip(pdf["system_prompt"], pdf["user_prompt"])])
        return fn

    day = dt.datetime(2024, 8, 3, 15, 53)
    batched = spark.createDataFrame(
        [(1, 0, i + 1, 1 + i, u, r, day, "August 03, 2024 at 03:53 PM UTC", t) for i, (u, r, t) in enumerate([("u", 5.0, "x | 1.0 of 5"), ("v", 2.0, "y")])],
        "data_id long, batch_id long, batch_pos long, date_pos long, user string, rating double, ts timestamp_ntz, date string, review_text string")
    header = spark.createDataFrame([(1, "A", "B", 4.0, 2)], "data_id long, title string, address string, rating double, total_reviews long")
    req = analysis_requests(batched, header, "2024-08-04")
    out = validate_responses(run_analyzer(req, rating_analyzer, partitions=2)).collect()[0]
    assert out.valid and out.report.overall_sentiment.average_score == 3.5
    assert out.report.hotel_name == "A"

    def broken():
        def fn(pdf):
            raise RuntimeError("model down")
        return fn
    bad = validate_responses(run_analyzer(req, broken)).collect()[0]
    assert not bad.valid and "model down" in bad.reason


def test_star_bar(spark):
    df = spark.createDataFrame([(4.3,), (4.5,), (0.0,), (6.0,), (None,), (-1.0,)], "r double")
    got = [r.s for r in df.select(star_bar("r").alias("s")).collect()]
    assert got == ["★★★★", "★★★★½", "☆☆☆☆☆", "★★★★★", "☆☆☆☆☆", "☆☆☆☆☆"]


def test_flatten_null_lists(spark):
    rep = good_report()
    res = spark.createDataFrame(
        [(1, "Hotel", 4.5, [("u", "d", 5.0, "t")], json.dumps(rep))],
        "data_id long, title string, rating double, reviews array<struct<user:string,date:string,"
        "rating:double,review_text:string>>, j string").withColumn(
        "hotel_analysis", F.from_json("j", HOTEL_ANALYSIS)).drop("j")
    rows = flatten_report(res).collect()
    by = {(r.section, r.field, r.ordinal): r.text for r in rows}
    assert by[("Header", "Rating", 0)] == "★★★★½ 4.5"
    assert ("Service", "Strengths", 0) not in by            # null list renders empty
    assert by[("Top Improvement Priorities", "Priorities", 0)] == "Priority 1: Service"
    assert by[("Reviews", "Reviews", 0)] == "u | ★★★★★ | d | t"
    assert {r.section_no for r in rows} == set(range(12)) - {4}   # service lists all empty
