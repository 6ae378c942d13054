"""A report reads its phrase counts once, whatever it lists, and lists what the operators of their own say."""

from pyspark.sql import functions as F

from guestlens.operators import aspects as asp
from guestlens.operators import sentiment as sen
from guestlens.operators.report import assemble_counts, place_lists

LEX = [("room", "accommodation"), ("bed", "accommodation"), ("staff", "service"), ("food", "food_and_dining")]
POL = [("good", 1), ("clean", 1), ("bad", -1), ("dirty", -1)]
TEXTS = [(1, "bad room, dirty bed. good staff"), (1, "dirty room but good food"), (1, "bad bed, bad food, food"), (2, "clean room, staff"), (3, "nothing")]


def reviews(spark):
    return spark.createDataFrame([(d, i, float(i % 5 + 1), t) for i, (d, t) in enumerate(TEXTS)], "data_id long, review_id long, rating double, review_text string") \
        .withColumn("ts", F.lit(None).cast("timestamp_ntz"))


def counts(spark, path):
    asp.mention_counts(asp.mentions(reviews(spark), LEX, POL)).write.parquet(path)
    return spark.read.parquet(path)


def test_lists_equal_the_operators(spark, tmp_path):
    m = counts(spark, str(tmp_path / "counts"))
    rows = {r["data_id"]: r for r in place_lists(m).collect()}
    assert sorted(rows) == [1, 2]
    phrases = {(r["data_id"], r["aspect"], r["polarity"]): r["phrases"] for r in asp.top_phrases(m).collect()}
    said = {(d, a, p): r[f"{a}__{p}"] for d, r in rows.items() for a, _ in asp.ASPECTS for p in ("praise", "criticism", "neutral") if r[f"{a}__{p}"]}
    assert said == phrases
    hints = [(r["data_id"], r["aspect"], r["suggestion"]) for r in asp.aspect_suggestions(m).orderBy("data_id", "aspect", "rank").collect()]
    assert [(d, a, x) for d in sorted(rows) for a in sorted(a for a, _ in asp.ASPECTS) for x in rows[d][f"{a}__suggest"]] == hints
    first = [(r["data_id"], r["category"], r["issue"], r["suggestion"], r["potential_impact"]) for r in asp.improvement_priorities(m).orderBy("data_id", "priority").collect()]
    assert [(d, *x) for d in sorted(rows) for x in rows[d]["priorities"]] == first
    summed = {r["data_id"]: r for r in asp.feedback_counts(m).collect()}
    for d, r in rows.items():
        assert {c: r[c] for c in summed[d].asDict()} == summed[d].asDict()


def test_counts_are_read_once(spark, tmp_path):
    path = str(tmp_path / "counts")
    r = reviews(spark)
    places = spark.createDataFrame([(1, "A"), (2, "B")], "data_id long, title string")
    out = assemble_counts(counts(spark, path), sen.overall_sentiment(r), places, r)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert sum("short_term" in line and "Relation" in line for line in plan.splitlines()) == 1
    assert {x["data_id"]: x["hotel_analysis"]["accommodation"]["common_criticisms"] for x in out.collect()} == {1: ["bad bed", "bad room", "dirty bed", "dirty room"], 2: [], 3: []}
